"""View requests and the catalogue of grouping fields."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from navspark.functions.predicates import is_order


class Exposure(str, Enum):
    SOD = "SOD"
    CURRENT = "CURRENT"
    EXPECTED = "EXPECTED"

    @property
    def column(self) -> str:
        return {"SOD": "sodNavUSD", "CURRENT": "currentNavUSD", "EXPECTED": "expectedNavUSD"}[
            self.value
        ]


ALL_EXPOSURES = (Exposure.SOD, Exposure.CURRENT, Exposure.EXPECTED)


def _plain(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


def _of_orders(name: str) -> Callable[[], Column]:
    return lambda: F.when(is_order(), F.col(name))


GROUP_FIELDS: dict[str, Callable[[], Column]] = {
    "accountName": _plain("accountName"),
    "instrumentName": _plain("instrumentName"),
    "instrumentType": _plain("instrumentType"),
    "currency": _plain("currency"),
    "countryOfRisk": _plain("countryOfRisk"),
    "countryOfDomicile": _plain("countryOfDomicile"),
    "sector": _plain("sector"),
    "orderStatus": _of_orders("orderStatus"),
    "orderType": _of_orders("orderType"),
    "venue": _of_orders("venue"),
}
EVERY_FIELD = {**GROUP_FIELDS, "accountId": _plain("accountId")}


def canonical_field(name: str) -> str:
    """Catalogue spelling of a field named in any case; unknown names stay as they are."""
    for field in EVERY_FIELD:
        if field.lower() == name.lower():
            return field
    return name


def field_column(name: str) -> Column:
    """Value of a grouping field; a field outside the catalogue groups as ``unknown``."""
    build = EVERY_FIELD.get(canonical_field(name))
    return build() if build else F.lit("unknown")


@dataclass(frozen=True)
class ViewRequest:
    """What a view shows: accounts, ordered grouping fields, exposures.

    ``accounts=None`` stands for every account and is for whole-table reports.
    """

    accounts: tuple[str, ...] | None
    group_by: tuple[str, ...] = ("accountName",)
    exposures: tuple[Exposure, ...] = ALL_EXPOSURES
    user_id: str = ""
    view_name: str = ""
    view_id: str = "view"

    def validate(self) -> ViewRequest:
        if self.accounts is not None and not self.accounts:
            raise ValueError("a view needs at least one account")
        if not self.group_by:
            raise ValueError("a view needs at least one grouping field")
        if not self.exposures:
            raise ValueError("a view needs at least one exposure")
        return self

    @property
    def fields(self) -> tuple[str, ...]:
        """Grouping fields in order, each once, in catalogue spelling."""
        return tuple(dict.fromkeys(canonical_field(name) for name in self.group_by))

    @property
    def with_account_first(self) -> ViewRequest:
        """The same request as a user interface sends it: account name leads the grouping."""
        rest = tuple(name for name in self.fields if name != "accountName")
        return ViewRequest(
            self.accounts, ("accountName", *rest), self.exposures, self.user_id,
            self.view_name, self.view_id,
        )

    @property
    def configuration_key(self) -> str:
        """Text that is equal for equal requests."""
        chosen = "*" if self.accounts is None else ",".join(sorted(self.accounts))
        exposures = ", ".join(e.value for e in ALL_EXPOSURES if e in self.exposures)
        return f"accounts:{chosen}|groupBy:{','.join(self.fields)}|exposures:[{exposures}]"
