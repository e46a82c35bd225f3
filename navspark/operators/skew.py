"""Joins and neighbour lookups that hold when one key owns a large part of the rows.

Rows are counted by key as part of the plan, and a key with more rows than one task should hold
gets as many shares as its count asks for. The counts stay a table that is joined by key without
a hint: however many keys are heavy, all of them are spread, nothing is collected and calling
these functions runs no job. Every row and every match is kept, and the result does not depend on
the shares.

A join with a side that has one row per key needs none of this: there Spark broadcasts the
side if its measured size allows, and otherwise splits the heavy partitions itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

ROWS_PER_TASK = 1_000_000


def heavy_keys(
    df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Keys with more rows than one task should hold, and the shares they need."""
    shares = F.ceil(F.count("*") / F.lit(rows_per_task)).cast("int").alias("shares")
    return df.groupBy(*keys).agg(shares).filter("shares > 1")


LOAD = "_load"

#: Counts of a level are kept by so many buckets of a hash, whatever the number of its keys.
BUCKETS = 1 << 16
#: Bits of a filter, 8 MB: beyond some ten million keys it lets more rows through, which costs time
#: and disk only.
FILTER_BITS = 1 << 26


def _load_mark(level: int, keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), *keys), F.lit(BUCKETS)) + F.lit(level * BUCKETS)


def loads(
    df: DataFrame,
    *levels: Sequence[str],
    flagged: Column | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows by key for several keys at once, from one pass over the rows.

    A key is shown by the level's number and a bucket of its hash: each task sends a row per bucket
    and not one per key, and nothing that a reader of one level knows can be pushed below the sums,
    so all readers share one exchange. Two keys of one bucket count together, which at worst spreads
    a key without need.

    With ``flagged`` the same pass also notes the ``by`` keys of the flagged rows; ``noted`` reads them.
    """
    none = F.lit(None).cast("bigint")
    marks = [F.struct(_load_mark(i, level).alias(LOAD), none.alias("bit")) for i, level in enumerate(levels)]
    if flagged is not None:
        word, bit = _bit(by, FILTER_BITS)
        word = F.when(flagged, word + F.lit(len(levels) * BUCKETS))
        marks.append(F.struct(word.alias(LOAD), bit.alias("bit")))
    marked = df.select(F.explode(F.array(*marks)).alias("_mark")).select(f"_mark.{LOAD}", "_mark.bit")
    sums = marked.filter(F.col(LOAD).isNotNull()).groupBy(LOAD)
    return sums.agg(F.count("*").alias("rows"), F.bit_or("bit").alias("bits"))


def heavy_of(load: DataFrame, level: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """As ``heavy_keys``, of a level of rows already counted."""
    shares = F.ceil(F.col("rows") / F.lit(rows_per_task)).cast("int").alias("shares")
    counted = load.filter(F.col("bits").isNull())
    return counted.select(F.col(LOAD).alias(f"{LOAD}{level}"), shares).filter("shares > 1")


WORD = "_word"
#: Words of a filter lie in chunks of 1024.
CHUNK = 10


def _bit(keys: Sequence[str], bits: int) -> tuple[Column, Column]:
    """Where a filter notes a key: the number of a word, and a bit of it."""
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    here = place.bitwiseAND(F.lit(63)).cast("int")
    return F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), here)


def _whole(words: DataFrame, bits: int) -> DataFrame:
    """Words by number as one row: chunks of words, those without any bit included."""
    none = words.sparkSession.range(bits // 64).select(
        F.col("id").alias(WORD), F.lit(0).cast("bigint").alias("bits")
    )
    every = words.select(WORD, "bits").unionAll(none).groupBy(WORD).agg(F.bit_or("bits").alias("bits"))
    chunk = F.shiftright(WORD, CHUNK).alias("_chunk")
    listed = F.sort_array(F.collect_list(F.struct(WORD, "bits")))
    chunks = every.groupBy(chunk).agg(F.transform(listed, lambda word: word.bits).alias("bits"))
    listed = F.sort_array(F.collect_list(F.struct("_chunk", "bits")))
    return chunks.agg(F.transform(listed, lambda one: one.bits).alias("bits"))


def seen(df: DataFrame, keys: Sequence[str], bits: int = 1 << 23) -> DataFrame:
    """A filter of the keys that a table has: one row of ``bits`` bits, however large the table."""
    word, bit = _bit(keys, bits)
    return _whole(df.groupBy(word.alias(WORD)).agg(F.bit_or(bit).alias("bits")), bits)


def noted(load: DataFrame, levels: int) -> DataFrame:
    """The filter of the keys that ``loads`` noted."""
    words = load.filter(F.col("bits").isNotNull() & (F.col("rows") > 0))
    return _whole(words.select((F.col(LOAD) - F.lit(levels * BUCKETS)).alias(WORD), "bits"), FILTER_BITS)


def possible(keys: Sequence[str], filter_: DataFrame, bits: int = 1 << 23) -> Column:
    """Whether a filter may have seen a key: true of all that it has, and of few others.

    Made of the row's own columns and a subquery, so it goes down to where the rows are read.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    word = F.get(
        F.get(filter_.scalar(), F.shiftright(place, 6 + CHUNK).cast("int")),
        F.shiftright(place, 6).bitwiseAND(F.lit((1 << CHUNK) - 1)).cast("int"),
    )
    return F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1


def _marked(df: DataFrame, keys: Sequence[str], heavy: DataFrame) -> tuple[DataFrame, list[str], bool]:
    """The rows with what heavy keys are found by, its columns, and whether those were added."""
    mark = next((name for name in heavy.columns if name.startswith(LOAD)), None)
    if mark is None:
        return df, list(keys), False
    return df.withColumn(mark, _load_mark(int(mark.removeprefix(LOAD)), keys)), [mark], True


def with_splits(df: DataFrame, keys: Sequence[str], heavy: DataFrame, name: str) -> DataFrame:
    """Add the number of tasks a row's key is spread over; 1 for all but heavy keys."""
    df, on, added = _marked(df, keys, heavy)
    lookup = heavy.withColumnRenamed("shares", name)
    if added:
        lookup = F.broadcast(lookup)  # at most ``BUCKETS`` rows
    found = df.join(lookup, on, "left").withColumn(name, F.coalesce(name, F.lit(1)))
    return found.drop(*on) if added else found


def of_heavy(df: DataFrame, keys: Sequence[str], heavy: DataFrame) -> DataFrame:
    """The rows of heavy keys."""
    df, on, added = _marked(df, keys, heavy)
    found = df.join(heavy.drop("shares"), on, "left_semi")
    return found.drop(*on) if added else found


def _share(columns: Sequence[str], splits: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.col(splits)).cast("int")


def _copies(splits: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(splits) - 1))


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_spread: Sequence[str],
    right_spread: Sequence[str],
    condition: Column | None = None,
    left_rows: int = ROWS_PER_TASK,
    right_rows: int = ROWS_PER_TASK,
    heavy_left: DataFrame | None = None,
    heavy_right: DataFrame | None = None,
) -> DataFrame:
    """Inner join on ``on`` (plus ``condition`` on ``l.`` and ``r.``) of two many-row sides.

    A heavy key with L shares on the left and R on the right becomes a grid of L x R join
    keys. Each left row goes to its share and is copied along R, each right row the other way,
    so every pair meets exactly once. The heavy keys can be given, for instance from the tables
    the sides were built from.
    """
    if heavy_left is None:
        heavy_left = heavy_keys(left, on, left_rows)
    if heavy_right is None:
        heavy_right = heavy_keys(right, on, right_rows)
    cells = ["_lx", "_rx"]
    kept_left, kept_right = left.columns, right.columns
    left = with_splits(with_splits(left, on, heavy_left, "_l"), on, heavy_right, "_r")
    left = left.select(*kept_left, _share(left_spread, "_l").alias("_lx"), _copies("_r").alias("_rx"))
    right = with_splits(with_splits(right, on, heavy_left, "_l"), on, heavy_right, "_r")
    right = right.select(
        *kept_right, _share(right_spread, "_r").alias("_rx"), _copies("_l").alias("_lx")
    )
    keys = [*on, *cells]
    left, right = left.alias("l"), right.alias("r")
    equal = [F.col(f"l.{key}") == F.col(f"r.{key}") for key in keys]
    matches = left.join(right, equal if condition is None else [*equal, condition])
    kept = [F.col(f"l.{name}") for name in left.columns if name not in cells]
    kept += [F.col(f"r.{name}") for name in right.columns if name not in keys]
    return matches.select(*kept)


def _time_chunk(time: str, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(F.col(time).cast("timestamp")) / seconds).cast("bigint")


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    name: str,
    forward: bool,
    chunk_seconds: int = 3600,
    rows_per_task: int = ROWS_PER_TASK,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Add ``name``: a struct of ``columns`` from the next (or previous) row of the key.

    The first order column is a time. The history of a heavy key is cut into time chunks, and a
    chunk with many rows into parts by time, or by the second order column if all its rows have
    one time. Parts are sorted apart; the row at the edge of one takes its neighbour from the
    nearest part that has rows, found on a table of one row per part of the heavy keys.

    There is at most one heavy key for every ``rows_per_task`` rows, which bounds the table that
    is broadcast. Where it is empty Spark drops the branches behind it while it runs, and what
    is left is one window over the input.
    """
    shift = F.lead if forward else F.lag
    value = F.struct(*columns)
    cell = [*keys, "_chunk"]
    heavy_rows = heavy_keys(df, keys, rows_per_task) if heavy is None else heavy
    heavy = F.broadcast(heavy_rows)
    # Without heavy keys no row leaves its scan here.
    some = heavy_rows.agg(F.count("*").alias("n")).scalar() > 0
    few = of_heavy(df.filter(some), keys, heavy).withColumn("_chunk", _time_chunk(order[0], chunk_seconds))
    df = with_splits(df, keys, heavy, "_splits")
    chunk = F.when(F.col("_splits") > 1, _time_chunk(order[0], chunk_seconds))
    df = df.withColumn("_chunk", F.coalesce(chunk, F.lit(0)))

    places = {"time": F.unix_micros(F.col(order[0]).cast("timestamp"))}
    if len(order) > 1 and isinstance(df.schema[order[1]].dataType, NumericType):
        places["tie"] = F.col(order[1]).cast("double")
    sizes = few.groupBy(*cell).agg(
        F.ceil(F.count("*") / F.lit(rows_per_task)).alias("_parts"),
        *[F.min(place).alias(f"_{n}_low") for n, place in places.items()],
        *[F.max(place).alias(f"_{n}_high") for n, place in places.items()],
    )
    sizes = F.broadcast(sizes.filter("_parts > 1"))

    def within(n: str) -> Column:
        width = F.col(f"_{n}_high") - F.col(f"_{n}_low")
        return F.when(width > 0, (places[n] - F.col(f"_{n}_low")) / width)

    at = F.coalesce(*[within(n) for n in places], F.lit(0.0))
    part = F.least(F.floor(at * F.col("_parts")), F.col("_parts") - 1)

    def parted(rows: DataFrame) -> DataFrame:
        return rows.join(sizes, cell, "left").withColumn("_part", F.coalesce(part, F.lit(0)))

    step = Window.partitionBy(*cell, "_part").orderBy(*order)
    inside = parted(df).withColumn(name, shift(value, 1).over(step))
    pick = F.min_by if forward else F.max_by
    edges = (
        parted(few)
        .groupBy(*cell, "_part")
        .agg(pick(value, F.struct(*order)).alias("_edge"))
        .withColumn(
            "_edge",
            shift("_edge", 1).over(Window.partitionBy(*keys).orderBy("_chunk", "_part")),
        )
    )
    helpers = [c for c in inside.columns if c.startswith(("_time_", "_tie_"))]
    return (
        inside.join(edges, [*cell, "_part"], "left")
        .withColumn(name, F.coalesce(F.col(name), F.col("_edge")))
        .drop("_edge", "_chunk", "_part", "_parts", "_splits", *helpers)
    )


def later_sums(
    points: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    time: str,
    columns: Sequence[str],
    chunk_seconds: int = 86_400,
    spread_key: str | None = None,
    heavy: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add to each probe the sums of ``columns`` over the key's points at or after its time.

    Two levels: running sums inside a time chunk, plus the totals of all later chunks. Probes of
    a heavy ``spread_key`` (by default the first key) are spread over tasks, each with a copy of
    the chunk's points, which are first added up per instant. No probe ever meets a point in a
    join. A probe must not lie before the first point of its key.
    """
    cell = [*keys, "_chunk"]
    points = (
        points.withColumn("_chunk", _time_chunk(time, chunk_seconds))
        .groupBy(*cell, time)
        .agg(*[F.sum(name).alias(name) for name in columns])
    )
    # One row per key and chunk from its first to its last point, so that chunks without points
    # are found too.
    per_chunk = points.groupBy(*cell).agg(*[F.sum(name).alias(name) for name in columns])
    chunks = (
        points.groupBy(*keys)
        .agg(F.min("_chunk").alias("_first"), F.max("_chunk").alias("_last"))
        .select(*keys, F.explode(F.sequence("_first", "_last")).alias("_chunk"))
        .join(per_chunk, cell, "left")
    )
    later = Window.partitionBy(*keys).orderBy(F.col("_chunk").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = chunks.select(*cell, *[F.sum(name).over(later).alias(f"_later_{name}")
                                    for name in columns])

    spread_key = spread_key or keys[0]
    if heavy is None:
        heavy = heavy_keys(probes, [spread_key], rows_per_task)
    spread = probes.columns
    probes = probes.withColumn("_chunk", _time_chunk(time, chunk_seconds))
    probes = with_splits(probes, [spread_key], heavy, "_n").withColumn(
        "_share", _share(spread, "_n")
    )
    copies = with_splits(points, [spread_key], heavy, "_n").withColumn("_share", _copies("_n"))
    both = probes.withColumn("_probe", F.lit(True)).unionByName(
        copies.withColumn("_probe", F.lit(False)), allowMissingColumns=True
    )
    here = Window.partitionBy(*cell, "_share").orderBy(F.col(time).desc()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    for name in columns:
        both = both.withColumn(f"_here_{name}", F.sum(name).over(here))
    found = both.filter("_probe").drop("_probe", "_share", "_n", *columns).join(
        totals, cell, "left"
    )
    for name in columns:
        total = F.coalesce(F.col(f"_here_{name}"), F.lit(0)) + F.coalesce(
            F.col(f"_later_{name}"), F.lit(0)
        )
        found = found.withColumn(name, total).drop(f"_here_{name}", f"_later_{name}")
    return found.drop("_chunk")


def as_of(
    probes: DataFrame,
    versions: DataFrame,
    keys: Sequence[str],
    at: str,
    since: str,
    columns: Sequence[str],
    chunk_seconds: int = 86_400,
    inclusive: bool = True,
    spread: DataFrame | None = None,
) -> DataFrame:
    """Each probe with ``columns`` of the key's last version at or before its time.

    Without ``inclusive`` a version at the probe's own time comes too late. A probe without a
    time asks for the key's last version. Probes without a version are dropped; a key has one
    version per instant.

    Work is linear in both sides and no pair of a probe and a version is ever built. A probe
    after the last version's chunk, or without a time, takes the key's last version from a table
    of one row per key, whatever their number. The others are ordered together with the versions
    of their time chunk, and a chunk starts with what the chunks before it ended with. With
    ``spread`` (keys with ``shares``) the probes of a chunk are dealt over shares that each get a
    copy of its versions.
    """
    value = F.struct(*columns)
    cell = [*keys, "_chunk"]
    marked = versions.select(*keys, F.col(since).alias("_at"), value.alias("_value")).withColumn(
        "_chunk", _time_chunk("_at", chunk_seconds)
    )
    ends = marked.groupBy(*cell).agg(F.max_by("_value", "_at").alias("_end"))
    last = marked.groupBy(*keys).agg(
        F.max("_chunk").alias("_until"), F.max_by("_value", "_at").alias("_last")
    )
    # What each chunk starts with, also those without versions, up to the key's last one.
    earlier = Window.partitionBy(*keys).orderBy("_chunk")
    starts = (
        ends.withColumn("_next", F.lead("_chunk").over(earlier))
        .filter(F.col("_next").isNotNull())
        .select(*keys, F.explode(F.sequence(F.col("_chunk") + 1, F.col("_next"))).alias("_chunk"),
                F.col("_end").alias("_start"))
    )
    asked = (
        probes.withColumn("_at", F.col(at))
        .join(last, list(keys))
        .withColumn("_chunk", _time_chunk("_at", chunk_seconds))
        .withColumn("_settled", F.col("_chunk").isNull() | (F.col("_chunk") > F.col("_until")))
        # Settled probes need no order; they lie anywhere.
        .withColumn("_chunk", F.when(~F.col("_settled"), F.col("_chunk")))
        .withColumn("_value", F.when(F.col("_settled"), F.col("_last")))
        .drop("_until", "_last")
    )
    any_share = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in probes.columns]), F.lit(4096)).cast("int")
    if spread is None:
        share = F.lit(0)
        marked = marked.withColumn("_share", share)
    else:
        asked = with_splits(asked, keys, spread, "_n")
        marked = with_splits(marked, keys, spread, "_n").withColumn("_share", _copies("_n")).drop("_n")
        share = F.pmod(any_share, F.col("_n"))
    asked = asked.withColumn("_share", F.when(F.col("_settled"), any_share).otherwise(share)).drop("_n")
    both = asked.withColumn("_probe", F.lit(1)).unionByName(
        marked.withColumn("_probe", F.lit(0)), allowMissingColumns=True
    )
    first = F.col("_probe") if inclusive else -F.col("_probe")
    here = Window.partitionBy(*cell, "_share").orderBy(F.col("_at"), first).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    found = both.withColumn("_here", F.last(F.when(F.col("_probe") == 0, F.col("_value")), ignorenulls=True).over(here))
    found = found.filter("_probe = 1").join(starts, cell, "left").withColumn(
        "_value", F.coalesce(F.when(F.col("_settled"), F.col("_value")), F.col("_here"), F.col("_start"))
    ).filter(F.col("_value").isNotNull())
    kept = [c for c in probes.columns if c not in columns]
    return found.select(*kept, *[F.col(f"_value.{c}").alias(c) for c in columns])
