"""Decoding of odd messages; streams against their batch twins."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from navspark.operators import changes, overview
from navspark.operators.replay import replay
from navspark.plans import streams
from navspark.plans.request import ViewRequest
from navspark.schemas import TOPICS
from navspark.session import shared_folder
from navspark.sources import decode, publish, topics
from navspark.streaming import revalue, tables, ticks
from tests.conftest import rows_of
from tests.feeds import at, feeds, holding, instrument, order, price

KEPT = ["recordType", "instrumentId", "accountId", "orderId", "holdingId", "position",
        "orderQuantity", "filledQuantity", "sector", "subSectors", "price", "marketValueUSD",
        "filledMarketValueUSD", "tickTime", "tickSequence"]


def messages(spark, dataset, values):
    rows = [(i, v.encode() if isinstance(v, str) else v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "offset BIGINT, value BINARY").select(
        F.lit(b"").alias("key"), "value", F.lit(TOPICS[dataset]).alias("topic"),
        F.lit(0).alias("partition"), "offset", F.lit(0).cast("timestamp").alias("timestamp"),
    )


def test_decoding_of_bytes(spark):
    df = spark.createDataFrame([(b"\xe9",), (b"{\xe9}",), (b' {"a":1} ',), (None,)], "v BINARY")
    assert [r[0] for r in df.select(decode.decode_text(F.col("v"))).collect()] == [
        "é", "{�}", ' {"a":1} ', None,
    ]


def test_price_messages(spark):
    log = messages(spark, "price", [
        '{"instrumentId":"A","price":1.5,"date":"2024-01-15T10:30:00","buyOrder":true}',
        '{"instrumentId":"A","price":"2.25","date":[2024,1,15,10,30]}',
        '{"instrumentId":"A","price":3,"date":[2024,1,15,10,30,5,7000000]}',
        "", "   ", "nonsense", '{"price":1}', '{"instrumentId":"A"}', "{}", None, "[1]",
        b'{"instrumentId":"A","price":1,"source":"\xe9"}',
    ])
    parsed = decode.parse(log, "price")
    good = {r.sequence: r for r in decode.accepted(parsed).collect()}
    assert sorted(good) == [0, 1, 2, 11]
    assert str(good[0].date) == str(good[1].date) == "2024-01-15 10:30:00"
    assert str(good[2].date) == "2024-01-15 10:30:05.007000"
    reasons = {r.sequence: r.reason for r in decode.quarantine(parsed, "price").collect()}
    assert reasons == {
        3: "blank", 4: "blank", 5: "malformed", 6: "missing:instrumentId", 7: "missing:price",
        8: "missing:instrumentId", 9: "blank", 10: reasons[10],
    }


def test_order_defaults_and_old_names(spark):
    log = messages(spark, "order", ['{"orderId":"O","instrumentId":"A","orderQuantity":5}'])
    row = decode.read_dataset(log, "order").first()
    assert (row.filledQuantity, row.orderStatus) == (0, "CREATED")
    old = messages(spark, "unified", [
        '{"recordType":"HOLDING","instrumentId":"INST001","accountId":"ACC001","quantity":100.0,'
        '"kafkaKey":"k","price":150.25,"marketValueUSD":15025.00,"date":[2024,1,15]}'
    ])
    row = decode.read_dataset(old, "unified").first()
    assert (row.position, row.marketValueUSD, str(row.date)) == (None, 15025, "2024-01-15")


def test_published_key_and_text(spark):
    orders = feeds(spark, orders=[order(0, 5)])[1]
    row = publish.to_topic(orders, "order").first()
    assert row.key == b"O1" and row.topic == "base.order-events"
    assert b'"orderQuantity":5.0000' in row.value and b"filledQuantity" not in row.value


def sample(spark):
    return feeds(
        spark,
        [holding(0, 10), holding(0, 4, "ACC002"), holding(20, 12), holding(31, 13, day=16)],
        [order(1, 5), order(22, 5, 2, "PARTIALLY_FILLED"), order(35, 9, 0, order_id="O2")],
        [instrument(2), instrument(25, sector="Tech2")],
        [price(1, 9), price(10, 10), price(20, 11), price(30, 12), price(40, 13)],
    )


def to_log(logs):
    names = ("holding", "order", "instrument", "price")
    parts = [publish.as_log(df, name) for df, name in zip(logs, names, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


MANY_CUTS = tuple(f"2024-01-15 12:{minute:02d}:00" for minute in (2, 11, 15, 21, 24, 31))


def streamed(spark, log, cuts, **options):
    """Valued rows of a log that a stream reads slice by slice."""
    folder = shared_folder(spark)
    stream = revalue.Revaluation(folder, buckets=4, **options)
    streams.run_in_slices(
        log, folder, lambda: stream.start(topics.file_topics(spark, f"{folder}/log")), cuts
    )
    return stream.valued(spark)


@pytest.mark.parametrize("cuts", [(), MANY_CUTS])
def test_stream_equals_replay_through_restarts(spark, cuts):
    logs = sample(spark)
    found = streamed(spark, to_log(logs), cuts, fold_every=2).select(*KEPT)
    expected = replay(*logs).withColumn(
        "filledQuantity",
        F.when(F.col("recordType") == "ORDER", F.coalesce("filledQuantity", F.lit(0))),
    )
    assert rows_of(found) == rows_of(expected.select(*KEPT))
    assert found.count() == 13


def test_a_position_without_quantity_ends_the_one_before(spark):
    logs = feeds(
        spark, [holding(0, 10), holding(20, None)], [], [instrument(0)],
        [price(10, 10), price(30, 11)],
    )
    expected = rows_of(replay(*logs).select(*KEPT))
    assert [r[KEPT.index("tickSequence")] for r in expected] == [10]
    for cuts in ((), ("2024-01-15 12:15:00",), ("2024-01-15 12:25:00",)):
        found = streamed(spark, to_log(logs), cuts)
        assert rows_of(found.filter("recordType = 'HOLDING'").select(*KEPT)) == expected


def test_late_rows_do_not_depend_on_the_cuts(spark):
    """Two messages that arrive after others with a later time in their text."""
    logs = feeds(
        spark, [holding(0, 10), holding(2, 4, "ACC002")], [], [instrument(0)],
        [price(5, 9), price(10, 10), price(7, 8)],
    )
    minute = F.minute(F.col("timestamp"))
    late = F.when(minute == 2, 11).when(minute == 7, 12).otherwise(minute)
    log = to_log(logs).withColumn(
        "timestamp", F.lit("2024-01-15 12:00:00").cast("timestamp") + F.make_interval(mins=late)
    )
    kept = ["accountId", "price", "tickSequence", "marketValueUSD"]
    whole = rows_of(streamed(spark, log, ()).select(*kept))
    assert [r[0] for r in whole].count("ACC002") == 1
    for cuts in (("2024-01-15 12:11:00",), MANY_CUTS):
        assert rows_of(streamed(spark, log, cuts).select(*kept)) == whole


def test_expired_state_is_not_valued(spark):
    """An instrument lives for thirty days, a holding for seven."""
    logs = feeds(
        spark, [holding(0, 10)], [], [instrument(0)], [price(1, 9), price(60 * 24 * 8, 10)]
    )
    cut = ("2024-01-16 00:00:00",)
    assert streamed(spark, to_log(logs), cut).count() == 2
    assert streamed(spark, to_log(logs), cut, expire=True).count() == 1


def batches_of(folder):
    """By bucket the batches that left files."""
    found = {}
    for path in folder.glob("bucket=*/batch=*"):
        found.setdefault(int(path.parent.name[7:]), set()).add(int(path.name[6:]))
    found.pop(-1)
    return found


def test_old_files_go(spark, tmp_path):
    table = tables.LatestTable(f"{tmp_path}/t", ["k"], ["n"], fold_every=2)
    for number in range(9):
        table.upsert(spark.createDataFrame([("a", number)], "k STRING, n INT"), number)
    assert list(batches_of(tmp_path / "t").values()) == [{6, 7, 8}]
    assert rows_of(table.current(spark)) == [("a", 8)]


def test_a_batch_reads_and_folds_only_its_buckets(spark, tmp_path):
    """One of 2,000 instruments ticks."""
    table = tables.LatestTable(
        f"{tmp_path}/t", ["k", "account"], ["n"], fold_every=2, place=["k"], buckets=50
    )
    many = spark.range(6000).selectExpr(
        "concat('I', id % 2000) AS k", "id AS account", "0 AS n", "id AS v"
    )
    table.upsert(many, 0)
    whole = batches_of(tmp_path / "t")
    assert len(whole) == 50
    one = spark.sql("SELECT 'I7' AS k, CAST(7 AS BIGINT) AS account, 1 AS n, CAST(-1 AS BIGINT) AS v")
    [mine] = table.buckets_of(one)
    before = table.before(one, 1, [mine])
    assert {f"bucket={mine}"} == {p.split("/")[-3] for p in before.inputFiles()} - {"bucket=-1"}
    assert rows_of(before.filter("k = 'I7'").select("account")) == [(2007,), (4007,), (7,)]
    for number in (1, 2, 3, 4):
        table.upsert(one.withColumn("n", F.lit(number)), number)
    after = batches_of(tmp_path / "t")
    assert after.pop(mine) == {2, 3, 4}
    assert after == {bucket: {0} for bucket in whole if bucket != mine}
    folded = spark.read.parquet(f"{tmp_path}/t/bucket={mine}/batch=4")
    held = rows_of(many.withColumn("b", table.bucket()).filter(F.col("b") == mine).select("k", "account"))
    assert rows_of(folded.select("k", "account")) == held
    assert table.current(spark).count() == 6000
    assert rows_of(table.current(spark).filter("v < 0").select("k", "n")) == [("I7", 4)]


def test_expired_rows_leave_the_table(spark, tmp_path):
    """Over many batches the table holds what lives, in its files too."""
    table = tables.LatestTable(
        f"{tmp_path}/t", ["k"], ["at"], fold_every=2, buckets=4, lives=("at", 3)
    )
    for number in range(12):
        rows = spark.sql(f"SELECT 'k{number}' AS k, {number} AS n, TIMESTAMP_NTZ '2024-01-01 {number:02d}:00:00' AS at")
        as_of = F.lit(f"2024-01-01 {number:02d}:00:00").cast("timestamp_ntz")
        table.upsert(rows, number, as_of)
    live = {"k9", "k10", "k11"}
    assert {r.k for r in table.current(spark, as_of=as_of).collect()} == live
    stored = spark.read.parquet(f"{tmp_path}/t").filter("batch >= 10").select("k").distinct()
    assert {r.k for r in stored.collect()} <= live | {"k8"}
    assert spark.read.parquet(f"{tmp_path}/t").count() < 12


def test_a_key_that_changes_its_place(spark):
    """Rows of an order that moves between instruments; each batch may be run twice."""
    table = tables.PlacedTable(shared_folder(spark), "k", "p", ["n"], fold_every=2, buckets=8)

    def batch(*rows):
        return spark.createDataFrame(list(rows), "k STRING, p STRING, n INT")

    steps = [batch(("a", "A", 1), ("b", "B", 1)), batch(("a", "B", 2)), batch(("c", "A", 3)),
             batch(("a", "C", 4), ("a", "A", 5)), batch(("b", "C", 6))]
    want = [{("a", "A", 1), ("b", "B", 1)}, {("a", "B", 2), ("b", "B", 1)},
            {("a", "B", 2), ("b", "B", 1), ("c", "A", 3)},
            {("a", "A", 5), ("b", "B", 1), ("c", "A", 3)},
            {("a", "A", 5), ("b", "C", 6), ("c", "A", 3)}]
    for number, rows in enumerate(steps):
        table.upsert(rows, number)
        table.upsert(rows, number)
        assert {tuple(r) for r in table.current(spark).collect()} == want[number]
        by_place = table.before(rows, number + 1, table.buckets_of(batch(("x", "A", 0))))
        assert {tuple(r) for r in by_place.filter("p = 'A'").collect()} == {r for r in want[number] if r[1] == "A"}


def test_an_order_that_moves_to_another_instrument(spark):
    """The stream values it where the replay does, wherever micro-batches are cut."""
    logs = feeds(
        spark, [], [order(1, 5), order(22, 6, instrument="MSFT"), order(35, 7)],
        [instrument(0), instrument(0, "MSFT")],
        [price(m, 10 + m, name) for m in (10, 20, 30, 40) for name in ("AAPL", "MSFT")],
    )
    kept = ["instrumentId", "orderQuantity", "price", "tickTime"]
    expected = rows_of(replay(*logs).select(*kept))
    assert len(expected) == 4
    cuts = ("2024-01-15 12:25:00", "2024-01-15 12:38:00")
    assert rows_of(streamed(spark, to_log(logs), cuts, fold_every=2).select(*kept)) == expected


def test_table_survives_a_repeated_batch(spark):
    table = tables.LatestTable(shared_folder(spark), ["k"], ["n"], fold_every=2)

    def batch(*rows):
        return spark.createDataFrame(list(rows), "k STRING, n INT, v STRING")

    steps = [batch(("a", 1, "x"), ("a", 2, "y")), batch(("b", 3, "x")), batch(("a", 4, "z")),
             batch(("c", 5, "x")), batch(("b", 6, "w"))]
    for number, rows in enumerate(steps):
        table.upsert(rows, number)
        table.upsert(rows, number)
    assert rows_of(table.current(spark)) == [("a", 4, "z"), ("b", 6, "w"), ("c", 5, "x")]


def test_live_view_and_deliveries(spark):
    folder = shared_folder(spark)
    table = tables.PlacedTable(
        f"{folder}/t", "unifiedKey", "instrumentId", ["tickTime", "tickSequence"]
    )
    view = tables.LiveView(table, f"{folder}/v", ViewRequest(None, ("accountName",)))
    log = replay(*sample(spark)).withColumn("unifiedKey", streams.K.unified_key())
    first = view.advance(log.filter("tickSequence <= 10"), 0)
    assert {r.changeType for r in first.collect()} == {"INSERT"}
    second = view.advance(log.filter("tickSequence > 10"), 1)
    columns = ["rowKey", "changeType", "old_sodNavUSD", "new_sodNavUSD"]
    seen = rows_of(second.select(*columns))
    assert {row[1] for row in seen} == {"UPDATE"}
    second = view.advance(log.filter("tickSequence > 10"), 1)
    assert rows_of(second.select(*columns)) == seen
    sent = tables.deliveries(second, "view", largest=1).collect()
    assert sum(r.changes for r in sent) == 2 and {r.viewId for r in sent} == {"view"}
    folded = changes.fold(changes.as_log(first, 0).unionByName(changes.as_log(second, 1)))
    whole = view.rows(spark).select(*folded.columns)
    assert rows_of(folded) == rows_of(whole)


def test_streamed_aggregate_equals_batch(spark):
    folder, log = shared_folder(spark), replay(*sample(spark))
    request = ViewRequest(None, ("accountName", "orderStatus"))
    names = ["rowKey", "sodNavUSD", "currentNavUSD", "expectedNavUSD", "recordCount"]
    table = tables.LatestTable(f"{folder}/view", ["rowKey"], ["recordCount"])

    def start():
        rows = overview.cumulative_overview(
            spark.readStream.schema(log.schema).parquet(f"{folder}/log"), request
        )
        return tables.listen(rows.select(*names), table.upsert, f"{folder}/checkpoint")

    for low, high in ((0, 15), (15, 100)):
        part = log.filter((F.col("tickSequence") > low) & (F.col("tickSequence") <= high))
        part.write.mode("append").parquet(f"{folder}/log")
        start().awaitTermination()
    assert rows_of(table.current(spark)) == rows_of(
        overview.cumulative_overview(log, request).select(*names)
    )


def test_ticks_by_day(spark, tmp_path):
    """Late ticks go to their day, a repeated batch changes nothing, a day opens one folder."""
    table = ticks.TickTable(f"{tmp_path}/t")
    day = 24 * 60
    series = [price(0, 1), price(5, 2), price(day, 3), price(day + 1, 4), price(2 * day, 5), price(9, 6)]
    batches = [feeds(spark, prices=part)[3] for part in (series[:3], series[3:])]
    for number, batch in enumerate(batches):
        table.append(batch, number)
        table.append(batch, number)
    assert table.ticks(spark).count() == 6
    first = at(0).date()
    one = table.ticks(spark, [first])
    assert {p.split("day=")[1][:10] for p in one.inputFiles()} == {"2024-01-15", ticks.NO_DAY}
    assert sorted(float(r.price) for r in one.collect()) == [1, 2, 6]
    assert [(float(r.closePrice), r.ticks) for r in table.closes(spark, [first]).collect()] == [(6, 3)]


def test_prices_from_the_tail(spark):
    """Old ticks value nothing, positions and instruments from before count."""
    logs = sample(spark)
    log = topics.from_tail(to_log(logs), ("price",), "2024-01-15 12:25:00")
    found = streamed(spark, log, ("2024-01-15 12:15:00",)).select(*KEPT)
    whole = replay(*logs).withColumn(
        "filledQuantity",
        F.when(F.col("recordType") == "ORDER", F.coalesce("filledQuantity", F.lit(0))),
    )
    late = whole.filter("tickTime >= TIMESTAMP_NTZ '2024-01-15 12:25:00'")
    assert rows_of(found) == rows_of(late.select(*KEPT)) and found.count() > 0


def shuffle_files(spark):
    """Names of the shuffle files that lie on disk."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = blocks.getAllFiles()
    names = {files.apply(i).getName() for i in range(files.size())}
    return {name for name in names if name.startswith("shuffle_")}


def test_a_stream_leaves_tables_and_results_only(spark):
    """One slice of the log at a time; it, parsed messages and shuffle files are gone at the end."""
    folder, slices = shared_folder(spark), []
    stream = revalue.Revaluation(folder, buckets=4, fold_every=2)
    path = Path(folder.removeprefix("file:"))

    def start():
        log = spark.read.parquet(f"{folder}/log")
        slices.append(sorted(row.timestamp for row in log.select("timestamp").collect()))
        assert not (path / "whole").exists()
        return stream.start(topics.file_topics(spark, f"{folder}/log"))

    log = to_log(sample(spark))
    before = shuffle_files(spark)
    streams.run_in_slices(log, folder, start, ("2024-01-15 12:15:00", "2024-01-15 12:24:00"))
    assert len(slices) == 3 and sum(map(len, slices)) == 14
    assert all(one[-1] < two[0] for one, two in zip(slices, slices[1:], strict=False))
    assert {p.name for p in path.iterdir()} == {"checkpoint", "news", "state", "valued"}
    assert not list((path / "news").iterdir())
    assert shuffle_files(spark) <= before
    assert stream.valued(spark).count() == 13
