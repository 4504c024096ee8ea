"""Streams over several micro-batches give what the same rows give at once."""

import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ballast import catalog
from ballast.streaming import feed, runner, stateful, upsert, windows

catalog.load()


def as_stream(spark, folder, frame, order, pieces=4):
    """The rows of `frame` as `pieces` files in time order, one per micro-batch."""
    ordered = frame.orderBy(order).toPandas()
    os.makedirs(folder)
    size = -(-len(ordered) // pieces)
    for n in range(pieces):
        part = spark.createDataFrame(ordered.iloc[n * size : (n + 1) * size], frame.schema)
        part.coalesce(1).write.parquet(f"{folder}/tmp{n}")
        name = next(f for f in os.listdir(f"{folder}/tmp{n}") if f.startswith("part"))
        target = f"{folder}/{n}.parquet"
        os.rename(f"{folder}/tmp{n}/{name}", target)
        os.utime(target, (time.time() + n, time.time() + n))
    return (
        spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", "1")
        .option("pathGlobFilter", "?.parquet").parquet(folder)
    )


def collected(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)


def test_refresh_merge(spark, tmp_path):
    data = [
        (1, "push", 1, None, "a", 9, None),  # held: generation 1 is not open yet
        (2, "open", 1, "a\nb", None, None, None),
        (3, "push", 1, None, "b", None, "failed"),
        (4, "push", 1, None, "b", 5, None),
        (5, "push", 1, None, "b", None, "failed again"),  # never replaces a size
        (6, "push", 1, None, "z", 5, None),  # unknown identity
        (7, "open", 2, "a", None, None, None),
        (8, "push", 1, None, "a", 7, None),  # superseded generation
        (9, "push", 2, None, "a", 8, None),
    ]
    events = spark.createDataFrame(
        [("w", "d", *row) for row in data],
        "workspace string, document string, seq long, kind string, generation long, identities string, identity string, brotli_bytes long, error string",
    )
    stream = as_stream(spark, str(tmp_path / "r"), events, "seq", pieces=3)
    live = stateful.refresh_merge(runner.run_append(stream, "t1"))
    got = [(r.generation, r.identity, r.brotli_bytes, r.error) for r in live.orderBy("seq", "identity").collect()]
    assert got == [(1, "a", 9, None), (1, "b", None, "failed"), (1, "b", 5, None), (2, "a", 8, None)]


def test_manual_refresh(spark, tmp_path):
    data = [("p", 0, 1, True), ("p", 9_999, 2, True), ("p", 10_000, 3, False), ("p", 10_001, 4, True), ("p", 15_000, 5, True)]
    requests = spark.createDataFrame(data, "name string, ts_ms long, seq long, succeeds boolean")
    stream = as_stream(spark, str(tmp_path / "m"), requests, "seq", pieces=5)
    live = stateful.manual_refresh_coalesce(runner.run_append(stream, "t5"))
    assert [r.served_from for r in live.orderBy("seq").collect()] == ["registry", "store", "registry", "registry", "store"]


def test_change_bursts(spark, tmp_path):
    data = [("w", t, "/node_modules/p%d/package.json" % n) for n, t in enumerate(range(0, 2100, 100))]  # 21 manifests
    data += [("w", 10_000, "/w/tsconfig.json"), ("w", 10_100, "/w/tsconfig.json"), ("w", 20_000, "/node_modules/x/tsconfig.json")]
    data += [("w", 30_000, "/node_modules/a/package.json"), ("z", 90_000, "/late/package.json")]
    events = spark.createDataFrame(
        [(w, t, n, p) for n, (w, t, p) in enumerate(data)], "workspace string, t long, id long, path string"
    ).select("workspace", F.timestamp_millis("t").alias("ts"), "id", "path")
    once = windows.change_bursts(events, "id", bucket_ms=700)
    columns = ["workspace", "session_start", "manifests", "configs", "decision"]
    expected = [("w", 0, 21, 0, "all"), ("w", 10_000, 0, 1, "changed"), ("w", 30_000, 1, 0, "changed"), ("z", 90_000, 1, 0, "changed")]
    assert collected(once.select(*columns)) == expected
    paths = ["manifest_paths", "config_paths"]
    for n, order in enumerate(["ts", F.desc("ts"), F.hash("id")]):
        stream = as_stream(spark, str(tmp_path / f"b{n}"), events, order)
        live = runner.run_closed(stream, lambda rows: windows.change_bursts_stream(rows, delay="1 hour"), "t2")
        assert collected(live.select(*columns, *paths)) == collected(once.select(*columns, *paths))
    # with a short delay what comes late is dropped, and closed bursts are not touched again
    stream = as_stream(spark, str(tmp_path / "late"), events, F.desc("ts"), pieces=2)
    live = runner.run_closed(stream, lambda rows: windows.change_bursts_stream(rows, delay="1 second"), "t2")
    assert ("z", 90_000, 1, 0, "changed") in collected(live.select(*columns))


def feed_rows(spark, data):
    frame = spark.createDataFrame(data, "identity string, ts_ms long, seq long, brotli_bytes long")
    return frame.withColumn("ts", F.timestamp_millis("ts_ms"))


def test_history_feed_in_any_order_and_its_state(spark, tmp_path):
    data = [("a", 1_000, 1, 5), ("a", 2_000, 2, 5), ("a", 3_000, 3, 7), ("a", 3_000, 4, 7), ("a", 9_000, 5, None), ("b", 500, 6, 1), ("a", 4_000, 7, 5), (None, 10, 8, 3)]
    want = [("a", 1_000, 1, 5), ("a", 3_000, 3, 7), ("a", 4_000, 7, 5), ("a", 9_000, 5, None), ("b", 500, 6, 1), (None, 10, 8, 3)]
    for n, order in enumerate(["ts_ms", F.desc("ts_ms")]):
        stream = as_stream(spark, str(tmp_path / f"f{n}"), feed_rows(spark, data), order, pieces=3)
        live = runner.run_closed(stream, lambda rows: feed.history_feed(rows, "identity", ["brotli_bytes"], "1 hour"), "t8")
        assert collected(live) == collected(spark.createDataFrame(want, "identity string, ts_ms long, seq long, brotli_bytes long"))


def test_feed_state_holds_one_settled_row_an_identity(spark, tmp_path):
    """After a run the state has the last sizes of each identity and only rows the watermark has not reached."""
    data = [(f"i{n % 3}", 1_000 * n, n, n // 10) for n in range(60)]
    stream = as_stream(spark, str(tmp_path / "s"), feed_rows(spark, data), "ts_ms", pieces=4).withColumn(runner.CLOCK, F.lit(False))
    state = str(tmp_path / "state")
    query = (
        feed.history_feed(stream, "identity", ["brotli_bytes"], "5 seconds").writeStream.format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    reader = spark.read.format("statestore").option("path", state)
    assert reader.option("stateVarName", "last").load().count() == 3
    assert reader.option("stateVarName", "waiting").load().count() <= 6


def test_claims_continue_from_the_checkpoint(spark, tmp_path):
    folder = str(tmp_path / "sites")
    shape = "identity string, workspace string, document string, generation long, ts timestamp"
    freshness = spark.createDataFrame([("a", "stale"), ("b", "gone"), ("c", "fresh"), ("d", "unknown")], "identity string, freshness string")
    later = spark.createDataFrame([("a", "fresh"), ("b", "stale")], "identity string, freshness string")

    def arrive(rows):
        frame = spark.createDataFrame(rows, "identity string, workspace string, document string, generation long, t long")
        frame.select("identity", "workspace", "document", "generation", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema(shape).parquet(folder)
        query = (
            windows.claims_stream(stream, freshness, ["identity"], later, "1 hour").writeStream.format("parquet")
            .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("identity", "document", "generation", "attempt").collect())

    arrive([("a", "w", "x", 1, 10), ("a", "w", "x", 1, 11), ("b", "w", "x", 1, 12), ("c", "w", "x", 1, 12), ("d", "w", "x", 1, 12)])
    first = [("a", "x", 1, 1), ("b", "x", 1, 1), ("b", "x", 1, 2)]
    assert run() == first
    arrive([("a", "w", "x", 1, 20), ("a", "w", "x", 2, 21), ("b", "w", "x", 1, 22)])
    assert run() == sorted([*first, ("a", "x", 2, 1)])


def test_partials(spark):
    rows = [
        # manifest, position, name, status, seq, message, final
        ("m", 0, "a", "loading", 1, 1, False), ("m", 0, "b", "ready", 2, 1, False), ("m", 0, "a", "ready", 3, 2, False),
        ("m", 1, "c", "loading", 4, 2, False),
        # the last final message replaces all positions, also those past its end
        ("n", 0, "a", "ready", 1, 1, True), ("n", 1, "b", "ready", 2, 1, True), ("n", 2, "x", "ready", 3, 2, False),
        ("n", 0, "z", "loading", 4, 3, True), ("n", 0, "a", "ready", 5, 4, False),
    ]
    partials = spark.createDataFrame(
        [(m, p, n, "d", *rest) for m, p, n, *rest in rows],
        "manifest_path string, position long, name string, section string, status string, seq long, message long, final boolean",
    )
    assert collected(windows.indexed_partials(partials).select("manifest_path", "position", "name", "status")) == [
        ("m", 0, "a", "ready"), ("m", 1, "c", "unavailable"), ("n", 0, "z", "unavailable"),
    ]


def test_merged_table_survives_replays_and_dead_writers(spark, tmp_path, monkeypatch):
    shape = StructType.fromDDL("k long, v long")
    table = upsert.MergedTable(spark, str(tmp_path / "t"), shape, ["k"], buckets=4)

    def keep_largest(stored, batch):
        return stored.unionByName(batch).groupBy("k").agg(F.max("v").alias("v")).where("v >= 0")

    def batch(*pairs):
        return spark.createDataFrame(list(pairs), shape)

    assert table.read().collect() == []
    assert table.merge(batch(*[(n, n) for n in range(20)]), 0, keep_largest)
    first = table.version()
    assert table.merge(batch((3, 100), (4, 1)), 1, keep_largest)
    want = sorted(((n, 100 if n == 3 else n) for n in range(20)), key=repr)
    assert collected(table.read()) == want
    before = table.version()
    # a replayed epoch does nothing
    assert not table.merge(batch((3, 500)), 1, keep_largest) and table.version() == before
    # untouched buckets keep their folders
    changed = [b for b, f in before["folders"].items() if first["folders"].get(b) != f]
    assert 1 <= len(changed) <= 2 < len(before["folders"])
    # a writer that dies before it publishes leaves the version as it was, and the next one goes on
    monkeypatch.setattr(table, "_publish", lambda version: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        table.merge(batch((5, 500)), 2, keep_largest)
    monkeypatch.undo()
    assert table.version() == before and collected(table.read()) == want
    # two writers of one version: one of them fails
    stale = table.version()
    assert table.merge(batch((5, 500)), 2, keep_largest)
    with pytest.raises(RuntimeError):
        table._publish({**stale, "number": stale["number"] + 1})
    assert dict(collected(table.read()))[5] == 500
    # rows that a merge leaves out are gone, also where a bucket becomes empty
    assert table.merge(batch(*[(n, -1) for n in range(20)]), 3, lambda stored, rows: rows.where("v >= 0"))
    assert table.read().collect() == [] and table.version()["folders"] == {}


def test_partials_by_batches_equal_the_table_rule(spark):
    import random

    rng = random.Random(5)
    rows = [
        (f"m{rng.randrange(3)}", rng.randrange(4), rng.choice("ab"), "d", rng.choice(["ready", "loading", "unavailable"]), seq, seq // 6, (seq // 6) % 5 == 4)
        for seq in range(240)
    ]
    shape = "manifest_path string, position long, name string, section string, status string, seq long, message long, final boolean"
    want = collected(windows.indexed_partials(spark.createDataFrame(rows, shape)))
    rng.shuffle(rows)
    said = spark.createDataFrame([], StructType.fromDDL(windows.PARTIALS))
    for n in range(3):
        said = spark.createDataFrame(
            windows.merge_partials(said, windows.compact_partials(spark.createDataFrame(rows[n::3], shape))).select(*said.columns).collect(), said.schema
        )
    assert collected(windows.shown_partials(said)) == want and said.count() < len(rows) / 2


STREAMS = [key for key in catalog.QUERIES if key.endswith("_stream") or key.split("_")[0] in ("T5", "T7", "T8", "T9", "T10", "T11")]


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    """The small events table as one file, as part files, and as part files out of time order."""
    source = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{source}/events.parquet")
    folders = {}
    for kind in ("one", "parts", "shuffled"):
        folder = str(tmp_path_factory.mktemp(kind))
        for name in os.listdir(source):
            if name != "events.parquet":
                os.symlink(f"{source}/{name}", f"{folder}/{name}")
        folders[kind] = folder
    os.symlink(f"{source}/events.parquet", f"{folders['one']}/events.parquet")
    events.repartitionByRange(4, "ts").write.parquet(f"{folders['parts']}/events.parquet")
    events.repartitionByRange(4, F.desc("ts")).write.parquet(f"{folders['shuffled']}/events.parquet")
    return folders


@pytest.mark.parametrize("key", STREAMS)
def test_any_layout_gives_the_same_rows(spark, laid_out, key, monkeypatch):
    query = catalog.QUERIES[key]
    want = collected(query(spark, laid_out["one"]))
    assert want
    assert collected(query(spark, laid_out["parts"])) == want
    plain = runner.table_stream
    monkeypatch.setattr(runner, "table_stream", lambda spark, folder, name, files_per_batch=None: plain(spark, folder, name, 1))
    assert collected(query(spark, laid_out["shuffled"])) == want


def test_empty_stream_gives_an_empty_table(spark, tmp_path):
    os.makedirs(tmp_path / "events.parquet")
    spark.createDataFrame([], "user_id long, ts timestamp").write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
    stream = runner.table_stream(spark, str(tmp_path), "events").groupBy("user_id").count()
    assert runner.run_updates(stream, "none", ["user_id"]).collect() == []


def test_restart_counts_do_not_walk_their_window_again(spark):
    # ends of the window, equal times, two workspaces and one without a name
    times = [("w", 0), ("w", 0), ("w", 600_000), ("w", 600_001), ("w", 1_199_999), ("w", 1_800_000), ("v", 600_000), (None, 5), (None, 7)]
    restarts = spark.createDataFrame([(*row, n) for n, row in enumerate(times)], "workspace string, ms long, id int")
    counted = windows.restart_loops(restarts.withColumn("ts", F.timestamp_millis("ms")), "id")
    got = {row["id"]: row["recent"] for row in counted.collect()}
    want = {
        n: sum(other == name and at - 600_000 <= ms <= at for other, ms in times) for n, (name, at) in enumerate(times)
    }
    assert got == want
    # a frame with a lower bound is counted anew for each row
    assert "600000" not in "".join(line for line in counted._jdf.queryExecution().toString().splitlines() if "specifiedwindowframe" in line)


def test_feed_moves_its_waiting_rows_by_batches():
    import pandas as pd

    calls = []

    class State:
        def __init__(self):
            self.held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return iter(self.held or []) if isinstance(self.held, list) or self.held is None else self.held

        def update(self, value):
            self.held = value

        def appendList(self, values):
            calls.append("append")
            self.held = [*(self.held or []), *values]

        def put(self, values):
            calls.append("put")
            self.held = list(values)

        def clear(self):
            self.held = None

        def __getattr__(self, name):
            raise AssertionError(f"one call a row: {name}")

    class Handle:
        def getValueState(self, *_):
            return State()

        getListState = getMapState = getValueState

        def registerTimer(self, at):
            pass

        deleteTimer = registerTimer

    class Now:
        def getCurrentWatermarkInMs(self):
            return 50

    processor = feed.ChangesOnly("identity", ["brotli_bytes"], None)
    processor.init(Handle())
    rows = [(at, at, at // 10, False) for at in range(100)] + [(7, 7, 99, False)]
    frame = pd.DataFrame(rows, columns=["ts_ms", "seq", "brotli_bytes", runner.CLOCK])
    assert list(processor.handleInputRows(("a",), iter([frame]), None)) == []
    (out,) = processor.handleExpiredTimer(("a",), Now(), None)
    # the row that landed twice counts with what came last
    assert out["seq"].tolist() == [0, 7, 8, 10, 20, 30, 40, 50]
    assert len(calls) == 2
