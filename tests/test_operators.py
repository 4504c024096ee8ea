"""Operators on small literal tables."""

import zlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from ballast import vocabulary as V
from ballast.operators import budgets, changes, facts, freshness, graph, history, ranges, report, resolve, retention
from ballast.operators import registry as registry_ops
from ballast.plans import jobs
from ballast.sources import files, sinks

SIZES = ", ".join(f"{size} long" for size in V.SIZES)


def rows(frame, *columns):
    return sorted((tuple(row[c] for c in columns) for row in frame.collect()), key=str)


def test_shared_module_is_a_max_and_a_sum(spark):
    parts = spark.createDataFrame(
        [("w", "/m/node_modules/x/index.js", "a", 900), ("w", "/m/node_modules/x/index.js", "b", 400)],
        "workspace string, module_path string, specifier string, bytes long",
    )
    assert rows(report.shared_modules(parts, ["workspace"]), "module_bytes", "combined_bytes", "import_count") == [(900, 1300, 2)]


def test_modules_are_not_shared_across_runtimes(spark):
    parts = spark.createDataFrame(
        [("w", "f", "server", "m", 5, "i1"), ("w", "f", "client", "m", 5, "i2"), ("w", "f", "client", "m", 5, "i3")],
        "workspace string, source_file string, runtime string, module_path string, bytes long, site string",
    )
    assert rows(facts.shared_bytes(parts, ["site"]), "site", "shared_bytes") == [("i1", 0), ("i2", 5), ("i3", 5)]


def _cost_inputs(spark, sites, modules, failed):
    site_rows = spark.createDataFrame(
        sites, f"source_file string, runtime string, package_state string, {SIZES}, diagnostics array<struct<stage:string>>"
    ).withColumn("workspace", F.lit("w"))
    module_rows = spark.createDataFrame(modules, f"source_file string, runtime string, module_path string, {SIZES}").withColumn(
        "workspace", F.lit("w")
    )
    failed_rows = spark.createDataFrame(failed, "source_file string, runtime string, stage string").withColumn(
        "workspace", F.lit("w")
    )
    return facts.file_costs(site_rows, module_rows, failed_rows)


def test_file_cost_rules(spark):
    ten, none = (10,) * 5, (None,) * 5
    sites = [
        ("whole", "client", "installed", *ten, []), ("whole", "client", "installed", *ten, []),
        ("floor", "client", "installed", *ten, []), ("floor", "client", "not_installed", *none, []),
        ("alias", "client", "installed", *ten, []), ("alias", "client", "path_alias", *none, []),
        ("types", "client", "unresolved", 0, 0, 0, 0, 0, [("types_only",)]),
        ("fallback", "client", "installed", *ten, []), ("fallback", "client", "installed", *ten, []),
        ("nothing", "client", "installed", *none, []),
        ("two", "client", "installed", *ten, []), ("two", "server", "installed", *ten, []),
        ("assets", "client", "installed", *ten, [("uncounted_assets",)]),
    ]
    seven = (7,) * 5
    modules = [
        ("whole", "client", "m", *seven), ("whole", "client", "m", *seven), ("floor", "client", "m", *seven),
        ("alias", "client", "m", *seven), ("two", "client", "m", *seven), ("two", "server", "m", *seven),
        ("assets", "client", "m", *seven), ("fallback", "client", "m", *seven),
    ]
    failed = [("fallback", "client", "link"), ("nothing", "client", "link")]
    got = rows(_cost_inputs(spark, sites, modules, failed), "source_file", "brotli_bytes", "incomplete", "degraded", "error")
    error = "no import could be sized conservatively"
    assert got == sorted(
        [
            ("whole", 7, False, False, None), ("floor", 7, True, False, None), ("alias", 7, False, False, None),
            ("types", 0, False, False, None), ("fallback", 20, False, True, None), ("nothing", None, True, True, error),
            ("two", 14, False, False, None), ("assets", 7, True, False, None),
        ],
        key=str,
    )


def _store(spark, shards):
    data = [(shard, f"k{n:04d}", n, size) for shard, count, size in shards for n in range(count)]
    return spark.createDataFrame(data, "shard_id string, key string, last_seq long, size_bytes long")


def test_retention(spark):
    store = _store(spark, [("a", 300, 10), ("b", 100, 10)])
    assert retention.retention_plan(store, 0).count() == 0
    assert retention.retention_plan(store, 4000).count() == 0
    plan = retention.retention_plan(store, 3000)  # low water 2700, so 1300 bytes must go
    assert rows(plan, "shard_id", "last_seq") == sorted([("a", n) for n in range(130)], key=str)
    everything = retention.retention_plan(store, 100)
    assert everything.count() == 172  # the newest 128 of each shard stay
    assert rows(retention.retention_outcome(store, everything, 100), "evicted_bytes", "still_over_budget") == [(1720, True)]


def test_store_maintenance_moves_rows_once(spark):
    shape = "shard_id string, key string, last_seq long, size_bytes long, analyzer_version string, entry_path string, package_root string"
    data = [
        (f"s{n % 3}", f"k{n:05d}", n, 10, "v7" if n % 19 == 0 else "v8", f"/e{n}" if n % 23 else None, f"/r{n % 5}" if n % 11 else None)
        for n in range(4000)
    ]
    # a key that is also an orphan's goes with it; a NULL version is not another one
    data += [("s0", "twice", 1, 10, "v7", None, None), ("s0", "twice", 2, 10, "v8", None, None), ("s1", "unknown", 9999, 10, None, None, None)]
    paths = [f"/e{n}" for n in range(4000) if n % 4] + ["/r0", "/r1", "/r2", "/r2", "/e1"]
    live = set(paths)
    store = spark.createDataFrame(data, shape)
    live_paths = spark.createDataFrame([(path,) for path in paths], "path string")

    gone = [
        row for row in data
        if (row[4] is not None and row[4] != "v8") or (row[5] and row[5] not in live) or (row[6] and row[6] not in live)
    ]
    keys = {row[:2] for row in gone}
    kept = [row for row in data if row[:2] not in keys]
    evictable = []
    for shard in ("s0", "s1", "s2"):
        evictable += sorted((row for row in kept if row[0] == shard), key=lambda row: (-row[2], row[1]))[128:]
    needed, total, evicted = 10 * len(kept) - 7200, 0, []
    for row in sorted(evictable, key=lambda row: (row[2], row[0], row[1])):
        if total < needed:
            evicted.append(row)
        total += row[3]
    assert gone and evicted and len(evicted) < len(evictable)
    wanted = [(*row[:2], row[3], "orphan") for row in gone] + [(*row[:2], row[3], "over_budget") for row in evicted]

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in (threshold, "20000", "-1"):  # all fits, only the roots and the protected rows fit, nothing fits
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            orphans = freshness.orphan_entries(store, live_paths, "v8")
            assert orphans.count() == len(gone)
            plan = jobs.store_maintenance(store, live_paths, "v8", 8000)
            assert rows(plan, "shard_id", "key", "size_bytes", "reason") == sorted(wanted, key=str)
            if limit == "20000":
                assert "hashpartitioning(package_root" not in orphans._jdf.queryExecution().executedPlan().toString()
            # the rows were judged before the plan was made and are only read
            assert "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_first_until_matches_a_running_sum(spark):
    data = [(n % 50, f"k{n}", (n * 7919) % 97) for n in range(2000)]
    frame = spark.createDataFrame(data, "seq long, key string, size long")
    for needed in (0, 1, 5000, 60_000, 10**9):
        taken, total = set(), 0
        for seq, key, size in sorted(data):
            if total < needed:
                taken.add((seq, key))
            total += size
        got = ranges.first_until(frame, [F.col("seq"), F.col("key")], "size", needed)
        assert {(row.seq, row.key) for row in got.collect()} == taken


def test_previous_row_over_buckets(spark):
    data = [("hot", n * 10, n, n * n) for n in range(500)] + [("cold", 7, 1, 1)]
    frame = spark.createDataFrame(data, "k string, ts long, id long, v long")
    got = ranges.with_previous(frame, ["k"], ["ts", "id"], F.floor(F.col("ts") / 35), ["v"])
    found = {(row.k, row.id): row.previous.v if row.previous else None for row in got.collect()}
    assert found[("cold", 1)] is None and found[("hot", 0)] is None
    assert all(found[("hot", n)] == (n - 1) ** 2 for n in range(1, 500))


def test_sessions_over_buckets(spark):
    times = [0, 100, 240, 600, 849, 2000, 2001]
    frame = spark.createDataFrame([("w", t, n) for n, t in enumerate(times)], "w string, ts long, id long")
    got = ranges.sessions(frame, ["w"], "ts", "id", 250, 200)
    assert [row.session_start for row in got.orderBy("ts").collect()] == [0, 0, 0, 600, 600, 2000, 2000]


def test_history_cap_keeps_at_least_one(spark):
    frame = spark.createDataFrame([("w", n, n) for n in range(5)], "workspace string, ts_ms long, id long")
    assert history.history_cap(frame, ["workspace"], "id", 0).count() == 1


def test_worst_freshness_and_sentinels(spark):
    stored = spark.createDataFrame(
        [
            ("e", "same", 1, 1, 5, False), ("e", "touched", 1, 1, 5, False), ("f", "gone", 1, 1, 5, False),
            ("g", "locked", 1, 1, 5, False), ("g", "gone", 1, 1, 5, False), ("h", "nohash", 1, 1, None, False),
            ("i", "never", 0, 0, None, True), ("j", "appeared", 0, 0, None, True),
        ],
        "identity string, path string, len long, modified_millis long, content_hash long, absent boolean",
    )
    now = spark.createDataFrame(
        [("same", 1, 1, 5, True), ("touched", 1, 2, 5, True), ("locked", 1, 2, 5, False), ("nohash", 2, 1, 9, True), ("appeared", 1, 1, 1, True)],
        "path string, len long, modified_millis long, content_hash long, readable boolean",
    )
    worst = freshness.worst_freshness(freshness.stale_measurements(stored, now), ["identity"])
    assert rows(worst, "identity", "freshness") == [
        ("e", "fresh"), ("f", "gone"), ("g", "unknown"), ("h", "stale"), ("i", "fresh"), ("j", "stale"),
    ]


def test_signature_ignores_order_but_not_repeats(spark):
    frame = spark.createDataFrame(
        [("a", "x"), ("a", "y"), ("b", "y"), ("b", "x"), ("c", "x"), ("c", "x"), ("c", "y")], "f string, token string"
    )
    signed = {row.f: row.signature for row in freshness.file_signature(frame, ["f"]).collect()}
    assert signed["a"] == signed["b"] != signed["c"]


def test_nearest_rule_file_wins(spark):
    sites = spark.createDataFrame(
        [("w", "/r/a/x.ts", "lodash", "lodash"), ("w", "/r/b/x.ts", "lodash", "lodash"), ("w", "/r/b/y.ts", "@i/ui", "@i/ui")],
        "workspace string, path string, specifier string, package_name string",
    )
    rules = spark.createDataFrame(
        [("w", "/r", "package", "lodash"), ("w", "/r/b", "import", "@i/*")],
        "workspace string, dir string, kind string, pattern string",
    )
    assert rows(resolve.apply_ignore_rules(sites, rules), "path") == [("/r/b/x.ts",)]


def test_ambiguous_star_exports(spark):
    edges = spark.createDataFrame(
        [
            ("e", "star", None, "a", None), ("e", "star", None, "b", None), ("a", "own", "x", None, None),
            ("b", "own", "x", None, None), ("a", "own", "y", None, None), ("b", "own", "default", None, None),
            ("a", "star", None, "e", None), ("e", "named", "q", "a", "y"), ("a", "named", "z", "ext", "z"),
        ],
        "module string, kind string, name string, target string, source_name string",
    )
    surface = graph.export_names(graph.export_surface(edges)).where("module = 'e'")
    assert rows(surface, "name") == [("q",), ("y",), ("z",)]


def test_export_surface_carries_no_list_of_origins(spark, monkeypatch):
    # forty packages export the same name, and a chain of ten modules hands all of them on, in a circle
    edges = [(f"p{n}", "own", "x", None, None) for n in range(40)] + [("c0", "star", None, f"p{n}", None) for n in range(40)]
    edges += [(f"c{n + 1}", "star", None, f"c{n}", None) for n in range(9)] + [("c0", "star", None, "c9", None), ("c5", "named", "y", "p3", "x")]
    table = spark.createDataFrame(edges, "module string, kind string, name string, target string, source_name string")
    sizes, pinned = [], graph.pinned

    def counted(frame):
        stored = pinned(frame)
        if "origin_module" in stored.columns:
            sizes.append(stored.count())
        return stored

    monkeypatch.setattr(graph, "pinned", counted)
    monkeypatch.setattr(graph, "ROUNDS_BEFORE_MERGE", 10**6)
    surface = graph.export_surface(table)
    want = [(f"c{n}", "y", "p3", "x") for n in range(10)] + [(f"p{n}", "x", f"p{n}", "x") for n in range(40)]
    assert rows(surface, "module", "name", "origin_module", "origin_name") == sorted(want, key=str)
    assert sum(sizes) <= 2 * (len(want) + 10)


def test_cycles_end(spark):
    edges = spark.createDataFrame([("g", "a", "b"), ("g", "b", "a"), ("g", "c", "d")], "graph_id string, from_path string, to_path string")
    entries = spark.createDataFrame([("g", "client", "a")], "graph_id string, runtime string, module_path string")
    assert rows(graph.reachable_modules(entries, edges), "module_path") == [("a",), ("b",)]


def test_request_rates_and_registry_cap(spark):
    entries = spark.createDataFrame([("old", 0, 5), ("a", 10, 5), ("b", 11, 5), ("c", 12, 5)], "name string, updated_at long, size_bytes long")
    dropped = registry_ops.registry_retention(entries, now_ms=100, max_bytes=9, retention_ms=90)
    assert rows(dropped, "name", "reason") == [("a", "over_budget"), ("b", "over_budget"), ("old", "expired")]


def test_artifact_sizes_are_real_codecs(spark):
    texts = ["", "a" * 5000, "é" * 10]
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(texts)] + [(9, None)], "id int, text string")
    got = {row.id: row for row in facts.artifact_sizes(frame, ["id"]).collect()}
    for n, t in enumerate(texts):
        data = t.encode()
        assert got[n].raw_bytes == len(data)
        assert got[n].brotli_bytes == len(pa.Codec("brotli", 9).compress(data))
        packed = pa.Codec("gzip", 6).compress(data, asbytes=True)
        assert zlib.decompress(packed, 31) == data and got[n].gzip_bytes == len(packed)
    assert got[9].raw_bytes is None and got[9].brotli_bytes is None


def test_oversized_artifacts_are_refused_whole(spark):
    parts = spark.createDataFrame(
        [("big", "a", "x" * 60), ("big", "b", "y" * 60), ("ok", "b", "2"), ("ok", "a", "1"), ("ok", "a", "1")],
        "f string, module_path string, text string",
    )
    got = facts.joined_artifacts(parts, ["f"], max_total_bytes=100)
    assert rows(got, "f", "text", "stage") == [("big", None, "module_graph_limit"), ("ok", "1\n2", None)]


def _lcs(left, right):
    table = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9))
def test_changed_lines_leave_a_longest_common_subsequence(before, after):
    changed = changes._changed("\n".join(before), "\n".join(after))
    # an empty text is one empty line
    old, new = before or [""], after or [""]
    kept = [line for n, line in enumerate(new) if n not in set(changed)]
    if changed or old == new:
        assert _lcs(old, kept) == len(kept) == _lcs(old, new)
    else:  # a pure deletion reports nothing
        assert _lcs(old, new) == len(new)


def test_line_endings_do_not_count(spark):
    pairs = spark.createDataFrame([("f", "a\r\nb\r\n", "a\nb\nc\n"), ("g", "x", "x"), ("h", "a\nb", "a")], "f string, base string, current string")
    assert rows(changes.changed_lines(pairs, ["f"]), "f", "line") == [("f", 2)]


def test_report_sink(spark, tmp_path):
    from ballast.catalog.report import _rows

    table = _rows(spark, "/root/testdata/sf0.001")
    paths = sinks.write_report(table, str(tmp_path / "report"))
    assert set(paths) == {
        "rows", "summary", "duplicates", "duplicate_files", "shared_modules", "shared_module_specifiers", "treemap",
    }
    assert spark.read.parquet(paths["rows"]).count() == table.count()
    assert spark.read.parquet(paths["summary"]).count() == 20


def test_row_numbers_of_a_large_group_match_one_window(spark):
    data = [("hot", (n * 7919) % 501, n) for n in range(3000)] + [("cold", 5, 1), ("cold", 4, 2)]
    frame = spark.createDataFrame(data, "k string, v long, id long")
    order = [F.col("v"), F.col("id")]
    plain = frame.withColumn("position", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    sliced = ranges.row_numbers(frame, ["k"], order, "position")
    assert rows(plain, "k", "id", "position") == rows(sliced, "k", "id", "position")


def test_order_statistics_of_a_hot_group(spark):
    from ballast.operators import compare

    data = [("hot", (n * 31) % 977) for n in range(4000)] + [("few", n) for n in range(29)] + [("min", n) for n in range(30)]
    frame = spark.createDataFrame(data, "g string, millis long")
    got = {row.g: (row.p50_millis, row.p95_millis, row.max_millis) for row in compare.latency_summary(frame, ["g"]).collect()}
    ordered = sorted(v for g, v in data if g == "hot")
    assert got == {"hot": (ordered[2000], ordered[3799], ordered[-1]), "min": (15, 28, 29)}


def test_rewrites_and_artifacts_of_any_size(spark):
    from ballast.operators import changes, facts

    lines = 2_500
    pairs = spark.createDataFrame(
        [(1, "\n".join(f"a{n}" for n in range(lines)), "\n".join(f"b{n}" for n in range(lines)))],
        "id long, base string, current string",
    )
    assert changes.changed_lines(pairs, ["id"]).count() == lines
    parts = spark.range(2_001).selectExpr("'a' AS artifact", "'m' || id AS module_path", "'x' AS text")
    assert [len(r.text) for r in facts.joined_artifacts(parts, ["artifact"]).collect()] == [2 * 2_001 - 1]
    limited = facts.joined_artifacts(parts, ["artifact"], max_modules=2_000).collect()
    assert [(r.text, r.stage) for r in limited] == [(None, "module_graph_limit")]


def test_line_differences_match_the_full_table():
    import random

    from ballast.operators.changes import _changed

    def full(before, after):
        n, m = len(before), len(after)
        common = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                common[i][j] = common[i + 1][j + 1] + 1 if before[i] == after[j] else max(common[i + 1][j], common[i][j + 1])
        return n + m - 2 * common[0][0], common[0][0]

    rng = random.Random(4)
    for _ in range(60):
        before = [rng.choice("abcd") for _ in range(rng.randint(1, 30))]
        after = [rng.choice("abcd") for _ in range(rng.randint(1, 30))]
        changed = _changed("\n".join(before), "\n".join(after))
        assert len(after) - len(changed) == full(before, after)[1]


def test_row_numbers_take_one_path(spark):
    from ballast.operators import ranges

    frame = spark.range(1_000).selectExpr("id % 3 AS k", "id * 7919 % 1000 AS v")
    got = ranges.row_numbers(frame, ["k"], [F.col("v")], "nth").collect()
    for key in range(3):
        own = sorted((r.v, r.nth) for r in got if r.k == key)
        assert [n for _, n in own] == list(range(1, len(own) + 1))


def test_row_numbers_move_rows_once_and_keep_groups_without_a_key(spark, monkeypatch):
    from ballast.operators import ranges

    data = [(None if n % 3 == 0 else f"k{n % 3}", n * 7919 % 2003, "x" * (n % 50)) for n in range(2_000)]
    frame = spark.createDataFrame(data, "k string, v long, wide string").repartition(4)
    order = [F.col("v").desc(), F.length("wide")]
    written, pinned = [], ranges.pinned

    def planned(rows_):
        written.append((rows_.columns, rows_._jdf.queryExecution().executedPlan().toString()))
        return pinned(rows_)

    monkeypatch.setattr(ranges, "pinned", planned)
    got = ranges.row_numbers(frame, ["k"], order, "nth", ["k", "v"])
    assert got.columns == ["k", "v", "nth"]
    for key in (None, "k1", "k2"):
        values = sorted((v for k, v, _ in data if k == key), reverse=True)
        assert sorted((r.nth, r.v) for r in got.collect() if r.k == key) == list(enumerate(values, 1))
    assert "wide" not in written[0][0] and written[0][1].count("Exchange rangepartitioning") == 1
    # the rows meet the shifts where they lie
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest as _pytest

    from ballast.session import shared_folder

    class Conf:
        def get(self, name, default=None):
            return default

    fake = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with _pytest.raises(ValueError):
        shared_folder(fake)


def test_release_leaves_no_tables(spark):
    import os

    from ballast.session import pinned, release, shared_folder

    release(spark)
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    pinned(spark.range(3)).collect()
    assert set(os.listdir(folder)) - before
    release(spark)
    assert set(os.listdir(folder)) <= before


def test_bounded_walk_equals_the_sweep():
    import random
    import time

    import numpy as np

    from ballast.operators.changes import _changed, _reach, _swept, _walked

    rng = random.Random(2)
    for _ in range(800):
        letters = rng.choice([2, 3, 8])
        left, right = (np.array([rng.randrange(letters) for _ in range(rng.randint(low, 14))], dtype=np.int64) for low in (0, 1))
        reach = _reach(left, right, 60)
        assert _walked(left, right, reach) == _swept(left, right)
        assert len(reach) < 2 or _reach(left, right, len(reach) - 2) is None
    before = [f"line {rng.randrange(5_000)}" for _ in range(200_000)]
    after = list(before)
    for _ in range(5):
        del after[rng.randrange(len(after))]
        after.insert(rng.randrange(len(after)), "new")
    started = time.time()
    assert len(_changed("\n".join(before), "\n".join(after))) == 5
    assert time.time() - started < 20


def test_globs_meet_only_values_with_their_literal_piece(spark):
    from ballast.operators import resolve

    rules = [("package", f"@s{n}/*") for n in range(40)] + [("path", f"src/d{n}/**") for n in range(40)]
    rules += [("path", "*.test.ts"), ("path", "/abs/*"), ("import", "**"), ("path", "a[1].ts"), ("path", "win\\dir\\*"), ("package", "lodash.*")]
    patterns = resolve.ignore_patterns(spark.createDataFrame([("w", "", k, p) for k, p in rules], "workspace string, dir string, kind string, pattern string"))
    values = [("package", f"@s{n}/p") for n in range(60)] + [("path", f"x/src/d{n}/f.ts") for n in range(60)]
    values += [("path", "q/a.test.ts"), ("path", "/abs/y"), ("path", "x/abs/y"), ("import", "z"), ("path", "k/a[1].ts"), ("path", "win/dir/q"), ("package", "lodash.x"), ("package", "lodashx")]
    asked = spark.createDataFrame([("w", "", k, v) for k, v in values], "workspace string, rule_dir string, kind string, value string")
    formed = resolve.glob_candidates(asked, patterns)
    matched = formed.where(F.rlike("value", "regex"))
    every = asked.join(patterns, ["workspace", "rule_dir", "kind"]).where(F.rlike("value", "regex"))
    assert rows(matched, "kind", "value", "regex") == rows(every, "kind", "value", "regex")
    # all pairs would be thousands
    assert formed.count() <= matched.count() + 5


def test_alias_prefixes_of_occurring_lengths(spark):
    from ballast.operators import resolve

    asked = spark.createDataFrame([("w", s) for s in ("@/a", "~x/b", "lib/c.js", "z", "@/gone")], "workspace string, specifier string")
    aliases = spark.createDataFrame(
        [("w", "@/", "", "src/", ".ts"), ("w", "lib/", ".js", "vendor/", ".ts"), ("w", "", "", "types/", ".d.ts"), ("v", "~x/", "", "src/", ".ts")],
        "workspace string, prefix string, suffix string, target_prefix string, target_suffix string",
    )
    files = spark.createDataFrame([("w", p) for p in ("src/a.ts", "vendor/c.ts", "types/z.d.ts", "src/b.ts")], "workspace string, path string")
    got = rows(resolve.classify_unresolved(asked, aliases, files), "specifier", "resolution")
    assert got == [("@/a", "path_alias"), ("@/gone", "not_installed"), ("lib/c.js", "path_alias"), ("z", "path_alias"), ("~x/b", "not_installed")]


def test_linked_sums_move_no_pair_of_file_and_module(spark, monkeypatch):
    # files share sets of packages; packages share modules; one package has no module
    imports = [(f"f{n}", runtime, f"p{k}") for n in range(12) for runtime in ("server", "client") for k in range(8) if (n * 7 + k * 3 + len(runtime)) % 4 < 2]
    modules = {(f"p{k}", f"m{m}"): m * 10 + 1 for k in range(7) for m in range(20) if (k + m) % 3 == 0 or m == 5}
    sites = spark.createDataFrame([*imports, ("alone", "client", "p7")], "source_file string, runtime string, package_name string")
    weighed = spark.createDataFrame([(*key, *[size * n for n in range(1, 6)]) for key, size in modules.items()], f"package_name string, module_path string, {SIZES}")
    plans, pinned = [], facts.pinned

    def planned(frame):
        if "_set" in frame.columns and V.SIZES[0] in frame.columns:
            plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return pinned(frame)

    monkeypatch.setattr(facts, "pinned", planned)
    monkeypatch.setattr(facts, "_ROWS_A_BLOCK", 20)
    monkeypatch.setattr(facts, "_PAIRS_A_TASK", 5)
    got = rows(facts.linked_by_packages(sites, weighed, ["source_file", "runtime"]), "source_file", "runtime", *V.SIZES)
    want = []
    for file, runtime in sorted({row[:2] for row in imports}):
        reached = {m: size for f, r, p in imports if (f, r) == (file, runtime) for (q, m), size in modules.items() if q == p}
        if reached:
            want.append((file, runtime, *[sum(reached.values()) * n for n in range(1, 6)]))
    assert got == sorted(want, key=str)
    assert len(plans) > 1
    for plan in plans:
        # the sets are dealt to tasks once, and no grouping moves what they meet
        assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 1


def test_modules_meet_parts_of_sets_and_not_whole_sets(spark, monkeypatch):
    # two families of packages share no module; each pair of a package of one and of the other is a set
    families = [[f"{name}{k}" for k in range(12)] for name in "ab"]
    imports = [(f"f-{a}-{b}", p) for a in families[0] for b in families[1] for p in (a, b, "none")] + [("two", "a0"), ("two", "a1"), ("two", "b3")]
    modules = {(p, f"{p[0]}/m{m}"): m * 10 + 1 for family in families for k, p in enumerate(family) for m in range(10) if (k + m) % 3 or m == 5}
    modules |= {(p, "odd"): 1000 + k for k, p in enumerate(families[0])}  # its size depends on the package
    modules |= {("a1", "a/null"): None, ("b3", "b/null"): None}
    sites = spark.createDataFrame([(file, "client", p) for file, p in imports], "source_file string, runtime string, package_name string")
    weighed = spark.createDataFrame(
        [(*key, *[None if size is None else size * n for n in range(1, 6)]) for key, size in modules.items()], f"package_name string, module_path string, {SIZES}"
    )
    parts, folded, pinned = [], [], facts.pinned

    def counted(frame):
        kept = pinned(frame)
        if {"_part", "_set"} <= set(frame.columns):
            parts.append(kept.count())
        if {"_cluster", "_module", V.SIZES[0]} <= set(frame.columns):
            folded.append(kept.count())
        return kept

    monkeypatch.setattr(facts, "pinned", counted)
    got = rows(facts.linked_by_packages(sites, weighed, ["source_file", "runtime"]), "source_file", *V.SIZES)
    want = []
    for file in {file for file, _ in imports}:
        own = {p for f, p in imports if f == file}
        held = {m for p, m in modules if p in own}
        total = sum(max(modules.get((p, m)) or 0 for p in own) for m in held)
        want.append((file, *[total * n for n in range(1, 6)]))
    assert got == sorted(want, key=str)
    # 145 sets, but few parts in each cluster; modules of the same packages are one
    assert parts[0] < 100 and folded[0] < len(modules) / 2


def test_a_gate_makes_no_summaries(spark, monkeypatch):
    from ballast import catalog

    def unasked(*_):
        raise AssertionError("a gate reads no summary")

    catalog.load()
    monkeypatch.setattr(facts, "file_summaries", unasked)
    monkeypatch.setattr(facts, "asset_breakdown", unasked)
    assert catalog.QUERIES["Q3_gate_of_reports"](spark, "/root/testdata/sf0.001").count() == 25


def test_results_pushed_at_one_position_do_not_depend_on_row_order(spark):
    existing = spark.createDataFrame(
        [("w", "f", "i", "s", 1, None, "ready", True)],
        "workspace string, source_file string, identity string, specifier string, brotli_bytes long, error string, status string, has_result boolean",
    )
    pushed = [("w", "f", 2, "s", "i", 30, None), ("w", "f", 2, "s", "i", 50, None), ("w", "f", 2, "s", "i", 40, None), ("w", "f", 1, "s", "i", 90, None)]
    for order in (pushed, pushed[::-1]):
        updates = spark.createDataFrame(
            order, "workspace string, source_file string, position long, specifier string, identity string, brotli_bytes long, error string"
        ).coalesce(1)
        merged = changes.merge_refreshed_documents(existing, updates, ["workspace", "source_file"], "position")
        assert rows(merged, "brotli_bytes") == [(50,)]


def _sharing_sites(spark):
    sites = [
        ("f", "client", "i1", [("m", 5), ("n", 3)]), ("f", "client", "i2", [("m", 7), ("m", 2)]), ("f", "server", "i1", [("m", 1)]),
        ("g", "client", "i1", [("m", 9), ("n", 4)]), ("g", "client", "i3", [("n", 4), ("o", None)]), ("g", "client", "i3", [("o", 6)]), ("h", "client", "i4", []),
    ] * 3
    return spark.createDataFrame(
        sites, "source_file string, runtime string, identity string, module_breakdown array<struct<path:string, bytes:long>>"
    ).withColumn("workspace", F.lit("w"))


def test_modules_shared_in_a_file_come_from_one_shuffle_of_its_sites(spark):
    sites = _sharing_sites(spark)
    parts = facts.contributions(sites, ["workspace", "source_file", "runtime", "identity"])
    shared, used = facts.shared_bytes(parts, ["identity"]), changes.shared_with(parts)
    for least in (1, 5_000_000):  # all groups too large for one task, and none
        found = facts.site_shared_bytes(sites, ["identity"], least=least)
        assert rows(found, "identity", "shared_bytes") == rows(shared, "identity", "shared_bytes")
        with_module = changes.site_shared_with(sites, least=least)
        assert sorted(with_module.columns) == sorted(used.columns)
        assert rows(with_module, *used.columns) == rows(used, *used.columns)
    # no join of the modules with their counts
    assert "Join" not in facts.site_shared_bytes(sites, ["identity"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in changes.site_shared_with(sites)._jdf.queryExecution().optimizedPlan().toString()


def test_statements_inside_one_bin_and_across_bins_meet_their_lines(spark):
    sites = spark.createDataFrame(
        [("f", "a", 1, 3), ("f", "a", 1, 3), ("f", "b", 60, 70), ("f", "c", 60, 200), ("f", "d", 4, 63), ("g", "e", 1, 3), ("f", "x", None, 3)],
        "source_file string, site string, stmt_start_line long, stmt_end_line long",
    )
    lines = spark.createDataFrame([("f", 2), ("f", 3), ("f", 130), ("f", 64)], "source_file string, line long")
    found = changes.changed_imports(sites, lines, ["source_file"])
    assert rows(found, "site") == [("a",), ("a",), ("b",), ("c",)]
    # the sites of one-bin statements move once: no distinct spans of theirs are made and joined back
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2


def test_scan_names_the_path_seldom_and_keeps_its_rules(spark):
    kept = ["a.ts", "A.TSX", ".vue", "dist.ts", "x/outer/b.js", "a/dist.d/c.mts", "x.y/out.ts"]
    left = ["ts", "a.ts/b", "dist/a.ts", "a/node_modules/b/c.ts", "a.ts\n", "a.rs", "", "a/out/dist.ts", None, "a.d/ts"]
    table = spark.createDataFrame([(path,) for path in kept + left], "path string")
    found = files.scan_sources(table)
    assert rows(found, "path") == sorted((path,) for path in kept)
    assert rows(files.scan_sources(table, max_depth=1), "path") == sorted((path,) for path in kept if path.count("/") <= 1)
    assert rows(files.scan_sources(table, pruned=["x.y"]), "path") == sorted(
        (path,) for path in [*kept, "dist/a.ts", "a/node_modules/b/c.ts", "a/out/dist.ts"] if not (path or "").startswith("x.y/")
    )
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Filter") : plan.index("LogicalRDD")].count("path#") <= 3


def test_sites_stay_where_they_are_if_few_places_were_resolved(spark):
    sites = spark.createDataFrame([("w", "src/a.ts", "p"), ("w", "src/d/b.ts", "q")], "workspace string, path string, package_name string")
    copies = spark.createDataFrame([("w", "src", "p", "1.0"), ("w", "src/d", "p", "2.0")], "workspace string, dir string, package_name string, version string")
    found = resolve.resolve_installed(sites, copies)
    assert rows(found, "path", "installed_dir", "resolution") == [("src/a.ts", "src", "installed"), ("src/d/b.ts", None, "missing")]
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    ruled = resolve.nearest_ignore_rules(sites, copies.select("workspace", "dir"))
    assert rows(ruled, "path", "rule_dir") == [("src/a.ts", "src"), ("src/d/b.ts", "src/d")]
    assert "SortMergeJoin" not in ruled._jdf.queryExecution().executedPlan().toString()


def test_modules_of_a_file_are_linked_once_from_one_shuffle_of_its_sites(spark):
    # a workspace that is no constant, or its place among the keys is folded away
    sites, scale = _sharing_sites(spark).withColumn("workspace", F.upper("source_file")), dict(zip(V.SIZES, (8, 6, 3, 2, 4)))
    sizes = [(F.col("bytes") * n).alias(size) for size, n in scale.items()]
    once = facts.contributions(sites, ["source_file", "runtime"]).groupBy("source_file", "runtime", "module_path").agg(F.max("bytes").alias("b"))
    wanted = rows(once.groupBy("source_file", "runtime").agg(F.sum("b").alias("b")), "source_file", "runtime", "b")
    for least in (1, 5_000_000):  # all groups too large for one task, and none
        found = facts.linked_by_modules(sites, sizes, least)
        for size, n in scale.items():
            assert rows(found.select("source_file", "runtime", (F.col(size) / n).cast("long").alias("b")), "source_file", "runtime", "b") == wanted
    # the sites are the only exchange
    assert facts.linked_by_modules(sites, sizes)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_gate_makes_file_costs_once(spark):
    sizes = "workspace string, source_file string, brotli_bytes long, incomplete boolean, degraded boolean, error string, diagnostics array<struct<stage:string>>"
    files_ = spark.createDataFrame([("w", "a.ts", 90, False, False, None, []), ("w", "b.ts", 5, True, False, None, [])], sizes)
    imports = spark.createDataFrame(
        [("w", "a.ts", "p", 70, 70, 70, 70, 70, [], None)],
        "workspace string, source_file string, specifier string, raw_bytes long, minified_bytes long, gzip_bytes long, brotli_bytes long, zstd_bytes long,"
        " diagnostics array<struct<stage:string>>, unmeasured_stage string",
    ).withColumn("error", F.lit(None).cast("string"))
    limits = spark.createDataFrame([("w", 60, 80)], "workspace string, per_import_brotli_bytes long, per_file_brotli_bytes long")
    found = budgets.gate_findings(files_, imports, limits)
    assert rows(found, "source_file", "finding", "actual_bytes") == [
        ("a.ts", "file_over", 90), ("a.ts", "import_over", 70), ("b.ts", "could_not_measure", None)
    ]
    # the files' costs are read from where they were pinned, not made again for each kind of finding
    assert "incomplete" not in found._jdf.queryExecution().analyzed().toString()


def test_written_lists_are_cut_by_written_groups(spark, tmp_path):
    table = spark.createDataFrame(
        [("w", "p", "a", 1, 5), ("w", "p", "a", 2, 5), ("w", "p", "b", 1, None), ("w", "q", "a", 3, 7), ("v", "p", "a", 1, 5)],
        "workspace string, specifier string, source_file string, line long, brotli_bytes long",
    ).selectExpr(
        "*", "specifier AS package_name", "'high' AS confidence", "false AS is_conservative", "false AS over_budget",
        "array(named_struct('path', '/m/' || CASE WHEN line < 3 THEN 'x' ELSE 'y' END || '.js', 'bytes', brotli_bytes)) AS module_contributions",
    )
    paths = sinks.write_report(table, str(tmp_path / "report"))
    for name, wanted in sinks.report_tables(table).items():
        assert rows(spark.read.parquet(paths[name]).select(*wanted.columns), *wanted.columns) == rows(wanted, *wanted.columns), name
    # a list asks for the repeated groups and does not count its rows again
    listed = report.repeated_import_files(report.imports_per_file(table, ["workspace"]), spark.read.parquet(paths["duplicates"]), ["workspace"])
    assert listed._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
