"""Streaming rules. Where SQL can say the rule, the stream's table is checked
against it; the stream reads the events table as files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ballast import vocabulary as V
from ballast.adapters import project, view
from ballast.catalog import register
from ballast.catalog.sql import oracle
from ballast.operators import freshness, history, registry
from ballast.plans import jobs
from ballast.session import scratch_path
from ballast.streaming import feed, runner, stateful, upsert, windows


def _stream(spark, sf_dir, name):
    """A view over the events table as a stream, with an event-time column."""
    frame = project(runner.table_stream(spark, sf_dir, "events"), name)
    return frame.withColumn("ts", F.timestamp_millis("ts_ms")) if "ts_ms" in frame.columns else frame


_REFRESH = (
    "'w' || (user_id % 4) AS workspace",
    "'/src/d' || (user_id % 12) AS document",
    "event_id AS seq",
    "CASE WHEN event_id % 6 = 0 THEN 'open' ELSE 'push' END AS kind",
    "event_id // 120 AS generation",
    "CASE WHEN event_id % 6 = 0 THEN 'i0' || chr(10) || 'i1' || chr(10) || 'i2' END AS identities",
    "'i' || (event_id % 4) AS identity",
    "CASE WHEN event_type <> 'error' THEN CAST(floor(value * 10) AS BIGINT) END AS brotli_bytes",
    "CASE WHEN event_type = 'error' THEN 'failed' END AS error",
)


@register(
    "T1_refresh_merge_stream",
    f"""WITH ev AS (SELECT {', '.join(_REFRESH)} FROM events),
        opened AS (SELECT workspace, document, generation, min(seq) AS opened_at FROM ev WHERE kind = 'open' GROUP BY ALL),
        closed AS (SELECT *, lead(opened_at) OVER (PARTITION BY workspace, document ORDER BY generation) AS until FROM opened),
        held AS (SELECT e.*, o.opened_at, o.until
          FROM ev e JOIN closed o ON o.workspace = e.workspace AND o.document = e.document AND o.generation = e.generation
          WHERE kind = 'push' AND (until IS NULL OR e.seq < until) AND identity <> 'i3'),
        ranked AS (SELECT *, max(CASE WHEN error IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY workspace, document, generation, identity ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had
          FROM held)
        SELECT workspace, document, generation, identity, brotli_bytes, error FROM ranked WHERE error IS NULL OR coalesce(had, 0) = 0""",
)
def t1(spark, sf_dir):
    source = runner.table_stream(spark, sf_dir, "events")
    events = source.selectExpr(*[text.replace(" // ", " div ") for text in _REFRESH])
    merged = stateful.refresh_merge(runner.run_append(events, "refresh"))
    return merged.drop("seq")


_BURST_MS = 300_000
_BURSTS = f"""SELECT *, max(CASE WHEN prev IS NULL OR ts_ms - prev >= {_BURST_MS} THEN ts_ms END) OVER (PARTITION BY workspace ORDER BY ts_ms, event_id) AS session_start
  FROM (SELECT *, lag(ts_ms) OVER (PARTITION BY workspace ORDER BY ts_ms, event_id) AS prev FROM changes WHERE path <> '')"""
_MANIFEST_PATH, _CONFIG_PATH = "path LIKE '%/package.json'", "path = '/w/tsconfig.json'"


_BURST_REPORT = oracle(
        f"""SELECT workspace, session_start, manifests, configs, decision,
            CASE WHEN decision = 'changed' THEN coalesce(m, '') END AS manifest_paths, CASE WHEN decision = 'changed' THEN coalesce(c, '') END AS config_paths
            FROM (SELECT workspace, session_start, count(DISTINCT path) FILTER (WHERE {_MANIFEST_PATH}) AS manifests, count(DISTINCT path) FILTER (WHERE {_CONFIG_PATH}) AS configs,
              CASE WHEN count(DISTINCT path) FILTER (WHERE {_MANIFEST_PATH}) > 3 THEN 'all' ELSE 'changed' END AS decision,
              string_agg(DISTINCT path, ',' ORDER BY path) FILTER (WHERE {_MANIFEST_PATH}) AS m, string_agg(DISTINCT path, ',' ORDER BY path) FILTER (WHERE {_CONFIG_PATH}) AS c
              FROM bursts GROUP BY workspace, session_start) WHERE manifests + configs > 0""",
        "changes",
        bursts=_BURSTS,
    )


def _listed(bursts):
    return bursts.withColumn("manifest_paths", F.array_join("manifest_paths", ",")).withColumn(
        "config_paths", F.array_join("config_paths", ",")
    )


@register("T2_change_bursts", _BURST_REPORT)
def t2(spark, sf_dir):
    events = view(spark, sf_dir, "changes").withColumn("ts", F.timestamp_millis("ts_ms"))
    return _listed(windows.change_bursts(events, "event_id", gap_ms=_BURST_MS, limit=3))


@register("T2_change_bursts_stream", _BURST_REPORT)
def t2_stream(spark, sf_dir):
    # files of a finished table come in any order, so the watermark waits for all of them
    return _listed(
        runner.run_closed(
            _stream(spark, sf_dir, "changes"),
            lambda events: windows.change_bursts_stream(events, gap_ms=_BURST_MS, limit=3, delay="60 days"),
            "changes",
        )
    )


@register(
    "T3_restart_loop_alert",
    oracle(
        """SELECT workspace, event_id, ts_ms, count(*) OVER (PARTITION BY workspace ORDER BY ts_ms RANGE BETWEEN 600000 PRECEDING AND CURRENT ROW) AS recent,
           count(*) OVER (PARTITION BY workspace ORDER BY ts_ms RANGE BETWEEN 600000 PRECEDING AND CURRENT ROW) > 5 AS degraded FROM (SELECT 'w' AS workspace, event_id, ts_ms // 200 AS ts_ms FROM changes)""",
        "changes",
    ),
)
def t3(spark, sf_dir):
    restarts = view(spark, sf_dir, "changes").select(
        F.lit("w").alias("workspace"), "event_id", F.timestamp_millis(F.expr("ts_ms div 200")).alias("ts")
    )
    return windows.restart_loops(restarts, "event_id")


@register(
    "T3_restart_loop_alert_stream",
    oracle(
        """SELECT workspace, CAST(start AS BIGINT) AS window_start_ms, count(*) AS restarts FROM (SELECT 'w' || (event_id % 2) AS workspace, unnest(range(ts_ms // 200 // 60000 - 9, ts_ms // 200 // 60000 + 1)) * 60000 AS start FROM changes)
           GROUP BY workspace, start HAVING count(*) > 5""",
        "changes",
    ),
)
def t3_stream(spark, sf_dir):
    restarts = _stream(spark, sf_dir, "changes").select(
        F.expr("'w' || (event_id % 2)").alias("workspace"), F.timestamp_millis(F.expr("ts_ms div 200")).alias("ts")
    )
    # files of a finished table come in any order, so the watermark waits for all of them
    found = windows.restart_loops_stream(restarts, "60 days")
    return runner.run_updates(found, "restarts", ["workspace", "window_start_ms"])


_GRADUATED = """SELECT key, ts_ms, seq, CASE WHEN n <= 3 AND ts_ms - first < 2000 THEN 'stale_revalidating' ELSE 'unverified' END AS state
  FROM (SELECT *, row_number() OVER (PARTITION BY key, run ORDER BY ts_ms, seq) AS n, min(ts_ms) OVER (PARTITION BY key, run) AS first
    FROM (SELECT *, count(*) FILTER (WHERE outcome <> 'unknown') OVER (PARTITION BY key ORDER BY ts_ms, seq) AS run FROM compressed) WHERE outcome = 'unknown')"""
# checks come minutes apart in the events table; time runs faster here so that both bounds matter
_COMPRESSED = "SELECT key, ts_ms // 10000 AS ts_ms, seq, outcome FROM checks"


@register("T4_unknown_graduation", oracle(_GRADUATED, "checks", compressed=_COMPRESSED))
def t4(spark, sf_dir):
    checks = view(spark, sf_dir, "checks").selectExpr("key", "ts_ms div 10000 AS ts_ms", "seq", "outcome")
    return freshness.unknown_graduation(checks, "key", bucket_ms=60_000)


@register("T4_unknown_graduation_stream", oracle(_GRADUATED, "checks", compressed=_COMPRESSED))
def t4_stream(spark, sf_dir):
    checks = _stream(spark, sf_dir, "checks").selectExpr("key", "ts_ms div 10000 AS ts_ms", "seq", "outcome")
    landed = runner.run_append(checks, "graduation")
    return freshness.unknown_graduation(landed, "key", bucket_ms=60_000)


@register(
    "T5_manual_refresh_coalesce",
    oracle(
        """SELECT m.name, m.ts_ms, m.seq, CASE WHEN EXISTS (SELECT 1 FROM fetches f WHERE f.name = m.name AND (f.ts_ms < m.ts_ms OR (f.ts_ms = m.ts_ms AND f.seq < m.seq)) AND m.ts_ms - f.ts_ms < 10000) THEN 'store' ELSE 'registry' END AS served_from
           FROM manual m""",
        "requests",
        manual="SELECT name, ts_ms // 300 AS ts_ms, seq, succeeds FROM requests WHERE manual",
        fetches="""--recursive
          SELECT name, ts_ms, seq FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts_ms, seq) AS n FROM manual WHERE succeeds) WHERE n = 1
          UNION ALL SELECT name, ts_ms, seq FROM (SELECT m.name, m.ts_ms, m.seq, row_number() OVER (PARTITION BY m.name ORDER BY m.ts_ms, m.seq) AS n
            FROM fetches f JOIN manual m ON m.name = f.name AND m.succeeds AND m.ts_ms - f.ts_ms >= 10000) WHERE n = 1""",
    ),
)
def t5(spark, sf_dir):
    manual = _stream(spark, sf_dir, "requests").where("manual").selectExpr("name", "ts_ms div 300 AS ts_ms", "seq", "succeeds")
    return stateful.manual_refresh_coalesce(runner.run_append(manual, "coalesce"))


_RATE_SQL = "SELECT ts_ms // 100000000 * 1000 AS second_ms, manual, count(*) AS requests FROM requests GROUP BY 1, 2 HAVING count(*) > CASE WHEN manual THEN 5 ELSE 20 END"


def _rate_input(frame):
    """Time runs faster here, so that a second holds several requests."""
    return frame.select(F.timestamp_millis(F.expr("ts_ms div 100000000 * 1000")).alias("ts"), "manual")


@register("T6_request_rate_violations", oracle(_RATE_SQL, "requests"))
def t6(spark, sf_dir):
    found = registry.request_rate_violations(_rate_input(view(spark, sf_dir, "requests")))
    return found.select(F.unix_millis("window_start").alias("second_ms"), "manual", "requests")


@register("T6_request_rate_violations_stream", oracle(_RATE_SQL, "requests"))
def t6_stream(spark, sf_dir):
    stream = _rate_input(_stream(spark, sf_dir, "requests")).withWatermark("ts", "60 days")
    found = registry.request_rate_violations(stream)
    table = runner.run_updates(found, "rates", ["window_start", "manual"])
    return table.select(F.unix_millis("window_start").alias("second_ms"), "manual", "requests")


_LOG_KEY = "CASE WHEN detail = 'error' THEN 'warn:' || request || ':' || specifier || ':' || detail ELSE 'debug:' || request || ':' || specifier END"


@register("T7_log_dedupe", oracle(f"SELECT DISTINCT {_LOG_KEY} AS key FROM logs", "logs"))
def t7(spark, sf_dir):
    lines = _stream(spark, sf_dir, "logs")
    kind = F.when(F.col("detail") == "error", "warn").otherwise("debug")
    keyed = lines.withColumn(
        "key", windows.log_key(kind, F.col("request"), F.col("specifier"), F.col("detail"))
    )
    return runner.run_append(windows.log_dedupe(keyed.select("ts", "key"), "60 days"), "logs").select("key")


_FEED_SIZES = "brotli_bytes // 3000"


_FEED = oracle(
    f"""SELECT identity, seq, brotli_bytes FROM (SELECT *, lag(brotli_bytes) OVER (PARTITION BY identity ORDER BY ts_ms, seq) AS previous FROM
          (SELECT file_name AS identity, ts_ms, event_id AS seq, {_FEED_SIZES} AS brotli_bytes FROM cost_history WHERE NOT imprecise AND event_id % 10 <> 3)) WHERE previous IS NULL OR previous <> brotli_bytes""",
    "cost_history",
)


def _feed_items(frame):
    return frame.selectExpr(
        "file_name AS identity",
        "ts_ms",
        "event_id AS seq",
        "'ready' AS status",
        "CAST(NULL AS STRING) AS error",
        # a stage nobody has classified, and one that passes
        "CASE WHEN imprecise THEN array(named_struct('stage', 'timeout')) WHEN event_id % 10 = 3 THEN array(named_struct('stage', 'strange')) ELSE array() END AS diagnostics",
        "CAST(NULL AS STRING) AS unmeasured_stage",
        *[f"brotli_bytes div 3000 AS {size}" for size in ("raw_bytes", "minified_bytes", "gzip_bytes", "brotli_bytes", "zstd_bytes")],
        *[name for name in ("ts", runner.CLOCK) if name in frame.columns],
    )


@register("T8_history_feed", _FEED)
def t8(spark, sf_dir):
    def fed(events):
        items = _feed_items(events)
        durable = history.durable_items(items.where(~F.col(runner.CLOCK))).unionByName(items.where(runner.CLOCK))
        return feed.history_feed(durable, "identity", list(V.SIZES), "60 days")

    return runner.run_closed(_stream(spark, sf_dir, "cost_history"), fed, "feed").select("identity", "seq", "brotli_bytes")


@register("T8_history_changes", _FEED)
def t8_table(spark, sf_dir):
    durable = history.durable_items(_feed_items(view(spark, sf_dir, "cost_history")))
    return history.history_changes(durable, ["identity"], "seq", list(V.SIZES)).select("identity", "seq", "brotli_bytes")


_PARTIALS = (
    "'/m' || (user_id % 30) || '/package.json' AS manifest_path",
    "event_id % 7 AS position",
    "CASE WHEN event_id % 11 = 0 THEN 'other' ELSE 'dep' || (event_id % 7) END AS name",
    "'dependencies' AS section",
    "CASE event_type WHEN 'error' THEN 'unavailable' WHEN 'click' THEN 'loading' ELSE 'ready' END AS status",
    "event_id AS seq",
    # rows of one user and hundred events are one message; each seventh message is final
    "event_id // 100 AS message",
    "(event_id // 100 % 7 = 0) AS final",
)


@register(
    "T9_indexed_partials",
    f"""WITH p AS (SELECT {', '.join(_PARTIALS)} FROM events),
        kept AS (SELECT * FROM p WHERE message >= coalesce((SELECT max(message) FROM p q WHERE q.final AND q.manifest_path = p.manifest_path), -1)),
        firsts AS (SELECT manifest_path, position, min_by(name, seq) AS name FROM kept GROUP BY ALL)
        SELECT manifest_path, position, name, 'dependencies' AS section, CASE WHEN status = 'loading' THEN 'unavailable' ELSE status END AS status FROM
        (SELECT k.manifest_path, k.position, k.name, max_by(k.status, k.seq) AS status FROM kept k JOIN firsts f USING (manifest_path, position, name) GROUP BY ALL)""",
)
def t9(spark, sf_dir):
    events = runner.table_stream(spark, sf_dir, "events")
    partials = events.selectExpr(*[text.replace(" // ", " div ") for text in _PARTIALS])
    shape = StructType.fromDDL(windows.PARTIALS)
    said = upsert.MergedTable(spark, scratch_path(spark, "partials"), shape, ["manifest_path"])
    merged = upsert.run_merged(partials, said, scratch_path(spark, "partials-state"), windows.compact_partials, windows.merge_partials)
    return windows.shown_partials(merged)


@register(
    "T10_stale_revalidation_worklist",
    oracle(
        """SELECT *, 1 AS attempt FROM claims UNION ALL
           SELECT *, 2 AS attempt FROM claims WHERE CAST(substr(identity, 2) AS BIGINT) % 3 = 0""",
        "requests", "fingerprints", "current_files",
        checked="""SELECT identity, CASE WHEN absent THEN CASE WHEN c.path IS NULL THEN 1 WHEN NOT readable THEN 4 ELSE 2 END WHEN c.path IS NULL THEN 3 WHEN NOT readable THEN 4
             WHEN f.len = c.len AND f.modified_millis = c.modified_millis THEN 1 WHEN f.content_hash = c.content_hash THEN 1 ELSE 2 END AS severity
             FROM fingerprints f LEFT JOIN current_files c ON c.path = f.path""",
        worst="SELECT identity, CASE max(severity) WHEN 4 THEN 'unknown' WHEN 3 THEN 'gone' WHEN 2 THEN 'stale' ELSE 'fresh' END AS freshness FROM checked GROUP BY identity",
        claims="""SELECT DISTINCT 'i' || (seq % 900) AS identity, workspace, document, seq // 500 AS generation FROM requests
             WHERE 'i' || (seq % 900) IN (SELECT identity FROM worst WHERE freshness IN ('stale', 'gone'))""",
    ),
)
def t10(spark, sf_dir):
    checked = freshness.stale_measurements(
        view(spark, sf_dir, "fingerprints"), view(spark, sf_dir, "current_files")
    )
    worst = freshness.worst_freshness(checked, ["identity"])
    sites = _stream(spark, sf_dir, "requests").selectExpr(
        "'i' || (seq % 900) AS identity", "workspace", "document", "seq div 500 AS generation", "ts"
    )
    # a later check: two thirds of the identities have been measured again since
    later = worst.withColumn("freshness", F.when(F.expr("substr(identity, 2) % 3 = 0"), F.col("freshness")).otherwise("fresh"))
    claims = jobs.revalidation_claims(
        sites, view(spark, sf_dir, "fingerprints"), view(spark, sf_dir, "current_files"), ["identity"], later, "60 days"
    )
    return runner.run_append(claims, "worklist")


@register(
    "T11_superseded_requests",
    oracle("SELECT workspace, document, max(request_id) AS current_request, count(*) AS requests FROM requests GROUP BY workspace, document", "requests"),
)
def t11(spark, sf_dir):
    stream = _stream(spark, sf_dir, "requests").select("workspace", "document", "request_id")
    return runner.run_updates(windows.current_requests(stream), "requests", ["workspace", "document"])
