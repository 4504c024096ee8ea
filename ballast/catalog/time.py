"""Histories and latencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballast import vocabulary as V
from ballast.adapters import table, view
from ballast.catalog import register
from ballast.catalog.sql import kilo_text, oracle
from ballast.operators import compare, history
from ballast.plans import jobs
from ballast.sources import sinks

KEY = ["workspace", "file_name"]
_ORDER = "PARTITION BY workspace, file_name ORDER BY ts_ms, event_id"


def _history(spark, sf_dir):
    return view(spark, sf_dir, "cost_history")


@register(
    "J5_previous_measurement",
    oracle(
        """SELECT c.event_id, h.ts_ms AS previous_ts_ms, h.brotli_bytes AS previous_brotli_bytes FROM
           (SELECT * FROM cost_history WHERE event_id % 3 = 0) c ASOF LEFT JOIN (SELECT * FROM cost_history WHERE event_id % 3 <> 0) h
           ON c.workspace = h.workspace AND c.file_name = h.file_name AND c.ts_ms > h.ts_ms""",
        "cost_history",
    ),
)
def j5(spark, sf_dir):
    rows = _history(spark, sf_dir)
    found = history.previous_measurement(
        rows.where("event_id % 3 = 0"), rows.where("event_id % 3 <> 0"), KEY, ["brotli_bytes"]
    )
    return found.select("event_id", "previous_ts_ms", "previous_brotli_bytes")


_DELTAS = f"""SELECT *, brotli_bytes - previous AS delta_bytes, CASE WHEN previous IS NOT NULL THEN CASE WHEN brotli_bytes >= previous THEN '+' ELSE '-' END
    || {kilo_text('abs(brotli_bytes - previous)')} || ' br vs previous' || CASE WHEN imprecise OR was_imprecise THEN ', against an upper bound' ELSE '' END END AS delta_label
  FROM (SELECT *, lag(brotli_bytes) OVER ({_ORDER}) AS previous, lag(imprecise) OVER ({_ORDER}) AS was_imprecise FROM cost_history)"""


@register(
    "W2_history_delta",
    oracle("SELECT event_id, previous AS previous_brotli_bytes, delta_bytes, delta_label FROM deltas", "cost_history", deltas=_DELTAS),
)
def w2(spark, sf_dir):
    deltas = history.history_delta(_history(spark, sf_dir), KEY, "event_id")
    return deltas.select("event_id", "previous_brotli_bytes", "delta_bytes", "delta_label")


_SIZED = "SELECT workspace, file_name, event_id, ts_ms, brotli_bytes // 3000 AS coarse FROM cost_history"
_CHANGES = f"SELECT * FROM (SELECT *, lag(coarse) OVER ({_ORDER}) AS previous FROM sized) WHERE previous IS NULL OR previous <> coarse"


def _sized(spark, sf_dir):
    return _history(spark, sf_dir).selectExpr(*KEY, "event_id", "ts_ms", "brotli_bytes div 3000 AS coarse")


@register("W3_history_change_only", oracle(f"SELECT event_id, coarse FROM ({_CHANGES})", "cost_history", sized=_SIZED))
def w3(spark, sf_dir):
    changed = history.history_changes(_sized(spark, sf_dir), KEY, "event_id", ["coarse"])
    return changed.select("event_id", "coarse")


@register(
    "W3_history_latest",
    oracle(
        f"""SELECT workspace, file_name, event_id, coarse FROM (SELECT *, row_number() OVER (PARTITION BY workspace, file_name ORDER BY ts_ms DESC, event_id DESC) AS n
            FROM ({_CHANGES})) WHERE n = 1""",
        "cost_history", sized=_SIZED,
    ),
)
def w3_latest(spark, sf_dir):
    changed = history.history_changes(_sized(spark, sf_dir), KEY, "event_id", ["coarse"])
    return history.latest_per_identity(changed, KEY, "event_id").select(*KEY, "event_id", "coarse")


_CAPPED = "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY workspace ORDER BY ts_ms DESC, event_id DESC) AS INTEGER) AS age_rank FROM cost_history) WHERE age_rank <= 20"


@register("W4_history_cap", oracle("SELECT workspace, event_id, age_rank FROM capped", "cost_history", capped=_CAPPED))
def w4(spark, sf_dir):
    capped = history.history_cap(_history(spark, sf_dir), ["workspace"], "event_id", V.FILE_HISTORY_ROWS)
    return capped.select("workspace", "event_id", "age_rank")


_SERIES = """SELECT event_id, CAST(dense_rank() OVER (PARTITION BY workspace ORDER BY first_rank) AS INTEGER) AS series,
    CAST(floor((CASE WHEN newest = oldest THEN 452.0::DOUBLE ELSE (ts_ms - oldest) / (newest - oldest)::DOUBLE * 904 END + 28) * 1000) AS BIGINT) AS x_milli,
    CAST(floor((192 - brotli_bytes / peak::DOUBLE * 164) * 1000) AS BIGINT) AS y_milli
  FROM (SELECT *, min(ts_ms) OVER (PARTITION BY workspace) AS oldest, max(ts_ms) OVER (PARTITION BY workspace) AS newest,
    greatest(max(brotli_bytes) OVER (PARTITION BY workspace), 1) AS peak, min(age_rank) OVER (PARTITION BY workspace, file_name) AS first_rank FROM capped)"""


def _milli(name):
    return F.floor(F.col(name) * 1000).cast("long").alias(f"{name}_milli")


@register("W9_history_series", oracle(_SERIES, "cost_history", capped=_CAPPED))
def w9(spark, sf_dir):
    points = history.history_series(_history(spark, sf_dir), "event_id")
    return points.select("event_id", "series", _milli("x"), _milli("y"))


@register(
    "Q6_history_report",
    oracle(
        f"""SELECT d.workspace, d.file_name, d.brotli_bytes, d.import_count, d.delta_label, s.series, s.x_milli FROM
            (SELECT *, row_number() OVER (PARTITION BY workspace, file_name ORDER BY ts_ms DESC, event_id DESC) AS n FROM deltas) d
            LEFT JOIN ({_SERIES}) s ON s.event_id = d.event_id WHERE n = 1""",
        "cost_history", capped=_CAPPED, deltas=_DELTAS,
    ),
)
def q6(spark, sf_dir):
    rows = jobs.history_report(_history(spark, sf_dir), "event_id")
    return rows.select(*KEY, "brotli_bytes", "import_count", "delta_label", "series", _milli("x"))


@register(
    "A21_latency_summary",
    """SELECT event_type, n AS samples, max(CASE WHEN r = n // 2 THEN millis END) AS p50_millis, max(CASE WHEN r = (n * 95 + 99) // 100 - 1 THEN millis END) AS p95_millis,
       max(millis) AS max_millis FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY millis) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n
         FROM (SELECT event_type || (user_id % 12) AS event_type, CAST(floor(value * 10) AS BIGINT) AS millis FROM events)) GROUP BY event_type, n HAVING n >= 30""",
)
def a21(spark, sf_dir):
    samples = table(spark, sf_dir, "events").selectExpr(
        "event_type || (user_id % 12) AS event_type", "CAST(floor(value * 10) AS BIGINT) AS millis"
    )
    return compare.latency_summary(samples, ["event_type"])


@register(
    "S11_append_history",
    oracle(
        """SELECT workspace, event_id FROM (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY ts_ms DESC, event_id DESC) AS n FROM cost_history) WHERE n <= 20""",
        "cost_history",
    ),
)
def s11_append(spark, sf_dir):
    rows = _history(spark, sf_dir)
    stored = history.history_cap(rows.where("event_id % 2 = 0"), ["workspace"], "event_id", 20).drop("age_rank")
    merged = sinks.append_history(stored, rows.where("event_id % 2 = 1"), "event_id")
    return merged.select("workspace", "event_id")


_FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workspace, file_name ORDER BY ts_ms DESC, event_id DESC) AS n FROM cost_history WHERE event_id % 2 = 0) WHERE n = 1"


@register(
    "S11_upsert_history",
    oracle(
        """SELECT workspace, file_name, event_id FROM (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY ts_ms DESC, event_id DESC) AS m FROM
             (SELECT * FROM changed UNION ALL SELECT * FROM stored s WHERE (workspace, file_name) NOT IN (SELECT (workspace, file_name) FROM changed))) WHERE m <= 3""",
        "cost_history",
        stored=_FIRST,
        incoming=_FIRST.replace("event_id % 2 = 0", "event_id % 2 = 1 AND user_id_even"),
        changed="""SELECT i.* FROM incoming i LEFT JOIN stored s ON s.workspace = i.workspace AND s.file_name = i.file_name
           WHERE s.event_id IS NULL OR s.brotli_bytes <> i.brotli_bytes""",
    ).replace("AND user_id_even", "AND length(file_name) % 2 = 0"),
)
def s11_upsert(spark, sf_dir):
    rows = _history(spark, sf_dir)
    stored = history.latest_per_identity(rows.where("event_id % 2 = 0"), KEY, "event_id")
    incoming = history.latest_per_identity(
        rows.where("event_id % 2 = 1 AND length(file_name) % 2 = 0"), KEY, "event_id"
    )
    merged = sinks.upsert_history(stored, incoming, KEY, "event_id", limit=3)
    return merged.select(*KEY, "event_id")
