"""SQL text shared by the oracles."""

from __future__ import annotations

from ballast import vocabulary as V
from ballast.adapters import select_text


def listed(words: list[str]) -> str:
    return ", ".join(f"'{word}'" for word in words)


DURABLE, TRANSIENT = listed(V.DURABLE_STAGES), listed(V.TRANSIENT_STAGES)

# quality columns over `sites`
QUALITY = f"""
SELECT *,
  coalesce(s.status = 'ready', false) AS has_result,
  (raw_bytes IS NOT NULL AND minified_bytes IS NOT NULL AND gzip_bytes IS NOT NULL
     AND brotli_bytes IS NOT NULL AND zstd_bytes IS NOT NULL) AS measured,
  (coalesce(unmeasured_stage IN ({TRANSIENT}), false) OR coalesce(diag1 IN ({TRANSIENT}), false)
     OR coalesce(diag2 IN ({TRANSIENT}), false)) AS transient_,
  (coalesce(unmeasured_stage IN ({DURABLE}), true) AND coalesce(diag1 IN ({DURABLE}), true)
     AND coalesce(diag2 IN ({DURABLE}), true)) AS durable,
  (coalesce(diag1 IN ({DURABLE}), true) AND coalesce(diag2 IN ({DURABLE}), true)) AS diag_durable,
  coalesce(diag1 = 'imprecise_assets', false) AS imprecise
FROM sites s"""

# confidence columns over `quality`
GRADED = """
SELECT *,
  CASE WHEN NOT measured THEN 'low' WHEN NOT side_effects AND diag1 IS NULL AND diag2 IS NULL THEN 'high'
       ELSE 'medium' END AS confidence,
  CASE WHEN NOT measured THEN 'not_measured' ELSE concat_ws(' · ',
       CASE WHEN side_effects THEN 'side_effects' END, least(diag1, diag2),
       CASE WHEN diag1 <> diag2 THEN greatest(diag1, diag2) END) END AS reasons,
  CASE WHEN import_kind <> 'named' THEN '' WHEN n1 = n2 THEN n1 ELSE least(n1, n2) || ',' || greatest(n1, n2) END AS names,
  (measured AND durable AND NOT imprecise) AS budgetable
FROM quality"""

PARTS = """
SELECT *, m1 AS module_path, m1_bytes AS bytes FROM graded
UNION ALL SELECT *, m2 AS module_path, m2_bytes AS bytes FROM graded"""

# report rows over `graded`
REPORT_ROWS = """
SELECT g.workspace, package_name, specifier, replace(source_file, workspace_root || '/', '') AS source_file,
  line + 1 AS line, runtime,
  CASE WHEN has_result THEN minified_bytes END AS minified_bytes,
  CASE WHEN has_result THEN gzip_bytes END AS gzip_bytes,
  CASE WHEN has_result THEN brotli_bytes END AS brotli_bytes,
  CASE WHEN has_result THEN zstd_bytes END AS zstd_bytes,
  CASE WHEN has_result THEN coalesce(shared_bytes, 0) ELSE 0 END AS shared_bytes,
  CASE WHEN has_result THEN confidence ELSE 'unknown' END AS confidence,
  CASE WHEN has_result THEN reasons ELSE '' END AS confidence_reasons,
  CASE WHEN has_result THEN split_part(m1, '/', -1) || ' (' || m1_bytes || ' B), ' || split_part(m2, '/', -1)
       || ' (' || m2_bytes || ' B)' ELSE '' END AS top_modules,
  concat_ws(' · ', warning, CASE WHEN has_result THEN error END,
    CASE WHEN has_result AND shared_bytes > 0 THEN 'Shares ' || shared_bytes || ' B with other imports in this file' END,
    CASE WHEN has_result AND budgetable AND brotli_bytes > per_import_brotli_bytes
         THEN 'Budget exceeded: ' || brotli_bytes || ' B br > ' || per_import_brotli_bytes || ' B br' END,
    CASE WHEN has_result AND (is_cjs OR side_effects OR NOT truly_treeshakeable) THEN 'Conservative estimate' END,
    CASE WHEN has_result AND confidence = 'low' THEN 'Low confidence: ' || reasons END,
    CASE WHEN has_result AND confidence = 'medium' THEN 'Medium confidence: ' || reasons END) AS warning,
  (has_result AND (is_cjs OR side_effects OR NOT truly_treeshakeable)) AS is_conservative,
  coalesce(has_result AND budgetable AND brotli_bytes > per_import_brotli_bytes, false) AS over_budget
FROM graded g LEFT JOIN budgets b ON g.workspace = b.workspace"""

_DERIVED = {
    "quality": (QUALITY, ["sites"]),
    "graded": (GRADED, ["quality"]),
    "parts": (PARTS, ["graded"]),
    "rows_": (REPORT_ROWS, ["graded", "budgets"]),
}


def kilo_text(size: str) -> str:
    """SQL of a byte count as text; the tie rule looks at the exact quotient."""
    q, n = f"({size} / 1000.0::DOUBLE)", f"({size})"
    high = f"({q} * 134217729 - ({q} * 134217729 - {q}))"
    error = f"(({high} * 1000 - {q} * 1000) + ({q} - {high}) * 1000)"
    up = f"(CASE WHEN {n} % 100 > 50 OR ({n} % 100 = 50 AND ({q} * 1000 - {n}) + {error} >= 0) THEN 1 ELSE 0 END)"
    tenths = f"({n} // 100 + {up})"
    return (
        f"CASE WHEN {n} < 1000 THEN {n} || ' B' ELSE ({tenths} // 10) || '.' || ({tenths} % 10) || ' kB' END"
    )


def oracle(query: str, *views: str, **extra: str) -> str:
    """A query with the views it needs as common table expressions."""
    order: list[str] = []
    texts: dict[str, str] = {}

    def need(name: str) -> None:
        if name in texts:
            return
        if name in _DERIVED:
            text, parents = _DERIVED[name]
            for parent in parents:
                need(parent)
        else:
            text = select_text(name)
        texts[name] = text
        order.append(name)

    for name in views:
        need(name)
    for name, text in extra.items():
        texts[name] = text
        order.append(name)
    if not order:
        return query
    clauses = ",\n".join(f"{name} AS ({texts[name]})" for name in order)
    recursive = "RECURSIVE " if any("--recursive" in text for text in texts.values()) else ""
    return f"WITH {recursive}{clauses}\n{query}"
