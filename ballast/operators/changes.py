"""Changed lines, refreshed results, insights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballast import vocabulary as V
from ballast.functions import labels
from ballast.functions import quality as Q
from ballast.functions import specifiers as S
from ballast.operators import facts
from ballast.operators import history as H
from ballast.session import ship_package

LINES_PER_BIN = 64


def _changed(base: str | None, current: str | None) -> list[int]:
    """Line numbers of `current` that a longest common subsequence leaves out."""
    before = (base or "").replace("\r\n", "\n").split("\n")
    after = (current or "").replace("\r\n", "\n").split("\n")
    low, high_b, high_a = 0, len(before), len(after)
    while low < min(high_b, high_a) and before[low] == after[low]:
        low += 1
    while min(high_b, high_a) > low and before[high_b - 1] == after[high_a - 1]:
        high_b, high_a = high_b - 1, high_a - 1
    rows, cols = high_b - low, high_a - low
    if cols == 0:
        return []
    codes = {text: code for code, text in enumerate(dict.fromkeys(before[low:high_b] + after[low:high_a]))}
    left = np.array([codes[text] for text in before[low:high_b]], dtype=np.int64)
    right = np.array([codes[text] for text in after[low:high_a]], dtype=np.int64)
    # few differences cost their square, many the product of the lengths
    most = min(MOST_DIFFERENCES, max(16, int((rows * cols) ** 0.5) // 20))
    reach = _reach(left, right, most)
    found = _swept(left, right) if reach is None else _walked(left, right, reach)
    return [low + j for j in found]


#: Differences up to which the frontiers of the walk are kept: 4 bytes times half the square.
MOST_DIFFERENCES = 4_000
_NEVER = np.iinfo(np.int32).max


def _run(left: np.ndarray, right: np.ndarray) -> int:
    """Length of the common start of two code arrays, compared in growing pieces."""
    most, at, size = min(len(left), len(right)), 0, 16
    while at < most:
        end = min(most, at + size)
        other = np.flatnonzero(left[at:end] != right[at:end])
        if len(other):
            return at + int(other[0])
        at, size = end, size * 2
    return most


def _reach(left: np.ndarray, right: np.ndarray, most: int) -> list[np.ndarray] | None:
    """For each number of differences d the least i on each diagonal i - j from which d lead to the ends.

    Entry n of frontier d is diagonal rows - cols - d + n. None if over `most` are needed. Along
    a diagonal the number falls towards the ends, so the frontiers tell it for every point.
    """
    rows, cols = len(left), len(right)
    ends = rows - cols
    back_left, back_right = left[::-1], right[::-1]
    frontiers: list[np.ndarray] = []
    for d in range(most + 1):
        own = np.full(2 * d + 1, _NEVER, np.int32)
        before = frontiers[-1] if frontiers else None
        for n in range(0, 2 * d + 1, 2):
            k = ends - d + n
            if before is None:
                i = rows
            else:
                # entry n of this frontier is entry n - 1 of the one before
                i = _NEVER
                if n < 2 * d and before[n] != _NEVER and before[n] > 0:
                    i = before[n] - 1
                if n > 1 and before[n - 2] != _NEVER and before[n - 2] - (k - 1) > 0:
                    i = min(i, before[n - 2])
                if i == _NEVER:
                    continue
            j = i - k
            own[n] = i - _run(back_left[rows - i :], back_right[cols - j :])
        frontiers.append(own)
        at = d - ends
        if 0 <= at <= 2 * d and own[at] == 0:
            return frontiers
    return None


def _walked(left: np.ndarray, right: np.ndarray, reach: list[np.ndarray]) -> list[int]:
    """The walk of `_swept`, with the differences to go in place of the common lengths."""
    rows, cols = len(left), len(right)
    ends = rows - cols
    d, i, j, changed = len(reach) - 1, 0, 0, []
    while j < cols:
        same = _run(left[i:], right[j:])
        i, j = i + same, j + same
        if j == cols:
            break
        # leaving out a line of `left` comes first, if it is one difference fewer
        n = (i + 1 - j) - ends + d - 1
        if i < rows and 0 <= n < 2 * d - 1 and reach[d - 1][n] <= i + 1:
            i += 1
        else:
            changed.append(j)
            j += 1
        d -= 1
    return changed


def _swept(left: np.ndarray, right: np.ndarray) -> list[int]:
    """Places of `right` that a longest common subsequence leaves out, row by row."""
    rows, cols = len(left), len(right)
    # common[i, j]: length of the common subsequence of left[i:] and right[j:]. Only every
    # `step`-th row is kept; the rows between are made again when the walk gets there.
    step = max(1, int(rows**0.5))

    def above(row: np.ndarray, i: int) -> np.ndarray:
        best = np.zeros(cols + 1, dtype=np.int32)
        reached = np.maximum(row[:-1], row[1:] + (right == left[i]))
        best[:-1] = np.maximum.accumulate(reached[::-1])[::-1]
        return best

    kept, row = {rows: np.zeros(cols + 1, dtype=np.int32)}, np.zeros(cols + 1, dtype=np.int32)
    for i in range(rows - 1, -1, -1):
        row = above(row, i)
        if i % step == 0:
            kept[i] = row
    common: dict[int, np.ndarray] = {}

    def at(i: int) -> np.ndarray:
        if i not in common:
            top = min(rows, (i // step + 1) * step)
            held, below = {top: kept[top]}, kept[top]
            for n in range(top - 1, i // step * step - 1, -1):
                held[n] = below = above(below, n)
            common.clear()
            common.update(held)
        return common[i]

    changed, i, j = [], 0, 0
    while j < cols:
        if i < rows and left[i] == right[j]:
            i, j = i + 1, j + 1
        elif i < rows and at(i)[j + 1] <= at(i + 1)[j]:
            i += 1
        else:
            changed.append(j)
            j += 1
    return changed


def changed_lines(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Changed line numbers of each (base, current) pair, one row per line.

    Equal pairs never reach Python. One pair is one row, so work spreads by rows.
    """
    ship_package(pairs.sparkSession)
    differing = pairs.where(~F.col("base").eqNullSafe(F.col("current"))).select(*keys, "base", "current")
    types = ", ".join(f"`{name}` {differing.schema[name].dataType.simpleString()}" for name in keys)

    def diff(batches):
        for batch in batches:
            found = [_changed(b, c) for b, c in zip(batch["base"], batch["current"])]
            out = batch[keys].assign(line=pd.Series(found, index=batch.index)).explode("line")
            out = out[out["line"].notna()]
            yield out.assign(line=out["line"].astype("int64"))

    return differing.mapInPandas(diff, f"{types}, line long")


def changed_imports(sites: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Sites whose statement covers a changed line.

    Line ranges are cut into bins; sites and lines meet by equality on (file,
    bin), and a bin holds at most a fixed number of distinct lines. A statement inside
    one bin asks that bin, so its site moves once.
    """
    first, last = F.col("stmt_start_line"), F.col("stmt_end_line")
    marks = (
        lines.select(*keys, "line").distinct()
        .withColumn("_bin", F.floor(F.col("line") / LINES_PER_BIN))
        .withColumnRenamed("line", "_line")
    )
    low, high = F.floor(first / LINES_PER_BIN), F.floor(last / LINES_PER_BIN)
    asked, held = sites.where(low == high).withColumn("_bin", low).alias("s"), marks.alias("m")
    meets = F.col("m._line").between(F.col("s.stmt_start_line"), F.col("s.stmt_end_line"))
    for name in (*keys, "_bin"):
        meets = meets & (F.col(f"s.{name}") == F.col(f"m.{name}"))
    inside = asked.join(held, meets, "left_semi").drop("_bin")
    across = sites.where(low != high)
    spans = [*keys, "stmt_start_line", "stmt_end_line"]
    # distinct spans meet the lines; the sites come back by equality
    met = (
        across.select(*spans).distinct().withColumn("_bin", F.explode(F.sequence(low, high)))
        .join(marks, [*keys, "_bin"])
        .where(F.col("_line").between(first, last))
        .select(*spans)
        .distinct()
    )
    return inside.unionByName(across.join(met, spans, "left_semi"))


def merge_refreshed(existing: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed upsert into document state. A failure never replaces a result;
    an update for an unknown key is ignored. `has_result` tells whether a state
    carries a result; the payload columns are those of `updates`."""
    payload = [name for name in updates.columns if name not in keys]
    renamed = updates.select(
        *keys, *[F.col(name).alias(f"_new_{name}") for name in payload], F.lit(True).alias("_hit")
    )
    joined = existing.join(renamed, keys, "left")
    refused = F.col("_new_error").isNotNull() & F.col("has_result")
    taken = F.coalesce(F.col("_hit") & ~refused, F.lit(False))
    kept = [
        F.when(taken, F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name)
        if name in payload
        else F.when(taken, F.lit("ready")).otherwise(F.col("status")).alias("status")
        if name == "status"
        else (F.col("has_result") | taken).alias("has_result")
        if name == "has_result"
        else F.col(name)
        for name in existing.columns
    ]
    return joined.select(*kept, taken.alias("changed"))


def merge_refreshed_documents(existing: DataFrame, updates: DataFrame, document: list[str], position: str) -> DataFrame:
    """J12 in full: the results pushed for each document, merged into its imports.

    `updates` has the document, `position` in the push, `identity` and `specifier`, and the payload.
    The results of a document are keyed by identity where every one of them has one, else all
    of them by specifier; of several for one key the last counts. `insights` of a changed import
    are void and come back NULL.
    """
    aligned = updates.groupBy(*document).agg((F.count_if(F.col("identity").isNull()) == 0).alias("_aligned"))
    key = F.when(F.col("_aligned"), F.col("identity")).otherwise(F.col("specifier"))
    payload = [name for name in updates.columns if name not in (*document, position, "identity", "specifier")]
    latest = (
        updates.join(aligned, document).groupBy(*document, key.alias("_key"))
        .agg(F.max(F.struct(F.col(position).alias("_at"), F.struct(*payload).alias("_row"))).alias("_last"))
        .select(*document, "_key", "_last._row.*")
    )
    keyed = existing.join(aligned, document, "left").withColumn("_key", key).drop("_aligned")
    merged = merge_refreshed(keyed, latest, [*document, "_key"]).drop("_key")
    if "insights" not in existing.columns:
        return merged
    return merged.withColumn("insights", F.when(~F.col("changed"), F.col("insights")))


def module_sharers(parts: DataFrame) -> DataFrame:
    """How many distinct imports of a file and runtime use each module.

    `parts` has workspace, source_file, runtime, identity, module_path, bytes.
    """
    scope = ["workspace", "source_file", "runtime", "module_path"]
    users = parts.select(*scope, "identity").distinct()
    return users.groupBy(*scope).agg(F.count(F.lit(1)).alias("sharers"))


def shared_with(parts: DataFrame, k: int = 3) -> DataFrame:
    """For each import the first k of its modules that another import of the
    same file and runtime uses, in breakdown order, with the number of other
    imports. The other imports themselves are the rows of `parts` for the module;
    no pair of imports is ever formed."""
    scope = ["workspace", "source_file", "runtime", "module_path"]
    joined = parts.join(module_sharers(parts).where(F.col("sharers") > 1), scope)
    identity = ["workspace", "source_file", "runtime", "identity"]
    distinct = joined.groupBy(*identity, "module_path").agg(
        F.max("bytes").alias("bytes"), F.max("sharers").alias("sharers")
    )
    order = Window.partitionBy(*identity).orderBy(F.col("bytes").desc(), "module_path")
    return (
        distinct.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= k)
        .withColumn("other_imports", F.col("sharers") - 1)
        .drop("sharers")
    )


def site_shared_with(sites: DataFrame, k: int = 3, least: int | None = None) -> DataFrame:
    """J10 from sites with `identity` and their `module_breakdown`; the rows of `shared_with` over all
    contributions, from one shuffle of the sites."""
    scope = ["workspace", "source_file", "runtime", "module_path"]
    identity = ["workspace", "source_file", "runtime", "identity"]

    def local(parts):
        users = parts.groupBy(*scope, "identity").agg(F.max("bytes").alias("bytes"))
        counted = users.withColumn("sharers", F.count(F.lit(1)).over(Window.partitionBy(*scope)))
        order = Window.partitionBy(*identity).orderBy(F.col("bytes").desc(), "module_path")
        return (
            counted.where(F.col("sharers") > 1)
            .withColumn("position", F.row_number().over(order))
            .where(F.col("position") <= k)
            .select(*identity, "module_path", "bytes", "position", (F.col("sharers") - 1).alias("other_imports"))
        )

    limit = {} if least is None else {"least": least}
    return facts.by_file(sites, ["identity"], local, lambda parts: shared_with(parts, k), **limit)


def insights(
    sites: DataFrame,
    changed: DataFrame,
    shared: DataFrame,
    budgets: DataFrame,
    previous: DataFrame,
    site_key: str,
) -> DataFrame:
    """The insight list of each ready, measured site, in fixed order:
    change, budget, shared, barrel, history. Replaced as a whole.

    `changed`: site keys with a changed line. `shared`: site key and the text of
    its first shared modules. `previous`: site key and previous_brotli_bytes,
    previous_imprecise.
    """
    marked = changed.select(site_key).distinct().withColumn("_changed", F.lit(True))
    over = Q.over_import_budget(
        F.col("diagnostics"), F.col("unmeasured_stage"), F.col("per_import_brotli_bytes")
    )
    # what a site says by itself comes before the joins, so only that travels
    own = (
        sites.where((F.col("status") == "ready") & Q.is_measured())
        .join(budgets, "workspace", "left")
        .select(
            site_key, "brotli_bytes", F.coalesce("shared_bytes", F.lit(0)).alias("shared_bytes"),
            over.alias("_over"), (F.col("syntax") == "star_reexport").alias("_barrel"),
            Q.is_durable(F.col("diagnostics"), F.col("unmeasured_stage")).alias("_durable"),
            Q.is_imprecise(F.col("diagnostics")).alias("_imprecise"),
        )
    )
    joined = (
        own.join(marked, site_key, "left")
        .join(shared.select(site_key, "shared_text"), site_key, "left")
        .join(previous, site_key, "left")
    )
    size = labels.format_bytes(F.col("brotli_bytes"))
    over = F.col("_over")
    delta = F.col("brotli_bytes") - F.col("previous_brotli_bytes")
    durable = F.col("_durable")
    imprecise = F.col("_imprecise") | F.coalesce("previous_imprecise", F.lit(False))
    items = F.array(
        F.when(F.col("_changed"), F.concat(F.lit("changed: +"), size, F.lit(" br"))),
        F.when(over, F.concat(F.lit("over budget: "), size, F.lit(" br"))),
        F.when(
            F.col("shared_bytes") > 0,
            F.concat(
                F.lit("shared: "),
                F.coalesce("shared_text", F.lit("outside the module breakdown")),
                F.lit("; "),
                labels.format_bytes(F.col("shared_bytes")),
            ),
        ),
        F.when(F.col("_barrel"), "barrel"),
        F.when(
            durable & (delta != 0),
            F.concat(
                F.lit("history: "),
                H.delta_label(F.col("brotli_bytes"), F.col("previous_brotli_bytes"), imprecise),
            ),
        ),
    )
    listed = F.filter(items, lambda item: item.isNotNull())
    return joined.select(site_key, listed.alias("insights")).where(F.size("insights") > 0)


def shared_text(shared: DataFrame, keys: list[str]) -> DataFrame:
    """The names of the at most three shared modules of an import."""
    named = shared.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("position", S.basename(F.col("module_path")).alias("name")))).alias("_l")
    )
    return named.select(*keys, F.array_join("_l.name", ", ").alias("shared_text"))
