"""Per-key rules that replay the rows of a key in order. They run on landed rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from ballast import vocabulary as V
from ballast.session import ship_package


def refresh_merge(events: DataFrame, held_limit: int | None = None) -> DataFrame:
    """Pushed results merged into document state.

    Events: workspace, document, seq, kind (open / push), generation, identities
    (of an open, joined by newlines), identity, brotli_bytes, error. A push of an
    older generation is dropped; one of a generation not opened yet is held (where
    `held_limit` is given, at most so many per document, oldest out first). An error
    never replaces a size. Output: one row per accepted result.
    """
    schema = "workspace string, document string, generation long, identity string, brotli_bytes long, error string, seq long"

    names = [part.split()[0] for part in schema.split(", ")]

    def replay(key, rows):
        generation, known, held = -1, {}, []
        accepted = []

        def merge(push, seq):
            identity, size, error = push
            if identity not in known or (error is not None and known[identity] is not None):
                return
            known[identity] = size
            accepted.append((*key, generation, identity, size, error, seq))

        for row in rows.sort_values(["seq"], kind="stable").itertuples(index=False):
            if row.kind == "open":
                if row.generation <= generation:
                    continue
                generation = int(row.generation)
                known = {name: None for name in (row.identities or "").split("\n") if name}
                waiting, held = held, []
                for gen, push in waiting:
                    if gen == generation:
                        merge(push, int(row.seq))
                    elif gen > generation:
                        held.append([gen, push])
                continue
            size = None if pd.isna(row.brotli_bytes) else int(row.brotli_bytes)
            error = None if pd.isna(row.error) else row.error
            push = [row.identity, size, error]
            if row.generation == generation:
                merge(push, int(row.seq))
            elif row.generation > generation:
                held.append([int(row.generation), push])
                held = held[-held_limit:] if held_limit else held
        return pd.DataFrame(accepted, columns=names).astype({"brotli_bytes": "Int64"})

    ship_package(events.sparkSession)
    return events.groupBy("workspace", "document").applyInPandas(replay, schema)


def manual_refresh_coalesce(
    requests: DataFrame, cooldown_ms: int = V.REGISTRY_MANUAL_COOLDOWN_MS
) -> DataFrame:
    """T5: a manual refresh sooner than the cooldown after the last fetch of the
    package is answered from the store. Requests: name, ts_ms, seq, succeeds."""
    schema = "name string, ts_ms long, seq long, served_from string"

    def replay(key, rows):
        last, out = None, []
        for row in rows.sort_values(["ts_ms", "seq"], kind="stable").itertuples(index=False):
            cached = last is not None and row.ts_ms - last < cooldown_ms
            if not cached and row.succeeds:
                last = int(row.ts_ms)
            out.append((*key, row.ts_ms, row.seq, "store" if cached else "registry"))
        return pd.DataFrame(out, columns=["name", "ts_ms", "seq", "served_from"])

    ship_package(requests.sparkSession)
    return requests.groupBy("name").applyInPandas(replay, schema)
