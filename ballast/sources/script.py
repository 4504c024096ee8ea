"""Script regions of source text, by built-in regexes, and the import statements in them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions import identity
from ballast.functions import specifiers as S
from ballast.session import mapped_arrow, spread
from ballast.sources.statements import Statement, statements

# a `<script>` element: attributes and body
SCRIPT = r"(?is)<script(?=[\s/>])([^>]*)>(.*?)</script(?=[\s/>])[^>]*>"
FRONTMATTER = r"(?s)\A---(?:\r\n|\r|\n)(.*?)(?:\r\n|\r|\n)?(?<=[\r\n])---\r*(?=[\r\n]|\z)"
ATTRIBUTE_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""


def script_regions(files: DataFrame) -> DataFrame:
    """Script regions of each file with runtime, language and first line.

    `files` has path and content besides any keys. One scan and no shuffle: all
    regions of a file are built as one array and exploded. Regexes run for
    component files only; offsets come from the lengths of the text between the
    blocks.
    """
    extension = S.extension(F.col("path"))
    content = F.col("content")
    astro = F.col("_ext") == "astro"
    blocky = F.col("_ext").isin("svelte", "vue", "astro")
    keys = [name for name in files.columns if name != "content"]

    def found(group: int) -> Column:
        return F.when(blocky, F.regexp_extract_all(content, F.lit(SCRIPT), F.lit(group)))

    prepared = (
        files.withColumn("_ext", extension)
        .withColumn("_hits", found(0))
        .withColumn("_attributes", found(1))
        .withColumn("_bodies", found(2))
        .withColumn("_gaps", F.when(blocky, F.split(content, SCRIPT, -1)))
    )

    def region(number, offset, runtime, lang, text, first_line) -> Column:
        return F.struct(
            number.cast("int").alias("region_no"),
            offset.cast("long").alias("offset"),
            runtime.alias("runtime"),
            lang.alias("lang"),
            text.alias("text"),
            first_line.cast("long").alias("first_line"),
        )

    def block(part: Column, number: Column) -> Column:
        lengths = F.zip_with(
            F.slice("_gaps", F.lit(1), number + 1),
            F.slice("_hits", F.lit(1), number + 1),
            lambda gap, hit: F.length(gap) + F.length(hit),
        )
        before = F.aggregate(lengths, F.lit(0), lambda total, n: total + n) - F.length(part["_hits"])
        offset = before + F.length(F.regexp_extract(part["_hits"], r"(?s)\A[^>]*>", 0))
        value = F.lower(
            F.regexp_extract(
                part["_attributes"],
                rf"(?is)(?:^|[\s/]|(?<=[\"']))lang\s*=\s*({ATTRIBUTE_VALUE})(?=[\s/\"']|$)",
                1,
            )
        )
        named = F.regexp_replace(value, r"""^["']|["']$""", "")
        lang = (
            F.when(astro | named.isin("ts", "typescript"), "ts")
            .when(named.isin("tsx", "jsx"), named)
            .otherwise("js")
        )
        processed = F.trim(part["_attributes"]).rlike(rf"(?is)\A(?:src\s*=\s*{ATTRIBUTE_VALUE}\s*)?\z")
        line = _newlines(F.substring(content, F.lit(1), offset))
        runtime = F.when(astro, "client").otherwise("component")
        return F.when(
            ~astro | processed, region(number, offset, runtime, lang, part["_bodies"], line)
        )

    blocks = F.filter(
        F.transform(F.arrays_zip("_hits", "_attributes", "_bodies"), block),
        lambda item: item.isNotNull(),
    )
    front = F.when(
        astro & content.rlike(FRONTMATTER),
        F.array(
            region(
                F.lit(-1),
                F.when(content.rlike(r"\A---\r\n"), 5).otherwise(4),
                F.lit("server"),
                F.lit("ts"),
                F.regexp_extract(content, FRONTMATTER, 1),
                F.lit(1),
            )
        ),
    )
    lang = (
        F.when(F.col("_ext").isin("ts", "mts", "cts"), "ts")
        .when(F.col("_ext").isin("tsx", "jsx"), F.col("_ext"))
        .otherwise("js")
    )
    whole = F.array(region(F.lit(0), F.lit(0), F.lit("component"), lang, content, F.lit(0)))
    regions = F.when(~blocky, whole).when(front.isNotNull(), F.concat(front, blocks)).otherwise(blocks)
    return prepared.select(*keys, F.explode(regions).alias("_r")).select(*keys, "_r.*")


def _newlines(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n")))).cast("long")


_LEXED = "_no int, specifier string, _start long, _end long, _kind string, _syntax string, _names array<string>"


def _kinds(found: Statement) -> Iterator[tuple[str, str, list[str]]]:
    """What a statement imports: (import kind, syntax, names), without what is of types only."""
    form = found.form
    if form == "dynamic":
        yield "dynamic", form, []
        return
    if found.default:
        yield "default", form, []
    bare = form == "static" and not (found.star or found.default or found.names or found.items)
    if found.star or bare:
        yield "namespace", form if form == "static" else "star_reexport", []
    if found.names:
        yield "named", form, found.names


#: Texts whose statements a worker remembers: how many, and up to which length.
_REMEMBERED, _SHORT = 1 << 15, 1024


def _found(text: str) -> list[tuple]:
    """The imports of a text as rows of `_LEXED`."""
    rows, at, line = [], 0, 0
    for number, found in enumerate(statements(text)):
        line += text.count("\n", at, found.start)
        at = found.start
        if not found.type_only and "${" not in found.specifier:
            end = line + text.count("\n", at, found.end)
            rows.extend((number, found.specifier, line, end, *kind) for kind in _kinds(found))
    return rows


_found_in_short = lru_cache(_REMEMBERED)(_found)


def _lex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column is the text; the others are repeated for each import found in it.

    Equal texts of a batch are searched once, and short ones once as long as the worker remembers
    them: source trees hold many copies.
    """
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]
    names = [field.split()[0] for field in _LEXED.split(", ")]
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).dictionary_encode()
        found = [(_found_in_short if len(text) <= _SHORT else _found)(text) for text in texts.dictionary.to_pylist()]
        held = np.array([len(rows) for rows in found], np.int64)
        which = texts.indices.to_numpy(zero_copy_only=False)
        each = held[which]
        # of a row with n imports: the row n times, and the places of its imports in `out`
        rows = np.repeat(np.arange(len(which)), each)
        first = (np.cumsum(held) - held)[which] - (np.cumsum(each) - each)
        places = pa.array(np.arange(len(rows)) + np.repeat(first, each))
        out = [row for of_text in found for row in of_text]
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        taken = batch.select(batch.schema.names[:-1]).take(pa.array(rows))
        yield pa.RecordBatch.from_arrays(
            [*taken.columns, *(pa.array(c, k).take(places) for c, k in zip(columns, kinds, strict=True))],
            [*batch.schema.names[:-1], *names],
        )


def extract_imports(regions: DataFrame, partitions: int | None = None) -> DataFrame:
    """S3: one row per detected import of the runtime packages a region names.

    Statements are found by their tokens (`statements`), so comments, strings, regular
    expressions and nested templates neither hide nor invent one. Type-only statements and
    names are dropped. Regions that name no import never leave the JVM; the others are dealt to
    `partitions` tasks first, by default only where the scan has fewer tasks than the cluster.
    """
    keys = [
        name
        for name in regions.columns
        if name not in ("offset", "lang", "text", "first_line", "runtime", "region_no")
    ]
    named = F.col("text").contains("import") | F.col("text").contains("export")
    searched = regions.where(named).select(*keys, "region_no", "runtime", "first_line", "text")
    searched = searched.repartition(partitions) if partitions else spread(searched)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in searched.schema.fields[:-1]]
    sites = mapped_arrow(searched, _lex, ", ".join([*fields, _LEXED])).where(S.is_runtime_package(F.col("specifier")))
    return sites.select(
        *keys,
        "region_no",
        (F.col("first_line") + F.col("_start")).alias("line"),
        (F.col("first_line") + F.col("_start")).alias("stmt_start_line"),
        (F.col("first_line") + F.col("_end")).alias("stmt_end_line"),
        F.col("_no").alias("stmt_no"),
        "specifier",
        S.package_name(F.col("specifier")).alias("package_name"),
        F.col("_kind").alias("import_kind"),
        F.col("_syntax").alias("syntax"),
        "runtime",
        identity.sorted_names(F.col("_kind"), F.col("_names")).alias("named"),
    )
