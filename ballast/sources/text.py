"""Manifests, rule files, tool logs, budget files and stylesheet references."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast import vocabulary as V
from ballast.functions import specifiers as S
from ballast.operators.budgets import positive_budget
from ballast.session import mapped_arrow, spread

LOG_LEVELS = ["ERROR", "WARN", "INFO", "DEBUG"]


def _newlines_before(text: Column, position: Column) -> Column:
    head = F.substring(text, F.lit(1), position)
    return (F.length(head) - F.length(F.replace(head, F.lit("\n")))).cast("long")


def manifest_dependencies(manifests: DataFrame) -> DataFrame:
    """Dependency entries of the four sections; string versions only. Bad
    JSON gives no row. `manifests` has a `json` column besides its keys."""
    keys = [name for name in manifests.columns if name != "json"]
    shape = "struct<" + ",".join(f"{name}:map<string,variant>" for name in V.MANIFEST_SECTIONS) + ">"
    sections = F.array(
        *[
            F.struct(F.lit(name).alias("section"), F.col(f"_doc.{name}").alias("entries"))
            for name in V.MANIFEST_SECTIONS
        ]
    )
    valid = spread(manifests.where(F.try_parse_json("json").isNotNull()).select(*keys, "json"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in valid.schema.fields]
    places = mapped_arrow(valid, _placed, ", ".join([*fields, "_places array<struct<section:string,name:string,line:int>>"]))
    listed = (
        places.withColumn("_doc", F.from_json("json", shape))
        .withColumn("_section", F.explode(sections))
        .select(*keys, "_places", "_section.section", F.explode("_section.entries").alias("name", "_value"))
        .where(F.schema_of_variant("_value") == "STRING")
    )
    placed = F.filter(
        "_places", lambda place: (place["section"] == F.col("section")) & (place["name"] == F.col("name"))
    )
    return (
        listed.withColumn("line", F.try_element_at(placed, F.lit(1))["line"].cast("long"))
        .select(*keys, "section", "name", F.col("_value").cast("string").alias("version_range"), "line")
    )


# strings, brackets, colons and line ends of a JSON text; everything else does not matter here
_JSON_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:\n]')


def _section_keys(text: str) -> list[tuple[str, str, int]]:
    """section, name and line of the keys of the dependency sections, read token by token."""
    depth = line = said_line = 0
    said = section = ""
    found = []
    for token in _JSON_TOKENS.findall(text):
        if token == "\n":
            line += 1
        elif token in "{[":
            depth += 1
        elif token in "}]":
            depth -= 1
        elif token != ":":
            said, said_line = token, line
        elif depth == 1:
            section = json.loads(said)
        elif depth == 2 and section in V.MANIFEST_SECTIONS:
            found.append((section, json.loads(said), said_line))
    return found


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the places of the keys to batches whose last column is valid JSON text."""
    place = pa.struct([("section", pa.string()), ("name", pa.string()), ("line", pa.int32())])
    for batch in batches:
        places = [
            [{"section": s, "name": n, "line": at} for s, n, at in _section_keys(text)]
            for text in batch.column(batch.num_columns - 1).to_pylist()
        ]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(places, pa.list_(place))], [*batch.schema.names, "_places"]
        )


def dependency_names(dependencies: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct names only."""
    return dependencies.select(*keys, "name").distinct()


def read_ignore_rules(lines: DataFrame) -> DataFrame:
    """Rules of rule files held as rows of `line`."""
    keys = [name for name in lines.columns if name != "line"]
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    kept = lines.withColumn("_text", text).where((F.col("_text") != "") & ~F.col("_text").startswith("#"))
    rule = F.col("_text")
    kind = F.regexp_extract(rule, r"^(package|import|path):", 1)
    return kept.select(
        *keys,
        F.when(kind != "", kind).otherwise("import").alias("kind"),
        F.when(kind != "", F.regexp_replace(rule, r"^(?:package|import|path):", ""))
        .otherwise(rule)
        .alias("pattern"),
    )


def read_ignore_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """S6 from files: the folder of each file and its rules."""
    raw = spark.read.text(paths).select(
        S.parent_folder(F.col("_metadata.file_path")).alias("dir"), F.col("value").alias("line")
    )
    return read_ignore_rules(raw)


def parse_tool_logs(lines: DataFrame, tag: str) -> DataFrame:
    """Level, component and message of structured lines, on batch or stream.

    `tag` is the bracketed name the tool writes first. Other lines drop out.
    """
    pattern = (
        rf"(?i)^\[{tag}\]\s+(\S+)\s+\[({'|'.join(LOG_LEVELS)})\](?:\s+\[([^\]]+)\])?\s+(.+)$"
    )
    text = F.trim(F.col("line"))
    component = F.regexp_extract(text, pattern, 3)
    keys = [name for name in lines.columns if name != "line"]
    return lines.where(text.rlike(pattern)).select(
        *keys,
        F.regexp_extract(text, pattern, 1).alias("logged_at"),
        F.lower(F.regexp_extract(text, pattern, 2)).alias("level"),
        F.when(component != "", component).alias("component"),
        F.regexp_extract(text, pattern, 4).alias("message"),
    )


def budgets_from_json(documents: DataFrame, nested_under: str | None = None) -> DataFrame:
    """Per-import and per-file budgets of configuration documents.

    Budgets sit under `budgets`, or under `<nested_under>.budgets`. Malformed
    JSON fails the job; a value that is not a positive number is no budget.
    """
    keys = [name for name in documents.columns if name != "json"]
    parsed = documents.withColumn("_doc", F.parse_json("json"))
    found = F.try_variant_get("_doc", "$.budgets", "variant")
    if nested_under:
        found = F.coalesce(found, F.try_variant_get("_doc", f"$.{nested_under}.budgets", "variant"))

    def number(name: str) -> Column:
        value = F.try_variant_get("_budgets", f"$.{name}", "variant")
        numeric = ~F.schema_of_variant(value).isin("STRING", "BOOLEAN", "VOID")
        return positive_budget(F.when(numeric, F.try_variant_get("_budgets", f"$.{name}", "double")))

    return parsed.withColumn("_budgets", found).select(
        *keys,
        number("perImportBrotliBytes").alias("per_import_brotli_bytes"),
        number("perFileBrotliBytes").alias("per_file_brotli_bytes"),
    )


def percent_decoded(text: Column) -> Column:
    """Valid percent escapes become bytes, everything else stays; NULL where the
    bytes are not UTF-8."""
    shielded = F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    decoded = F.try_url_decode(shielded)
    return F.when(~decoded.contains("�") | text.contains("�"), decoded)


_URL = r"""(?is)url\(\s*(?:"([^"\n]*)"|'([^'\n]*)'|([^"'()\s]*))\s*\)"""
_IMPORT = r"""(?is)@import\s+(?:url\(\s*)?["']?([^"'()\s;]+)["']?"""
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def css_references(sheets: DataFrame) -> DataFrame:
    """P6 scan: every `url(...)` and `@import` of a stylesheet, as rows."""
    keys = [name for name in sheets.columns if name != "content"]
    body = F.regexp_replace("content", r"(?s)/\*.*?\*/", "")
    rules = F.regexp_replace(body, _IMPORT, "")
    urls = F.transform(
        F.regexp_extract_all(rules, F.lit(_URL), F.lit(0)),
        lambda hit: F.struct(
            F.lit("url").alias("form"),
            F.regexp_replace(hit, r"""(?is)^url\(\s*["']?|["']?\s*\)$""", "").alias("url"),
        ),
    )
    imports = F.transform(
        F.regexp_extract_all(body, F.lit(_IMPORT), F.lit(1)),
        lambda hit: F.struct(F.lit("import").alias("form"), hit.alias("url")),
    )
    return sheets.select(*keys, F.explode(F.concat(urls, imports)).alias("_r")).select(*keys, "_r.*")


def classify_css_references(references: DataFrame, package_files: DataFrame) -> DataFrame:
    """What each distinct reference of a stylesheet is.

    `references` has workspace, source_file, form, url; `package_files` has
    workspace, path, len. Existence is a left join on the resolved path.
    """
    url = F.trim(F.col("url"))
    plain = F.regexp_extract(url, r"(?s)\A([^?#]*)", 1)
    inline = (url == "") | url.startswith("#") | F.lower(url).startswith("data:")
    remote = url.startswith("//") | url.rlike(_SCHEME)
    decoded = percent_decoded(plain)
    joined_path = F.concat(S.parent_folder(F.col("source_file")), F.lit("/"), decoded)
    early = (
        F.when((F.col("form") == "import") & F.lower(url).startswith("data:"), "ignored")
        .when(F.col("form") == "import", "external")
        .when(inline, "ignored")
        .when(remote, "external")
        .when(decoded.isNull() | (decoded == ""), "omitted")
        .when(decoded.startswith("/") | ~F.col("source_file").startswith("/"), "omitted")
    )
    staged = references.withColumn("_early", early).withColumn(
        "path", F.when(F.col("_early").isNull(), _normal_path(joined_path))
    )
    known = package_files.select("workspace", "path", F.col("len").alias("asset_bytes")).withColumn(
        "_there", F.lit(True)
    )
    counted = S.classify_asset(F.col("path")).isin("font", "wasm")
    verdict = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(F.col("_there").isNull(), "unreadable")
        .when(F.coalesce(counted, F.lit(False)), "counted")
        .otherwise("uncounted")
    )
    return (
        staged.join(known, ["workspace", "path"], "left")
        .withColumn("reference", verdict)
        .where(F.col("reference") != "ignored")
        .select(
            "workspace",
            "source_file",
            "reference",
            F.coalesce("path", "url").alias("target"),
            "asset_bytes",
        )
        .distinct()
    )


def _normal_path(path: Column) -> Column:
    """`.` and `..` segments taken out."""
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when((part == "..") & (F.size(done) > 1), F.slice(done, F.lit(1), F.size(done) - 1))
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.array_join(parts, "/")
