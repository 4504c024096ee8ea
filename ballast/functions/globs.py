"""Glob patterns as regular expressions, built as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIALS = r"([\\.+^$()|\[\]{}?])"


def _stars(escaped: Column) -> Column:
    """`**` crosses folders, `*` does not."""
    marked = F.replace(escaped, F.lit("**"), F.lit("\u0001"))
    single = F.replace(marked, F.lit("*"), F.lit("[^/]*"))
    return F.replace(single, F.lit("\u0001"), F.lit(".*"))


def ignore_glob(pattern: Column) -> Column:
    """Whole-value match; only stars are special."""
    body = _stars(F.regexp_replace(pattern, _SPECIALS, r"\\$1"))
    return F.concat(F.lit(r"(?s)\A(?:"), body, F.lit(r")\z"))


def ignore_path_glob(pattern: Column) -> Column:
    """Path match: a pattern without a leading slash may start after any slash."""
    slashed = F.translate(pattern, "\\", "/")
    body = _stars(F.regexp_replace(slashed, _SPECIALS, r"\\$1"))
    anchor = F.when(slashed.startswith("/"), r"(?s)\A(?:").otherwise(r"(?s)(?:\A|/)(?:")
    return F.concat(anchor, body, F.lit(r")\z"))


def package_glob(pattern: Column) -> Column:
    """Manifest globs: a bare name, or one behind `./`, matches in any folder.
    `?`, classes and `{a,b}` keep their meaning."""
    trimmed = F.regexp_replace(pattern, r"^(?:\./)+", "")
    anywhere = (F.length(trimmed) != F.length(pattern)) | ~trimmed.contains("/")
    text = F.when(anywhere, F.concat(F.lit("**/"), trimmed)).otherwise(trimmed)
    escaped = F.regexp_replace(text, r"([\\.+^$()|])", r"\\$1")
    braces = F.translate(escaped, "{},", "\u0002\u0003\u0004")
    single = F.replace(braces, F.lit("?"), F.lit("[^/]"))
    folders = F.replace(single, F.lit("**/"), F.lit("\u0005"))
    starred = _stars(folders)
    opened = F.replace(starred, F.lit("\u0005"), F.lit("(?:.*/)?"))
    alternated = F.replace(
        F.replace(F.replace(opened, F.lit("\u0002"), F.lit("(?:")), F.lit("\u0003"), F.lit(")")),
        F.lit("\u0004"),
        F.lit("|"),
    )
    return F.concat(F.lit(r"(?s)\A(?:"), alternated, F.lit(r")\z"))
