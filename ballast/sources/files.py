"""File scans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast import vocabulary as V
from ballast.functions import specifiers as S
from ballast.sources import tree

ABSENT = (1 << 63) - 1


def scan_sources(
    files: DataFrame,
    extensions: list[str] = V.SOURCE_EXTENSIONS,
    pruned: list[str] = V.PRUNED_SOURCE_FOLDERS,
    max_depth: int | None = None,
) -> DataFrame:
    """Source files below a workspace root.

    `files` has `path` relative to the root. Folders deeper than `max_depth` are left out
    where one is given.
    """
    # the filter runs below the projection that makes the path, so it names the path as seldom as it can;
    # with a slash before it, a path without a dot is no extension, and a folder stands between slashes
    rooted = F.concat(F.lit("/"), F.col("path"))
    kept = F.lower(F.substring_index(rooted, ".", -1)).isin(extensions)
    if pruned:
        names = "|".join(re.escape(name) for name in pruned)
        kept = kept & ~rooted.rlike(rf"/(?:{names})/")
    if max_depth is not None:
        kept = kept & (F.size(F.split("path", "/")) - 1 <= max_depth)
    return files.where(kept)


def read_source_tree(
    spark: SparkSession, root: str, extensions: list[str] = V.SOURCE_EXTENSIONS, pruned: list[str] = V.PRUNED_SOURCE_FOLDERS
) -> DataFrame:
    """S1 over a folder tree: path relative to the root, and content as text.

    Pruned folders are not even listed; files of other extensions fall before anything is opened.
    """
    listed = scan_sources(tree.list_tree(spark, root, pruned), extensions, pruned)
    return tree.with_content(listed, root).withColumn("content", F.decode("content", "UTF-8"))


def fingerprint_columns(path: Column, length: Column, millis: Column, content: Column) -> list[Column]:
    """Stat and content hash; unreadable content gives the sentinel."""
    broken = content.isNull()
    return [
        S.slashed(path).alias("path"),
        F.when(broken, F.lit(ABSENT)).otherwise(length).cast("long").alias("len"),
        F.when(broken, F.lit(ABSENT)).otherwise(millis).cast("long").alias("modified_millis"),
        F.when(~broken, F.xxhash64(content)).alias("content_hash"),
    ]


def fingerprint_files(files: DataFrame) -> DataFrame:
    """S9 over a table with path, len, modified_millis and content."""
    return files.select(
        *[name for name in files.columns if name not in ("path", "len", "modified_millis", "content")],
        *fingerprint_columns(
            F.col("path"), F.col("len"), F.col("modified_millis"), F.col("content")
        ),
    )


def read_fingerprints(spark: SparkSession, root: str, pruned: list[str] | tuple = ()) -> DataFrame:
    """S9 over a folder tree; paths are relative to the root. Pruned folders are not listed."""
    return fingerprint_files(tree.with_content(tree.list_tree(spark, root, pruned), root))


def declaration_only(
    package_files: DataFrame, keys: list[str], scan_limit: int | None = None
) -> DataFrame:
    """P10: packages that ship declarations and no runtime source. Where `scan_limit` is
    given, a package of more files gets no such verdict."""
    name = F.lower(F.substring_index("path", "/", -1))
    declares = name.rlike(r"\.d\.[mc]?ts$")
    runs = ~declares & S.extension(F.col("path")).isin(V.RUNTIME_EXTENSIONS)
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    inside = package_files.where(
        ~F.arrays_overlap(folders, F.array(*[F.lit(n) for n in V.PRUNED_PACKAGE_FOLDERS]))
    )
    return (
        inside.groupBy(*keys)
        .agg(
            F.bool_or(declares).alias("has_declaration"),
            F.bool_or(runs).alias("has_runtime"),
            F.count(F.lit(1)).alias("files"),
        )
        .withColumn(
            "declaration_only",
            F.col("has_declaration")
            & ~F.col("has_runtime")
            & (F.lit(True) if scan_limit is None else F.col("files") <= scan_limit),
        )
    )
