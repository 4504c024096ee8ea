"""Which package, rule file or alias applies to a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions import globs, specifiers
from ballast.session import pinned


def _nearest(places: DataFrame, holders: DataFrame, keys: list[str]) -> DataFrame:
    """The deepest ancestor folder of each (keys, folder) that `holders` knows.

    `places` holds distinct (keys, folder); the explode is bounded by path depth
    and the maximum is combined before the shuffle.
    """
    climbed = places.withColumn("dir", F.explode(specifiers.ancestors(F.col("folder"))))
    found = climbed.join(holders, [*keys, "dir"])
    return found.groupBy(*keys, "folder").agg(F.max_by("dir", F.length("dir")).alias("dir"))


def resolve_installed(sites: DataFrame, manifests: DataFrame) -> DataFrame:
    """The nearest installed copy of each imported package.

    `sites` has workspace, path, package_name; `manifests` has workspace, dir (the
    folder that holds `node_modules`), package_name, version. Resolution runs once
    per distinct (folder, package) and is joined back. What was found is pinned, so its size
    is known: where it is small, the sites do not move.
    """
    keys = ["workspace", "package_name"]
    placed = sites.withColumn("folder", specifiers.parent_folder(F.col("path")))
    places = placed.select(*keys, "folder").distinct()
    copies = manifests.groupBy(*keys, "dir").agg(F.max("version").alias("version"))
    nearest = _nearest(places, copies.select(*keys, "dir"), keys).join(copies, [*keys, "dir"])
    resolved = pinned(
        nearest.select(
            *keys,
            "folder",
            F.col("dir").alias("installed_dir"),
            F.coalesce("version", F.lit("unknown")).alias("installed_version"),
        )
    )
    joined = placed.join(resolved, [*keys, "folder"], "left").drop("folder")
    return joined.withColumn(
        "resolution", F.when(F.col("installed_dir").isNull(), "missing").otherwise("installed")
    )


def nearest_ignore_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The folder of the nearest rule file of each file; rule files are not
    merged, the nearest one wins."""
    keys = ["workspace"]
    placed = files.withColumn("folder", specifiers.parent_folder(F.col("path")))
    places = placed.select(*keys, "folder").distinct()
    # pinned, so the files do not move where few folders have rules
    nearest = pinned(_nearest(places, rules.select(*keys, "dir").distinct(), keys))
    return placed.join(nearest.withColumnRenamed("dir", "rule_dir"), [*keys, "folder"], "left").drop(
        "folder"
    )


def ignore_patterns(rules: DataFrame) -> DataFrame:
    """Rules with their pattern as a regular expression."""
    return rules.select(
        F.col("workspace"),
        F.col("dir").alias("rule_dir"),
        "kind",
        "pattern",
        F.when(F.col("kind") == "path", globs.ignore_path_glob(F.col("pattern")))
        .otherwise(globs.ignore_glob(F.col("pattern")))
        .alias("regex"),
    )


def glob_candidates(values: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pairs of a value and a glob of its scope that agree in what the glob says literally.

    A glob is indexed by the text before its first star, or else behind its last one. Of a value
    only the pieces of lengths that occur among the globs of its scope are looked up: at its
    start (for paths also behind each slash) or at its end. A glob of stars alone meets every
    value of its scope, as it must. `values` has workspace, rule_dir, kind and value.
    """
    scope = ["workspace", "rule_dir", "kind"]
    text = F.when(F.col("kind") == "path", F.translate("pattern", "\\", "/")).otherwise(F.col("pattern"))
    head, tail = F.regexp_extract(text, r"(?s)^[^*]*", 0), F.regexp_extract(text, r"(?s)[^*]*$", 0)
    indexed = patterns.select(
        *scope, "regex", F.when(head != "", "head").otherwise("tail").alias("side"), F.when(head != "", head).otherwise(tail).alias("piece")
    ).distinct()
    lengths = indexed.groupBy(*scope).agg(
        *[F.collect_set(F.when(F.col("side") == side, F.length("piece"))).alias(f"_{side}") for side in ("head", "tail")]
    )
    value = F.col("value")
    # where a glob may begin: position 1, and behind slashes where a path has folders
    parts = F.split(value, "/")
    behind = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.length(F.array_join(F.slice(parts, F.lit(1), n - 1), "/")) + F.when(n == 1, 1).otherwise(2)
    )
    starts = F.when(F.col("kind") == "path", behind).otherwise(F.array(F.lit(1)))
    heads = F.flatten(F.transform(starts, lambda at: F.transform("_head", lambda n: F.substring(value, at, n))))
    tails = F.transform("_tail", lambda n: F.right(value, n))

    def sided(side: str, pieces: Column) -> Column:
        return F.transform(F.array_distinct(pieces), lambda piece: F.struct(F.lit(side).alias("side"), piece.alias("piece")))

    asked = values.join(lengths, scope).select(
        *scope, "value", F.explode(F.concat(sided("head", heads), sided("tail", tails))).alias("_p")
    ).select(*scope, "value", "_p.*")
    return asked.join(indexed, [*scope, "side", "piece"]).select(*scope, "value", "regex").distinct()


def apply_ignore_rules(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop every site that a rule of its nearest rule file matches.

    Rules are tested once per distinct value of a rule folder, never per site:
    those without a star by equality, the others where a value has the literal piece
    of the glob (`glob_candidates`), by their expression. What
    matched is taken out of the sites by anti joins. `sites` is read twice, so a
    caller with an expensive source pins it first.
    """
    placed = sites if "rule_dir" in sites.columns else nearest_ignore_rules(sites, rules)
    patterns = ignore_patterns(rules)
    scope = ["workspace", "rule_dir", "kind"]
    columns = {"package": "package_name", "import": "specifier", "path": "path"}
    tested = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.col(column).alias("value"))
            for kind, column in columns.items()
        ]
    )
    values = (
        placed.where(F.col("rule_dir").isNotNull())
        .select("workspace", "rule_dir", F.explode(tested).alias("_v"))
        .select("workspace", "rule_dir", "_v.kind", "_v.value")
        .distinct()
    )
    literal = ~F.col("pattern").contains("*") & (F.col("kind") != "path")
    equal = values.join(
        patterns.where(literal).select(*scope, F.col("pattern").alias("value")).distinct(),
        [*scope, "value"],
        "left_semi",
    )
    globbed = (
        glob_candidates(values, patterns.where(~literal))
        .where(F.rlike(F.col("value"), F.col("regex")))
        .select(*scope, "value")
    )
    # few values match, and three anti joins read them: found once, then kept
    matched = pinned(equal.unionByName(globbed).distinct())
    kept = placed
    for kind, column in columns.items():
        hits = matched.where(F.col("kind") == kind).select(
            "workspace", "rule_dir", F.col("value").alias(column)
        )
        kept = kept.join(hits, ["workspace", "rule_dir", column], "left_anti")
    return kept


def classify_unresolved(unresolved: DataFrame, aliases: DataFrame, files: DataFrame) -> DataFrame:
    """`path_alias` where an alias pattern maps the specifier to an existing
    first-party file, else `not_installed`.

    `aliases` has workspace, prefix, suffix, target_prefix, target_suffix: the
    parts around the star of a pattern and of its target. Only the prefix lengths that
    occur among the patterns of a workspace are looked up, by equality, so a specifier
    is at most as many rows as there are such lengths.
    """
    asked = unresolved.select("workspace", "specifier").distinct()
    lengths = aliases.groupBy("workspace").agg(F.collect_set(F.length("prefix")).alias("_lengths"))
    fitting = F.filter("_lengths", lambda n: n <= F.length("specifier"))
    heads = asked.join(lengths, "workspace").select(
        "workspace", "specifier",
        F.explode(F.transform(fitting, lambda n: F.substring(F.col("specifier"), F.lit(1), n))).alias("prefix"),
    )
    rest: Column = F.substring(
        F.col("specifier"), F.length("prefix") + 1, F.length("specifier")
    )
    star = F.substring(rest, F.lit(1), F.length(rest) - F.length("suffix"))
    mapped = (
        heads.join(aliases, ["workspace", "prefix"])
        .where((F.length(rest) >= F.length("suffix")) & rest.endswith(F.col("suffix")))
        .select(
            "workspace",
            "specifier",
            F.concat("target_prefix", star, "target_suffix").alias("path"),
        )
    )
    first_party = files.where(specifiers.is_first_party(F.col("path"))).select("workspace", "path")
    aliased = (
        mapped.join(first_party, ["workspace", "path"], "left_semi")
        .select("workspace", "specifier")
        .distinct()
        .withColumn("_alias", F.lit(True))
    )
    return (
        unresolved.join(aliased, ["workspace", "specifier"], "left")
        .withColumn("resolution", F.when(F.col("_alias"), "path_alias").otherwise("not_installed"))
        .drop("_alias")
    )
