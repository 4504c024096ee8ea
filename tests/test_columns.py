"""Edge cases of the scalar rules on literal rows."""

import pytest
from pyspark.sql import functions as F

from ballast.functions import globs, labels, manifests, quality, specifiers


def values(spark, rows, build):
    frame = spark.createDataFrame([(n, row) for n, row in enumerate(rows)], "n int, v string")
    return [row[0] for row in frame.orderBy("n").select(build(F.col("v"))).collect()]


def test_package_name(spark):
    rows = ["@a/b/c", "@a", "lodash/fp", "react", "@a/"]
    assert values(spark, rows, specifiers.package_name) == ["@a/b", "@a", "lodash", "react", "@a/"]


def test_runtime_packages(spark):
    yes = ["react", "@a/b", "test", "lodash/fp", "a.b"]
    no = [
        "./a", "../a", "/a", "\\\\srv", ".\\a", "..\\a", "C:\\a", "C:/a", "fs", "node:fs", "node:test",
        "http://x", "astro:content", "virtual:x", "$lib", "#x", "@/a", "~/a", "vscode", "electron", "bun:ffi",
    ]
    assert all(values(spark, yes, specifiers.is_runtime_package))
    assert not any(values(spark, no, specifiers.is_runtime_package))


def test_safe_names(spark):
    yes = ["react", "@a/b", "a.b"]
    no = ["", ".", "..", "a/b", "@a", "@/b", "@a/..", "@a/b/c", "a\\b", "a:b", "@a/", "@a/b:c"]
    assert all(values(spark, yes, specifiers.is_safe_package_name))
    assert not any(values(spark, no, specifiers.is_safe_package_name))


def test_package_of_manifest_path(spark):
    rows = [
        "/w/node_modules/a/package.json", "/w/node_modules/x/node_modules/@s/b/package.json",
        "C:\\w\\node_modules\\c\\package.json", "/w/package.json",
    ]
    assert values(spark, rows, specifiers.package_of_manifest_path) == ["a", "@s/b", "c", None]


def test_asset_classes(spark):
    rows = ["a.CSS", "a/b.wasm", "x.eot", "n.node", ".css", "a.js", "css"]
    assert values(spark, rows, specifiers.classify_asset) == [
        "css", "wasm", "font", "unmeasured", None, None, None,
    ]


@pytest.mark.parametrize(
    "pattern,value,expected",
    [
        ("@x/*", "@x/ui", True), ("@x/*", "@x/ui/b", False), ("@x/**", "@x/ui/b", True),
        ("moment", "moment", True), ("moment", "moment2", False), ("a.c", "abc", False), ("*", "", True),
    ],
)
def test_ignore_glob(spark, pattern, value, expected):
    row = spark.createDataFrame([(pattern, value)], "p string, v string")
    assert row.select(F.rlike("v", globs.ignore_glob(F.col("p")))).first()[0] is expected


@pytest.mark.parametrize(
    "pattern,value,expected",
    [
        ("src/generated/**", "C:/repo/src/generated/types.ts", True), ("src/generated/**", "C:/repo/src/app.ts", False),
        ("/abs/*.ts", "/abs/a.ts", True), ("/abs/*.ts", "/x/abs/a.ts", False), ("f*7.ts", "/a/f17.ts", True),
    ],
)
def test_ignore_path_glob(spark, pattern, value, expected):
    row = spark.createDataFrame([(pattern, value)], "p string, v string")
    assert row.select(F.rlike("v", globs.ignore_path_glob(F.col("p")))).first()[0] is expected


@pytest.mark.parametrize(
    "pattern,value,expected",
    [
        ("*.css", "a/b/x.css", True), ("./lib/*.js", "lib/a.js", True), ("./lib/*.js", "x/lib/a.js", True),
        ("lib/*.js", "x/lib/a.js", False), ("lib/**/*.js", "lib/a/b.js", True), ("lib/**/*.js", "lib/b.js", True),
        ("*.{css,scss}", "x.scss", True), ("a?.js", "ab.js", True),
    ],
)
def test_package_glob(spark, pattern, value, expected):
    row = spark.createDataFrame([(pattern, value)], "p string, v string")
    assert row.select(F.rlike("v", globs.package_glob(F.col("p")))).first()[0] is expected


def test_format_bytes_follows_the_double(spark):
    sizes = [0, 999, 1000, 1050, 1150, 1250, 1350, 1450, 12_345, 999_950, 1_000_000]
    rows = spark.createDataFrame([(size,) for size in sizes], "s long")
    got = [row[0] for row in rows.select(labels.format_bytes(F.col("s"))).collect()]

    def exact(size):
        from decimal import ROUND_HALF_UP, Decimal

        if size < 1000:
            return f"{size} B"
        return f"{Decimal(size / 1000).quantize(Decimal('0.1'), ROUND_HALF_UP)} kB"

    assert got == [exact(size) for size in sizes]


def test_age_labels(spark):
    now = 1_000_000_000
    rows = spark.createDataFrame([(now - d,) for d in (-5, 0, 59_999, 60_000, 3_600_000, 86_400_000)], "t long")
    got = [row[0] for row in rows.select(labels.age_label(F.col("t"), F.lit(now))).collect()]
    assert got == ["just now", "just now", "just now", "1m ago", "1h ago", "1d ago"]


def test_native_names(spark):
    def backed(name):
        return '{"optionalDependencies":{"%s":"1"}}' % name

    yes = [backed(n) for n in ("@b/cli-win32-x64", "p-linux-x64-musl", "darwin-arm64")]
    no = [backed(n) for n in ("linux-x64-musl-extra", "x64-linux", "arm", "linux-x64-foo")] + ["{}", "[]", "{bad"]
    check = lambda v: manifests.is_native_backed(manifests.parsed(v))
    assert all(values(spark, yes, check))
    assert not any(values(spark, no, check))


def test_unknown_stage_is_not_durable_and_null_is_not_zero(spark):
    schema = "id int, raw_bytes long, minified_bytes long, gzip_bytes long, brotli_bytes long, zstd_bytes long, unmeasured_stage string, diagnostics array<struct<stage:string>>"
    rows = spark.createDataFrame(
        [
            (0, 0, 0, 0, 0, 0, None, []),
            (1, 1, 1, 1, 1, None, None, []),
            (2, 1, 1, 1, 1, 1, None, [("new_stage",)]),
            (3, 1, 1, 1, 1, 1, None, [("imprecise_assets",)]),
            (4, None, None, None, None, None, "parse", [("parse",)]),
        ],
        schema,
    ).orderBy("id")
    got = rows.select(
        quality.is_measured(),
        quality.is_durable(F.col("diagnostics"), F.col("unmeasured_stage")),
        quality.is_budgetable(F.col("diagnostics"), F.col("unmeasured_stage")),
    ).collect()
    assert [tuple(row) for row in got] == [
        (True, True, True), (False, True, False), (True, False, False), (True, True, False), (False, True, False),
    ]
