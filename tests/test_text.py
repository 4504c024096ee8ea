"""Source text, manifests, rule files, stylesheets."""

import os

from pyspark.sql import functions as F

from ballast.sources import files, script, text, tree

MODULE = """
import React, { useMemo, type ReactNode } from "react";
import * as z from "zod";
import type { Foo } from "type-only";
export { format as formatDate } from "date-fns/format";
export * from "lodash-es";
const lazy = import("uuid");
const ignored = import(name);
// import x from "commented"
/* import y from "blocked"
 */
const s = "import q from 'in-string'";
import {
  a,
  b as c, // note
  default as d,
} from 'multi';
import {} from 'empty'; import { type Z } from 'only-types'
import type from "named-type";
import rel from "./rel"; import fs from "node:fs"
"""


def found(spark, path, content):
    frame = spark.createDataFrame([(path, content)], "path string, content string")
    rows = script.extract_imports(script.script_regions(frame)).orderBy("region_no", "stmt_no", "import_kind")
    return [(r.specifier, r.import_kind, r.syntax, list(r.named), r.runtime, r.line) for r in rows.collect()]


def test_module_statements(spark):
    assert found(spark, "a.tsx", MODULE) == [
        ("react", "default", "static", [], "component", 1),
        ("react", "named", "static", ["useMemo"], "component", 1),
        ("zod", "namespace", "static", [], "component", 2),
        ("date-fns/format", "named", "reexport", ["format"], "component", 4),
        ("lodash-es", "namespace", "star_reexport", [], "component", 5),
        ("uuid", "dynamic", "dynamic", [], "component", 6),
        ("multi", "named", "static", ["a", "b", "default"], "component", 12),
        ("empty", "namespace", "static", [], "component", 17),
        ("named-type", "default", "static", [], "component", 18),
    ]


HARD = r"""#!/usr/bin/env node
const q = /["'`]/; import a1 from "a1";
const d = x / 2; const e = "s" / 3 / "import z from 'no'";
if (x) /'/.test(y); import a2 from 'a2'
const t = `a ${ b ? `nested ${ {x: `}`}.x } '` : "}" } import no from "no"`;
import a3, { "string name" as sn, type T, type as tt, type as, type as as z, default as dd } from "a3";
export { x as "a-b", y } from "a4"; export * as "ns" from "a5"; export type { Q } from "no"; export type * from "no";
export { local }
import a6 from
   /* c */ "a6" with { type: "json" };
obj.import("no"); obj?.import("no"); import.meta.url; import("a7").then(); import(`a8`, {with: {}}); import(`a${b}`); import(name);
import x = require("no");
export const f = (a) => { return /import b from "no"/g };
export default function () {} import "a9";
import type, { k } from "a10"; import type D from "no"; import type from from "no"; import * as ns from "a11"; import d12, * as n12 from "a12";
const el = <p>it's</p>; import a13 from "a13";
let z = (a + b) / c; import a14 from "a14"; // '
let w = a[0] / 2; let v = {a: 1} / 2; i++ / 2; import a15 from "a15"; let u = "\"import no from 'no'";
"""


def test_statements_in_hard_syntax(spark):
    got = [(s, kind, syntax, names, line) for s, kind, syntax, names, _, line in found(spark, "a.tsx", HARD)]
    assert got == [
        ("a1", "default", "static", [], 1), ("a2", "default", "static", [], 3),
        ("a3", "default", "static", [], 5), ("a3", "named", "static", ["default", "string name", "type"], 5),
        ("a4", "named", "reexport", ["x", "y"], 6), ("a5", "namespace", "star_reexport", [], 6), ("a6", "default", "static", [], 8),
        ("a7", "dynamic", "dynamic", [], 10), ("a8", "dynamic", "dynamic", [], 10), ("a9", "namespace", "static", [], 13),
        ("a10", "default", "static", [], 14), ("a10", "named", "static", ["k"], 14), ("a11", "namespace", "static", [], 14),
        ("a12", "default", "static", [], 14), ("a12", "namespace", "static", [], 14), ("a13", "default", "static", [], 15),
        ("a14", "default", "static", [], 16), ("a15", "default", "static", [], 17),
    ]


def test_one_large_row_group_is_dealt_out(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(200).selectExpr("'f' || id || '.ts' AS path", "'import a from \"p' || id || '\";' AS content").coalesce(1).write.parquet(path)
    sites = script.extract_imports(script.script_regions(spark.read.parquet(path)))
    assert sites.count() == 200 and sites.rdd.getNumPartitions() > 1


def test_component_regions(spark):
    svelte = '\n<script lang="ts">\n  import { writable } from "svelte/store";\n</script >\n'
    assert found(spark, "C.svelte", svelte) == [
        ("svelte/store", "named", "static", ["writable"], "component", 2)
    ]
    astro = (
        '---\nimport serverOnly from "server-lib";\n---\n<script>\nimport clientOnly from "client-lib";\n</script>\n'
        '<script is:inline>\nimport ignored from "ignored-lib";\n</script>\n'
    )
    assert found(spark, "P.astro", astro) == [
        ("server-lib", "default", "static", [], "server", 1),
        ("client-lib", "default", "static", [], "client", 4),
    ]
    assert found(spark, "E.astro", "---\n---\n<h1>Hi</h1>\n") == []
    assert found(spark, "E.astro", "---\r\n---\r\n<h1>Hi</h1>\r\n") == []


def test_long_texts_do_not_overflow_the_matcher(spark):
    body = "const s = '" + "x" * 200_000 + "';\n/*" + "y\n" * 50_000 + "*/\nimport a from 'tail';\n"
    assert [row[0] for row in found(spark, "big.ts", body)] == ["tail"]


def test_scan_rules(spark):
    deep = "/".join(["d"] * 64)
    rows = [
        ("src/A.TSX",), ("src/node_modules/a.ts",), ("dist/a.js",), ("distx/a.js",), ("a.mjs",), ("a.vue",),
        (f"{deep}/a.ts",), (f"{deep}/d/a.ts",), ("build.ts",),
    ]
    frame = spark.createDataFrame(rows, "path string")
    # the depth limit is a parameter; without one no depth is left out
    limited = files.scan_sources(frame, max_depth=64).collect()
    wanted = ["src/A.TSX", "distx/a.js", "a.vue", f"{deep}/a.ts", "build.ts"]
    assert sorted(row.path for row in limited) == sorted(wanted)
    assert sorted(row.path for row in files.scan_sources(frame).collect()) == sorted([*wanted, f"{deep}/d/a.ts"])


def test_reading_a_tree(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.ts").write_text('import x from "x"\n')
    (tmp_path / "src" / "b.txt").write_text("no")
    (tmp_path / "src" / "node_modules" / "c.ts").write_text("no")
    sources = files.read_source_tree(spark, str(tmp_path))
    assert [(row.path, row.content) for row in sources.select("path", "content").collect()] == [
        ("src/a.ts", 'import x from "x"\n')
    ]
    printed = files.read_fingerprints(spark, str(tmp_path)).collect()
    assert len(printed) == 3 and all(row.content_hash is not None for row in printed)
    os.remove(tmp_path / "src" / "b.txt")
    os.symlink("nowhere", tmp_path / "src" / "b.txt")
    assert len(files.read_fingerprints(spark, str(tmp_path), ["node_modules"]).collect()) == 1
    gone = tree.with_content(spark.createDataFrame([("src/x.ts", 1)], "path string, len long"), str(tmp_path))
    assert gone.collect() == [("src/x.ts", 1, None)]


def test_pruned_folders_are_never_listed(tmp_path):
    for folder in ("src/a/b", "src/node_modules/p/deep", "lib/c", "lib/dist/d"):
        (tmp_path / folder).mkdir(parents=True)
        for n in range(3):
            (tmp_path / folder / f"f{n}.ts").write_text("x")

    def visited(folders, filters=()):
        plan = tree.TreeReader({"path": str(tmp_path), "pruned": '["node_modules", "dist"]', "folders": str(folders)})
        list(plan.pushFilters(list(filters)))
        found, seen = [], []
        for piece in plan.partitions():
            task = tree.TreeReader({"path": str(tmp_path), "pruned": '["node_modules", "dist"]'})
            task.prefix = plan.prefix
            found += [path for batch in task.read(piece) for path in batch.column(0).to_pylist()]
            seen += task.listed
        return sorted(found), set(plan.listed) | set(seen)

    wanted = sorted(f"{folder}/f{n}.ts" for folder in ("src/a/b", "lib/c") for n in range(3))
    for folders in (1, 2, 5, 50):
        found, seen = visited(folders)
        assert found == wanted
        assert seen == {"", "src/", "src/a/", "src/a/b/", "lib/", "lib/c/"}
    found, seen = visited(4, [tree.StringStartsWith(("path",), "lib/c/f1")])
    assert found == ["lib/c/f1.ts"] and seen == {"", "lib/", "lib/c/"}


def test_a_large_folder_is_several_tasks(spark, tmp_path, monkeypatch):
    for n in range(50):
        (tmp_path / f"f{n}").write_text("x")
    monkeypatch.setattr(tree, "FOLDER_FILES", 8)
    plan = tree.TreeReader({"path": str(tmp_path), "folders": "4"})
    pieces = plan.partitions()
    assert len(pieces) == 7
    assert sorted(p for piece in pieces for b in plan.read(piece) for p in b.column(0).to_pylist()) == sorted(f"f{n}" for n in range(50))
    listed = tree.list_tree(spark, str(tmp_path)).where(F.col("path").startswith("f1"))
    assert listed.count() == 11 and listed.where("path = 'f17'").count() == 1


def test_manifest_sections(spark):
    good = '{\n  "dependencies": {\n    "react": "^19.0.0",\n    "ignored": 1\n  },\n  "devDependencies": {\n    "typescript": "6.0.3"\n  }\n}'
    frame = spark.createDataFrame([("a", good), ("b", "{")], "manifest_path string, json string")
    rows = text.manifest_dependencies(frame).orderBy("line").collect()
    assert [(r.section, r.name, r.version_range, r.line) for r in rows] == [
        ("dependencies", "react", "^19.0.0", 2), ("devDependencies", "typescript", "6.0.3", 6),
    ]


def test_rule_files_and_logs(spark, tmp_path):
    (tmp_path / "rules").write_text("# c\n\npackage:moment\nimport:@i/*\npath:src/g/**\nodd:thing\nplain\n")
    rules = text.read_ignore_files(spark, str(tmp_path / "rules"))
    assert sorted((r.kind, r.pattern) for r in rules.collect()) == [
        ("import", "@i/*"), ("import", "odd:thing"), ("import", "plain"), ("package", "moment"), ("path", "src/g/**"),
    ]
    lines = spark.createDataFrame(
        [("[t] 2024 [warn] [net] slow  reply",), ("[t] 2024 [INFO] ready",), ("[u] 2024 [INFO] x",), ("junk",)],
        "line string",
    )
    got = [(r.level, r.component, r.message) for r in text.parse_tool_logs(lines, "t").collect()]
    assert sorted(got, key=str) == [("info", None, "ready"), ("warn", "net", "slow  reply")]


def test_malformed_budgets_fail(spark):
    import pytest

    frame = spark.createDataFrame([("{bad",)], "json string")
    with pytest.raises(Exception, match="MALFORMED"):
        text.budgets_from_json(frame).collect()


def test_percent_decoding(spark):
    frame = spark.createDataFrame([("a%20b",), ("a+b",), ("%zz",), ("%ff",), ("%C3%A9",)], "t string")
    assert [r[0] for r in frame.select(text.percent_decoded(F.col("t"))).collect()] == ["a b", "a+b", "%zz", None, "é"]


def test_dependency_lines_follow_the_section(spark):
    from ballast.sources import text

    manifest = """{
  "keywords": ["dependencies"],
  "scripts": {"a": "1"},
  "dependencies": {
    "b": "a",
    "a": "1",
    "q\\"x": "2"
  },
  "devDependencies": {"a": "3"}
}"""
    frame = spark.createDataFrame([("m", manifest)], "path string, json string")
    got = {(r.section, r.name): r.line for r in text.manifest_dependencies(frame).collect()}
    assert got == {("dependencies", "b"): 4, ("dependencies", "a"): 5, ("dependencies", 'q"x'): 6, ("devDependencies", "a"): 8}


def test_exports_of_any_depth(spark):
    from pyspark.sql import functions as F

    from ballast.functions import manifests

    def nested(depth):
        inner = '{"import": {"default": "./m.mjs"}, "require": "./c.js"}'
        for n in range(depth):
            inner = f'{{"k{n}": {inner}}}'
        return f'{{"exports": {{".": {inner}}}}}'

    rows = [(nested(depth),) for depth in range(9)]
    frame = spark.createDataFrame(rows, "json string").withColumn("doc", manifests.parsed(F.col("json")))
    got = {bool(r[0]) for r in frame.select(manifests._exports_point_to(F.col("doc"), F.lit("c.js"), ["require"])).collect()}
    assert got == {True}


def test_equal_texts_are_searched_once(monkeypatch):
    import pyarrow as pa

    from ballast.sources import script as source

    asked, search = [], source.statements
    monkeypatch.setattr(source, "statements", lambda text: asked.append(text) or search(text))
    short, long = "import a, { b } from 'p';\nimport type { T } from 'q';", "//" + "x" * 5000 + "\nexport * from 'r'; import('s')"
    texts = [short, long, "import", short, long, short]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["id", "text"])
    source._found_in_short.cache_clear()
    (out,) = source._lex(iter([batch]))
    assert sorted(asked) == sorted({short, long, "import"})
    got = list(zip(*(out.column(n).to_pylist() for n in ("id", "_no", "specifier", "_start", "_kind", "_names"))))
    of_short = [(0, "p", 0, "default", []), (0, "p", 0, "named", ["b"])]
    of_long = [(0, "r", 1, "namespace", []), (1, "s", 1, "dynamic", [])]
    assert got == [(n, *row) for n, text in enumerate(texts) for row in {short: of_short, long: of_long}.get(text, [])]
    list(source._lex(iter([batch])))
    # the long one is not remembered from batch to batch
    assert len(asked) == 4
