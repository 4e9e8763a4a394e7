"""Scanning, configuration, whole index runs, the command line and the driver's queries."""

import json
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.cli import main
from tessera.plans.index import index_project
from tessera.plans.registry import ORACLE_SQL, QUERIES
from tessera.sources.store import NoIndex, Store, project_name
from tessera.sources.tree import all_files, list_tree, read_tree, source_files
from tessera.sources.tsconfig import read_aliases

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def write(root, **files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_scan(tmp_path, spark):
    write(tmp_path, **dict.fromkeys(("src/index.ts", "src/App.tsx", "node_modules/lib.ts", "README.md", ".hidden/secret.ts", "dist/o.ts", "__tests__/_u.ts", "src/.dot.ts", "types.d.ts", "X.TS", "legacy.js", "c.jsx"), "x"))
    want = sorted(["src/index.ts", "src/App.tsx", "__tests__/_u.ts", "src/.dot.ts", "types.d.ts", "legacy.js", "c.jsx"])
    assert sorted(os.path.relpath(p, tmp_path) for p in source_files(str(tmp_path))) == want
    rows = read_tree(spark, str(tmp_path)).collect()
    assert sorted(r.rel_path for r in rows) == want and all(bytes(r.content) == b"x" for r in rows)
    assert sorted(r.path for r in list_tree(spark, str(tmp_path)).collect()) == sorted(all_files(str(tmp_path)))


def test_empty_scan(tmp_path, spark):
    assert read_tree(spark, str(tmp_path)).count() == 0


def test_aliases(tmp_path):
    assert read_aliases(str(tmp_path)) == []
    write(tmp_path, **{"tsconfig.json": json.dumps({"compilerOptions": {"baseUrl": "web", "paths": {"@/*": ["./src/*", "x"], "lib": ["../lib/main"], "none": []}}})})
    assert read_aliases(str(tmp_path)) == [("@", "web/src"), ("lib", "lib/main")]
    write(tmp_path, **{"tsconfig.json": "{ // comment\n}"})
    assert read_aliases(str(tmp_path)) == []


@pytest.mark.parametrize(("path", "name"), [("/Users/me/projects/my-app", "my-app"), ("./relative/path", "path"), ("/foo", "foo")])
def test_project_name(path, name):
    assert project_name(path) == name


def test_index_and_commands(tmp_path, spark, capsys):
    root, home = tmp_path / "app", str(tmp_path / "home")
    write(
        root,
        **{
            "tsconfig.json": json.dumps({"compilerOptions": {"paths": {"@/*": ["./*"]}}}),
            "a.ts": "import { b, c } from '@/lib/b'\nimport './x'\nimport r from 'react'\nexport function a() { b(); c.d() }\n",
            "lib/b.ts": "export function b() { e() }\nexport function b() { e() }\nexport const c = { d() {} }\n",
            "broken.ts": "(" * 20_000,
        },
    )
    stats = index_project(spark, str(root), home=home)
    assert {k: v for k, v in stats.items() if k != "elapsed"} == {"files": 2, "errors": 1, "symbols": 5, "imports": 4, "calls": 4, "deps": 2}
    index = Store(spark, home).read("app")
    imports = [(r.symbol_name, r.resolved_path, r.resolved_file_id) for r in index.imports.orderBy("id").collect()]
    assert imports == [("b", "lib/b.ts", 2), ("c", "lib/b.ts", 2), ("", "./x", None), ("r", None, None)]
    assert [(r.source_file_id, r.target_file_id, r.resolved) for r in index.dependency_edges.orderBy("id").collect()] == [(1, 2, True), (1, 2, True), (1, None, False)]
    calls = [(r.caller_symbol_id, r.callee_name) for r in index.call_edges.orderBy("id").collect()]
    assert calls == [(1, "b"), (1, "d"), (3, "e"), (3, "e")]  # of equal names the last one calls
    index.create_views()
    assert spark.sql("select count(*) from symbols").first()[0] == 5

    def run(*args):
        assert main(["--home", home, *args, "--project", "app"], spark) == 0
        return capsys.readouterr().out

    assert "Symbols: 5" in run("stats")
    assert "1 symbol(s) matching 'A'" in run("symbols", "A")
    assert "L   1  function         b" in run("file", "lib/b")
    assert "a.ts:1  ← @/lib/b (named) → lib/b.ts" in run("imports", "b")
    assert "imports: b, c" in run("used-by", "@/lib")
    assert "5 symbols (all kinds, exported)" in run("list", "--exported")
    assert "lib/b.ts  [b()]" in run("callers", "e")
    assert "'a' calls 2 unique function(s)" in run("callees", "a")
    assert "  a()\n    → b()\n    → d()\n    b()\n      → e()" in run("chain", "a")
    assert "a_ts_0 --> b_ts_1" in run("graph", "a.ts")
    assert "a --> b" in run("graph", "a", "--type", "calls")
    assert "a.ts\n  → lib/b.ts" in run("deps", "a.ts")
    assert "No callers found" in run("callers", "nobody")
    assert main(["--home", home, "stats", "--project", "nope"], spark) == 1
    assert "Indexed projects: app" in capsys.readouterr().err
    assert Store(spark, home).projects() == ["app"]
    with pytest.raises(NoIndex):
        Store(spark, home).read("nope")
    # a second run replaces the first
    (root / "broken.ts").unlink()
    assert index_project(spark, str(root), home=home)["errors"] == 0


def test_empty_project(tmp_path, spark):
    (tmp_path / "none").mkdir()
    stats = index_project(spark, str(tmp_path / "none"), home=str(tmp_path / "home"))
    assert stats["files"] == stats["symbols"] == stats["deps"] == 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_equal_their_sql(name, spark, duck):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want, columns = duck.execute(ORACLE_SQL[name]).df(), sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda x: sorted(map(str, x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry_registers_queries(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    if os.path.isdir(SF):
        assert entry.entry(spark).columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("table", ["symbols", "imports"])
def test_made_index_runs_what_it_needs(table, spark, monkeypatch):
    """Files of one row group are extracted by several tasks, and only files are sorted and numbered, whatever else an index has."""
    from tessera.functions import numbering
    from tessera.plans import samples

    runs, was = [], numbering.stored
    monkeypatch.setattr(numbering, "stored", lambda df, name: runs.append(df.columns) or was(df, name))
    monkeypatch.setattr(samples, "FILES_A_TASK", 20)
    assert samples.sources(spark, SF).rdd.getNumPartitions() > 4
    got = samples.index(spark, SF, table)
    assert len(runs) == 1 and "rel_path" in runs[0]
    ids = [r.id for r in got.select("id").orderBy("id").collect()]
    assert ids == list(range(1, len(ids) + 1)) and ids
