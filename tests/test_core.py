"""Text functions, queries, graphs, diagrams and resolution over small hand-made tables."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tessera.functions.numbering import in_order, numbered, numbered_within
from tessera.functions.text import ascii_like, base_name, normal_path
from tessera.operators import graph, queries, render, resolve
from tessera.plans.schema import CALL_EDGES, DEPENDENCY_EDGES, FILES, IMPORTS, SYMBOLS, Index


def frame(spark, schema, rows):
    names = schema.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def make(spark, files=(), symbols=(), imports=(), calls=(), deps=()):
    return Index(*(frame(spark, s, r) for s, r in zip((FILES, SYMBOLS, IMPORTS, CALL_EDGES, DEPENDENCY_EDGES), (files, symbols, imports, calls, deps), strict=True)))


@pytest.fixture(scope="module")
def index(spark):
    return make(
        spark,
        [{"id": 1, "path": "/proj/src/a.ts", "rel_path": "src/a.ts", "language": "typescript"}, {"id": 2, "path": "/proj/src/b.ts", "rel_path": "src/b.ts", "language": "typescript"}],
        [
            {"id": 1, "file_id": 1, "name": "foo", "kind": "function", "line_start": 10, "is_export": True},
            {"id": 2, "file_id": 1, "name": "bar", "kind": "function", "line_start": 25, "is_export": False, "parent_symbol": "foo"},
            {"id": 3, "file_id": 2, "name": "baz", "kind": "class", "line_start": 5, "is_export": True},
        ],
        [{"id": 1, "file_id": 1, "symbol_name": "baz", "source_path": "src/b", "import_type": "default", "line": 1}],
        [{"id": 1, "caller_file_id": 1, "caller_symbol_id": 1, "callee_name": "bar"}, {"id": 2, "caller_file_id": 2, "callee_name": "bar"}],
        [{"id": 1, "source_file_id": 1, "target_file_id": 2, "resolved": True}, {"id": 2, "source_file_id": 2, "resolved": False}],
    )


def values(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


def test_lookups(index):
    assert tuple(queries.stats(index).first()) == (2, 3, 1, 2, 2)
    assert values(queries.find_symbols(index, "FOO"), "name") == ["foo"]
    assert values(queries.find_symbols(index, "%ba%"), "name") == ["bar", "baz"]
    assert values(queries.symbols_in_file(index, "a.ts"), "name") == ["foo", "bar"]
    assert values(queries.list_symbols(index, "class"), "name") == ["baz"]
    assert values(queries.list_symbols(index, exported_only=True), "name") == ["baz", "foo"]
    assert values(queries.children_of(index, "foo"), "name") == ["bar"]
    assert values(queries.imports_of_symbol(index, "baz"), "importer") == ["src/a.ts"]
    assert values(queries.callers(index, "bar"), "rel_path", "caller_name") == [("src/a.ts", "foo"), ("src/b.ts", None)]
    assert values(queries.callers(index, "BAR"), "id") == []
    assert values(queries.callees(index, 1), "callee_name") == ["bar"]
    assert values(queries.symbol_by_name(index, "ba_", 1), "id") == [2]
    assert values(queries.dependencies(index, 1), "rel_path") == ["src/b.ts"]
    assert values(queries.dependents(index, 2), "rel_path") == ["src/a.ts"]
    assert values(queries.all_dependencies(index), "source_rel", "target_rel") == [("src/a.ts", "src/b.ts")]
    assert values(queries.kind_counts(index), "kind", "cnt") == [("function", 2), ("class", 1)]


def test_module_falls_back_only_without_exact_hits(spark, index):
    rows = [{"id": i, "file_id": 1, "symbol_name": f"s{i}" if i != 2 else "", "source_path": s} for i, s in enumerate(("lib", "lib/x", "xlib", "", "Lib/Y"), 1)]
    ix = index._replace(imports=frame(spark, IMPORTS, rows))
    assert sorted(values(queries.imports_from_module(ix, "lib"), "id")) == [1, 2, 5]
    assert sorted(values(queries.imports_from_module(ix, "ib"), "id")) == [1, 2, 3, 5]
    assert values(queries.imports_from_module(ix, "none"), "id") == []
    assert values(queries.used_by(ix, "lib"), "importer", "symbols") == [("src/a.ts", "s1, s5")]
    assert values(queries.top_imports(ix, 2), "source_path", "cnt") == [("Lib/Y", 1), ("lib", 1)]


@pytest.mark.parametrize(("text", "pattern", "hit"), [("Foo", "foo", True), ("a_b", "a_b", True), ("axb", "a_b", True), ("É", "é", False), ("a\\b", "a\\b", True), ("a%", "A%", True), ("ab", "a", False), ("!", "!", True)])
def test_ascii_like(spark, text, pattern, hit):
    assert spark.createDataFrame([(text,)], "x string").select(ascii_like(F.col("x"), pattern)).first()[0] is hit


def test_paths(spark):
    import os

    paths = ["a/./b", "a/../b", "../a", "a/../../b", "", ".", "/a//b/", "/../a", "//a", "///a", "a/b/..", "./"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(normal_path(F.col("p")), base_name(F.col("p"))).collect()
    assert [r[0] for r in got] == [os.path.normpath(p) for p in paths]
    assert [r[1] for r in got] == [p.rsplit("/", 1)[-1] for p in paths]


def test_numbers(spark):
    rows = [(f"src/components/{i % 7}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(5)
    want = {row: n for n, row in enumerate(sorted(rows), 1)}
    assert {(r.k, r.v): r.id for r in numbered(df, ["k", "v"]).collect()} == want
    assert {(r.k, r.v): r.n for r in numbered_within(df, "k", ["v"], "n").collect()} == {(k, v): sum(x == k and y <= v for x, y in rows) for k, v in rows}
    assert [(r.v, r.place) for r in in_order(df.orderBy(F.desc("v")), "place").orderBy("place").collect()] == [(299 - i, i + 1) for i in range(300)]
    assert numbered(df.limit(0), ["k", "v"]).count() == 0 == numbered_within(df.limit(0), "k", ["v"], "n").count()


def queue_search(adjacency, start, max_depth, cap=None):
    seen, todo, out = {start}, deque([(start, 0)]), []
    while todo:
        node, depth = todo.popleft()
        if depth >= max_depth:
            continue
        near = adjacency.get(node, [])
        out.append((depth, node, near))
        for other in near[:cap]:
            if other not in seen:
                seen.add(other)
                todo.append((other, depth + 1))
    return out


@pytest.mark.parametrize(("seed", "depth", "cap"), [(1, 3, None), (2, 6, 2), (3, 2, 1), (4, 0, None)])
def test_search_equals_a_queue(spark, seed, depth, cap):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", i) for i in range(40)]
    adjacency = {}
    for s, t, _ in edges:
        adjacency.setdefault(s, []).append(t)
    got = graph.search(spark.createDataFrame(edges, "s string, t string, ord long"), "n0", depth, cap)
    assert [(r.depth, r.node, list(r.neighbours)) for r in got.collect()] == queue_search(adjacency, "n0", depth, cap)


def test_unknown_start_is_emitted(spark, index):
    assert [tuple(r) for r in graph.downstream(index, "nowhere.ts").collect()] == [(0, 1, "nowhere.ts", [])]


def test_call_graph_merges_names(spark, index):
    symbols = [{"id": i, "file_id": i, "name": "foo", "kind": "function"} for i in (1, 2)]
    calls = [{"id": i, "caller_file_id": 1, "caller_symbol_id": c, "callee_name": n} for i, (c, n) in enumerate([(1, "x"), (2, "y"), (2, "x"), (None, "z")], 1)]
    ix = index._replace(symbols=frame(spark, SYMBOLS, symbols), call_edges=frame(spark, CALL_EDGES, calls))
    assert sorted(values(graph.call_graph(ix), "caller", "callee", "ord")) == [("foo", "x", 1), ("foo", "y", 2)]


def test_diagrams(spark, index):
    deps = [{"id": i, "source_file_id": 1, "target_file_id": 2, "resolved": True} for i in (1, 2)]
    ix = index._replace(dependency_edges=frame(spark, DEPENDENCY_EDGES, deps))
    want = ["```mermaid", "graph TD", '    a_ts_0["a.ts"]', '    b_ts_1["b.ts"]', "    a_ts_0 --> b_ts_1", "    a_ts_0 --> b_ts_1", "```"]
    assert render.text(render.dependency_diagram(ix, "src/a.ts")).split("\n") == want
    up = render.text(render.dependency_diagram(ix, "src/b.ts", "upstream", 1)).split("\n")
    assert up == ["```mermaid", "graph TD", '    b_ts_0["b.ts"]', '    a_ts_1["a.ts"]', "    a_ts_1 --> b_ts_0", "    a_ts_1 --> b_ts_0", "```"]
    assert render.text(render.call_diagram(ix, "foo")).split("\n") == ["```mermaid", "graph TD", '    foo["foo()"]', '    bar["bar()"]', "    foo --> bar", "```"]


def test_resolution(spark):
    aliases = [("@", ".")]
    listing = spark.createDataFrame([(f"/p/{x}",) for x in ("lib/terrain.ts", "lib/index.tsx", "foo.ts", "s.css", "x.ts", "both.tsx", "both.js")], "path string")
    sources = ["react", "@/lib/terrain", "@/lib", "@mui/material", "./foo", "./none", "@/s.css", "~/x", "", "@/both", "@/lib/"]
    imports = spark.createDataFrame([(i, 1, s) for i, s in enumerate(sources)], "id long, file_id long, source_path string")
    files = spark.createDataFrame([(f"/p/{x}", i) for i, x in enumerate(("lib/terrain.ts", "lib/index.tsx", "foo.ts", "both.tsx"), 1)], "path string, id long")
    done = resolve.with_file_ids(resolve.resolve(imports, listing, "/p", aliases), files)
    got = {r.source_path: (r.resolved_path, r.resolved_file_id) for r in done.collect()}
    assert got == {
        "react": (None, None), "@/lib/terrain": ("lib/terrain.ts", 1), "@/lib": ("lib/index.tsx", 2), "@mui/material": ("mui/material", None), "./foo": ("./foo.ts", None),
        "./none": ("./none", None), "@/s.css": ("s.css", None), "~/x": (None, None), "": (None, None), "@/both": ("both.tsx", 4), "@/lib/": ("lib/index.tsx", 2),
    }
    edges = {r.id: (r.target_file_id, r.resolved) for r in resolve.edges_of_imports(done).collect()}
    assert set(edges) == {1, 2, 3, 4, 5, 6, 9, 10} and edges[1] == (1, True) and edges[4] == (None, False)


def test_first_alias_wins(spark):
    df = spark.createDataFrame([("@lib/x",), ("@/y",)], "s string")
    got = [r[0] for r in df.select(resolve.apply_aliases(F.col("s"), [("@", "src"), ("@lib", "lib")])).collect()]
    assert got == ["src/lib/x", "src/y"]
