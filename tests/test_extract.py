"""The extractor: symbols, imports and calls of small sources."""

import pytest

from tessera.operators.extract.extract import extract_source

SOURCE = """
import React, { useState } from 'react';
import type { Feature } from "@/features/types";

export interface Params {
  ridge: string;
}

export function compute(ridge: string): Params {
  const result = helper(ridge);
  return result;
}

function helper(input: string): Params {
  return { input };
}

export default class Manager extends Base implements Other {
  flyTo(params: Params): void {
    this.map.go(params).then(x => done(x));
  }
}
"""


def get(source, path="a.ts", **more):
    return extract_source(path, source.encode(), **more)


def names(source, *fields):
    return [tuple(s[f] for f in fields) for s in get(source)["symbols"]]


def calls(source):
    return [(c["caller_symbol_name"], c["name"]) for c in get(source)["call_edges"]]


def test_whole_file():
    r = get(SOURCE)
    assert (r["language"], r["lines"], r["bytes"], r["error"]) == ("typescript", 22, len(SOURCE), None)
    got = [(s["name"], s["kind"], s["line_start"], s["line_end"], s["signature"], s["is_export"], s["is_default_export"], s["parent_symbol"], s["enclosing_type"]) for s in r["symbols"]]
    assert got == [
        ("Params", "interface", 5, 7, "interface Params", True, False, None, None),
        ("compute", "function", 9, 12, "compute(ridge: string): : Params", True, False, "compute", "function"),
        ("result", "variable", 10, 10, None, True, False, "compute", "function"),
        ("helper", "function", 14, 16, "helper(input: string): : Params", False, False, "helper", "function"),
        ("Manager", "class", 18, 22, "class Manager", True, True, "Manager", "class"),
        ("flyTo", "method", 19, 21, "flyTo(params: Params): : void", True, False, "Manager", "class"),
    ]
    assert [(i["symbol_name"], i["import_type"], i["source_path"], i["line"], i["is_type_import"]) for i in r["imports"]] == [
        ("React", "default", "react", 2, False), ("useState", "named", "react", 2, False), ("Feature", "named", "@/features/types", 3, True),
    ]
    assert calls(SOURCE) == [("compute", "helper"), ("flyTo", "then"), ("flyTo", "go"), ("flyTo", "done")]


@pytest.mark.parametrize(("path", "language"), [("x.tsx", "typescriptreact"), ("x.js", "typescript"), ("x.d.ts", "typescript"), (".tsx", "typescript"), ("x.TSX", "typescript")])
def test_language(path, language):
    assert extract_source(path, b"")["language"] == language


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("const f = async (a) => g(a);", [("f", "arrow_function", "f(a)", False)]),
        ("const f = x => x, y = 1", [("f", "arrow_function", "f()", False), ("y", "variable", None, False)]),
        ("async function f<T>(a: T = d()) {}", [("f", "function", "f(a: T = d())", True)]),
        ("function* g() { let a }", [("g", "function", "g()", False), ("a", "variable", None, False)]),
        ("const { a, b: [c] } = f()", [("{ a, b: [c] }", "variable", None, False)]),
        ("for (const x of xs) {} for (let i = 0; i < 1; i++) {}", [("i", "variable", None, False)]),
        ("const o = { m() {}, async n() {}, get p() { return 1 }, q: () => 1 }", [("o", "variable", None, False), ("m", "method", "m()", False), ("n", "method", "n()", True), ("p", "method", "p()", False)]),
        ("type T = { f(): void } | U\nenum E { A }\nconst enum F { B }", [("T", "type_alias", None, False), ("E", "enum", None, False), ("F", "enum", None, False)]),
        ("abstract class A { f(): void {} abstract g(): void }", [("f", "method", "f(): : void", False)]),
        ("function f(a: string): void;\nfunction f(a: any) {}", [("f", "function", "f(a: any)", False)]),
        ("export default function () { const a = 1 }", [("a", "variable", None, False)]),
        ("const C = () => { return <div>{items.map(i => <A key={i} />)} it's</div> }\nlet z", [("C", "arrow_function", "C()", False), ("z", "variable", None, False)]),
        ("const a: (x: number) => void = f, b = 2", [("a", "variable", None, False), ("b", "variable", None, False)]),
        ("const r = /[/\"]/.test(s)\nconst t = `a ${`b ${c}`} d`\nconst u = a / b / c", [("r", "variable", None, False), ("t", "variable", None, False), ("u", "variable", None, False)]),
    ],
)
def test_symbols(source, want):
    assert names(source, "name", "kind", "signature", "is_async") == want


def test_scopes():
    source = "class A { m() { const x = 1; function f() { const y = 1 } } }\nfunction o() { function* g() { let z } }"
    assert names(source, "name", "parent_symbol", "enclosing_type") == [
        ("A", "A", "class"), ("m", "A", "class"), ("x", "A", "class"), ("f", "f", "function"), ("y", "f", "function"), ("o", "o", "function"), ("g", "o", "function"), ("z", "o", "function"),
    ]


def test_exports():
    source = "export const a = () => { const b = 1 }\nconst c = 1\nexport { c }\nexport * from 'x'\nexport namespace N { const d = 1 }"
    assert names(source, "name", "is_export") == [("a", True), ("b", True), ("c", False), ("d", True)]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("const f = () => g()", []),
        ("g()", []),
        ("function f() { a(b(c)).d(e()) }", [("f", "d"), ("f", "a"), ("f", "b"), ("f", "e")]),
        ("function f() { new X(a()); f()(); x[i](); super.m(); import('y'); y?.z(); q?.(); t`x`; g<T>(1); h!() }", [("f", "a"), ("f", "f"), ("f", "m"), ("f", "z"), ("f", "q"), ("f", "t"), ("f", "g")]),
        ("function f() { function g() { h() } g() }", [("f", "h"), ("f", "g"), ("g", "h")]),
        ("class A { m() { if (a()) { b() } else return c() } }", [("m", "a"), ("m", "b"), ("m", "c")]),
        ("function f() { return <A x={g()}>{h()} text()</A> }", [("f", "g"), ("f", "h")]),
    ],
)
def test_calls(source, want):
    assert calls(source) == want


def test_imports():
    source = "import './a'\nimport * as n from \"b\"\nimport d, { x as y, type Z } from 'c'\nimport('e')\nimport q = require('r')"
    assert [(i["symbol_name"], i["alias_name"], i["source_path"], i["import_type"]) for i in get(source)["imports"]] == [
        ("", None, "./a", "side_effect"), ("n", None, "b", "namespace"), ("d", None, "c", "default"), ("x", "y", "c", "named"), ("Z", None, "c", "named"), ("", None, "", "side_effect"),
    ]
    assert "namespace" not in {i["import_type"] for i in get(source, namespace_imports=False)["imports"]}


@pytest.mark.parametrize("source", ["", "{", "}", "function", "function f(", "class {", "`${", "<div", "const", "export", "import", "export default", "((((", "a ? b : <", "\x00￾", "const a = <T,>(x: T) => x", "class A { x", "type T", "enum", "'", "/*"])
def test_broken_sources_never_fail(source):
    assert extract_source("a.tsx", source.encode())["error"] is None


def test_too_deep_is_an_error():
    assert extract_source("a.ts", b"(" * 50_000 + b")" * 50_000)["error"] == "nested too deeply"
