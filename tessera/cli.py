"""Command line: index a project and ask it questions."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tessera import __version__
from tessera.operators import graph, queries, render
from tessera.plans.index import index_project
from tessera.plans.schema import Index
from tessera.sources.store import NoIndex, Store, project_name

CALLABLE = ("function", "method", "arrow_function")


def _mark(r) -> str:
    return "📤" if r.is_export else "  "


def _print_all(lines) -> None:
    for line in lines:
        print(line)


def cmd_index(spark: SparkSession, a: argparse.Namespace) -> None:
    s = index_project(spark, a.path, a.name, a.home, a.verbose)
    print(f"Indexed {s['files']} files ({s['errors']} errors) in {s['elapsed']:.1f}s: {s['symbols']} symbols, {s['imports']} imports, {s['calls']} calls, {s['deps']} deps")


def cmd_stats(index: Index, a: argparse.Namespace) -> None:
    s = queries.stats(index).first()
    print(f"\n📊 {a.project}")
    for label, n in (("Files:", s.files), ("Symbols:", s.symbols), ("Imports:", s.imports), ("Calls:", s.calls), ("Deps:", s.deps)):
        print(f"   {label:<8} {n}")
    print("\n   Symbol kinds:")
    _print_all(f"     {r.kind:<18} {r.cnt:>5}" for r in queries.kind_counts(index).collect())
    print("\n   Top imports:")
    _print_all(f"     {r.source_path:<45} {r.cnt:>3}" for r in queries.top_imports(index).collect())


def cmd_symbols(index: Index, a: argparse.Namespace) -> None:
    rows = queries.find_symbols(index, a.name).collect()
    if not rows:
        return print(f"No symbols matching '{a.name}'")
    print(f"\n🔍 {len(rows)} symbol(s) matching '{a.name}':\n")
    for r in rows:
        parent = f"  [{r.parent_symbol}]" if r.parent_symbol else ""
        print(f"  {_mark(r)} {r.kind:<16} {r.name:<28} {r.rel_path}:{r.line_start}{parent}" + (f"\n     → {r.signature}" if r.signature else ""))


def cmd_file(index: Index, a: argparse.Namespace) -> None:
    rows = queries.symbols_in_file(index, a.path).collect()
    if not rows:
        return print(f"No symbols found in '{a.path}'")
    print(f"\n📄 {rows[0].rel_path} — {len(rows)} definition(s):\n")
    for r in rows:
        print(f"  L{r.line_start:>4}  {r.kind:<16} {r.name:<30} {'[exp]' if r.is_export else ''}" + (f" ← {r.parent_symbol}" if r.parent_symbol else ""))
        if r.signature:
            print(f"         → {r.signature}")


def cmd_imports(index: Index, a: argparse.Namespace) -> None:
    rows = queries.imports_of_symbol(index, a.name).collect()
    if not rows:
        return print(f"No files import '{a.name}'")
    print(f"\n📥 {len(rows)} file(s) import '{a.name}':\n")
    for r in rows:
        alias = f" as {r.alias_name}" if r.alias_name else ""
        print(f"  {r.importer}:{r.line}  ← {r.source_path} ({r.import_type}{alias})" + (f" → {r.resolved_path}" if r.resolved_path else ""))


def cmd_used_by(index: Index, a: argparse.Namespace) -> None:
    rows = queries.used_by(index, a.module).collect()
    if not rows:
        return print(f"No files import from '{a.module}'")
    print(f"\n📥 {len(rows)} file(s) import from '{a.module}':\n")
    for r in rows:
        print(f"  {r.importer}")
        if r.symbols:
            print(f"    imports: {r.symbols}")


def cmd_list(index: Index, a: argparse.Namespace) -> None:
    rows = queries.list_symbols(index, a.kind, a.exported).collect()
    what = (f"kind={a.kind}" if a.kind else "all kinds") + (", exported" if a.exported else "")
    print(f"\n📋 {len(rows)} symbols ({what}):\n")
    _print_all(f"  {_mark(r)} {r.kind:<16} {r.name:<30} {r.rel_path}:{r.line_start}" for r in rows)


def cmd_callers(index: Index, a: argparse.Namespace) -> None:
    rows = queries.callers(index, a.name).collect()
    if not rows:
        return print(f"No callers found for '{a.name}'")
    print(f"\n📞 {len(rows)} call site(s) → '{a.name}':\n")
    _print_all(f"  {r.rel_path}  [{f'{r.caller_name}()' if r.caller_name else '(top-level)'}]" for r in rows)


def cmd_callees(index: Index, a: argparse.Namespace) -> None:
    first = queries.symbol_by_name(index, a.name).first()
    if first is None:
        return print(f"No symbol '{a.name}'")
    if first.kind not in CALLABLE:
        return print(f"'{a.name}' ({first.kind}) is not callable — no callee list available")
    names = [r.callee_name for r in queries.callees(index, first.id).collect()]
    if not names:
        return print(f"No outbound calls for '{a.name}'")
    print(f"\n📤 '{a.name}' calls {len(names)} unique function(s):\n")
    _print_all("".join(f"  {n:<30}" for n in names[i : i + 4]) for i in range(0, len(names), 4))


def cmd_chain(index: Index, a: argparse.Namespace) -> None:
    rows = graph.call_chain(index, a.name, a.depth).collect()
    if not rows:
        return print(f"No call chain found for '{a.name}'")
    print(f"\n🔗 Call chain: {a.name}()\n")
    for r in rows:
        indent = "  " * (r.depth + 1)
        print(f"{indent}{r.node}()")
        _print_all(f"{indent}  → {n}()" for n in r.neighbours[:5])


def cmd_graph(index: Index, a: argparse.Namespace) -> None:
    print(render.text(render.dependency_diagram(index, a.target, a.direction, a.depth) if a.type == "deps" else render.call_diagram(index, a.target, a.depth)))


def cmd_deps(index: Index, a: argparse.Namespace) -> None:
    down = a.direction == "downstream"
    rows = (graph.downstream if down else graph.upstream)(index, a.path, a.depth).collect()
    if not rows:
        return print(f"No dependencies found for '{a.path}'")
    print(f"\n📦 Dependencies ({a.direction}) for '{a.path}':\n")
    for r in rows:
        indent = "  " * r.depth
        print(f"{indent}{r.node}")
        _print_all(f"{indent}  {'→' if down else '←'} {n}" for n in r.neighbours)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description="A code knowledge base for TypeScript and JavaScript projects.")
    top.add_argument("--version", action="version", version=f"tessera {__version__}")
    top.add_argument("--home", default=None, help="folder of the stored indexes (default: ~/.tessera)")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, *positional: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=run.__name__)
        p.set_defaults(run=run)
        for x in positional:
            p.add_argument(x)
        if run is not cmd_index:
            p.add_argument("--project", default=None, help="project name (default: this folder's name)")
        return p

    p = add("index", cmd_index)
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--name", default=None)
    p.add_argument("--verbose", "-v", action="store_true")
    add("stats", cmd_stats)
    add("symbols", cmd_symbols, "name")
    add("file", cmd_file, "path")
    add("imports", cmd_imports, "name")
    add("used-by", cmd_used_by, "module")
    p = add("list", cmd_list)
    p.add_argument("--kind", default=None)
    p.add_argument("--exported", action="store_true")
    add("callers", cmd_callers, "name")
    add("callees", cmd_callees, "name")
    add("chain", cmd_chain, "name").add_argument("--depth", type=int, default=3)
    for name, run, target in (("graph", cmd_graph, "target"), ("deps", cmd_deps, "path")):
        p = add(name, run, target)
        p.add_argument("--direction", choices=("downstream", "upstream"), default="downstream")
        p.add_argument("--depth", type=int, default=3)
        if run is cmd_graph:
            p.add_argument("--type", choices=("deps", "calls"), default="deps")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.master("local[*]").appName("tessera").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    if a.run is cmd_index:
        cmd_index(spark, a)
        return 0
    a.project = a.project or project_name(".")
    store = Store(spark, a.home)
    try:
        index = store.read(a.project)
    except NoIndex:
        known = store.projects()
        print(f"No index found for '{a.project}'." + (f"\nIndexed projects: {', '.join(known)}" if known else "") + "\nRun: tessera index <project-path>", file=sys.stderr)
        return 1
    a.run(index, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
