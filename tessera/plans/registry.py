"""The queries that the driver runs over its own tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numbering import in_order
from tessera.operators import graph, render, resolve
from tessera.operators import queries as q
from tessera.plans import samples
from tessera.plans.bridge import SQL, bridge, table
from tessera.plans.schema import Index

CALL_START, DEPTH, DEEP = "small ring", 3, 6
SYMBOL = ["id", "name", "kind", "rel_path", "line_start"]
ALIASES = [("@", "src")]


def _over_index(f: Callable[[Index], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(bridge(spark, sf_dir))


def _busiest(edges: DataFrame, key: str) -> int:
    """The id with the most edges, the smallest of equals; 0 if there is none."""
    row = edges.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).first()
    return row[key] if row else 0


def _busy_file(index: Index, key: str) -> str:
    """The path of the file with the most resolved edges."""
    row = index.files.where(F.col("id") == _busiest(index.dependency_edges.where("resolved"), key)).select("rel_path").first()
    return row.rel_path if row else ""


def _busy_callees(index: Index) -> DataFrame:
    busy = _busiest(index.call_edges, "caller_symbol_id")
    parts = [q.callees(index, i).select(F.lit(i).cast("long").alias("symbol_id"), "callee_name") for i in sorted({1, busy})]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _listing(index: Index) -> DataFrame:
    """A tree that answers some sources: .ts files for even numbers, .tsx and .ts for number 3."""
    types = index.imports.select(F.col("symbol_name").alias("e")).distinct()
    ends = F.array(*[F.lit(x) for x in ("0.ts", "2.ts", "3.tsx", "3.ts", "4.ts", "6.ts")])
    return types.select("e", F.explode(ends).alias("k")).select(F.concat(F.lit("/root/src/"), F.col("e"), F.lit("/m"), F.col("k")).alias("path"))


def _resolved(index: Index) -> DataFrame:
    return resolve.resolve(index.imports, _listing(index), "/root", ALIASES)


def _edges_of_imports(index: Index) -> DataFrame:
    """Files of the listing get ids by hash of their path, as if they were indexed."""
    files = _listing(index).select("path", F.crc32(F.col("path").cast("binary")).alias("id"))
    return resolve.edges_of_imports(resolve.with_file_ids(_resolved(index), files)).groupBy(F.col("source_file_id").alias("file_id"), "resolved").agg(F.count(F.lit(1)).alias("n"))


def _search(f: Callable, key: str | None, depth: int = DEPTH) -> Callable[[Index], DataFrame]:
    """depth, node and number of neighbours of a search from the call start or from the busiest file."""
    name = "n_callees" if key is None else "n_neighbours"

    def run(index: Index) -> DataFrame:
        start = CALL_START if key is None else _busy_file(index, key)
        return f(index, start, depth).select("depth", "node", F.size("neighbours").cast("long").alias(name))

    return run


def _page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", links.alias("pos", "href")).select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), "href")


def _page_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = F.explode(F.regexp_extract_all("html", F.lit(r"([A-Za-z_]+)\("), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", calls.alias("callee")).groupBy("page_id", "callee").agg(F.count(F.lit(1)).alias("n"))


IMPORT = ["id", "importer", "symbol_name", "source_path"]
_INDEX_QUERIES: dict[str, Callable[[Index], DataFrame]] = {
    "stats": q.stats,
    "kind_counts": q.kind_counts,
    "top_imports": q.top_imports,
    "find_symbols_like": lambda i: q.find_symbols(i, "%RING%").select(SYMBOL),
    "symbols_in_file": lambda i: q.symbols_in_file(i, "N1/").select(SYMBOL),
    "list_symbols_kind": lambda i: q.list_symbols(i, "economy").select("id", "name", "kind", "is_export", "rel_path"),
    "list_symbols_exported": lambda i: q.list_symbols(i, exported_only=True).select("id", "name", "kind", "is_export", "rel_path"),
    "children_of": lambda i: q.children_of(i, "Brand#2").select("id", "name", "parent_symbol", "rel_path"),
    "imports_of_symbol": lambda i: q.imports_of_symbol(i, "CLICK").select("id", "importer", "source_path", "import_type", "line"),
    "imports_from_module_exact": lambda i: q.imports_from_module(i, "@/click").select(IMPORT),
    "imports_from_module_fallback": lambda i: q.imports_from_module(i, "lick/m3").select(IMPORT),
    "used_by_grouped": lambda i: q.used_by(i, "@/error/m1"),
    "callers": lambda i: q.callers(i, CALL_START).select("id", "rel_path", "caller_name", "caller_kind"),
    "callees": _busy_callees,
    "symbol_by_name_limit": lambda i: q.symbol_by_name(i, "%widget%").select("id", "name", "rel_path"),
    "dependencies": lambda i: q.dependencies(i, _busiest(i.dependency_edges.where("resolved"), "source_file_id")).select("id", "rel_path"),
    "dependents": lambda i: q.dependents(i, _busiest(i.dependency_edges.where("resolved"), "target_file_id")).select("id", "rel_path"),
    "all_dependencies": lambda i: q.all_dependencies(i).select("id", "source_rel", "target_rel"),
    "call_graph": graph.call_graph,
    "dep_graph": lambda i: graph.neighbour_rows(graph.dependency_edges(i)),
    "reverse_dep_graph": lambda i: graph.neighbour_rows(graph.dependency_edges(i, reverse=True)),
    "call_chain_bfs": _search(graph.call_chain, None),
    "upstream_bfs": _search(graph.upstream, "target_file_id"),
    "downstream_bfs": _search(graph.downstream, "source_file_id"),
    "bfs_rank_order": lambda i: graph.downstream(i, _busy_file(i, "source_file_id"), DEPTH).select("depth", "rank", "node"),
    "call_chain_deep": _search(graph.call_chain, None, DEEP),
    "downstream_deep": _search(graph.downstream, "source_file_id", DEEP),
    "find_symbols_order": lambda i: in_order(q.find_symbols(i, "%RING%"), "place").select("place", "id"),
    "symbols_in_file_order": lambda i: in_order(q.symbols_in_file(i, "N1/"), "place").select("place", "id"),
    "list_symbols_order": lambda i: in_order(q.list_symbols(i, exported_only=True), "place").select("place", "id"),
    "imports_of_symbol_order": lambda i: in_order(q.imports_of_symbol(i, "CLICK"), "place").select("place", "id"),
    "callers_order": lambda i: in_order(q.callers(i, CALL_START), "place").select("place", "id"),
    "mermaid_deps": lambda i: render.dependency_diagram(i, _busy_file(i, "source_file_id"), max_depth=DEPTH),
    "mermaid_calls": lambda i: render.call_diagram(i, CALL_START, DEPTH),
    "resolve_alias_prefix": lambda i: i.imports.select("id", F.when(resolve.is_internal(F.col("source_path")), resolve.apply_aliases(F.col("source_path"), ALIASES)).alias("resolved_rel")),
    "resolve_first_candidate": lambda i: _resolved(i).select("id", "resolved_path", F.col("resolved_abs").isNotNull().alias("hit")),
    "dep_edges_from_imports": _edges_of_imports,
    "caller_last_wins": lambda i: i.symbols.groupBy("file_id", "name").agg(F.max("id").alias("id")),
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _over_index(f) for k, f in _INDEX_QUERIES.items()}
QUERIES |= {"page_links_extract": _page_links, "page_calls_extract": _page_calls} | samples.QUERIES


def _bfs_sql(edges: str, start: str, count: str, follow: str | None = None, levels: int = DEPTH) -> str:
    """Breadth-first search in SQL: edges is the body of a CTE (s, t, ord); each emitted node's depth and number of edges."""
    return (
        f"{SQL}, edges AS ({edges}), followed AS ({follow or 'SELECT s, t FROM edges'}), origin AS ({start}),"
        f" walk(depth, node) AS (SELECT 0, node FROM origin UNION SELECT depth + 1, t FROM walk JOIN followed ON s = node WHERE depth < {levels - 1}),"
        f" nodes AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)"
        f" SELECT depth, node, (SELECT count(*) FROM edges WHERE s = node) AS {count} FROM nodes"
    )


def _busy_sql(key: str) -> str:
    return f"SELECT {key} FROM dependency_edges WHERE resolved GROUP BY {key} ORDER BY count(*) DESC, {key} LIMIT 1"


def _diagram_sql(edges: str, start: str, follow: str, drawn: str, calls: bool) -> str:
    """A diagram's numbered lines: the searched nodes in order, then each edge, before it the leaf that it meets first."""
    base = "{x}" if calls else "regexp_extract({x}, '[^/]*$')"
    label = f"{base} || '()'" if calls else base
    name = f"translate({base}, '.-', '__')" + ("" if calls else " || '_' || {i}")
    line = f"'    ' || {name} || '[\"' || {label} || '\"]'"
    return (
        f"{SQL}, edges AS ({edges}), followed AS ({follow}), origin AS ({start}),"
        " walk(depth, node, place) AS (SELECT 0, node, CAST([] AS BIGINT[]) FROM origin"
        f" UNION SELECT depth + 1, t, list_append(place, ord) FROM walk JOIN followed ON s = node WHERE depth < {DEPTH - 1}),"
        " nodes AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node), places AS (SELECT depth, node, min(place) AS place FROM walk JOIN nodes USING (depth, node) GROUP BY ALL),"
        " steps AS (SELECT node, row_number() OVER (ORDER BY depth, place) - 1 AS i FROM places),"
        f" drawn AS (SELECT i, s, t, row_number() OVER (ORDER BY i, ord) AS e FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ord) AS k FROM edges) JOIN steps ON s = node{drawn}),"
        " leaves AS (SELECT t AS node, e, (SELECT count(*) FROM steps) + row_number() OVER (ORDER BY e) - 1 AS i FROM (SELECT t, min(e) AS e FROM drawn WHERE t NOT IN (SELECT node FROM steps) GROUP BY t)),"
        f" named AS (SELECT node, {name.format(x='node', i='i')} AS name FROM (SELECT node, i FROM steps UNION ALL SELECT node, i FROM leaves)),"
        " lines AS (SELECT 0 AS a, 0 AS b, 0 AS c, '```mermaid' AS line UNION ALL SELECT 0, 1, 0, 'graph TD'"
        f" UNION ALL SELECT 1, i, 0, {line.format(x='node', i='i')} FROM steps UNION ALL SELECT 2, e, 0, {line.format(x='node', i='i')} FROM leaves"
        " UNION ALL SELECT 2, e, 1, '    ' || p.name || ' --> ' || q.name FROM drawn JOIN named p ON p.node = s JOIN named q ON q.node = t UNION ALL SELECT 3, 0, 0, '```')"
        " SELECT row_number() OVER (ORDER BY a, b, c) AS line_no, line FROM lines"
    )


_CALLS = "SELECT caller AS s, callee AS t, ord FROM call_pairs"
_FOLLOWED_CALLS = f"SELECT s, t, ord FROM (SELECT s, t, ord, row_number() OVER (PARTITION BY s ORDER BY ord) AS k FROM edges) WHERE k <= {graph.CALL_FAN_OUT}"
_SYMBOLS = "FROM symbols s JOIN files f ON f.id = s.file_id"
_IMPORTS = "FROM imports i JOIN files f ON f.id = i.file_id"
_IMPORT_COLUMNS = "i.id, f.rel_path AS importer, i.symbol_name, i.source_path"
_ORDER = "row_number() OVER (PARTITION BY {s} ORDER BY id)"
_NUMBER = "regexp_extract(source_path, '([0-9]+)$', 1)"
_HIT = f"CASE WHEN {_NUMBER} IN ('0', '2', '3', '4', '6') THEN '.ts' END"
_PATH = "replace(source_path, '@/', 'src/')"

ORACLE_SQL: dict[str, str] = {
    "stats": f"{SQL} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM imports) AS imports, (SELECT count(*) FROM call_edges) AS calls, (SELECT count(*) FROM dependency_edges) AS deps",
    "kind_counts": f"{SQL} SELECT kind, count(*) AS cnt FROM symbols GROUP BY kind",
    "top_imports": f"{SQL} SELECT source_path, count(*) AS cnt FROM imports WHERE source_path <> '' GROUP BY source_path ORDER BY cnt DESC, source_path LIMIT 10",
    "find_symbols_like": f"{SQL} SELECT s.id, name, kind, rel_path, line_start {_SYMBOLS} WHERE lower(name) LIKE '%ring%'",
    "symbols_in_file": f"{SQL} SELECT s.id, name, kind, rel_path, line_start {_SYMBOLS} WHERE lower(rel_path) LIKE '%n1/%'",
    "list_symbols_kind": f"{SQL} SELECT s.id, name, kind, is_export, rel_path {_SYMBOLS} WHERE kind = 'economy'",
    "list_symbols_exported": f"{SQL} SELECT s.id, name, kind, is_export, rel_path {_SYMBOLS} WHERE is_export",
    "children_of": f"{SQL} SELECT s.id, name, parent_symbol, rel_path {_SYMBOLS} WHERE parent_symbol = 'Brand#2'",
    "imports_of_symbol": f"{SQL} SELECT i.id, f.rel_path AS importer, source_path, import_type, line {_IMPORTS} WHERE lower(symbol_name) LIKE 'click'",
    "imports_from_module_exact": f"{SQL} SELECT {_IMPORT_COLUMNS} {_IMPORTS} WHERE source_path = '@/click' OR lower(source_path) LIKE '@/click/%'",
    "imports_from_module_fallback": f"{SQL} SELECT {_IMPORT_COLUMNS} {_IMPORTS} WHERE lower(source_path) LIKE '%lick/m3%'",
    "used_by_grouped": f"{SQL} SELECT f.rel_path AS importer, string_agg(symbol_name, ', ' ORDER BY i.id) AS symbols {_IMPORTS} WHERE source_path = '@/error/m1' GROUP BY f.rel_path",
    "callers": f"{SQL} SELECT ce.id, f.rel_path, s.name AS caller_name, s.kind AS caller_kind FROM call_edges ce JOIN files f ON f.id = ce.caller_file_id LEFT JOIN symbols s ON s.id = ce.caller_symbol_id WHERE callee_name = '{CALL_START}'",
    "callees": f"{SQL} SELECT DISTINCT caller_symbol_id AS symbol_id, callee_name FROM call_edges WHERE caller_symbol_id = 1 OR caller_symbol_id = (SELECT caller_symbol_id FROM call_edges WHERE caller_symbol_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
    "symbol_by_name_limit": f"{SQL} SELECT s.id, name, rel_path {_SYMBOLS} WHERE lower(name) LIKE '%widget%' ORDER BY s.id LIMIT 20",
    "dependencies": f"{SQL} SELECT d.id, f.rel_path FROM dependency_edges d JOIN files f ON f.id = d.target_file_id WHERE d.source_file_id = ({_busy_sql('source_file_id')})",
    "dependents": f"{SQL} SELECT d.id, f.rel_path FROM dependency_edges d JOIN files f ON f.id = d.source_file_id WHERE d.target_file_id = ({_busy_sql('target_file_id')})",
    "all_dependencies": f"{SQL} SELECT id, source_rel, target_rel FROM dep_paths",
    "call_graph": f"{SQL} SELECT caller, callee, ord FROM call_pairs",
    "dep_graph": f"{SQL} SELECT source_rel AS node, {_ORDER.format(s='source_rel')} AS pos, target_rel AS neighbour FROM dep_paths",
    "reverse_dep_graph": f"{SQL} SELECT target_rel AS node, {_ORDER.format(s='target_rel')} AS pos, source_rel AS neighbour FROM dep_paths",
    "call_chain_bfs": _bfs_sql(
        _CALLS, f"SELECT '{CALL_START}' AS node", "n_callees", _FOLLOWED_CALLS,
    ),
    "upstream_bfs": _bfs_sql("SELECT target_rel AS s, source_rel AS t, id AS ord FROM dep_paths", f"SELECT rel_path AS node FROM files WHERE id = ({_busy_sql('target_file_id')})", "n_neighbours"),
    "downstream_bfs": _bfs_sql("SELECT source_rel AS s, target_rel AS t, id AS ord FROM dep_paths", f"SELECT rel_path AS node FROM files WHERE id = ({_busy_sql('source_file_id')})", "n_neighbours"),
    "call_chain_deep": _bfs_sql(_CALLS, f"SELECT '{CALL_START}' AS node", "n_callees", _FOLLOWED_CALLS, DEEP),
    "downstream_deep": _bfs_sql("SELECT source_rel AS s, target_rel AS t, id AS ord FROM dep_paths", f"SELECT rel_path AS node FROM files WHERE id = ({_busy_sql('source_file_id')})", "n_neighbours", None, DEEP),
    "find_symbols_order": f"{SQL} SELECT row_number() OVER (ORDER BY rel_path, line_start, s.id) AS place, s.id {_SYMBOLS} WHERE lower(name) LIKE '%ring%'",
    "symbols_in_file_order": f"{SQL} SELECT row_number() OVER (ORDER BY line_start, s.id) AS place, s.id {_SYMBOLS} WHERE lower(rel_path) LIKE '%n1/%'",
    "list_symbols_order": f"{SQL} SELECT row_number() OVER (ORDER BY kind, name, s.id) AS place, s.id {_SYMBOLS} WHERE is_export",
    "imports_of_symbol_order": f"{SQL} SELECT row_number() OVER (ORDER BY rel_path, i.id) AS place, i.id {_IMPORTS} WHERE lower(symbol_name) LIKE 'click'",
    "callers_order": f"{SQL} SELECT row_number() OVER (ORDER BY ce.id) AS place, ce.id FROM call_edges ce JOIN files f ON f.id = ce.caller_file_id WHERE callee_name = '{CALL_START}'",
    "bfs_rank_order": (
        f"{SQL}, walk(depth, node, place) AS (SELECT 0, rel_path, CAST([] AS BIGINT[]) FROM files WHERE id = ({_busy_sql('source_file_id')})"
        f" UNION SELECT depth + 1, target_rel, list_append(place, id) FROM walk JOIN dep_paths ON source_rel = node WHERE depth < {DEPTH - 1}),"
        " nodes AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node), places AS (SELECT depth, node, min(place) AS place FROM walk JOIN nodes USING (depth, node) GROUP BY ALL)"
        " SELECT depth, row_number() OVER (PARTITION BY depth ORDER BY place) AS rank, node FROM places"
    ),
    "mermaid_deps": _diagram_sql("SELECT source_rel AS s, target_rel AS t, id AS ord FROM dep_paths", f"SELECT rel_path AS node FROM files WHERE id = ({_busy_sql('source_file_id')})", "SELECT s, t, ord FROM edges", "", False),
    "mermaid_calls": _diagram_sql(_CALLS, f"SELECT '{CALL_START}' AS node", _FOLLOWED_CALLS, f" WHERE k <= {render.CALL_LIMIT}", True),
    "resolve_alias_prefix": f"{SQL} SELECT id, CASE WHEN starts_with(source_path, '@') THEN {_PATH} END AS resolved_rel FROM imports",
    "resolve_first_candidate": f"{SQL} SELECT id, {_PATH} || coalesce({_HIT}, '') AS resolved_path, {_HIT} IS NOT NULL AS hit FROM imports",
    "dep_edges_from_imports": f"{SQL} SELECT file_id, {_HIT} IS NOT NULL AS resolved, count(*) AS n FROM imports GROUP BY ALL",
    "caller_last_wins": f"{SQL} SELECT file_id, name, max(id) AS id FROM symbols GROUP BY file_id, name",
    "page_links_extract": "SELECT page_id, unnest(generate_series(1, len(l))) AS pos, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM pages)",
    "page_calls_extract": "SELECT page_id, callee, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '([A-Za-z_]+)\\(', 1)) AS callee FROM pages) GROUP BY ALL",
}
ORACLE_SQL |= samples.ORACLE_SQL
