"""The five tables of an index, column by column, and the nested result of extraction."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType, TimestampType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v() if isinstance(v, type) else v) for k, v in fields.items()])


FILES = _struct(id=LongType, path=StringType, rel_path=StringType, language=StringType, lines=LongType, bytes=LongType, indexed_at=TimestampType)
SYMBOLS = _struct(
    id=LongType, file_id=LongType, name=StringType, kind=StringType, line_start=IntegerType, line_end=IntegerType, signature=StringType,
    is_export=BooleanType, is_default_export=BooleanType, is_async=BooleanType, parent_symbol=StringType, enclosing_type=StringType,
)
IMPORTS = _struct(
    id=LongType, file_id=LongType, symbol_name=StringType, alias_name=StringType, source_path=StringType, import_type=StringType,
    line=IntegerType, resolved_path=StringType, resolved_file_id=LongType, is_type_import=BooleanType,
)
CALL_EDGES = _struct(
    id=LongType, caller_file_id=LongType, caller_symbol_id=LongType, callee_name=StringType,
    callee_symbol_id=LongType, callee_file_id=LongType, resolved=BooleanType,
)
DEPENDENCY_EDGES = _struct(id=LongType, source_file_id=LongType, target_file_id=LongType, resolved=BooleanType)
TABLES = {"files": FILES, "symbols": SYMBOLS, "imports": IMPORTS, "call_edges": CALL_EDGES, "dependency_edges": DEPENDENCY_EDGES}

#: What extraction gives for a file.
SYMBOL = _struct(
    name=StringType, kind=StringType, line_start=IntegerType, line_end=IntegerType, signature=StringType, is_export=BooleanType,
    is_default_export=BooleanType, is_async=BooleanType, parent_symbol=StringType, enclosing_type=StringType,
)
IMPORT = _struct(symbol_name=StringType, alias_name=StringType, source_path=StringType, import_type=StringType, line=IntegerType, is_type_import=BooleanType)
CALL = _struct(name=StringType, is_member=BooleanType, object=StringType, line=IntegerType, caller_symbol_name=StringType)
EXTRACTED = _struct(
    path=StringType, rel_path=StringType, language=StringType, lines=LongType, bytes=LongType,
    symbols=ArrayType(SYMBOL), imports=ArrayType(IMPORT), call_edges=ArrayType(CALL), error=StringType,
)


class Index(NamedTuple):
    """The five tables, as DataFrames that hold at least the columns a query names."""

    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    call_edges: DataFrame
    dependency_edges: DataFrame

    def create_views(self) -> None:
        """Each table as a temporary view of its name, for spark.sql."""
        for name, df in self._asdict().items():
            df.createOrReplaceTempView(name)
