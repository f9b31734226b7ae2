"""Core tables and edge kinds, and a check of a catalogue against them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Names and types of the tables and edges.
NODES = {
    "file": "id string, path string, relative_path string, extension string, hash string, size long, last_modified long, language string, framework string",
    "function": "id string, name string, file_id string, start_line int, end_line int, start_column int, end_column int, signature string, return_type string, is_exported boolean, is_async boolean, is_generator boolean, complexity int, parameter_count int, doc_comment string, business_logic string, inference_confidence double",
    "class": "id string, name string, file_id string, start_line int, end_line int, is_abstract boolean, is_exported boolean, extends_class string, implements_interfaces array<string>, doc_comment string",
    "interface": "id string, name string, file_id string, start_line int, end_line int, is_exported boolean, extends_interfaces array<string>, doc_comment string, properties string",
    "type_alias": "id string, name string, file_id string, start_line int, end_line int, is_exported boolean, type_definition string, doc_comment string",
    "variable": "id string, name string, file_id string, line int, column int, variable_type string, is_const boolean, is_exported boolean, scope string",
    "ghost_node": "id string, name string, package_name string, entity_type string, signature string, is_external boolean",
    "entity_embedding": "entity_id string, file_id string, vector array<float>, text_hash string, model string, created_at long",
}


@dataclass(frozen=True)
class Edge:
    """Rows are unique by (from_id, to_id); a later one replaces an earlier."""

    sources: tuple[str, ...]
    targets: tuple[str, ...]
    columns: str = ""


EDGES = {
    "contains": Edge(("file",), ("function", "class", "interface", "type_alias", "variable"), "line_number int"),
    "calls": Edge(("function",), ("function",), "line_number int, is_direct_call boolean, is_await boolean"),
    "imports": Edge(("file",), ("file",), "imported_symbols array<string>, import_type string, is_type_only boolean"),
    "extends": Edge(("class",), ("class",)),
    "implements": Edge(("class",), ("interface",)),
    "extends_interface": Edge(("interface",), ("interface",)),
    "has_method": Edge(("class", "interface"), ("function",), "visibility string, is_static boolean, is_abstract boolean"),
    "uses_type": Edge(("function",), ("class", "interface", "type_alias"), "context string, parameter_name string"),
    "references_external": Edge(("function", "class", "interface"), ("ghost_node",), "context string, line_number int"),
}


def schema(name: str) -> StructType:
    if name in NODES:
        return StructType.fromDDL(NODES[name])
    edge = EDGES[name]
    return StructType.fromDDL("from_id string, to_id string" + (f", {edge.columns}" if edge.columns else ""))


def dangling_kinds() -> list[str]:
    """Edge kinds that name a node kind which isn't declared."""
    return [n for n, e in EDGES.items() if not set(e.sources + e.targets) <= set(NODES)]


def differences(name: str, rows: DataFrame) -> list[str]:
    """What keeps rows from being a table of this name."""
    have = {f.name: f.dataType.simpleString() for f in rows.schema}
    want = {f.name: f.dataType.simpleString() for f in schema(name)}
    return [f"{c}: {have.get(c, 'absent')}, not {t}" for c, t in want.items() if have.get(c) != t]
