"""Tables (as DDL) and vocabularies of the code graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

FILES = "id long, repo_root string, relative_path string, language string, hash string, size long, line_count long, indexed_at timestamp, last_modified string"
NODES = "id long, kind string, name string, file_id long, start_line int, start_col int, end_line int, end_col int, doc_comment string, properties string"
EDGES = "id long, source_node_id long, target_node_id long, kind string, properties string, file_id long"
BROKEN_REFS = "id long, source_node_id long, ref_name string, file_id long, line int, kind string, target_name string"
SNAPSHOTS = "id long, timestamp timestamp, commit_hash string, total_files long, total_nodes long, total_edges long, avg_complexity double, max_complexity int, circular_deps int"
METRIC_HISTORY = "id long, snapshot_id long, metric_name string, metric_value double"

# The vocabularies of the data model.
NODE_KINDS = ("File", "Module", "Function", "Class", "Method", "Interface", "Enum", "Variable", "Field", "Parameter", "TypeAlias", "Import", "Macro", "Anonymous")
EDGE_KINDS = ("Contains", "Calls", "References", "Defines", "Inherits", "Implements", "Overrides", "Imports", "Exports", "DependsOn", "Declares", "Next")
BROKEN_REF_KINDS = ("UnresolvedRef", "UnresolvedCall", "DeadImport")
FUNCTION_KINDS = ("Function", "Method")
MODULE_KINDS = ("Class", "Interface", "Module")
CONTAINER_KINDS = ("Module", "Class", "Interface", "Enum", "File")
DEFINITION_KINDS = ("Function", "Class", "Method", "Interface", "Enum", "Variable", "TypeAlias", "Field")
LANGUAGES = ("typescript", "tsx", "javascript", "python", "rust", "go", "c", "cpp", "java")
LIST_LIMIT = 50_000
SEARCH_LIMIT = 50


@dataclass
class CodeGraph:
    """The tables of one graph version. Any DataFrame with these columns will do. stored: they are stored tables, so a loop over them needs no copy."""

    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    broken_refs: DataFrame | None = None
    stored: bool = False
