"""The data model: closed vocabularies and the columns of every table of a graph."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The vocabularies, in the order of their codes from 1 on.
EDGE_KINDS = (
    "CONTAINS_PACKAGE", "CONTAINS_FILE", "DEFINES", "PACKAGE_DEPENDS_ON", "MODULE_DEPENDS_ON", "IMPORTS_SYMBOL", "EXPORTS",
    "REEXPORTS", "REFERENCES", "CALLS_DIRECT", "PASSES_AS_CALLBACK", "ASSIGNS_FUNCTION", "RETURNS_FUNCTION", "TYPE_USES",
    "IMPLEMENTS", "EXTENDS", "EMBEDS", "OVERRIDES", "PART_OF", "METHOD_OF",
)
CONFIDENCES = (
    "EXACT_TYPECHECKED", "EXACT_DECLARATION_MAPPED", "EXACT_PACKAGE_MAPPED", "STRUCTURAL_CERTAIN", "CANDIDATE", "UNRESOLVED",
)

STRUCTURAL_KINDS = EDGE_KINDS[:3]
PACKAGE_KINDS = EDGE_KINDS[3:5]
REFERENCE_KINDS = EDGE_KINDS[5:19]
EXACT_CONFIDENCES = CONFIDENCES[:4]
#: The provenance that can't support an exact edge.
INEXACT_PROVENANCE = "TREE_SITTER_SYNTAX"
#: Left out of references unless asked for.
QUIET_KINDS = ("EXPORTS", "REEXPORTS")
#: Symbol kinds that an outline and an impact report leave out unless asked for.
MEMBER_KINDS = ("field", "property", "enum_member", "variant")
QUIET_IMPACT_KINDS = ("field", "variable")
DERIVED_PREFIX = "derived:"

MAX_DEPTH, MAX_NODES, MAX_PAGE, MAX_SAMPLES = 5, 25_000, 500, 20

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


POSITION = _schema(line=_L, column=_L, offset=_L)
REPOSITORY = _schema(stable_key=_S, name=_S, root_path=_S, commit=_S, branch=_S, dirty=_B, languages=T.ArrayType(_S))
PACKAGE = _schema(stable_key=_S, repository_key=_S, language=_S, name=_S, version=_S, root_path=_S, manifest_path=_S, container=_S)
FILE = _schema(stable_key=_S, repository_key=_S, package_key=_S, path=_S, language=_S, content_hash=_S, generated=_B)
SYMBOL = _schema(
    stable_key=_S, canonical_identity=_S, repository_key=_S, package_key=_S, file_key=_S, language=_S, name=_S,
    qualified_name=_S, kind=_S, exported=_B, signature=_S, start_line=_L, end_line=_L,
)
EVIDENCE = _schema(stable_key=_S, repository_key=_S, file_key=_S, start_line=_L, start_offset=_L, end_offset=_L, text=_S)
EDGE = _schema(source_key=_S, target_key=_S, kind=_S, confidence=_S, provenance=_S, evidence_key=_S)
UNRESOLVED = _schema(
    stable_key=_S, repository_key=_S, file_key=_S, source_symbol_key=_S, language=_S, requested_package=_S,
    requested_symbol=_S, reason=_S, detail=_S, start_line=_L, start_offset=_L,
)
#: A JSON document of facts: the seven collections.
FACT_SET = _schema(
    repositories=T.ArrayType(REPOSITORY), packages=T.ArrayType(PACKAGE), files=T.ArrayType(FILE), symbols=T.ArrayType(SYMBOL),
    evidence=T.ArrayType(EVIDENCE), edges=T.ArrayType(EDGE), unresolved=T.ArrayType(UNRESOLVED),
)
EVENT = _schema(
    ts=T.TimestampType(), level=_S, kind=_S, msg=_S, pid=_L, tool=_S, status=_S, duration_ms=T.DoubleType(), stage=_S,
    repository=_S, generation=_S, results=_L, symbols=_L, error=_S,
)


@dataclass
class Graph:
    """The tables of one graph.  ``edges`` holds all relations in one long table, whatever their kind."""

    repositories: DataFrame
    packages: DataFrame
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    unresolved: DataFrame
    evidence: DataFrame | None = None
    #: The edges clustered by their ends, if they are (``factlake.operators.adjacency``); not a table of its own.
    clustered: object | None = None

    def walked(self):
        """What walks read: the clustered edges, or the plain ones."""
        return self.clustered if self.clustered is not None else self.edges

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: t for f in fields(self) if f.name != "clustered" and (t := getattr(self, f.name)) is not None}
