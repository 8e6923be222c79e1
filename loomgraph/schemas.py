"""Table schemas of the property graph and the tables around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _B, _I, _L, _D = (
    T.StringType(),
    T.BooleanType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
)
_LIST = T.ArrayType(T.StringType())

# Metadata keys that become entity columns.
PROMOTED_METADATA: dict[str, T.DataType] = {
    "version": _S,
    "scope": _S,
    "manifest": _S,
    "method": _S,
    "handler": _S,
    "source": _S,
    "classification": _S,
    "documented": _B,
    "tags": _LIST,
    "script": _S,
    "schedule": _S,
    "sources": _LIST,
    "dests": _LIST,
    "expression": _S,
    "is_repository": _B,
    "discovered_as": _S,
    "schema": _S,
    "object_name": _S,
    "materialized": _B,
}

# Metadata read by inference but not promoted to columns.
INFERENCE_METADATA: dict[str, T.DataType] = {"kind": _S, "language": _S}


def _struct(fields: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


METADATA = _struct({**PROMOTED_METADATA, **INFERENCE_METADATA})

NODE_FIELDS: dict[str, T.DataType] = {
    "id": _S,
    "label": _S,
    "norm_label": _S,
    "origin": _S,
    "file_type": _S,
    "community": _I,
    "community_name": _S,
    "source_file": _S,
    "source_location": _S,
    "type": _S,
    "ecosystem": _S,
    "metadata": METADATA,
}

LINK_FIELDS: dict[str, T.DataType] = {
    "source": _S,
    "target": _S,
    "relation": _S,
    "confidence": _S,
    "confidence_score": _D,
    "weight": _D,
    "source_file": _S,
    "source_location": _S,
    "context": _S,
}

ENTITY_FIELDS: dict[str, T.DataType] = {
    "node_key": _S,
    "node_id": _S,
    "name": _S,
    "norm_name": _S,
    "name_lower": _S,
    "norm_name_lower": _S,
    "path": _S,
    "line": _S,
    "language": _S,
    "file_type": _S,
    "community": _I,
    "community_name": _S,
    "ecosystem": _S,
    "repo": _S,
    "shared": _B,
    "label": _S,
    **PROMOTED_METADATA,
    "content_hash": _S,
    "last_commit": _S,
    "last_run": _S,
}

EDGE_FIELDS: dict[str, T.DataType] = {
    "src": _S,
    "dst": _S,
    "type": _S,
    "repo": _S,
    "weight": _D,
    "confidence": _S,
    "confidence_score": _D,
    "context": _S,
    "content_hash": _S,
    "last_commit": _S,
    "last_run": _S,
}

OWNERSHIP_FIELDS: dict[str, T.DataType] = {
    "repo": _S,
    "node_key": _S,
    "last_commit": _S,
    "last_run": _S,
}

# One graph document as stored in a node-link JSON file.
GRAPH_DOCUMENT = _struct(
    {
        "nodes": T.ArrayType(
            _struct({("_origin" if n == "origin" else n): t for n, t in NODE_FIELDS.items()})
        ),
        "links": T.ArrayType(_struct(LINK_FIELDS)),
        "hyperedges": T.ArrayType(_S),
    }
)

PUSH_EVENT = T.StructType(
    [
        T.StructField("ref", _S),
        T.StructField("deleted", _B),
        T.StructField("after", _S),
        T.StructField(
            "repository",
            _struct({"full_name": _S, "clone_url": _S, "ssh_url": _S, "html_url": _S}),
        ),
        T.StructField("at", T.TimestampType()),
    ]
)

USAGE_SAMPLE = T.StructType(
    [
        T.StructField("actor", _S),
        T.StructField("endpoint", _S),
        T.StructField("repos", _LIST),
        T.StructField("at", T.TimestampType()),
    ]
)


def conform(df: DataFrame, fields: dict[str, T.DataType], keep: tuple[str, ...] = ()) -> DataFrame:
    """Select exactly ``fields`` (plus ``keep``), adding typed nulls for absent columns."""
    have = set(df.columns)
    cols = [F.col(c) for c in keep]
    for name, dtype in fields.items():
        cols.append((F.col(name) if name in have else F.lit(None)).cast(dtype).alias(name))
    return df.select(*cols)


def metadata_struct(**values):
    """A metadata struct column; keys that are not given stay null."""
    fields = {**PROMOTED_METADATA, **INFERENCE_METADATA}
    unknown = set(values) - set(fields)
    if unknown:
        raise ValueError(f"unknown metadata keys: {sorted(unknown)}")
    return F.struct(
        *[
            F.coalesce(values[n], F.lit(None)).cast(t).alias(n)
            if n in values
            else F.lit(None).cast(t).alias(n)
            for n, t in fields.items()
        ]
    )
