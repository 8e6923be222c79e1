"""Registry of queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.plans.oracle_ctes import with_graph
from loomgraph.plans.projections import GraphTables
from loomgraph.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Comparable output: lists joined with '|', whole numbers as long, doubles rounded."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            col = F.array_join(col, "|")
        elif isinstance(kind, T.MapType):
            pairs = F.array_sort(F.map_entries(col))
            col = F.array_join(
                F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|"
            )
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            col = col.cast("long")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            col = F.round(col, 6)
        elif isinstance(kind, T.TimestampType):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        out.append(col.alias(field.name))
    return df.select(*out)


def query(name: str, oracle: str | None = None, extra: dict[str, str] | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its oracle SQL."""

    def wrap(fn: Callable[[GraphTables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return flat(fn(GraphTables(tune(spark), sf_dir)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_graph(oracle, extra)
        return fn

    return wrap
