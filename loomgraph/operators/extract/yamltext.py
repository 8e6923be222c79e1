"""YAML documents as JSON text, so that JSON functions read both.

The one step of extraction Spark has no function for.  Needs PyYAML: planning a read of
YAML without it on the driver is an error, and so is running one on an executor
that lacks it.
"""

from __future__ import annotations

import importlib.util

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import spread


def yaml_to_json(text: Column) -> Column:
    """JSON text of a YAML document, null when it cannot be read."""
    if importlib.util.find_spec("yaml") is None:
        raise ModuleNotFoundError("PyYAML is needed to read YAML files")

    # Everything the workers need is inside, so they need not have this package.
    def convert(texts: pd.Series) -> pd.Series:
        import json

        import yaml

        def plain(loader, suffix, node):
            if isinstance(node, yaml.ScalarNode):
                return loader.construct_scalar(node)
            if isinstance(node, yaml.SequenceNode):
                return loader.construct_sequence(node, deep=True)
            return loader.construct_mapping(node, deep=True)

        def tolerant(base):
            """A loader that keeps unknown tags, such as template functions, as plain values."""
            loader = type("Tolerant", (base,), {})
            loader.add_multi_constructor("!", plain)
            return loader

        # PyYAML's parser in C, where it was built with it; what that one refuses is left to the other.
        loaders = [tolerant(base) for base in (getattr(yaml, "CSafeLoader", None), yaml.SafeLoader) if base]

        def one(document):
            for loader in loaders:
                try:
                    return json.dumps(yaml.load(document, Loader=loader), default=str)
                except Exception:  # noqa: BLE001 - the caller reports what cannot be read
                    continue
            return None

        return texts.map(one)

    return F.pandas_udf(convert, "string")(text)


def json_texts(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Files of ``rows`` as JSON texts: the columns ``keep`` and json.

    YAML takes the Python step, on all cores; JSON does not pass through it.  Readers
    cut what they make of the texts, or each use of them would take that step again.
    """
    read = spread(rows.where("ext <> '.json'").select(*keep, "content"), "path")
    return rows.where("ext = '.json'").select(*keep, F.col("content").alias("json")).unionByName(
        read.select(*keep, yaml_to_json(F.col("content")).alias("json"))
    )
