"""Operators for training data, one module each, and their queries."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: functions of this package travel with the tasks that use them.
cloudpickle.register_pickle_by_value(sys.modules["loomgraph"])


def load_llm():
    """(queries, oracles) of the training-data operators."""
    from loomgraph.llm import queries  # noqa: F401
    from loomgraph.llm.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
