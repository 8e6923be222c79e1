"""A training corpus from raw documents, in stages that are written and reread; see ``loomgraph.llm.pipeline``."""

from loomgraph.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
