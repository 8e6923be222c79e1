"""Cases in which an operator once did less than its whole job."""

import random

from loomgraph.llm import sentence_spans
from tests.llm.test_operators import sentence


def test_passages_that_begin_in_a_sentence_at_any_offset_are_removed(spark):
    rng = random.Random(11)
    shared = sentence(rng, 100)
    rows = [(i, f"{sentence(rng, 30 + i)} {shared} {sentence(rng, 30)}") for i in range(21)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.row.doc_id: r.result.text for r in sentence_spans.deduplicated(df).collect()}
    assert got[0] == rows[0][1]
    for i in range(1, 21):
        left = [w for w in shared.split() if f" {w} " in f" {got[i]} "]
        assert len(left) < 50 and rows[i][1].split()[0] in got[i]
