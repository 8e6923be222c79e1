import numpy as np
import pyarrow as pa

from loomgraph.llm import toxicity


def test_a_text_has_the_same_grams_wherever_it_stands_in_a_batch():
    texts = ["abcd", "abcdef", "", "xy", "abcd", "abcdef"]
    every = np.arange(1 << toxicity.HASH_BITS, dtype=np.int32)
    for _, bounds, found in toxicity.NGrams().of(pa.array(texts)):
        text, feature = toxicity._present(bounds, found, every)
        own = [sorted(feature[text == i].tolist()) for i in range(len(texts))]
        assert [len(x) for x in own] == [1, 5, 0, 0, 1, 5]
        assert own[0] == own[4] and own[1] == own[5]
