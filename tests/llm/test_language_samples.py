import random

from loomgraph.llm import language
from tests.llm.test_operators import sentence


def test_languages_of_long_empty_or_short_texts_are_learned(spark):
    rng = random.Random(3)
    long = [(i, f"\n12 -- {sentence(rng, 2000)}", "xx") for i in range(3)]
    blank = [(100 + i, None if i % 2 else "  7 ", "yy") for i in range(400)] + [(999, "ein kurzer Satz", "yy")]
    short = [(1000 + i, sentence(rng, 3), "zz") for i in range(4000)]
    odd = [(9000, "12 34", "qq"), (9001, None, "qq")]
    df = spark.createDataFrame(long + blank + short + odd, "doc_id long, text string, lang string")
    got = language.samples(df)
    assert list(got) == ["zz", "yy", "xx"]
    assert got["yy"] == "ein kurzer satz\n"
    assert len(got["xx"]) > 3 * 0.7 * language.LONGEST_SAMPLE
    assert len(got["zz"]) == language.SAMPLE_CHARS
