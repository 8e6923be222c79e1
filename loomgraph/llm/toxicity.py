"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed character n-grams (a-z folded, as are other
letters of one character).  An n-gram's ratio is the log of its smoothed share in
toxic over its share in other labelled texts.  The n-grams with the surest ratios
are kept, presence times ratio is the feature value, and logistic regression
weighs them; the score is its probability.

The model is fitted on at most ``most_labelled`` labelled rows, the first by hash
of their id, so the driver holds a bounded sample of bit rows and a bounded list
of features.  Scoring reads every whole text and moves nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.rows import map_texts
from loomgraph.llm.wordhash import slices, text_bytes
from loomgraph.session import cut_lineage

SIZES = (4, 5)
HASH_BITS = 19
SAMPLE_PARTS = 6
MOST_LABELLED = 16_000
MOST_FEATURES = 2_048
LEAST_TEXTS = 3


def _folds() -> np.ndarray:
    """Lower-case code point of every code point below 65,536 whose lower case is one character."""
    table = np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


class NGrams:
    """Hashed character n-grams of many texts at once."""

    def __init__(self):
        self.fold = _folds()

    def of(self, column: pa.Array):
        """(first text, text bounds, hashes by start, lengths' masks) for each slice: yields (lo, bounds, [(hash, valid)])."""
        data, offsets = text_bytes(column)
        for lo, hi in slices(offsets):
            own = data[offsets[lo] : offsets[hi]]
            lead = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
            bounds = lead[offsets[lo : hi + 1] - offsets[lo]]
            points = np.frombuffer(own.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
            low = points < 1 << 16
            points = np.where(low, self.fold[np.where(low, points, 0)], points)
            found = []
            for n in SIZES:
                size = len(points) - n + 1
                if size <= 0:
                    continue
                h = np.full(size, n, dtype=np.uint32)
                for j in range(n):
                    h = h * np.uint32(0x01000193) + points[j : j + size]
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(13)
                h *= np.uint32(0xC2B2AE35)
                h >>= np.uint32(32 - HASH_BITS)
                inside = np.ones(len(points) + 1, dtype=bool)
                for back in range(1, n):
                    across = bounds[1:] - back
                    inside[across[across >= 0]] = False
                found.append((h, inside[:size]))
            yield lo, bounds, found


def _present(bounds: np.ndarray, found, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) once each, for the n-grams that ``table`` maps to a feature (-1: none)."""
    width = int(table.max()) + 2
    pairs = []
    for h, inside in found:
        feature = table[h]
        at = np.flatnonzero((feature >= 0) & inside)
        text = np.searchsorted(bounds, at, side="right") - 1
        pairs.append(text * width + feature[at])
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.int64)
    return both // width, both % width


@dataclass
class Model:
    """Bias, and weight times ratio of each kept n-gram hash."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        table = np.full(1 << HASH_BITS, -1, dtype=np.int32)
        table[self.hashes] = np.arange(len(self.hashes))
        return table


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int) -> DataFrame:
    """(text, y) of the labelled rows to learn from: one per id, the first ``most`` by hash."""
    wanted = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{doc_id}`").isNotNull())
    wanted = wanted.groupBy(F.col(f"`{doc_id}`").alias("id")).agg(F.max((F.col(f"`{label}`") > 0).cast("int")).alias("y"))
    wanted = wanted.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(wanted), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y")


def _counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, other): in how many texts of each class a hashed n-gram stands."""

    def run(batches):
        grams, every = NGrams(), np.arange(1 << HASH_BITS, dtype=np.int32)
        totals = np.zeros((2, 1 << HASH_BITS), dtype=np.int32)
        for batch in batches:
            y = batch.column(1).to_numpy()
            for lo, bounds, found in grams.of(batch.column(0)):
                text, feature = _present(bounds, found, every)
                for c in (0, 1):
                    np.add.at(totals[c], feature[y[lo + text] == c], 1)
        at = np.flatnonzero(totals.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(totals[1][at]), pa.array(totals[0][at])], ["feature", "toxic", "other"]
        )

    parts = sample.mapInArrow(run, "feature int, toxic int, other int")
    return parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    most_labelled: int = MOST_LABELLED,
    most_features: int = MOST_FEATURES,
) -> Model:
    """The model of the labelled rows; without both classes, a model that gives every text the same score."""
    sample = cut_lineage(_sample(docs, labels, doc_id, text, label, most_labelled)).coalesce(SAMPLE_PARTS)
    sizes = dict(sample.groupBy("y").count().collect())
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), 6.0 if n1 else -6.0)
    counts = _counts(sample).where(F.col("toxic") + F.col("other") >= LEAST_TEXTS)
    ratio = F.log((F.col("toxic") + 1) / (F.lit(n1) + 2)) - F.log((F.col("other") + 1) / (F.lit(n0) + 2))
    sure = F.abs(ratio) / F.sqrt(1 / (F.col("toxic") + 1) + 1 / (F.col("other") + 1))
    kept = counts.select("feature", ratio.alias("ratio"), sure.alias("sure")).orderBy(F.desc("sure"), "feature").limit(most_features)
    rows = sorted((r["feature"], r["ratio"]) for r in kept.collect())
    hashes, ratios = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows])
    model = Model(hashes, ratios, 0.0)
    if not len(hashes):
        return Model(hashes, ratios, float(np.log(n1 / n0)))

    def bits(batches):
        grams, table = NGrams(), model.table()
        for batch in batches:
            seen = np.zeros((batch.num_rows, len(model.hashes)), dtype=bool)
            for lo, bounds, found in grams.of(batch.column(0)):
                at, feature = _present(bounds, found, table)
                seen[lo + at, feature] = True
            packed = [np.packbits(r).tobytes() for r in seen]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(1)], ["bits", "y"])

    data = sample.mapInArrow(bits, "bits binary, y int").toArrow().sort_by([("bits", "ascending"), ("y", "ascending")])
    seen = np.unpackbits(np.frombuffer(b"".join(data.column("bits").to_pylist()), dtype=np.uint8).reshape(data.num_rows, -1), axis=1)
    x = seen[:, : len(hashes)].astype(np.float32)
    x *= ratios.astype(np.float32)
    weights, bias = _logistic(x, data.column("y").to_numpy().astype(np.float32))
    return Model(hashes, weights * ratios, bias)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of L2-penalised logistic regression, by accelerated gradient steps."""
    n, m = x.shape
    top = np.ones(m, dtype=np.float32)
    for _ in range(20):
        top = x.T @ (x @ top)
        top /= max(float(np.linalg.norm(top)), 1e-12)
    size = 0.25 * (float(np.linalg.norm(x @ top)) ** 2 / n + 1) + penalty
    w = v = np.zeros(m, dtype=np.float32)
    b = c = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    for t in range(rounds):
        gap = 1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30))) - y
        w_new = v - (x.T @ gap / n + penalty * v) / size
        b_new = c - float(gap.mean()) / size
        pull = t / (t + 3)
        v, c = w_new + pull * (w_new - w), b_new + pull * (b_new - b)
        w, b = w_new, b_new
    return w.astype(np.float64), float(b)


def scored(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the struct of ``keep``, all columns by default) and ``result.score``, 0 to 1.

    A null text is scored as an empty one, which has the model's base rate.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.hashes, model.weights, model.bias))
    state = {}

    def score(texts: pa.Array) -> dict[str, list]:
        if not state:
            model = Model(*sent.value)
            state.update(grams=NGrams(), table=model.table(), model=model)
        model = state["model"]
        total = np.full(len(texts), model.bias)
        if len(model.hashes):
            for lo, bounds, found in state["grams"].of(texts):
                at, feature = _present(bounds, found, state["table"])
                total[lo : lo + len(bounds) - 1] += np.bincount(at, model.weights[feature], len(bounds) - 1)
        return {"score": 1 / (1 + np.exp(-np.clip(total, -30, 30)))}

    return map_texts(docs, text, score, "score double", keep)
