"""Quality classifier: a generalised additive model with pairwise interactions over text statistics.

Features are rates of a whole text that don't depend on its length. The model is fitted on
the driver from a bounded sample of labelled rows and scores all documents in Arrow batches
by additions of table entries.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafstrata.llm.boosting import AdditiveModel
from leafstrata.llm.common import crc_remainder, lean, pick, table, training_rows

#: Labelled rows that the model is fitted on at most.
SAMPLE = 8000
THRESHOLD = 0.3
HELD_OUT = (5, 0)  # rows whose crc32(doc_id) mod 5 is 0 are never learned from

FEATURES = ("odd", "punctuation", "digits", "shouted", "marked", "bare", "echo", "top_word", "distinct", "word_length", "lines_again", "stops")
_USUAL = set(b".,;:'\"-?!()")
_CLASS = np.zeros((256, 3))
for _b in range(33, 127):
    if not chr(_b).isalnum():
        _CLASS[_b, 1 if _b in _USUAL else 0] = 1
_CLASS[48:58, 2] = 1
_STOPS = frozenset(
    "the of and to in is that for it with as was on be by this are or from at an a un une le la les des de du et en que qui "
    "pour par sur pas dans der die das und ist von zu den mit nicht sich auf ein eine el los las y del se por con su para al lo no es im".split()
)
#: Words counted at a time for the share of distinct words, so that long texts compare with short ones.
WINDOW = 200


def features(text: str | None) -> list[float]:
    """The FEATURES of a text; all zero for a null or empty one."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    odd, usual, digits = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS / len(raw)).tolist()
    n = len(words)
    lower = text.lower().split()
    shouted = sum(w.isupper() and len(w) > 1 for w in words)
    marked = sum(not w[-1].isalnum() and not w[-1] in ".,;:'\")-?" for w in words)
    bare = sum(len(w) == 1 and not w.isalnum() for w in words)
    seen = [(len(set(part)), len(part)) for part in (words[i : i + WINDOW] for i in range(0, n, WINDOW))]
    lines = [x for x in text.split("\n") if x]
    return [
        odd,
        usual,
        digits,
        shouted / n,
        marked / n,
        bare / n,
        sum(map(eq, words, words[1:])) / n,
        (max(Counter(words).values()) - 1) / n,
        sum(a for a, _ in seen) / sum(b**0.9 for _, b in seen),
        sum(map(len, words)) / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        sum(map(_STOPS.__contains__, lower)) / n,
    ]


def feature_matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel:
    """Fit on up to ``sample`` labelled rows. Their features are made on the executors; only numbers reach the driver.

    Without usable labels, or with one class only, the model scores every text alike: near
    that class, or 0.5.
    """
    rows = training_rows(labels, docs, "quality", *HELD_OUT, sample)

    def run(batches):
        for b in batches:
            x = feature_matrix(b.column(0).to_pylist())
            yield pa.record_batch([pa.array(list(x), pa.list_(pa.float64())), b.column(1)], names=["x", "label"])

    got = rows.select("text", "label").mapInArrow(lean(run), "x array<double>, label int").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(got.num_rows, len(FEATURES))
    y = np.array(got.column("label").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # the fit doesn't depend on the order in which rows arrive
    return AdditiveModel().fit(x[order], y[order])


def keep(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text the model scores at ``threshold`` or more, with all their columns.

    Narrow: texts pass through Arrow once, and rejected rows go on the spot. A null text
    counts as empty.
    """
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(model.score(feature_matrix(b.column(at).to_pylist())) >= threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Null and empty texts have all features zero and get one score in 0 .. 1; long texts are
    read whole. Null doc_ids count as the empty text in held_out. Repeated rows come back
    repeated, extra columns are ignored, an empty table gives no rows.
    """
    bare = pick(docs, "doc_id", "text")
    model = fit(bare, labels, sample)

    def run(batches):
        for b in batches:
            p = model.score(feature_matrix(b.column(1).to_pylist())) if b.num_rows else np.zeros(0)
            yield pa.record_batch([b.column(0), pa.array(p)], names=["doc_id", "score"])

    kind = bare.schema["doc_id"].dataType.simpleString()
    scored = bare.mapInArrow(lean(run), f"doc_id {kind}, score double")
    held = crc_remainder("doc_id", HELD_OUT[0]) == HELD_OUT[1]
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
