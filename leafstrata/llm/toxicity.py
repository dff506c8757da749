"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of lexicon hits, their closeness to the second person, capitals,
punctuation and obfuscation rates. The lexicon is learned from the labelled rows: whole
words, and beginnings of words, that toxic texts hold far more often than others. Its
counts are made on the executors; only the bounded lexicons and the features of a bounded
sample reach the driver, where trees are fitted. Margins out of fold calibrate the score:
each fold has a lexicon and trees of its own, which have not seen the fold's labels.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafstrata.llm.boosting import BoostedTrees, Isotonic
from leafstrata.llm.common import crc_remainder, discard, lean, materialise, pick, table, training_rows

#: Labelled rows that lexicon and trees are fitted on at most, and entries a lexicon holds at most.
SAMPLE, ENTRIES = 12000, 2000
THRESHOLD = 0.7
HELD_OUT = (3, 1)
FOLDS = 3
#: Lengths of the word beginnings that the lexicon considers, and the G statistic from which an entry counts.
BEGINNINGS, EVIDENCE = (4, 5, 6, 7), 20.0
#: Words before and after a second-person pronoun that count as near it.
NEAR = 5

SECOND_PERSON = frozenset(
    "you your yours yourself youre u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer tú ti tus usted ustedes vosotros".split()
)
_LEET = str.maketrans("013457@$!|", "oieastasil")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»„“”‘’…–—"
_PLAIN = re.compile(r"[^\W\d_]+")
_INNER = re.compile(r"[\W\d_]")
_LONG = re.compile(r"(.)\1\1")
_SQUEEZE = re.compile(r"(.)\1+")

FEATURES = (
    "word_hits", "start_hits", "log_word_hits", "log_start_hits", "weight", "distinct", "near_second", "second_person",
    "capitals", "exclaims", "punctuation", "mixed", "hidden_hits", "drawn_out",
)


def normal_forms(word: str) -> tuple[str, str]:
    """A lower-case word without marks at its ends, and what it may stand for behind digits, marks and drawn-out letters."""
    w = word.strip(_EDGE) or word
    if _PLAIN.fullmatch(w):
        return w, _SQUEEZE.sub(r"\1", w) if _LONG.search(w) else w
    return w, _SQUEEZE.sub(r"\1", _INNER.sub("", w.translate(_LEET)))


def entries(text: str) -> set[str]:
    """What a text offers to the lexicon: its words, and beginnings marked by a trailing ``*``."""
    words = {w.strip(_EDGE) for w in set(text.lower().split())}
    return {w for w in words if len(w) > 2} | {w[:k] + "*" for w in words for k in BEGINNINGS if len(w) > k}


def learn_lexicons(rows: DataFrame, folds: int = FOLDS, limit: int = ENTRIES) -> list[dict[str, float]]:
    """Entries over-represented in label 1 with their log odds; at most ``limit``, best evidence first.

    ``rows`` has text, label and fold. The first lexicon is of all rows, the others leave out
    a fold each. Entries are counted once, by fold.
    """
    names = [f"{c}{k}" for c in "ab" for k in range(folds)]

    def count(batches):
        held = [Counter() for _ in names]
        for b in batches:
            for text, label, fold in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held[fold + (0 if label else folds)].update(entries(text))
        keys = list(set().union(*held))
        yield pa.record_batch([pa.array(keys, pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in held]], names=["entry", *names])

    sizes = {(r["fold"], r["label"]): r["n"] for r in rows.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    counted = rows.select("text", "label", "fold").mapInArrow(lean(count), "entry string, " + ", ".join(f"{n} long" for n in names))
    counted = counted.groupBy("entry").agg(*[F.sum(n).alias(n) for n in names])
    counted = materialise(counted.where(" + ".join(f"a{k}" for k in range(folds)) + " >= 3"), "lexicon")
    out = []
    for without in (None, *range(folds)):
        used = [k for k in range(folds) if k != without]
        n1, n0 = (sum(sizes.get((k, label), 0) for k in used) for label in (1, 0))
        if not n1 or not n0:
            out.append({})
            continue
        share = n1 / (n1 + n0)
        of = counted.select("entry", *[sum((F.col(f"{c}{k}") for k in used[1:]), F.col(f"{c}{used[0]}")).alias(c) for c in "ab"]).where("a >= 3")
        g = F.expr(f"2 * (IF(a > 0, a * ln(a / ((a + b) * {share!r}D)), 0D) + IF(b > 0, b * ln(b / ((a + b) * {1 - share!r}D)), 0D))")
        odds = F.expr(f"ln((a + 0.5D) / {n1 + 1}D) - ln((b + 0.5D) / {n0 + 1}D)")
        best = of.select("entry", g.alias("g"), odds.alias("odds")).where(f"g >= {EVIDENCE}D AND odds > 1.5D")
        out.append({r["entry"]: float(r["odds"]) for r in best.orderBy(F.desc("g"), "entry").limit(limit).collect()})
    discard(counted)
    return out


class Features:
    """Feature rows of texts under a lexicon; a cache of bounded size judges a word once."""

    def __init__(self, lexicon: dict[str, float], cache: int = 200_000):
        self.words = {k: v for k, v in lexicon.items() if not k.endswith("*")}
        self.starts = {k[:-1]: v for k, v in lexicon.items() if k.endswith("*")}
        self.cache: dict[str, tuple[float, float, bool, bool, bool, str]] = {}
        self.most = cache

    def judge(self, word: str) -> tuple[float, float, bool, bool, bool, str]:
        """Weights as a word and as a beginning, hidden, mixed, drawn out, and the plain form."""
        plain, meant = normal_forms(word)
        whole = self.words.get(plain, 0.0)
        hidden = False
        if not whole and meant != plain and meant in self.words:
            whole, hidden = self.words[meant], True
        start = max((self.starts.get(plain[:k], 0.0) for k in BEGINNINGS if len(plain) > k), default=0.0)
        mixed = any(c.isalpha() for c in plain) and not _PLAIN.fullmatch(plain)
        got = (whole, start, hidden, mixed, bool(_LONG.search(plain)), plain)
        if len(self.cache) >= self.most:
            self.cache.clear()
        self.cache[word] = got
        return got

    def row(self, text: str | None) -> list[float]:
        words = (text or "").lower().split()
        if not words:
            return [0.0] * len(FEATURES)
        n, get, judge = len(words), self.cache.get, self.judge
        hits, second, whole, starts, weight, hidden, mixed, drawn = [], [], 0, 0, 0.0, 0, 0, 0
        distinct = set()
        for i, w in enumerate(words):
            a, b, h, m, d, plain = get(w) or judge(w)
            if a or b:
                hits.append(i)
                distinct.add(plain)
                whole += a > 0
                starts += b > 0
                weight += max(a, b)
                hidden += h
            mixed += m
            drawn += d
            if plain in SECOND_PERSON:
                second.append(i)
        near = 0
        if hits and second:
            at = np.searchsorted(second, hits)
            gaps = [min(abs(second[k] - h) for k in (max(j - 1, 0), min(j, len(second) - 1))) for h, j in zip(hits, at.tolist(), strict=True)]
            near = sum(g <= NEAR for g in gaps)
        capitals = sum(w.isupper() and len(w) > 1 for w in text.split())
        marks = text.count("!") + text.count("?")
        other = marks + sum(map(text.count, ".,;:*#%&$"))
        return [
            100 * whole / n, 100 * starts / n, float(np.log1p(whole)), float(np.log1p(starts)), weight / n**0.5, len(distinct) / n**0.5,
            100 * near / n, 100 * len(second) / n, capitals / n, marks / n, other / n, mixed / n, 100 * hidden / n, drawn / n,
        ]

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.row(t) for t in texts], float).reshape(len(texts), len(FEATURES))


class ToxicityModel:
    """Lexicon, trees and calibration; ``score`` gives probabilities of label 1."""

    def __init__(self, lexicon: dict[str, float], trees: BoostedTrees, calibration: Isotonic):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def features(self) -> Features:
        return Features(self.lexicon)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.calibration(self.trees.margin(x)), 0, 1) if len(x) else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Fit on up to ``sample`` labelled rows; with no usable labels every text scores 0.5, with one class near that class."""
    rows = training_rows(labels, docs, "toxic", *HELD_OUT, sample).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int"))
    rows = materialise(rows.select("text", "label", "fold"), "toxicity-sample")  # bounded by ``sample``
    lexicons = learn_lexicons(rows)

    def run(batches):
        each = [Features(x) for x in lexicons]
        for b in batches:
            wide = np.concatenate([made.matrix(b.column(0).to_pylist()) for made in each], axis=1)
            yield pa.record_batch([pa.array(list(wide), pa.list_(pa.float64())), b.column(1), b.column(2)], names=["x", "label", "fold"])

    got = rows.mapInArrow(lean(run), "x array<double>, label int, fold int").toArrow()
    discard(rows)
    x = np.array(got.column("x").to_pylist(), float).reshape(got.num_rows, len(FEATURES) * len(lexicons))
    y, fold = (np.array(got.column(c).to_pylist(), float) for c in ("label", "fold"))
    order = np.lexsort((*x.T, fold, y))  # the fit doesn't depend on the order in which rows arrive
    x, y, fold = x[order], y[order], fold[order]
    part = lambda k: x[:, len(FEATURES) * k : len(FEATURES) * (k + 1)]  # noqa: E731  the features under lexicon k
    margins = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any():
            own = part(k + 1)
            margins[fold == k] = BoostedTrees().fit(own[fold != k], y[fold != k]).margin(own[fold == k])
    return ToxicityModel(lexicons[0], BoostedTrees().fit(part(0), y), Isotonic().fit(margins, y))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Null and empty texts have all features zero and score like other texts without hits.
    Null doc_ids count as the empty text in held_out; repeated rows come back repeated;
    extra columns are ignored.
    """
    bare = pick(docs, "doc_id", "text")
    model = fit(bare, labels, sample)

    def run(batches):
        made = model.features()
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(model.score(made.matrix(b.column(1).to_pylist())))], names=["doc_id", "score"])

    kind = bare.schema["doc_id"].dataType.simpleString()
    scored = bare.mapInArrow(lean(run), f"doc_id {kind}, score double")
    held = crc_remainder("doc_id", HELD_OUT[0]) == HELD_OUT[1]
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
