"""Secret scans: fixed patterns, and character Markov models of random and ordinary strings.

Two first-order Markov models over characters are trained from labelled samples: random
strings on one side, ordinary identifiers and words on the other. A token's score is the
log-likelihood ratio of the two models per transition; tokens well on the random side are
reported as spans of their own kind beside the spans of the fixed patterns, which stay
whatever the models say.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from leafstrata.llm.common import pick, table

#: Kinds in the order in which they are listed at equal starts.
KINDS = ("assign", "access", "hex", "markov")


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])
ASSIGN = re.compile(rf"(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: A token that the models judge: a whole run of the characters that keys are made of. A '=' may stand before it, or pad its end.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?(?![A-Za-z0-9+/_-])")
#: Mean log-likelihood ratio per transition, in nats, from which a token counts as random.
THRESHOLD = 0.55

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
_CODE = np.full(128, -1, np.int16)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))

#: Words of which the ordinary identifiers of the training sample are composed.
WORDS = (
    "account action address admin alert array async backup base batch binary block buffer build button cache call "
    "channel check child class clear client close cluster code column command common config connect content context "
    "control copy count create current customer data date default delete detail device digest direct document domain "
    "download driver dynamic edit element email enable encode engine entry error event exception export factory field "
    "file filter final find first folder format frame front function general get global group handler hash header "
    "height helper hidden history host image import index info init inner input insert instance interface internal "
    "item java job join key label language last layout length level library limit line link list listener load local "
    "lock logger login loop main manager map master match matrix max memory menu message meta method metric min mode "
    "model module month mouse name native network next node normal notification null number object offset open "
    "operation option order output owner package page panel parameter parent parse partition password path payment "
    "plugin point policy pool port position prefix preview price process product profile project property provider "
    "public query queue random range read record reference region register release remote render report request "
    "resource response result return role root route row rule sample scan schema scope screen script search section "
    "select sender sequence server service session setting shape share size sort source space stack start state static "
    "status step stop storage store stream string style submit success summary support switch system table target task "
    "template test text thread time title token total trace transfer transform tree trigger type unit update upload "
    "user utility valid value variable vector version video view virtual visible wait warning widget width window "
    "word worker workflow wrapper write year zone"
).split()


def training_sample(n: int = 4000, seed: int = 3) -> tuple[list[str], list[str]]:
    """Labelled samples: ``n`` random strings and ``n`` ordinary identifiers, drawn with a seed."""
    rng = np.random.default_rng(seed)
    sets = (ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:62], ALPHABET[:26] + ALPHABET[52:62], "0123456789abcdef")
    random = ["".join(rng.choice(list(sets[i % len(sets)]), int(rng.integers(20, 64)))) for i in range(n)]
    plain = []
    for i in range(n):
        w = list(rng.choice(WORDS, int(rng.integers(2, 6))))
        kind = i % 6
        if kind == 0:
            s = "_".join(w)
        elif kind == 1:
            s = w[0] + "".join(x.title() for x in w[1:])
        elif kind == 2:
            s = "-".join(w)
        elif kind == 3:
            s = "_".join(w).upper()
        elif kind == 4:
            s = "/".join(w) + f"/{int(rng.integers(1, 3000))}"
        else:
            s = "".join(w)
        plain.append(s)
    return random, plain


def _train(sample: list[str]) -> np.ndarray:
    """Log probabilities of the next character given the last, with additive smoothing."""
    k = len(ALPHABET)
    counts = np.full((k, k), 0.5)
    for s in sample:
        c = _CODE[np.frombuffer(s.encode("ascii"), np.uint8)]
        np.add.at(counts, (c[:-1], c[1:]), 1)
    return np.log(counts / counts.sum(1, keepdims=True))


@lru_cache(maxsize=4)
def model(n: int = 4000, seed: int = 3) -> np.ndarray:
    """The table of log-likelihood ratios, random over ordinary, by pair of characters."""
    random, plain = training_sample(n, seed)
    return _train(random) - _train(plain)


def ratio(token: str, table_of_ratios: np.ndarray | None = None) -> float:
    """Mean log-likelihood ratio per transition; below zero for a token of one character or none."""
    c = _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]
    if len(c) < 2:
        return -1.0
    return float((model() if table_of_ratios is None else table_of_ratios)[c[:-1], c[1:]].mean())


def scan(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, in code points, ordered by start and then kind."""
    if not text:
        return []
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    llr = model()
    spans += [("markov", m.start(), m.end()) for m in TOKEN.finditer(text) if ratio(m.group(), llr) >= threshold]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id and spans, an array of (kind, start, end).

    Null and empty texts have no spans. Whole texts are read, in Arrow batches; nothing
    is shuffled. Repeated rows come back repeated, extra columns are ignored, and null
    doc_ids are kept.
    """
    rows = pick(docs, "doc_id", "text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan(t, threshold)] for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    of = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {of}, spans array<struct<kind:string,start:int,end:int>>")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    listed = "transform({0}, s -> concat_ws(':', s.kind, s.start, s.end))"
    base = "filter(spans, s -> s.kind <> 'markov')"
    count = "CAST(size(filter(spans, s -> s.kind = '{0}')) AS BIGINT) AS n_{0}"
    return found.selectExpr(
        "doc_id",
        *[count.format(k) for k in KINDS[:3]],
        f"sha2(CAST(array_join({listed.format(base)}, ',') AS BINARY), 256) AS base_sha256",
        f"array_join({listed.format('spans')}, ',') AS spans",
    )
