"""Each query on whole small tables against its SQL, or against a plain version."""

import base64
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

from leafstrata.llm import secrets, simhash
from leafstrata.llm.queries import ORACLE_SQL, QUERIES
from tests.check import same

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(name, table="documents"):
    return duckdb.sql(f"SELECT {name} FROM '{DATA}/{table}.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    same(QUERIES[name], ORACLE_SQL[name], spark, DATA)


def plain_fingerprint(text):
    import xxhash

    w = [x for x in text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()]
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash(spark):
    got = QUERIES["op1_simhash_near_dedup"](spark, DATA).toPandas().set_index("doc_id")
    fps = {i: plain_fingerprint(t) for i, t in rows("doc_id, text")}
    assert {i: int(x, 16) for i, x in got.fingerprint.items()} == fps
    reach = {i: {j for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4} for i in fps}
    for i in fps:
        seen, todo = {i}, [i]
        while todo:
            new = reach[todo.pop()] - seen
            seen |= new
            todo += new
        assert got.component_id[i] == min(seen)


def test_simhash_is_spark_xxhash64(spark):
    (r,) = spark.sql("SELECT xxhash64('a b c d')").collect()
    assert simhash.shingle_hashes("a b c d", 4).view(np.int64).tolist() == [r[0]]


def contract_spans(text):
    """The base spans by the contract's own words: leftmost matches a kind, then those that fail dropped."""
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    spans = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_base_spans_follow_the_contract(spark):
    got = QUERIES["op3_secret_scan"](spark, DATA).toPandas().set_index("doc_id")
    found = 0
    for i, t in rows("doc_id, text"):
        want = contract_spans(t)
        found += len(want)
        assert [got[f"n_{k}"][i] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in want) for k in ("assign", "access", "hex")]
        assert got.base_sha256[i] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
    assert found > 0


def test_secrets(spark):
    got = QUERIES["op3_secret_scan"](spark, DATA).toPandas().set_index("doc_id")
    for i, t in rows("doc_id, text"):
        spans = secrets.scan(t)
        listed = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert got.spans[i] == ",".join(listed)
        assert got.base_sha256[i] == hashlib.sha256(",".join(x for x in listed if not x.startswith("markov")).encode()).hexdigest()


@pytest.mark.parametrize(("name", "label", "modulus", "held"), [("op6_quality", "quality", 5, 0), ("op9_toxicity", "toxic", 3, 1)])
def test_classifiers_on_held_out_rows(spark, name, label, modulus, held):
    data = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, data).toPandas().set_index("doc_id")
    ids = [i for (i,) in duckdb.sql(f"SELECT doc_id FROM '{data}/documents.parquet'").fetchall()]
    assert sorted(got.index) == sorted(ids)
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % modulus == held) for i in ids)
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= (0.3 if label == "quality" else 0.7))).all()
    truth = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{data}/labels.parquet'").fetchall())
    out = [i for i in truth if got.held_out[i]]
    assert np.mean([got.predicted[i] == truth[i] for i in out]) > 0.93


def test_pieces(spark):
    import sentencepiece

    from leafstrata.llm.pieces import default_model

    got = QUERIES["op7_sentencepiece"](spark, DATA).toPandas().set_index("doc_id")
    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    assert got.lossless.all()
    for i, t in rows("doc_id, text"):
        assert sp.decode([int(x) for x in got.ids[i]]) == t and len(got.ids[i]) >= len(sp.encode(t))


def test_shards(spark):
    got = QUERIES["op8_sharding"](spark, DATA).toPandas().set_index("doc_id")
    texts = dict(rows("doc_id, text"))
    assert sorted(got.index) == sorted(texts)
    for i, t in texts.items():
        assert got["size"][i] == len(t.encode()) + 16 and got.text_crc32[i] == zlib.crc32(t.encode())
    counts = got.groupby("shard").slot.agg(list)
    assert all(sorted(x) == list(range(len(x))) for x in counts)
    sizes = [len(counts.get(s, [])) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1 and (got.law == "rows").all() and got.grown_shard.isna().all()


def test_warc_digest_label():
    from leafstrata.llm.warc import sha1_label

    assert base64.b32decode(sha1_label(b"abc")[5:]) == hashlib.sha1(b"abc").digest()
