import hashlib
import math
import os
from collections import Counter

import corpus_pipeline
from leafstrata.llm import mixing, pieces, quality, simhash, stages
from leafstrata.llm.common import materialise, table
from tests.llm.frames import ROWS, clashing, documents

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_keep_columns_and_take_effect(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "poisson_mixing", "sentencepiece"]
    docs = table(spark, DATA, "documents")
    names, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(materialise(stage(spark, kept[-1], DATA), name))
        assert kept[-1].columns == names
    ids = [{r.doc_id: r.text for r in d.collect()} for d in kept]
    assert all(set(b) <= set(a) for a, b in zip(ids, ids[1:], strict=False))
    assert len(set(ids[2].values())) == len(ids[2]) == len(set(ids[1].values()))
    encoded = stages.encode(spark, kept[-1], DATA)
    assert encoded.count() == kept[-1].count() and all(r.lossless for r in encoded.collect())
    assert {(r.doc_id, r.text) for r in pieces.decode_documents(encoded).collect()} == set(ids[4].items())


def plain_run(spark):
    """run() by loops over the documents: the same model of quality, then texts, all pairs, draws and agendas one by one."""
    docs = table(spark, DATA, "documents")
    model = quality.fit(docs, table(spark, DATA, "labels"))
    rows = [(r.doc_id, r.text or "", r.source) for r in docs.collect()]
    score = model.score(quality.feature_matrix([t for _, t, _ in rows]))
    rows = [r for r, s in zip(rows, score, strict=True) if s >= quality.THRESHOLD]
    last = {}
    for i, t, source in sorted(rows):
        last[t] = (i, t, source)
    rows = sorted(last.values())
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t, _ in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b) or len(a & b) >= 0.8 * len(a | b):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    rows = [r for n, r in enumerate(rows) if group[n] == n]
    count = Counter(source for _, _, source in rows)
    units = {s: math.floor(math.sqrt(n) * 1e6 + 0.5) for s, n in count.items()}
    table_of_pieces, out = pieces.PieceTable(), []
    encoder = pieces.Encoder(table_of_pieces)
    for i, t, source in rows:
        rate = len(rows) * units[source] / sum(units.values()) / count[source]
        parts = max(math.ceil(rate / mixing.PIECE), 1)
        copies = 0
        for part in range(1, parts + 1):
            u = int(hashlib.md5(f"10:{i}:{part}".encode()).hexdigest()[:13], 16) / (1 << 52)
            p = c = math.exp(-rate / parts)
            for k in range(1, mixing.TERMS + 1):
                copies += c <= u
                p *= rate / parts / k
                c += p
        for copy in range(1, copies + 1):
            cut = pieces._WORD.findall(" " + t) if t else []
            keys = encoder.keys(i, copy, len(cut)).tolist()
            out.append((i, tuple(x for w, key in zip(cut, keys, strict=True) for x in pieces.segment(w, table_of_pieces, key, encoder.limit))))
    return sorted(out)


def test_run_equals_the_plain_version(spark):
    got = corpus_pipeline.run(spark, DATA).collect()
    want = plain_run(spark)
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == want and len(want) > 50
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in got)


def test_stages_on_awkward_rows(spark):
    """Nulls, empty, long and repeated texts, and extra columns: nothing fails, and what a stage may not drop stays."""
    docs = clashing(spark, skip=("TEXT",))
    kept = stages.exact(spark, docs, DATA)
    assert kept.columns == docs.columns and kept.count() == len({t or "" for _, t, *_ in ROWS})
    near = stages.near(spark, materialise(kept, "near"), DATA)
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} >= {None, 8, 9}
    mixed = stages.mixing_stage(spark, docs, DATA)
    assert mixed.columns == docs.columns
    assert stages.encode(spark, docs, DATA).where("NOT lossless").count() == 0
    accepted = stages.quality(spark, docs, DATA)
    assert accepted.columns == docs.columns and accepted.count() <= len(ROWS)
    for stage in (stages.quality, stages.exact, stages.near, stages.mixing_stage, stages.encode):
        assert stage(spark, documents(spark, []), DATA).count() == 0
