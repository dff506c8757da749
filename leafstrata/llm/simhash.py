"""SimHash near-duplicates: pigeonring filtering before the full Hamming check.

A text's fingerprint has bit i set when over half of its word shingles' XXH64 values
have it set. Fingerprints link at ``tolerance`` or fewer differing bits. To find all
links without comparing all pairs, the 64 bits are cut into ``tolerance + 1`` segments
on a ring. If two fingerprints differ in at most t bits, then on some start of the ring
every chain of l consecutive segments differs in at most floor(l*t/(t+1)) bits: none in
the first segment, one in the first two, and so on. Each start gives an index key (the
first two segments) and probe keys (the same with one bit of the second segment turned
on); equal keys meet in an equi-join whose condition checks the longer chains and only
then the whole fingerprints.

Equal fingerprints are one node, so copies never multiply. Links go to the components
step, so that the result has one row per document and its class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafstrata.llm.common import lean, materialise, pick, table
from leafstrata.llm.components import connected_components

BITS = 64
#: Hashes turned into bits at a time; bounds the memory that a very long text takes.
CHUNK = 1 << 15


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included; fewer words: the whole sequence; none: no hash."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        return np.array([digest(joined, seed)], np.uint64)
    length = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(length + 1) - 1
    start = end - length
    pairs = zip(start[: len(w) - words + 1].tolist(), end[words - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], seed) for a, b in pairs), np.uint64, len(w) - words + 1)


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The text's 64-bit SimHash as an unsigned int; zero for a text without words."""
    h = shingle_hashes(text, words, seed)
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), CHUNK):
        part = h[i : i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp holds the fingerprint's 64 bits as a signed long. Narrow, no shuffle."""
    rows = pick(docs, "doc_id", "text")

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, words, seed) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, fp long")


def _ring(tolerance: int) -> list[tuple[int, list[int], list[int]]]:
    """For each start: its offset, and per chain length the chain's width in bits and its budget."""
    m = tolerance + 1
    widths = [BITS // m + (i < BITS % m) for i in range(m)]
    out = []
    for r in range(m):
        chain = np.cumsum([widths[(r + i) % m] for i in range(m)]).tolist()
        out.append((sum(widths[:r]), chain, [(i + 1) * tolerance // m for i in range(m)]))
    return out


def _low(width: int) -> int:
    """A mask of the lowest ``width`` bits, as a signed long."""
    return -1 if width >= BITS else (1 << width) - 1


def links(fps: DataFrame, tolerance: int = 4) -> DataFrame:
    """All pairs (a, b), a < b, of distinct fingerprints that differ in at most ``tolerance`` bits.

    ``fps`` has distinct longs in ``fp``. Rows made: tolerance + 1 index keys and on
    average (tolerance + 1) * (1 + width / 2) probe keys a fingerprint, whatever the
    groups' sizes.
    """
    if tolerance < 1:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    ring = _ring(tolerance)
    turned = "CASE r " + " ".join(
        f"WHEN {r} THEN " + (f"(shiftrightunsigned(fp, {o}) | shiftleft(fp, {BITS - o}))" if o else "fp") for r, (o, _, _) in enumerate(ring)
    ) + " END"
    two = 1 if tolerance > 1 else 0
    keyed = "CASE r " + " ".join(f"WHEN {r} THEN ring & {_low(c[two])}L" for r, (_, c, _) in enumerate(ring)) + " END"
    first = "CASE r " + " ".join(f"WHEN {r} THEN {c[0]}" for r, (_, c, _) in enumerate(ring)) + " END"
    second = "CASE r " + " ".join(f"WHEN {r} THEN {c[two] - c[0]}" for r, (_, c, _) in enumerate(ring)) + " END"
    rows = (
        fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(ring) - 1))).alias("r"))
        .withColumn("ring", F.expr(turned))
        .withColumn("key", F.expr(keyed))
    )
    index = rows.select("r", "key", F.col("fp").alias("b"), F.col("ring").alias("ring_b"))
    # turn 0 probes the key itself (pairs a < b), turn i > 0 the key with bit i-1 of the second segment turned on
    probe = (
        rows.withColumn("turn", F.explode(F.expr(f"sequence(0, {second})")))
        .withColumn("bit", F.expr(f"CASE WHEN turn = 0 THEN 0L ELSE shiftleft(1L, CAST({first} + turn - 1 AS INT)) END"))
        .where("key & bit = 0")
        .select("r", F.expr("key | bit").alias("key"), F.expr("turn = 0").alias("same"), F.col("fp").alias("a"), F.col("ring").alias("ring_a"))
    )
    chains = " AND ".join(
        "bit_count((ring_a ^ ring_b) & CASE p.r "
        + " ".join(f"WHEN {r} THEN {_low(c[i])}L" for r, (_, c, _) in enumerate(ring))
        + f" END) <= {ring[0][2][i]}"
        for i in range(two + 1, tolerance + 1)
    )
    whole = f"bit_count(a ^ b) <= {tolerance}"
    on = f"p.r = i.r AND p.key = i.key AND a <> b AND (NOT same OR a < b) AND {chains or 'true'} AND {whole}"
    # explode's rows are missing from Spark's estimates: by default it would broadcast one of the sides through the driver
    found = probe.alias("p").join(index.hint("merge").alias("i"), F.expr(on))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 4, tolerance: int = 4, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id in reach through links, the document itself
    included. A null or empty text has fingerprint zero and links like any other.
    Rows with a null doc_id are returned; their class is the smallest non-null id in
    reach, or null if there is none. Repeated rows come back repeated. Extra columns
    are ignored. An empty table gives no rows.
    """
    marked = materialise(fingerprints(docs, words, seed), "simhash")
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    comp = connected_components(links(nodes.select("fp"), tolerance))
    nodes = nodes.join(comp, nodes["fp"] == comp["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    nodes = materialise(nodes, "simhash-classes")
    lowest = nodes.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = nodes.join(lowest, "component").select(F.col("fp").alias("node"), "component_id")
    return marked.join(classes, marked["fp"] == classes["node"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
