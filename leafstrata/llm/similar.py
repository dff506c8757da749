"""Near-duplicates down to a shingle similarity: an exact join by shingle prefixes, after a cheap joining of crowds.

A similarity of 0.8 on shingles leaves about 15 % of a fingerprint's bits different, too
many for the pigeonring keys of ``simhash``. So candidates come from a prefix filter: under
one order of all shingles, rarest first, two sets of Jaccard t or more share one of the first
``n - ceil(t * n) + 1`` shingles of each. The order is by a sketch of shingle counts; its
errors cost candidates, never pairs. Sizes, places and parity bitmaps bound the similarity
from above and drop candidates before Jaccard is computed on the sets.

Only components are asked for, so pairs that are connected already are no candidates.
The pigeonring join of ``simhash`` over 64-bit fingerprints and its Hamming check come first:
they find the closest pairs. With neighbours of sorted 256-bit fingerprints they connect most
of a crowd of near copies; then every set is compared with one set of each of its prefix keys; and at last all
pairs that share a key and are still apart are compared. That last step leaves out no pair,
so the result doesn't depend on what the first two found.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafstrata.llm.common import discard, lean, materialise, pick, small
from leafstrata.llm.components import connected_components
from leafstrata.llm.simhash import CHUNK, links as ring_links, shingle_hashes

WORDS64 = 4
WIDE = 64 * WORDS64
FIELDS = tuple(f"f{i}" for i in range(WORDS64))
#: A parity bitmap of 256 slots as longs, which join conditions hold against similarity.
SLOTS = tuple(f"q{i}" for i in range(WORDS64))
#: Bits in which the 64-bit fingerprints of pairs of the pigeonring join differ at most.
TOLERANCE = 4
#: Orders in which fingerprints are sorted, bits sampled for an order, and neighbours looked at on one side.
ORDERS, SAMPLED, NEIGHBOURS = 8, 64, 2
#: Counters of the sketch that orders shingles, as a power of two, and least and most bits of a parity bitmap (powers of two).
SKETCH, PARITY = 18, (1024, 1 << 16)
#: A counter this far above four times the mean marks its shingles as hot.
HOT = 10_000
#: Contested keys before its own that a row remembers, so that two nodes don't meet at each key that they share.
PASSED = 8
#: Keeps rounding from dropping a pair at the similarity itself.
EPS = 1e-9


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """256 bits as 4 unsigned longs: the SimHash of four mixes of each shingle's hash."""
    if not len(hashes):
        return np.zeros(WORDS64, np.uint64)
    ones = np.zeros(WIDE, np.int64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), CHUNK // WORDS64):
            h = hashes[i : i + CHUNK // WORDS64, None] + np.arange(WORDS64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
            ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(len(h), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).view(">u8").astype(np.uint64)


def node_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles, given as its sorted distinct hashes."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))


def _spread(similarity: float, bits: int, sigmas: float) -> int:
    """Differing bits that a pair of that Jaccard similarity stays within, sigmas above the mean."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + sigmas * math.sqrt(bits * p * (1 - p)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of hashes; two empty sets are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def parity(shingles: np.ndarray) -> bytes:
    """A bit for each slot of hashes: whether it holds an odd number of them. Bitmaps differ in at most as many bits as the sets have differing elements.

    Twice as many slots as hashes, as a power of two within PARITY; halves of a longer
    bitmap fold into the shorter one's slots.
    """
    slots = 1 << min(max(2 * len(shingles) - 1, PARITY[0] - 1).bit_length(), PARITY[1].bit_length() - 1)
    return np.packbits(np.bincount((shingles & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1, bitorder="little").tobytes()


def slots(shingles: np.ndarray) -> np.ndarray:
    """parity() of WIDE slots, as longs."""
    odd = np.bincount((shingles & np.uint64(WIDE - 1)).astype(np.int64), minlength=WIDE) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def parity_difference(x: bytes, y: bytes) -> int:
    """Slots in which two parity bitmaps differ, by the shorter one's slots."""
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        half = len(x) // 2
        x = (int.from_bytes(x[:half], "little") ^ int.from_bytes(x[half:], "little")).to_bytes(half, "little")
    return (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count()


def prefix(shingles: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles in the order of ``counts`` by slot, rarest first, of which a similar set must share one."""
    n = len(shingles)
    if not n:
        return shingles
    some = min(n, n - math.ceil(similarity * n - EPS) + 1)
    return shingles[np.lexsort((shingles, counts[_slot(shingles)]))[:some]]


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH)).astype(np.int64)


def _sketch(parts: DataFrame) -> np.ndarray:
    """The sum of the tasks' sketches: counts of distinct shingles by the top bits of their hashes."""

    def slots(batches):
        for b in batches:
            for blob in b.column(0).to_pylist():
                n = np.frombuffer(blob, np.int32)
                at = np.flatnonzero(n)
                yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["slot", "n"])

    got = parts.mapInArrow(lean(slots), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SKETCH, np.int64)
    counts[got["slot"].to_numpy()] = got["n"].to_numpy()
    return counts


def _shared(batches):
    """Of rows (key, node, size, place) sorted by key and node, each node once: those whose key another node has, and all with a negative place, which marks hot keys."""
    names = ["key", "node", "size", "place"]
    held = [np.zeros(0, np.int64)] * 4  # the last row, while it isn't known whether another node has its key
    last = None  # key and node of the last row that was decided
    for b in batches:
        if not b.num_rows:
            continue
        key, node, size, place = (np.concatenate([h, b.column(n).to_numpy()]) for h, n in zip(held, names, strict=True))
        again = np.zeros(len(key), bool)
        again[1:] = (key[1:] == key[:-1]) & (node[1:] == node[:-1])
        again[0] = last == (key[0], node[0])
        key, node, size, place = (x[~again] for x in (key, node, size, place))
        held = [x[:0] for x in (key, node, size, place)]
        if not len(key):
            continue
        met = place < 0
        same = key[1:] == key[:-1]
        met[1:] |= same
        met[:-1] |= same
        met[0] |= last is not None and last[0] == key[0]
        if not met[-1]:
            held = [x[-1:] for x in (key, node, size, place)]
        if len(key) > len(held[0]):
            last = (key[-1 - len(held[0])], node[-1 - len(held[0])])
        out = (key[met], node[met], size[met].astype(np.int32), np.abs(place[met]).astype(np.int32))
        yield pa.record_batch([pa.array(x) for x in out], names=names)


def similar_nodes(docs: DataFrame, words: int = 5, similarity: float = 0.8, seed: int = 42, orders: int = ORDERS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of all rows and links (a, b) between nodes.

    A node stands for the rows with one set of shingles. Links join nodes whose sets have
    the similarity; they are not all such pairs, but connect what all such pairs connect.
    """
    rows = pick(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def mark(batches):
        total = np.zeros(1 << SKETCH, np.int32)
        names = ["doc_id", "node", "size", "parity", *FIELDS, *SLOTS]
        column = pa.array([], pa.int64())
        for b in batches:
            hashes = [np.unique(shingle_hashes(t, words, seed)) for t in b.column(1).to_pylist()]
            for h in hashes:
                np.add.at(total, _slot(h), 1)
            ids = np.fromiter(map(node_of, hashes), np.int64, len(hashes))
            fps = np.array([wide_fingerprint(h) for h in hashes], np.uint64).reshape(-1, WORDS64)
            odd = np.array(list(map(slots, hashes)), np.int64).reshape(-1, WORDS64)
            longs = [pa.array(np.ascontiguousarray(x)) for x in (*fps.view(np.int64).T, *odd.T)]
            column = b.column(0)
            yield pa.record_batch([column, pa.array(ids), pa.array(np.array(list(map(len, hashes)), np.int32)), pa.array(list(map(parity, hashes)), pa.binary()), *longs], names=names)
        empty = [pa.nulls(1, column.type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([total.tobytes()], pa.binary()), *[pa.nulls(1, pa.int64())] * (2 * WORDS64)]
        if total.any():  # the task's sketch, as a row without a node
            yield pa.record_batch(empty, names=names)

    made = rows.mapInArrow(lean(mark), f"doc_id {kind}, node long, size int, parity binary, " + ", ".join(f"{f} long" for f in (*FIELDS, *SLOTS)))
    written = materialise(made, "similar")
    marked = written.where("node IS NOT NULL")
    nodes = materialise(marked.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.first(f).alias(f) for f in ("size", "parity", *FIELDS, *SLOTS)]), "similar-nodes")
    counts = _sketch(written.where("node IS NULL").select("parity"))
    hot = counts > 4 * counts.mean() + HOT

    def sets(batches):
        for b in batches:
            made = [np.unique(shingle_hashes(t, words, seed)) for t in b.column(1).to_pylist()]
            own = pa.array([node_of(x) == n for x, n in zip(made, b.column(0).to_pylist(), strict=True)], pa.bool_())  # rows may share a doc_id
            yield pa.record_batch([b.column(0), pa.array([x.tobytes() for x in made], pa.binary())], names=["node", "shingles"]).filter(own)

    def check(batches):
        for b in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            ok = [jaccard(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) >= similarity for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def possible(batches):
        share = (1 - similarity) / (1 + similarity)
        for b in batches:
            a, c, na, nb, x, y = (b.column(i).to_pylist() for i in range(6))
            ok = [parity_difference(p, q) <= share * (n + m) + EPS for n, m, p, q in zip(na, nb, x, y, strict=True)]
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def checked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sets are similar enough, written. Bitmaps rule out most of the others before sets are made."""
        pair = materialise(pairs, "similar-near")
        one, two = (nodes.select(F.col("node").alias(x), F.col("size").alias(f"n{x}"), F.col("parity").alias(f"{x}_p")) for x in ("a", "b"))
        close = pair.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "a_p", "b_p").mapInArrow(lean(possible), "a long, b long")
        close = materialise(close, "similar-pairs")
        asked = close.select(F.col("a").alias("node")).union(close.select("b")).distinct()
        wanted = materialise(nodes.join(asked, "node").select("node", "doc_id"), "similar-asked")
        held = rows.join(small(wanted), "doc_id")
        shingled = materialise(held.select("node", "text").mapInArrow(lean(sets), "node long, shingles binary").dropDuplicates(["node"]), "similar-shingles")
        one, two = (shingled.select(F.col("node").alias(x), F.col("shingles").alias(f"{x}_s")) for x in ("a", "b"))
        found = materialise(close.join(one, "a").join(two, "b").select("a", "b", "a_s", "b_s").mapInArrow(lean(check), "a long, b long"), "similar-links")
        discard(pair, close, wanted, shingled)
        return found

    def bounded(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of candidates (node, size, place and the other's) that sizes and places don't rule out."""
        low, high = F.least("size", "o_size"), F.greatest("size", "o_size")
        shared = F.lit(1) + F.least(F.col("size") - F.col("place"), F.col("o_size") - F.col("o_place"))  # at most, if this key is the first in common
        fit = pairs.where((low >= similarity * high - EPS) & (shared * (1 + similarity) >= similarity * (low + high) - EPS))
        return fit.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).where("a <> b").distinct()

    def labelled(keys: DataFrame, links: DataFrame) -> DataFrame:
        """Keys with the component of their node, and whether it has more nodes than one."""
        comp = small(materialise(connected_components(links).withColumnRenamed("node", "_n"), "similar-components"))
        tops = small(materialise(comp.select(F.col("component").alias("_t")).distinct(), "similar-tops"))
        of = keys.join(comp, keys["node"] == comp["_n"], "left").join(tops, F.col("node") == F.col("_t"), "left")
        label = F.coalesce("component", "node").alias("label")
        return of.select("key", "node", "size", "place", label, (F.col("component").isNotNull() | F.col("_t").isNotNull()).alias("joined"))

    def contested(keys: DataFrame) -> DataFrame:
        """Keys whose rows have several labels, each row with one row of the key's chosen label: partial aggregates, then a join that splits."""
        chosen = F.max(F.struct("joined", "label", "node", "size", "place")).alias("o")
        several = keys.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), chosen).where("_low <> _high")
        hubs = several.select(F.col("key").alias("_k"), F.col("o.label").alias("hub"), F.col("o.node").alias("o_node"), F.col("o.size").alias("o_size"), F.col("o.place").alias("o_place"))
        hubs = materialise(hubs, "similar-hubs")
        found = materialise(keys.join(small(hubs), keys["key"] == hubs["_k"]).drop("_k"), "similar-contested")
        discard(hubs)
        return found

    def keyed(batches):
        for b in batches:
            made = [np.unique(shingle_hashes(t, words, seed)) for t in b.column(0).to_pylist()]
            first = [prefix(x, counts, similarity) for x in made]
            some = list(map(len, first))
            if sum(some):
                keys = np.concatenate(first)
                ids, size = np.repeat([node_of(x) for x in made], some), np.repeat(np.array(list(map(len, made)), np.int32), some)
                place = np.concatenate([np.arange(1, n + 1, dtype=np.int32) for n in some])
                place[hot[_slot(keys)]] *= -1
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(ids), pa.array(size), pa.array(place)], names=["key", "node", "size", "place"])

    # Most keys are of one node, and go at the first exchange. It deals a hot key's rows by their nodes,
    # unlooked at: they are kept whether or not the key has other nodes, which can only cost work.
    columns = "key long, node long, size int, place int"
    dealt = rows.select("text").mapInArrow(lean(keyed), columns).repartition(F.col("key"), F.when(F.col("place") < 0, F.col("node")))
    keys = materialise(dealt.sortWithinPartitions("key", "node").mapInArrow(lean(_shared), columns), "similar-shared")
    links = checked(_ring_candidates(nodes).unionByName(_candidates(nodes, orders, similarity, seed)).distinct())
    known = contested(labelled(keys, links))
    discard(keys)
    links = links.unionByName(checked(bounded(known.where("label <> hub"))))
    again = contested(labelled(known.select("key", "node", "size", "place"), links))
    discard(known)
    # two nodes that share many keys need to meet once: not at a key where both have passed another shared one
    passed = F.collect_list("key").over(Window.partitionBy("node").orderBy("place").rowsBetween(-PASSED, -1))
    known = materialise(again.select("key", "label", "hub", "node", "size", "place").withColumn("passed", passed), "similar-passed")
    discard(again)
    # sets that differ in more slots than similar ones can are no pair: told where they meet, so that a crowd with a rare key in common makes no pairs by its square
    parities = nodes.select(F.col("node").alias("_n"), *SLOTS)
    written_known = known
    known = known.join(parities, known["node"] == parities["_n"]).drop("_n")
    # of two rows with different labels one at least is outside the key's chosen label
    other = known.select(F.col("key").alias("_k"), F.col("label").alias("_l"), F.col("node").alias("o_node"), F.col("size").alias("o_size"), F.col("place").alias("o_place"), F.col("passed").alias("o_passed"), *[F.col(q).alias(f"o_{q}") for q in SLOTS])
    outside = known.where("label <> hub").select("key", "label", "node", "size", "place", "passed", *SLOTS)
    differ = sum((F.bit_count(F.col(q).bitwiseXOR(F.col(f"o_{q}"))) for q in SLOTS), F.lit(0))
    alike = differ <= (1 - similarity) / (1 + similarity) * (F.col("size") + F.col("o_size")) + EPS
    meet = (outside["key"] == other["_k"]) & (outside["label"] != other["_l"]) & alike & ~F.arrays_overlap("passed", "o_passed")
    pairs = outside.join(other, meet).drop("passed", "o_passed", *SLOTS, *[f"o_{q}" for q in SLOTS])
    links = links.unionByName(checked(bounded(pairs)))
    discard(written_known, nodes)
    return marked.select("doc_id", "node"), links


def _neighbours(batches, key_bits: int, all_bits: int):
    """Of rows (t, key, node, fingerprint) sorted by t and key: pairs (a, b) of a node with one of the NEIGHBOURS before it, if few bits differ."""
    held = np.zeros((3 + WORDS64, 0), np.int64)
    for b in batches:
        old = held.shape[1]
        rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])], 1)
        for i in range(1, NEIGHBOURS + 1):
            at = np.arange(max(i, old), rows.shape[1])
            x, y = rows[:, at], rows[:, at - i]
            differ = np.bitwise_count((x ^ y).view(np.uint64))
            close = (x[0] == y[0]) & (differ[1] <= key_bits) & (differ[3:].sum(0) <= all_bits)
            one, two = x[2, close], y[2, close]
            yield pa.record_batch([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"])
        held = rows[:, -NEIGHBOURS:].copy()


def _candidates(nodes: DataFrame, count: int, similarity: float, seed: int) -> DataFrame:
    """Pairs (a, b) of neighbours in ``count`` orders with close fingerprints.

    Sorted rows carry the whole fingerprint, so that candidates are checked where they meet.
    Ranges of the order are dealt to tasks, so that a crowd of one fingerprint is split; rows
    on both sides of a cut don't meet, which costs later steps work and loses no link.
    """

    def orders(batches):
        rng = np.random.default_rng(seed)
        picks = [rng.choice(WIDE, SAMPLED, replace=False) for _ in range(count)]
        for b in batches:
            raw = np.stack([b.column(1 + i).to_numpy(zero_copy_only=False) for i in range(WORDS64)], 1).astype(">i8")
            bits = np.unpackbits(raw.view(np.uint8).reshape(len(raw), -1), axis=1)
            for t, at in enumerate(picks):
                keys = np.ascontiguousarray(np.packbits(bits[:, at], axis=1)).view(">i8").ravel().astype(np.int64)
                yield pa.record_batch([pa.array(np.full(len(keys), t, np.int32)), pa.array(keys), *b.columns], names=["t", "key", "node", *FIELDS])

    rows = nodes.select("node", *FIELDS).mapInArrow(lean(orders), "t int, key long, node long, " + ", ".join(f"{f} long" for f in FIELDS))
    near = partial(_neighbours, key_bits=_spread(similarity, SAMPLED, 2), all_bits=_spread(similarity, WIDE, 3))
    order = ["t", "key", *FIELDS, "node"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(lean(near), "a long, b long").distinct()


def _ring_candidates(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes by the pigeonring join over their 64-bit fingerprints. Nodes of one fingerprint hang on its smallest, which stands for them."""
    of = nodes.groupBy(F.col("f0").alias("fp")).agg(F.min("node").alias("rep"))
    one, two = (of.select(F.col("fp").alias(x), F.col("rep").alias(f"r{x}")) for x in ("a", "b"))
    near = ring_links(of.select("fp"), TOLERANCE).join(one, "a").join(two, "b").select(F.col("ra").alias("x"), F.col("rb").alias("y"))
    same = nodes.join(of, nodes["f0"] == of["fp"]).where("node <> rep").select(F.col("node").alias("x"), F.col("rep").alias("y"))
    return near.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def keep_one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with all columns, one document of each group of near-duplicates.

    The smallest doc_id of a group stays. Rows with a null doc_id, and rows that share the
    kept doc_id, stay as well. Null and empty texts are near-duplicates of each other.
    """
    marked, links = similar_nodes(docs, words, similarity)
    comp = connected_components(links)
    lowest = marked.join(comp, "node", "left").select("doc_id", F.coalesce("component", "node").alias("c"))
    lowest = materialise(lowest, "similar-classes")
    keep = lowest.groupBy("c").agg(F.min("doc_id").alias("keep"), F.count("*").alias("n")).where("n > 1")
    gone = materialise(lowest.join(keep, "c").where("doc_id <> keep").select(F.col("doc_id").alias("_gone")).distinct(), "similar-gone")
    discard(lowest)
    side = small(gone)
    return docs.join(side, docs["doc_id"] == side["_gone"], "left_anti")
