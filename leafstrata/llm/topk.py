"""Exact top-k by inner product with vector-approximation files.

Vectors are packed into blocks of fixed size. Each block has a VA file, built once: every
dimension is quantised into cells of about equal population, so that a vector is a byte a
dimension, and the cells' ends bound any candidate's score from both sides.

Phase 1 scans the VA files against packs of queries; exact vectors stay where they are. The
kth highest lower bound over all blocks is a score that the kth result reaches for certain;
only candidates whose upper bound reaches it survive. Phase 2 reads the survivors' exact
vectors, each once, and goes through every query's survivors in the order of their bounds
until the kth exact score is above the next bound.

Query packs meet blocks by an equi-join on numbers: a stated query set against all rows,
in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafstrata.llm.common import discard, lean, materialise, pick, small, table

#: Vectors in a candidate block and in a query pack; a block's VA file and a pack meet in a row of a few MB.
BLOCK, QUERY_PACK = 8192, 512
#: log2 of the number of cells of a dimension.
CELL_BITS = 8
#: Parts into which the list of blocks is dealt where packs meet it.
DEAL = 64


def _clean(batches, scale: float):
    """(id, vector) of the rows that take part: floor(scale * x) of finite components, at least one."""
    for b in batches:
        for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if i is None or not v.is_valid or v.values.null_count:
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if len(x) and np.isfinite(x).all():
                yield i, np.floor(scale * x) + 0.0  # no negative zero


class VaFile:
    """Cells of a block of vectors (rows of float64) and the ends of each cell."""

    def __init__(self, cells: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.cells, self.low, self.high = cells, low, high

    @classmethod
    def of(cls, vectors: np.ndarray, bits: int = CELL_BITS) -> VaFile:
        n, dim = vectors.shape
        count = 1 << bits
        cells = np.empty((n, dim), np.uint8 if bits <= 8 else np.uint16)
        low, high = np.zeros((dim, count)), np.zeros((dim, count))
        for d in range(dim):
            x = np.ascontiguousarray(vectors[:, d])
            edges = np.unique(np.quantile(x, np.linspace(0, 1, count + 1)[1:-1], method="nearest")) if n > 1 else x[:0]
            cell = np.searchsorted(edges, x, side="right")
            cells[:, d] = cell
            least, most = np.full(count, np.inf), np.full(count, -np.inf)
            np.minimum.at(least, cell, x)
            np.maximum.at(most, cell, x)
            used = least <= most
            low[d][used], high[d][used] = least[used], most[used]
        return cls(cells, low, high)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores, a row a query, with room for rounding."""
        at = np.arange(self.cells.shape[1])
        floor, ceil = self.low[at, self.cells], self.high[at, self.cells]
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        slack = 1e-9 * (np.abs(queries) @ np.maximum(np.abs(self.low), np.abs(self.high)).max(1))[:, None]
        return up @ floor.T + down @ ceil.T - slack, up @ ceil.T + down @ floor.T + slack


def kth_highest(values: np.ndarray, k: int) -> np.ndarray:
    """Of each row, -inf where it has fewer than k."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, -k]


def read_in_order(query: np.ndarray, candidates, k: int) -> tuple[list[tuple[int, int]], int]:
    """(score, id) of the k best of ``candidates`` (bound, id, vector; bounds falling), ties to the smaller id, and how many vectors were read."""
    best: list[tuple[int, int]] = []
    read = 0
    for bound, i, vector in candidates:
        if len(best) == k and best[-1][0] > bound:
            break
        read += 1
        best = sorted([*best, (int(vector @ query), i)], key=lambda b: (-b[0], b[1]))[:k]
    return best, read


_BLOCK = "dim int, ids binary, vectors binary, cells binary, low binary, high binary"
_QUERY = "query_id long, key long, dim int, vector binary"
_PACK = "dim int, q_ids binary, q_keys binary, q_vectors binary"


def _blocks(size: int, scale: float, bits: int):
    """mapInArrow: rows (id, vector) to blocks of at most ``size`` vectors of one dimension, with their VA file."""

    def run(batches):
        held: dict[int, list] = {}

        def block(dim):
            rows = held.pop(dim)
            vectors = np.stack([r[1] for r in rows])
            va = VaFile.of(vectors, bits)
            parts = [np.array([r[0] for r in rows], np.int64), vectors, va.cells, va.low, va.high]
            return pa.record_batch([pa.array([dim], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], names=["dim", "ids", "vectors", "cells", "low", "high"])

        for i, x in _clean(batches, scale):
            held.setdefault(len(x), []).append((i, x))
            if len(held[len(x)]) == size:
                yield block(len(x))
        for dim in list(held):
            yield block(dim)

    return run


def _queries(scale: float):
    def run(batches):
        for b in batches:
            rows = [(i, np.uint64(xxhash.xxh64_intdigest(x.tobytes())).view(np.int64), len(x), x.tobytes()) for i, x in _clean([b], scale)]
            cols = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["query_id", "key", "dim", "vector"])

    return run


def _packs(size: int):
    def run(batches):
        held: dict[int, list] = {}

        def pack(dim):
            ids, keys, vectors = zip(*held.pop(dim), strict=True)
            parts = [np.array(ids, np.int64).tobytes(), np.array(keys, np.int64).tobytes(), b"".join(vectors)]
            return pa.record_batch([pa.array([dim], pa.int32()), *[pa.array([x], pa.binary()) for x in parts]], names=["dim", "q_ids", "q_keys", "q_vectors"])

        for b in batches:
            for i, key, dim, vector in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(dim, []).append((i, key, vector))
                if len(held[dim]) == size:
                    yield pack(dim)
        for dim in list(held):
            yield pack(dim)

    return run


def _scan(k: int, bits: int):
    """Phase 1, a row a block and a pack: each query's candidates that reach the block's own kth lower bound, and its k highest lower bounds."""
    cell = np.uint8 if bits <= 8 else np.uint16

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                dim = r["dim"]
                va = VaFile(np.frombuffer(r["cells"], cell).reshape(-1, dim), *(np.frombuffer(r[x]).reshape(dim, -1) for x in ("low", "high")))
                ids, own, keys = (np.frombuffer(r[x], np.int64) for x in ("ids", "q_ids", "q_keys"))
                lower, upper = va.bounds(np.frombuffer(r["q_vectors"]).reshape(-1, dim))
                itself = own[:, None] == ids
                lower[itself] = upper[itself] = -np.inf
                q, at = np.nonzero((upper >= kth_highest(lower, k)[:, None]) & ~itself)
                high = np.partition(lower, -k, axis=1)[:, -k:] if lower.shape[1] > k else lower
                floor = np.zeros(len(q))
                # the k highest lower bounds ride on the first k candidates of their query
                start = np.searchsorted(q, np.arange(len(own)))
                turn = np.arange(len(q)) - start[q]
                carried = turn < high.shape[1]
                floor[carried] = np.sort(high, axis=1)[:, ::-1][q[carried], turn[carried]]
                floor[~carried] = -np.inf
                yield pa.record_batch(
                    [pa.array(own[q]), pa.array(keys[q]), pa.array(np.full(len(q), r["block"], np.int64)), pa.array(at.astype(np.int32)), pa.array(ids[at]), pa.array(upper[q, at]), pa.array(floor)],
                    names=["query_id", "key", "block", "place", "vec_id", "bound", "floor"],
                )

    return run


def _fetch(batches):
    """The exact vectors at a block's asked places."""
    for b in batches:
        for r in b.to_pylist():
            vectors = np.frombuffer(r["vectors"]).reshape(-1, r["dim"])
            yield pa.record_batch(
                [pa.array(np.full(len(r["places"]), r["block"], np.int64)), pa.array(r["places"], pa.int32()), pa.array([vectors[p].tobytes() for p in r["places"]], pa.binary())],
                names=["block", "place", "exact"],
            )


def _rank(k: int):
    """Phase 2 over rows sorted by query and falling bound."""

    def run(batches):
        def flush(of, rows):
            query = np.frombuffer(rows[0][3])
            best, read = read_in_order(query, ((b, i, np.frombuffer(x)) for b, i, x, _ in rows), k)
            return [(of[0], n + 1, i, s, read) for n, (s, i) in enumerate(best)]

        def made(out):
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["query_id", "rank", "vec_id", "score", "read"])

        of, rows = None, []
        for b in batches:
            out = []
            for i, key, bound, vec, exact, query in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if of != (i, key):
                    if rows:
                        out += flush(of, rows)
                    of, rows = (i, key), []
                rows.append((bound, vec, exact, query))
            if out:
                yield made(out)
        if rows:
            yield made(flush(of, rows))

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, bits: int = CELL_BITS) -> DataFrame:
    """Each query's k highest integer inner products of floor(scale * x): query_id, rank, vec_id, score, read.

    Both sides have vec_id and embedding; a query never meets rows of its own vec_id. Ties
    go to the smaller vec_id. Vectors that are null or empty or hold null or non-finite
    components, and rows without vec_id, take no part; vectors of another dimension than the
    query's aren't comparable and are no candidates of it. Repeated candidate rows are
    candidates of their own; queries equal in vec_id and vector are one query, queries that
    share only the vec_id are ranked apart. Fewer candidates than k give as many rows; no
    candidates or queries, none. Scores are exact while scale * |x| stays below 2^20 for up
    to 2^12 dimensions (float64). ``read`` counts the exact vectors that were read for the
    query. Extra columns are ignored. A query's survivors are gathered in one task; they
    are few unless very many candidates tie.
    """
    made = pick(vectors, "vec_id", "embedding").mapInArrow(lean(_blocks(BLOCK, scale, bits)), _BLOCK)
    held = materialise(made.withColumn("block", F.monotonically_increasing_id()), "va-blocks")
    single = pick(queries, "vec_id", "embedding").mapInArrow(_queries(scale), _QUERY).dropDuplicates(["query_id", "key"])
    single = materialise(single, "va-queries")
    packs = materialise(single.mapInArrow(_packs(QUERY_PACK), _PACK), "va-packs")
    deal = F.sequence(F.lit(0), F.lit(DEAL - 1))
    list_of_blocks = small(materialise(held.select(F.col("block").alias("_b"), F.col("dim").alias("_d"), (F.col("block") % DEAL).cast("int").alias("_p")), "va-list"))
    spread = packs.withColumn("part", F.explode(deal)).join(list_of_blocks, (F.col("dim") == F.col("_d")) & (F.col("part") == F.col("_p")))
    scanned = held.select("block", "dim", "ids", "cells", "low", "high").join(spread.select(F.col("_b").alias("block"), "q_ids", "q_keys", "q_vectors"), "block")
    seen = materialise(
        scanned.repartition("block", F.xxhash64("q_ids")).mapInArrow(lean(_scan(k, bits)), "query_id long, key long, block long, place int, vec_id long, bound double, floor double"),
        "va-scanned",
    )
    by_floor = Window.partitionBy("query_id", "key").orderBy(F.desc("floor"))
    kth = seen.where("floor > double('-infinity')").select("query_id", "key", "floor", F.row_number().over(by_floor).alias("n")).where(F.col("n") <= k)
    kth = kth.groupBy("query_id", "key").agg(F.when(F.count("*") == k, F.min("floor")).alias("certain"))
    left = materialise(seen.join(kth, ["query_id", "key"], "left").where("certain IS NULL OR bound >= certain").drop("floor", "certain"), "va-survivors")
    places = left.groupBy("block").agg(F.collect_set("place").alias("places"))  # a block's size bounds it
    exact = held.select("block", "dim", "vectors").join(places, "block").mapInArrow(_fetch, "block long, place int, exact binary")
    read = left.join(exact, ["block", "place"]).join(single.select("query_id", "key", "vector"), ["query_id", "key"])
    ordered = read.select("query_id", "key", "bound", "vec_id", "exact", "vector").repartition("query_id", "key").sortWithinPartitions("query_id", "key", F.desc("bound"), "vec_id")
    found = materialise(ordered.mapInArrow(lean(_rank(k)), "query_id long, rank int, vec_id long, score long, read long"), "va-found")
    discard(held, single, packs, seen, left)
    return found


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.where("vec_id % 50 = 0")).select("query_id", "rank", "vec_id", "score")


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0),
s AS (
  SELECT q.vec_id AS query_id, q.e, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INT) AS rank, vec_id, score FROM r WHERE n <= 5
"""
