"""Mixing sources to target weights by Poisson replication.

A source with n of the N documents and target weight w is repeated at the mean rate
``budget * w / n``. Each document draws its number of copies by inverting the Poisson
distribution at a uniform number taken from a seeded hash of its name, is exploded by
that count, and all copies are dealt anew by a hash of (seed, name, copy). A name is the
doc_id, or a digest of source and text where that is null; the second and later of equal
rows carry their number too. Draws are independent of partitioning and of reruns.

Rates over PIECE are split into equal parts with a hash each, since a sum of Poisson
draws is a Poisson draw: the table of a distribution stays short at any rate and no
count is cut off. Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafstrata.llm.common import materialise, numbered, table

#: Largest rate inverted at once, and the terms of its distribution: beyond 64 less than 1e-30 is left.
PIECE, TERMS = 8, 64
#: Sources up to which the table of rates is broadcast (about 0.6 KB each); beyond, Spark joins by shuffle.
BROADCAST_SOURCES = 5_000
#: Weights follow the documents' share to this power where none are given.
FLATTEN = 0.5


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the parts."""
    text = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: DataFrame | None = None, budget: float | None = None) -> DataFrame:
    """source, n, rate, pieces, cdf: one row a source (null is a source of its own).

    ``weights`` has source and weight (>= 0, any scale; sources without one get none);
    weights count among the sources that have documents;
    without it, weight is the source's share to the power FLATTEN. ``budget`` is the
    expected number of copies in all; by default the number of documents.
    """
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        known = n.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(FLATTEN)))
    else:
        w = weights.groupBy(F.col("source").alias("s")).agg(F.sum(F.greatest("weight", F.lit(0.0))).alias("weight"))
        known = n.join(w, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    # one row of totals; weights are summed in units of 1e-6 so that the order of summing can't show
    fine = known.withColumn("units", F.floor(F.col("weight") * 1e6 + 0.5).cast("long"))
    sums = fine.agg(F.sum("units").alias("all_units"), F.sum("n").alias("all_n"))
    aim = F.col("all_n").cast("double") if budget is None else F.lit(float(budget))
    mean = F.when(F.col("all_units") > 0, aim * F.col("units") / F.col("all_units") / F.col("n")).otherwise(F.lit(0.0))
    rated = fine.join(F.broadcast(sums)).select("source", "n", mean.alias("rate"))
    rated = rated.withColumn("pieces", F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int"))
    part = F.col("rate") / F.col("pieces")
    step = lambda acc, k: F.struct(
        (acc["p"] * part / k).alias("p"),
        (acc["c"] + acc["p"] * part / k).alias("c"),
        F.concat(acc["cdf"], F.array(acc["c"] + acc["p"] * part / k)).alias("cdf"),
    )
    start = F.struct(F.exp(-part).alias("p"), F.exp(-part).alias("c"), F.array(F.exp(-part)).alias("cdf"))
    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda acc: acc["cdf"])
    return rated.withColumn("cdf", cdf)


def copies(docs: DataFrame, table_of_rates: DataFrame, seed: int) -> DataFrame:
    """``docs`` (source and name) with ``rate`` and ``copies``: the inverse of the source's distribution at the document's draws."""
    few = table_of_rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    side = table_of_rates.select(F.col("source").alias("_s"), "rate", "pieces", "cdf")
    joined = docs.join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col("_s")))
    draws = F.transform(F.sequence(F.lit(1), F.col("pieces")), lambda i: _uniform(F.lit(seed), F.col("name"), i))
    count = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter("cdf", lambda c: c <= u)))
    return joined.withColumn("copies", count).drop("_s", "pieces", "cdf")


def poisson_mix(docs: DataFrame, weights: DataFrame | None = None, budget: float | None = None, seed: int = 10) -> DataFrame:
    """All columns of ``docs`` (which has doc_id and source), rate, copies, copy (from 1) and mix_key.

    One row a copy, dealt over all partitions and sorted inside them by mix_key, which
    orders the whole result at random. Equal rows, and rows with a null doc_id, draw each
    for itself; different rows with one doc_id draw alike. Null, empty and very long texts
    are copied like any. Sources of weight 0 vanish. An empty table gives no rows. Columns named rate, copies, copy, mix_key, weight, n, pieces,
    cdf or _s in ``docs`` are not touched: they are carried in a struct meanwhile.
    """
    names = docs.columns
    text = docs["text"] if "text" in names else F.lit(None).cast("string")
    anonymous = F.concat(F.lit("null:"), F.md5(F.concat(F.coalesce(docs["source"].cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary")))
    name = F.coalesce(docs["doc_id"].cast("string"), anonymous)
    inner = docs.select(name.alias("name"), docs["source"].alias("source"), F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)]).alias("_row"))
    dealt = materialise(rates(inner.select("source"), weights, budget), "rates")
    inner = numbered(inner.withColumn("mark", F.xxhash64("name", "source", F.crc32(F.coalesce(F.col(f"_row.c{names.index('text')}") if "text" in names else F.lit(""), F.lit("")).cast("binary")))), "mark", "_row")
    inner = inner.withColumn("name", F.when(F.col("occurrence") > 1, F.concat("name", F.lit("#"), "occurrence")).otherwise(F.col("name")))
    counted = copies(inner, dealt, seed).where("copies > 0")
    spread = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), "name", "copy").cast("binary"))
    mixed = spread.withColumn("mix_key", key).repartition("mix_key", "mark").sortWithinPartitions("mix_key")  # by the mark too, so that one doc_id of many rows is split
    own = [F.col(f"_row.c{i}").alias(c) for i, c in enumerate(names)]
    added = [c for c in ("rate", "copies", "copy", "mix_key") if c not in {x.lower() for x in names}]
    return mixed.select(*own, *added)


def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return poisson_mix(docs).select("doc_id", "source", "text", "copies", "copy", "mix_key")


OP10_SQL = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
u AS (SELECT source, n, CAST(floor(pow(n::DOUBLE, 0.5) * 1e6 + 0.5) AS BIGINT) AS units FROM n),
t AS (SELECT CAST(sum(units) AS BIGINT) AS all_units, CAST(sum(n) AS BIGINT) AS all_n FROM u),
r AS (SELECT source, all_n::DOUBLE * units / all_units / n AS rate FROM u, t),
p AS (SELECT source, rate, greatest(ceil(rate / 8), 1)::INT AS pieces FROM r),
c AS (SELECT source, rate / pieces AS part, 0 AS k, exp(-(rate / pieces)) AS p, exp(-(rate / pieces)) AS c FROM p
      UNION ALL SELECT source, part, k + 1, p * part / (k + 1), c + p * part / (k + 1) FROM c WHERE k < 63),
again AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, text) AS nth FROM documents),
named AS (SELECT doc_id, source, text, coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(source, '') || ':' || coalesce(text, ''))) || CASE WHEN nth > 1 THEN '#' || nth ELSE '' END AS name FROM again),
draws AS (SELECT doc_id, d.source, text, name, i,
                 ('0x' || substr(md5('10:' || name || ':' || i), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS v
          FROM named d JOIN p ON d.source IS NOT DISTINCT FROM p.source, unnest(range(1, pieces + 1)) AS x(i)),
drawn AS (SELECT doc_id, draws.source, text, name, CAST(count(c.c) FILTER (WHERE c.c <= v) AS INT) AS copies
          FROM draws JOIN c ON draws.source IS NOT DISTINCT FROM c.source GROUP BY doc_id, draws.source, text, name)
SELECT doc_id, source, text, copies, CAST(j AS INT) AS copy, md5('10:order:' || name || ':' || j) AS mix_key
FROM drawn, unnest(range(1, copies + 1)) AS y(j)
"""
