"""Documents with every awkward row: nulls, empty and long texts, ties, repeats, clashing extra columns."""

LONG = "lorem ipsum dolor sit amet " * 8000
ROWS = [
    (1, "the cat sat on the mat and looked at the dog", "s1", 9),
    (2, None, "s1", 9),
    (3, "", None, 9),
    (4, "the cat sat on the mat and looked at the dog", "s2", 9),
    (4, "the cat sat on the mat and looked at the dog", "s2", 9),
    (5, "   \n\t ", "s2", 9),
    (6, LONG, "s1", 9),
    (7, LONG + "x", "s1", None),
    (8, "one", "s1", 9),
    (None, "text without id", "s1", 9),
    (9, "Zoë ▁ naïve 😀 \x0b end", "s3", 9),
]
#: Extra columns that share names with columns that operators make.
SCHEMA = "doc_id long, text string, source string, score int"
CLASHES = ("fp", "node", "component", "copies", "copy", "n", "keep", "file", "row", "bucket", "size", "slot", "shard", "held", "TEXT", "hit", "label", "rate")


def documents(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)


def clashing(spark, skip=()):
    from pyspark.sql import functions as F

    df = documents(spark)
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHES if c not in skip])
