"""Scalar page rules as SQL functions, for use in ``spark.sql``; Spark inlines them into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from leafstrata.operators.text import CJK

#: Name, parameters, result type and body of each function.
FUNCTIONS = (
    ("page_luma", "r INT, g INT, b INT", "INT", "shiftright(77 * r + 150 * g + 29 * b, 8)"),
    ("normal_level", "gray INT, bg INT", "INT", "IF(bg = 0, gray, least(255, CAST(gray * 255 div nullif(bg, 0) AS INT)))"),
    ("point_to_pixel", "v FLOAT, dpi FLOAT", "INT", "CAST(floor(CAST(v * CAST(dpi / 72 AS FLOAT) AS DOUBLE) + 0.5D) AS INT)"),
    ("mask_colour", "fg INT", "INT", "IF(fg = 1, -16777216, -1)"),
    ("is_cjk", "s STRING", "BOOLEAN", f"coalesce(s, '') RLIKE '{CJK}'"),
    ("file_stem", "s STRING", "STRING", r"regexp_replace(s, '\\.[^.]+$', '')"),
    ("byte_size", "n BIGINT", "STRING", "CASE WHEN n < 1024 THEN concat(n, ' B') WHEN n < 1048576 THEN printf('%.0f KB', n / 1024D) ELSE printf('%.1f MB', n / 1048576D) END"),
    ("producer_chain", "old STRING, own STRING", "STRING", "IF(trim(coalesce(old, '')) = '', own, concat(old, ' -> ', own))"),
    ("shorten", "s STRING, most INT", "STRING", "IF(length(coalesce(s, '')) <= most, coalesce(s, ''), concat(left(s, most), '…'))"),
    ("setting_int", "s STRING, otherwise INT", "INT", "coalesce(try_cast(s AS INT), otherwise)"),
    ("setting_double", "s STRING, otherwise DOUBLE", "DOUBLE", "coalesce(try_cast(s AS DOUBLE), otherwise)"),
    ("setting_boolean", "s STRING, otherwise BOOLEAN", "BOOLEAN", "coalesce(lower(s) = 'true', otherwise)"),
)


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session and return their names."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return [f[0] for f in FUNCTIONS]


def encoder_flags(text: str) -> list[str]:
    """Flags split at white space, without ``-b`` and its value."""
    out, words = [], iter(text.split())
    for w in words:
        if w == "-b":
            next(words, None)
        else:
            out.append(w)
    return out
