"""Settings: a flat JSON object with comments, typed reads, precedence and clamps."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STRING = r'"(?:\\.|[^"\\])*"'
_COMMENT = re.compile(rf"({_STRING})|//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_ENTRY = re.compile(rf"\s*,*\s*({_STRING})\s*:\s*({_STRING}|true|false|null|[-+0-9.eE]+)", re.S)


def parse_jsonc(text: str) -> dict[str, str]:
    """Entries of a flat object as raw text: numbers as written, strings without unescaping, null as ``null``.

    Comment marks inside strings are text. Reading stops at the first thing that is no
    entry, such as a nested value; what came before is kept. A later key wins.
    """
    bare = _COMMENT.sub(lambda m: m.group(1) or "", text).lstrip()
    out: dict[str, str] = {}
    if not bare.startswith("{"):
        return out
    at = 1
    while m := _ENTRY.match(bare, at):
        key, value = m.groups()
        out[key[1:-1]] = value[1:-1] if value[0] == '"' else value
        at = m.end()
    return out


def load(path: str | None = None) -> dict[str, str]:
    """Settings of the file at ``path``, else at the environment's LEAFSTRATA_SETTINGS, else ./settings.jsonc; none if it is missing."""
    path = path or os.environ.get("LEAFSTRATA_SETTINGS", "settings.jsonc")
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return parse_jsonc(f.read())


def get(settings: dict[str, str], key: str, default, chosen=None):
    """The value of ``key`` in the type of ``default``: an explicit choice first, then the setting, then the default.

    Text that doesn't parse gives the default; only ``true`` in any case is true.
    """
    if chosen is not None:
        return chosen
    raw = settings.get(key)
    if raw is None:
        return default
    if isinstance(default, bool):
        return raw.strip().lower() == "true"
    try:
        return type(default)(raw.strip() if not isinstance(default, str) else raw)
    except ValueError:
        return default


def clamp(value: float, low: float, high: float | None = None) -> float:
    value = max(low, value)
    return value if high is None else min(high, value)


@dataclass(frozen=True)
class PageConfig:
    """Parameters of segmentation and layer building, within their bounds."""

    dpi: float = 300.0
    tile_size: int = 64
    percentile: float = 0.95
    inpaint_radius: int = 0
    threshold_mode: str = "sauvola"
    sauvola_window: int = 15
    sauvola_k: float = 0.2
    sauvola_r: int = 128
    max_component_area: float = 0.005
    max_component_dim: float = 0.1
    background_scale: float = 0.33
    foreground_scale: float = 0.5
    smooth_sigma: float = 0.8
    foreground_colour: bool = False
    pdfa: bool = False
    min_font_size: float = 1.0

    #: Setting of each field (fixed values).
    KEYS = {
        "dpi": "rendering.dpi", "tile_size": "segmenter.tileSize", "percentile": "segmenter.percentile",
        "inpaint_radius": "segmenter.inpaintRadius", "threshold_mode": "segmenter.thresholdMode",
        "sauvola_window": "segmenter.sauvolaWindow", "sauvola_k": "segmenter.sauvolaK", "sauvola_r": "segmenter.sauvolaR",
        "max_component_area": "segmenter.maxComponentArea", "max_component_dim": "segmenter.maxComponentDim",
        "background_scale": "pipeline.mrc.backgroundScale", "foreground_scale": "pipeline.mrc.foregroundScale",
        "smooth_sigma": "pipeline.mrc.bgSmoothSigma", "foreground_colour": "pipeline.mrc.foregroundColor",
        "pdfa": "pdf.pdfa.enabled", "min_font_size": "pdf.minFontSize",
    }

    @classmethod
    def of(cls, settings: dict[str, str], **chosen) -> PageConfig:
        got = {f.name: get(settings, cls.KEYS[f.name], f.default, chosen.get(f.name)) for f in fields(cls)}
        for name in ("background_scale", "foreground_scale"):
            got[name] = clamp(got[name], 0.1, 1.0)
        for name in ("smooth_sigma", "max_component_area", "max_component_dim"):
            got[name] = clamp(got[name], 0.0)
        for name in ("sauvola_window", "sauvola_r"):
            got[name] = int(clamp(got[name], 1))
        if got["threshold_mode"] not in ("sauvola", "otsu"):
            got["threshold_mode"] = "sauvola"
        if got["pdfa"]:
            got["foreground_colour"] = False
        return cls(**got)


def settings_table(spark: SparkSession, text: str) -> DataFrame:
    """key, value and the value read as int, double and boolean (null where it doesn't parse)."""
    rows = spark.createDataFrame(sorted(parse_jsonc(text).items()), "key string, value string")
    return rows.select("key", "value", F.expr("try_cast(value AS INT)").alias("as_int"), F.expr("try_cast(value AS DOUBLE)").alias("as_double"), (F.lower("value") == "true").alias("as_boolean"))
