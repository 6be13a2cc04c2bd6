"""Page geometry, vision-token prices and profitability gates, as arithmetic on columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ctxledger.functions.text import normal_ratio, u16len, visual_rows

#: Page padding, characters a page stays readable at, slab columns, font cells (width, height).
PAD, READABLE, SLAB_COLS, PAGE_HEIGHT = 4, 28080, 312, 728
CELLS = {"spleen-5x8": (5, 8), "jetbrains-mono-10": (6, 11), "jetbrains-mono-12": (8, 13), "jetbrains-mono-14": (9, 16)}
#: Price of writing and reading the prompt cache, margin of the gate.
CREATE_RATE, READ_RATE, MARGIN = 1.25, 0.1, 1.10
#: Long edge and token limits of the two 28-px tiers.
TIERS = {"high-res": (2576, 4784), "standard": (1568, 1568)}


def ceil_div(a: Column, b) -> Column:
    return F.ceil(a / b).cast("long")


def page_width(cols: Column, cell_w: Column) -> Column:
    return cols * cell_w + 2 * PAD


def page_height(rows: Column, cell_h: Column) -> Column:
    return rows * cell_h + 2 * PAD


def max_chars(cols: Column) -> Column:
    return F.least(F.greatest(cols, F.lit(1)) * 90, F.lit(READABLE))


def lines_per_page(height: Column, cell_h: Column, cols: Column, chars: int = READABLE) -> Column:
    hard = F.greatest(F.lit(1), F.floor((height - 2 * PAD) / cell_h))
    readable = F.greatest(F.lit(1), F.floor(F.lit(chars) / F.greatest(cols, F.lit(1))))
    return F.least(hard, readable).cast("long")


def estimate_pages(chars: Column, rows: Column, cols: Column, max_per_page: int, max_lines: Column) -> Column:
    per = F.least(F.greatest(max_lines, F.lit(1)), F.greatest(F.lit(1), F.floor(F.lit(max_per_page) / F.greatest(cols, F.lit(1)))))
    return F.greatest(F.lit(1).cast("long"), ceil_div(rows, per), ceil_div(chars, max(1, max_per_page)))


def patch28(w: Column, h: Column) -> Column:
    return F.ceil(F.greatest(w, F.lit(1)) / 28) * F.ceil(F.greatest(h, F.lit(1)) / 28)


def fits_tier(w: Column, h: Column, tier: Column) -> Column:
    edge = F.when(tier == "high-res", TIERS["high-res"][0]).otherwise(TIERS["standard"][0])
    most = F.when(tier == "high-res", TIERS["high-res"][1]).otherwise(TIERS["standard"][1])
    return (F.ceil(w / 28) * 28 <= edge) & (F.ceil(h / 28) * 28 <= edge) & (patch28(w, h) <= most)


@F.pandas_udf(LongType())
def _resized(w: pd.Series, h: pd.Series, tier: pd.Series) -> pd.Series:
    """28-px patches after the tier's downscale: the largest width that fits, by bisection for all rows at once."""
    a, b = np.maximum(1, w.to_numpy(dtype=float)), np.maximum(1, h.to_numpy(dtype=float))
    big, small = np.maximum(a, b), np.minimum(a, b)
    high = (tier == "high-res").to_numpy()
    edge, most = np.where(high, TIERS["high-res"][0], TIERS["standard"][0]), np.where(high, TIERS["high-res"][1], TIERS["standard"][1])

    def short(x):
        return np.maximum(1, np.floor(x * (small / big) + 0.5))

    def fits(x, y):
        p, q = np.ceil(x / 28), np.ceil(y / 28)
        return (p * 28 <= edge) & (q * 28 <= edge) & (p * q <= most)

    lo, hi, best = np.ones_like(big), big.copy(), np.ones_like(big)
    while (lo <= hi).any():
        mid = np.floor((lo + hi) / 2)
        live = lo <= hi
        good = fits(mid, short(mid)) & live
        best = np.where(good, mid, best)
        lo, hi = np.where(good, mid + 1, lo), np.where(live & ~good, mid - 1, hi)
    whole = fits(big, small)
    x, y = np.where(whole, big, best), np.where(whole, small, short(best))
    return pd.Series((np.ceil(x / 28) * np.ceil(y / 28)).astype("int64"))


def patch28_tokens(tier: Column, w: Column, h: Column) -> Column:
    """Patches of an image; images within the tier need no resize and stay in built-in functions."""
    return F.when(fits_tier(w, h, tier), patch28(w, h)).otherwise(_resized(w, h, tier))


def vision_tokens(p: Column, w: Column, h: Column, resize: bool = True) -> Column:
    """Price of a w x h image under profile struct ``p`` (regime and its parameters).

    ``resize=False`` leaves out the helper for pages that outgrow their 28-px tier;
    such a price is then null. Pages of the built-in geometries never do.
    """
    patches = F.ceil(w / 32) * F.ceil(h / 32)
    capped = F.when(p["patch_cap"] > 0, F.least(patches, p["patch_cap"].cast("long"))).otherwise(patches)
    shrink = F.when(F.greatest(w, h) > 2048, F.lit(2048.0) / F.greatest(w, h)).otherwise(1.0)
    w1, h1 = F.floor(w * shrink), F.floor(h * shrink)
    shrink2 = F.when(F.least(w1, h1) > 768, F.lit(768.0) / F.least(w1, h1)).otherwise(1.0)
    tiles = F.ceil(F.floor(w1 * shrink2) / 512) * F.ceil(F.floor(h1 * shrink2) / 512)
    within = F.when(fits_tier(w, h, p["vision_tier"]), patch28(w, h))
    return (
        F.when(p["regime"] == "patch28", patch28_tokens(p["vision_tier"], w, h) if resize else within)
        .when(p["regime"] == "patch", F.ceil(capped * p["multiplier"]))
        .when(p["regime"] == "mpix", F.greatest(F.lit(1), F.ceil(F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0)) / 1e6 * p["per_megapixel"])))
        .when(p["regime"] == "flat", F.when((w == p["exact_w"]) & (h == p["exact_h"]), p["exact_tokens"]).otherwise(p["tokens"]))
        .when(p["regime"] == "tile", p["base"] + p["per_tile"] * tiles)
        .cast("long")
    )


def image_tokens_for_rows(p: Column, rows: Column, cols: Column, cap: int = 0, chars: int = READABLE, resize: bool = False) -> Column:
    """Vision tokens of full pages plus the last one, with the gate's margin, rounded up."""
    per = lines_per_page(p["max_height"], p["cell_h"], cols, chars)
    pages = ceil_div(rows, per)
    if cap > 0:
        pages = F.least(pages, F.lit(cap))
    last = F.least(F.greatest(F.lit(1), rows - (pages - 1) * per), per)
    width = page_width(cols, p["cell_w"])
    total = (pages - 1) * vision_tokens(p, width, page_height(per, p["cell_h"]), resize) + vision_tokens(p, width, page_height(last, p["cell_h"]), resize)
    return F.when(rows <= 0, F.lit(0.0)).otherwise(F.ceil(total.cast("double") * F.lit(MARGIN)).cast("double"))


def with_image_tokens(df: DataFrame, rows: str = "rows", cols: str = "profile.strip_cols", profile: str = "profile", out: str = "image_tokens") -> DataFrame:
    """``df`` plus the price of its pages; the steps are columns of their own, so that no expression is computed twice."""
    p = F.col(profile)
    df = df.withColumns({"_per": lines_per_page(p["max_height"], p["cell_h"], F.col(cols)), "_w": page_width(F.col(cols), p["cell_w"])})
    df = df.withColumn("_pages", ceil_div(F.col(rows), F.col("_per")))
    last = F.least(F.greatest(F.lit(1), F.col(rows) - (F.col("_pages") - 1) * F.col("_per")), F.col("_per"))
    df = df.withColumns({"_full": page_height(F.col("_per"), p["cell_h"]), "_last": page_height(last, p["cell_h"])})
    df = df.withColumns({"_a": vision_tokens(p, F.col("_w"), F.col("_full"), False), "_b": vision_tokens(p, F.col("_w"), F.col("_last"), False)})
    total = (F.col("_pages") - 1) * F.col("_a") + F.col("_b")
    priced = F.when(F.col(rows) <= 0, F.lit(0.0)).otherwise(F.ceil(total.cast("double") * F.lit(MARGIN)).cast("double"))
    return df.withColumn(out, priced).drop("_per", "_w", "_pages", "_full", "_last", "_a", "_b")


def profitable(image: Column, text: Column, warm_text: Column | None = None, warm_image: Column | None = None) -> Column:
    """Pages cost less than text, each side also paying for the warm cache it would burn."""
    burn = CREATE_RATE - READ_RATE
    left = F.lit(0.0) if warm_text is None else F.greatest(warm_text, F.lit(0.0)) * burn
    right = F.lit(0.0) if warm_image is None else F.greatest(warm_image, F.lit(0.0)) * burn
    return image + left < text + right


def profitable_amortized(image: Column, text: Column, horizon: int) -> Column:
    """The same over ``horizon`` requests: pages are written once and read after; text is read each time."""
    if horizon <= 1:
        return profitable(image, text)
    return image * (CREATE_RATE + READ_RATE * (horizon - 1)) < text * READ_RATE * horizon


def text_cost(s: Column, per_token: float | None) -> Column:
    return u16len(s) / F.lit(normal_ratio(per_token))


__all__ = ["visual_rows", "vision_tokens", "image_tokens_for_rows", "profitable", "profitable_amortized", "estimate_pages", "lines_per_page", "max_chars", "patch28_tokens", "text_cost"]
