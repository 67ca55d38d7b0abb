"""Per-pixel colour operators as column expressions; a pixel is a tuple (r, g, b) of columns in ACEScct."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photark.functions.numeric import clamp, smoothstep

#: Luma weights, the ACEScct curve, the tone pivot and step.
AP1_LUMA = (0.2722287, 0.6740818, 0.0536895)
BLEND_LUMA = (0.299, 0.587, 0.114)
CUT_LINEAR, CUT_LOG = 0.0078125, 0.1552511416
SLOPE, OFFSET = 10.5402377417, 0.0729055342
LOG_SCALE, LOG_SHIFT = 17.52, 9.72
LEAST = 1.1754944e-38
MID_GREY, TONE_STEP = 0.4136, 0.05707
BALANCE_RANGE = 0.5

Pixel = tuple[Column, Column, Column]


def luma(p: Pixel, weights: tuple[float, float, float] = AP1_LUMA) -> Column:
    return p[0] * weights[0] + p[1] * weights[1] + p[2] * weights[2]


def decode(v: Column) -> Column:
    """ACEScct to linear."""
    return F.when(v < CUT_LOG, (v - OFFSET) / SLOPE).otherwise(F.pow(F.lit(2.0), v * LOG_SCALE - LOG_SHIFT))


def encode(v: Column) -> Column:
    """Linear to ACEScct."""
    return F.when(v <= CUT_LINEAR, v * SLOPE + OFFSET).otherwise((F.log2(F.greatest(v, F.lit(LEAST))) + LOG_SHIFT) / LOG_SCALE)


def srgb_encode(v: Column, clamped: bool = True) -> Column:
    """Linear to sRGB, clamped to 0 and 1, or else only to what is not negative."""
    x = clamp(v, 0, 1) if clamped else F.greatest(v, F.lit(0.0))
    return F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def srgb_decode(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def to_byte(v: Column) -> Column:
    """0 to 255, half up; not a number is 0."""
    return F.when(F.isnan(v), 0).otherwise(F.round(clamp(v, 0, 1) * 255)).cast("int")


def stage(df: DataFrame, made: Callable[[Pixel], Pixel]) -> DataFrame:
    """df with r, g, b replaced. One projection a step keeps expressions from being copied into each other."""
    r, g, b = made((F.col("r"), F.col("g"), F.col("b")))
    return df.withColumns({"r": r, "g": g, "b": b})


def shifted(df: DataFrame, by: Column) -> DataFrame:
    """All channels plus one amount that depends on luma."""
    return stage(df.withColumn("shift_by", by), lambda p: tuple(c + F.col("shift_by") for c in p)).drop("shift_by")


def tone(df: DataFrame, exposure=0.0, contrast=0.0, blacks=0.0, whites=0.0, shadows=0.0, highlights=0.0, gamma=1.0) -> DataFrame:
    """Exposure, contrast, blacks, whites, shadows, highlights and gamma, in this order; each masked step
    takes the luma that the one before left."""
    y = luma((F.col("r"), F.col("g"), F.col("b")))
    out = shifted(df, F.lit(exposure * TONE_STEP))
    out = shifted(out, (y - MID_GREY) * contrast)
    out = shifted(out, (1 - smoothstep(0.0, MID_GREY, y)) * blacks)
    out = shifted(out, smoothstep(MID_GREY, 0.6, y) * whites)
    out = shifted(out, (1 - smoothstep(0.05, 0.38, y)) * (shadows * TONE_STEP))
    out = shifted(out, smoothstep(0.45, 0.65, y) * (-highlights * TONE_STEP))
    pivot = lambda c: F.signum(c / MID_GREY) * F.pow(F.abs(c / MID_GREY) + 1e-7, F.lit(float(gamma))) * MID_GREY
    return stage(out, lambda p: tuple(map(pivot, p)))


def color(df: DataFrame, saturation=1.0, vibrancy=0.0, temperature=0.0, tint=0.0) -> DataFrame:
    """White balance as log offsets, then saturation and vibrancy about the luma in linear light."""
    step = BALANCE_RANGE / LOG_SCALE
    t, m = temperature * step, tint * step
    out = stage(df, lambda p: (decode(p[0] + (t + m / 2)), decode(p[1] - m), decode(p[2] + (m / 2 - t))))
    out = out.withColumn("grey", luma((F.col("r"), F.col("g"), F.col("b"))))
    out = stage(out, lambda p: tuple(F.greatest(F.col("grey") + (c - F.col("grey")) * saturation, F.lit(0.0)) for c in p))
    most, least = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    vivid = F.when(most <= 1e-6, 0.0).otherwise(clamp((most - least) / F.greatest(most, F.lit(1e-6)), 0, 1))
    out = out.withColumn("grey", luma((F.col("r"), F.col("g"), F.col("b")))).withColumn("pull", F.greatest(F.lit(0.0), 1 + (1 - vivid) * vibrancy))
    out = stage(out, lambda p: tuple(F.col("grey") + (c - F.col("grey")) * F.col("pull") for c in p))
    return stage(out, lambda p: tuple(map(encode, p))).drop("grey", "pull")


def lut(values: list[float], x: Column) -> Column:
    """Linear interpolation in evenly spaced values over 0 to 1, continued straight beyond both ends."""
    n = len(values) - 1
    at = F.least(F.greatest(F.floor(x * n), F.lit(0)), F.lit(n - 1)).cast("int")
    table = F.array(*map(F.lit, values))
    low, high = F.get(table, at), F.get(table, at + 1)
    return low + (high - low) * (x * n - at)


def curve_lut(points: list[tuple[float, float]], size: int = 256, most: float = 1.0, left: float = 0.0) -> list[float]:
    """A monotone cubic curve through control points (x of 0 to 255, y of 0 to 1) as a table.

    x is rounded and clamped; of equal x the first point counts; missing ends are (0, left) and
    (255, 1). Values stay between 0 and ``most``. Tangents are means of the neighbouring secants, zero where these differ in sign, and
    scaled back where they would overshoot.
    """
    seen: dict[int, float] = {}
    for x, y in sorted(((min(max(round(x), 0), size - 1), y) for x, y in points), key=lambda p: p[0]):
        seen.setdefault(x, y)
    seen.setdefault(0, left)
    seen.setdefault(size - 1, 1.0)
    xs = sorted(seen)
    ys = [seen[x] for x in xs]
    secants = [(ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]) for i in range(len(xs) - 1)]
    slopes = [secants[0], *[(a + b) / 2 if a * b > 0 else 0.0 for a, b in zip(secants, secants[1:], strict=False)], secants[-1]]
    for i, s in enumerate(secants):
        if s == 0:
            slopes[i] = slopes[i + 1] = 0.0
        elif (norm := ((slopes[i] / s) ** 2 + (slopes[i + 1] / s) ** 2) ** 0.5) > 3:
            slopes[i], slopes[i + 1] = 3 * slopes[i] / norm, 3 * slopes[i + 1] / norm
    out = []
    for x in range(size):
        i = next(i for i in range(len(secants)) if x <= xs[i + 1])
        h = xs[i + 1] - xs[i]
        t = (x - xs[i]) / h
        y = (1 + 2 * t) * (1 - t) ** 2 * ys[i] + t * (1 - t) ** 2 * h * slopes[i] + t * t * (3 - 2 * t) * ys[i + 1] + t * t * (t - 1) * h * slopes[i + 1]
        out.append(min(max(y, 0.0), most))
    return out


def wide_curve_lut(points: list[tuple[float, float]], size: int = 256) -> list[float]:
    """The table that an editor draws for a curve of saturation by lightness: up to twice, and 1 at the left end if no point
    says otherwise. Rendering takes curve_lut, which cuts at 1 and begins at 0."""
    return curve_lut([(x, min(max(y, 0.0), 2.0)) for x, y in points], size, 2.0, 1.0)


def curves(df: DataFrame, master: list[float], channels: tuple[list[float], list[float], list[float]] | None = None) -> DataFrame:
    """The master table on each channel, then each channel's own."""
    out = stage(df, lambda p: tuple(lut(master, c) for c in p))
    return stage(out, lambda p: tuple(lut(t, c) for t, c in zip(channels, p, strict=True))) if channels else out


def vignette(v: Column, x: Column, y: Column, width: int, height: int, amount: float, midpoint=0.5, feather=0.2, roundness=1.0) -> Column:
    """v darkened with the distance of the pixel's corner from the middle."""
    dx, dy = (x / width - 0.5) * roundness, y / height - 0.5
    return v * (1 - smoothstep(midpoint - feather, midpoint + feather, F.sqrt(dx * dx + dy * dy)) * amount)


def blend(mode: str, base: Pixel, layer: Pixel) -> Pixel:
    """Layer over base, before opacity."""
    def each(f):
        return tuple(f(b, x) for b, x in zip(base, layer, strict=True))

    if mode == "normal":
        return layer
    if mode == "multiply":
        return each(lambda b, x: b * x)
    if mode == "screen":
        return each(lambda b, x: 1 - (1 - b) * (1 - x))
    if mode == "overlay":
        return each(lambda b, x: F.when(b > 0.5, 1 - (1 - b) * (1 - x) * 2).otherwise(b * x * 2))
    if mode == "soft_light":
        return each(lambda b, x: F.when(x > 0.5, b + (x * 2 - 1) * (F.sqrt(b) - b)).otherwise(b - (1 - x * 2) * b * (1 - b)))
    if mode == "luminosity":
        lift = luma(layer, BLEND_LUMA) - luma(base, BLEND_LUMA)
        return tuple(b + lift for b in base)
    raise ValueError(f"no blend mode {mode}")


def composite(base: Pixel, layer: Pixel, mode: str, opacity: float, mask: Column | None = None, layer_alpha: Column | None = None) -> Pixel:
    a = (mask if mask is not None else F.lit(1.0)) * opacity * (layer_alpha if layer_alpha is not None else F.lit(1.0))
    return tuple(b * (1 - a) + x * a for b, x in zip(base, blend(mode, base, layer), strict=True))


def linear_mask(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """0 at the first point to 255 at the second, by the projection of the pixel's middle on their axis."""
    n = (x1 - x0) ** 2 + (y1 - y0) ** 2
    if n == 0:
        raise ValueError("a gradient needs two different points")
    return F.floor(clamp(((x + 0.5 - x0) * (x1 - x0) + (y + 0.5 - y0) * (y1 - y0)) / n, 0, 1) * 255).cast("int")


def radial_mask(x: Column, y: Column, cx: float, cy: float, radius: float) -> Column:
    dx, dy = x + 0.5 - cx, y + 0.5 - cy
    return F.floor(clamp(1 - F.sqrt(dx * dx + dy * dy) / radius, 0, 1) * 255).cast("int")


#: Chromaticities (red, green, blue, white) of public colour spaces.
PRIMARIES = {
    "srgb": ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06), (0.3127, 0.3290)),
    "p3": ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060), (0.3127, 0.3290)),
    "adobe": ((0.64, 0.33), (0.21, 0.71), (0.15, 0.06), (0.3127, 0.3290)),
    "prophoto": ((0.7347, 0.2653), (0.1596, 0.8404), (0.0366, 0.0001), (0.3457, 0.3585)),
    "rec2020": ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046), (0.3127, 0.3290)),
    "working": ((0.713, 0.293), (0.165, 0.830), (0.128, 0.044), (0.32168, 0.33767)),
}
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))


def to_xyz(space: str):
    """3 x 3 matrix from linear RGB of a space to XYZ under its white."""
    import numpy as np

    *rgb, white = [np.array([x / y, 1.0, (1 - x - y) / y]) for x, y in PRIMARIES[space]]
    m = np.stack(rgb, axis=1)
    return m * np.linalg.solve(m, white), white


def matrix(source: str, target: str) -> list[list[float]]:
    """3 x 3 matrix between linear RGB spaces, the white adapted in Bradford's cone space."""
    import numpy as np

    (a, white_a), (b, white_b), cones = to_xyz(source), to_xyz(target), np.array(BRADFORD)
    adapt = np.linalg.solve(cones, np.diag((cones @ white_b) / (cones @ white_a)) @ cones)
    return (np.linalg.solve(b, adapt @ a)).tolist()


def multiplied(m: list[list[float]], p: Pixel) -> Pixel:
    return tuple(p[0] * row[0] + p[1] * row[1] + p[2] * row[2] for row in m)
