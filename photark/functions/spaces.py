"""Colour spaces: into and out of the working space (ACEScct) and linear sRGB, and the bytes that a display gets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photark.functions.color import Pixel, decode, encode, matrix, multiplied, srgb_decode, srgb_encode, stage
from photark.functions.numeric import clamp

Matrix = tuple[tuple[float, float, float], ...]

#: Matrices between linear spaces, as rows.
TO_SRGB: dict[str, Matrix] = {
    "adobe_rgb": ((1.3985, -0.3086, -0.0908), (-0.0827, 1.1316, -0.0489), (0.0172, -0.0603, 1.0431)),
    "display_p3": ((1.2249, -0.2247, 0.0), (-0.0420, 1.0419, 0.0), (-0.0197, -0.0786, 1.0983)),
    "prophoto_rgb": ((1.3460, -0.2556, -0.0511), (-0.5446, 1.5082, 0.0205), (0.0, 0.0, 1.2152)),
}
SRGB_TO_P3: Matrix = ((0.8225, 0.1774, 0.0), (0.0332, 0.9669, 0.0), (0.0171, 0.0724, 0.9105))
SRGB_TO_AP1: Matrix = ((0.6130974, 0.3395229, 0.0473796), (0.0701442, 0.9163569, 0.0134989), (0.0205687, 0.1095698, 0.8698615))
AP1_TO_SRGB: Matrix = ((1.7049908, -0.6217721, -0.0832185), (-0.1301592, 1.1407727, -0.0106135), (-0.0239210, -0.1289920, 1.1529130))
#: Exponents of spaces with a power curve, and steps of the display's table.
GAMMA = {"adobe_rgb": 2.2, "prophoto_rgb": 1.8}
STEPS = 8192

#: Spaces that are read as sRGB: what a file's profile names, but nobody knows, or none.
AS_SRGB = ("srgb", "unknown", "custom")
IDENTITY: Matrix = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)) for i in range(3))


def each(f: Callable[[Column], Column]) -> Callable[[Pixel], Pixel]:
    return lambda p: tuple(map(f, p))


def power(gamma: float) -> Callable[[Column], Column]:
    return lambda c: F.pow(F.greatest(c, F.lit(0.0)), F.lit(gamma))


#: What each mode does: a curve, a matrix or not, a curve. g is the mode's exponent.
MODES: dict[int, tuple[str, bool, str]] = {
    0: ("", False, ""), 1: ("", False, "srgb"), 2: ("srgb", False, ""), 3: ("", True, ""), 4: ("power", True, ""), 5: ("", True, "srgb"),
    6: ("srgb", True, "log"), 7: ("log", True, "srgb"), 8: ("power", True, "log"), 9: ("", True, "log"), 10: ("log", True, ""),
}


def transformed(df: DataFrame, mode: int, gamma: float = 1.0, m: Matrix = IDENTITY) -> DataFrame:
    """df with r, g, b after a mode of MODES; sRGB is not cut at 1. A mode that isn't there leaves them as they are."""
    first, mixed, last = MODES.get(mode, MODES[0])
    curves = {"srgb": srgb_decode, "log": decode, "power": power(gamma)}
    if first:
        df = stage(df, each(curves[first]))
    if mixed:
        df = stage(df, lambda p: multiplied(m, p))
    return stage(df, each({"srgb": lambda c: srgb_encode(c, clamped=False), "log": encode}[last])) if last else df


def side_by_side(df: DataFrame, kept: list[str], gamma: float = 1.0, m: Matrix = IDENTITY) -> DataFrame:
    """kept, mode, r, g, b: each row after each mode of MODES. What modes share is computed once, and the last curves come after
    the modes have become rows: code that holds all modes' curves is too long for the JVM to compile."""
    first = {"srgb": srgb_decode, "log": decode, "power": power(gamma)}
    needed = {f: f"{f}_" for f, _, _ in MODES.values() if f}
    firsts = df.withColumns({f"{prefix}{c}": first[f](F.col(c)) for f, prefix in needed.items() for c in "rgb"})
    own = lambda f: tuple(F.col(needed.get(f, "") + c) for c in "rgb")
    rows = [F.struct(F.lit(n).alias("mode"), F.lit(last).alias("last_"), *[v.alias(c) for c, v in zip("rgb", multiplied(m, own(f)) if mixed else own(f), strict=True)]) for n, (f, mixed, last) in MODES.items()]
    rows = firsts.select(*kept, F.inline(F.array(*rows)))
    lasts = lambda c: F.when(F.col("last_") == "srgb", srgb_encode(c, clamped=False)).when(F.col("last_") == "log", encode(c)).otherwise(c)
    return stage(rows, each(lasts)).drop("last_")


def into_working(space: str) -> tuple[int, float, Matrix]:
    """(mode, exponent, matrix) from a space to the working space."""
    if space == "acescct":
        return 0, 1.0, IDENTITY
    if space == "linear_srgb":
        return 9, 1.0, SRGB_TO_AP1
    if space == "rec2020":  # by its public primaries
        return 6, 1.0, tuple(map(tuple, matrix("rec2020", "working")))
    if space in AS_SRGB:
        return 6, 1.0, SRGB_TO_AP1
    return (8 if space in GAMMA else 6), GAMMA.get(space, 1.0), product(SRGB_TO_AP1, TO_SRGB[space])


def out_of_working(space: str) -> tuple[int, float, Matrix]:
    """(mode, exponent, matrix) from the working space to a space; where there is no way out, to sRGB."""
    if space == "acescct":
        return 0, 1.0, IDENTITY
    if space == "linear_srgb":
        return 10, 1.0, AP1_TO_SRGB
    return 7, 1.0, product(SRGB_TO_P3, AP1_TO_SRGB) if space == "display_p3" else AP1_TO_SRGB


def to_working(df: DataFrame, space: str) -> DataFrame:
    """r, g, b of a space in the working space."""
    return transformed(df, *into_working(space))


def from_working(df: DataFrame, space: str) -> DataFrame:
    """Working r, g, b in a space, clamped to 0 and 1 if it has a curve. Adobe RGB, ProPhoto RGB and unknown spaces give sRGB."""
    out = transformed(df, *out_of_working(space))
    return out if space in ("acescct", "linear_srgb") else stage(out, each(lambda c: clamp(c, 0, 1)))


def to_linear(df: DataFrame, space: str) -> DataFrame:
    """r, g, b of a space in linear sRGB; Display P3 has the exponent 2.2 here, and working pixels stay as they are."""
    if space in ("linear_srgb", "acescct"):
        return df
    return transformed(df, 2) if space in AS_SRGB else transformed(df, 4, GAMMA.get(space, 2.2), TO_SRGB[space])


def from_linear(df: DataFrame, space: str) -> DataFrame:
    """Linear sRGB r, g, b in a space: Display P3 with the exponent 2.2, all others but linear sRGB as sRGB, clamped."""
    if space == "linear_srgb":
        return df
    if space == "display_p3":
        return stage(transformed(df, 3, 1.0, SRGB_TO_P3), each(power(1 / 2.2)))
    return stage(df, each(srgb_encode))


def half(v: Column) -> Column:
    """The nearest number of half precision, ties to even; as a double."""
    least = F.lit(2.0**-14)
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.abs(v), least))) - 10)
    out = F.rint(v / step) * step
    return F.when(F.abs(out) >= 65520.0, F.signum(v) * float("inf")).otherwise(out)


def display_byte(v: Column) -> Column:
    """Linear to an sRGB byte, interpolated between STEPS + 1 evenly spaced points of the curve."""
    at = clamp(v, 0, 1) * STEPS
    low = F.floor(at)
    a, b = srgb_encode(low / STEPS), srgb_encode((F.least(low, F.lit(STEPS - 1)) + 1) / STEPS)
    return F.round((a + (b - a) * (at - low)) * 255).cast("int")


def preview_bytes(df: DataFrame) -> DataFrame:
    """Working r, g, b as display bytes, gamuts mapped."""
    linear = stage(stage(df, each(decode)), lambda p: multiplied(AP1_TO_SRGB, p))
    return stage(linear, each(display_byte))


def channel_bytes(df: DataFrame) -> DataFrame:
    """Working r, g, b as display bytes, channel by channel in half precision, gamuts not mapped: exact for greys."""
    return stage(df, each(lambda c: display_byte(decode(half(c)))))


def preview_p3(df: DataFrame) -> DataFrame:
    """Working r, g, b (negative ones as 0) in Display P3 with the sRGB curve, not cut at 1, in half precision."""
    linear = stage(stage(df, each(lambda c: decode(F.greatest(c, F.lit(0.0))))), lambda p: multiplied(AP1_TO_SRGB, p))
    encoded = stage(stage(linear, lambda p: multiplied(SRGB_TO_P3, p)), each(lambda c: srgb_encode(c, clamped=False)))
    return stage(encoded, each(half))


def linear_of(v: Column, bits: int = 8) -> Column:
    """A whole sample of 8 or 16 bits, encoded as sRGB, in linear light."""
    return srgb_decode(v / float((1 << bits) - 1))
