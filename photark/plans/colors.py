"""Registered queries on colour spaces and display bytes, each with its SQL, whose numbers are written out here."""

from __future__ import annotations

from pyspark.sql import functions as F

from photark.functions import spaces
from photark.functions.color import stage
from photark.functions.numeric import rounded
from photark.plans.images import KEY, PIXELS, K, every, final, shown, step
from photark.sources import tables as t

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: SQL of the curves, and products of the matrices between linear spaces.
SRGB_IN = "CASE WHEN $ <= 0.04045 THEN $ / 12.92 ELSE pow(($ + 0.055) / 1.055, 2.4) END"
SRGB_OUT = "CASE WHEN $ <= 0.0031308 THEN greatest($, 0.0) * 12.92 ELSE 1.055 * pow($, 1 / 2.4) - 0.055 END"
LOG_IN = "CASE WHEN $ < 0.1552511416 THEN ($ - 0.0729055342) / 10.5402377417 ELSE pow(2.0, $ * 17.52 - 9.72) END"
LOG_OUT = "CASE WHEN $ <= 0.0078125 THEN $ * 10.5402377417 + 0.0729055342 ELSE (log2(greatest($, 1.1754944e-38)) + 9.72) / 17.52 END"
SRGB_AP1 = ((0.6130974, 0.3395229, 0.0473796), (0.0701442, 0.9163569, 0.0134989), (0.0205687, 0.1095698, 0.8698615))
AP1_SRGB = ((1.7049908, -0.6217721, -0.0832185), (-0.1301592, 1.1407727, -0.0106135), (-0.0239210, -0.1289920, 1.1529130))
ADOBE_AP1 = ((0.83015309919, 0.19214526612, -0.02285025297), (0.02254612915, 1.01448898425, -0.03709824318), (0.03466552229, 0.06518903641, 0.90012692947))
P3_AP1 = ((0.73578966534, 0.21226188717, 0.05203701468), (0.04716671245, 0.93792983883, 0.01482584187), (0.00345639748, 0.04116787383, 0.95536888545))
PROPHOTO_AP1 = ((0.64032492906, 0.35536074234, 0.03320663223), (-0.40463387454, 1.36412061906, 0.03160481111), (-0.03198624288, 0.15999581264, 1.05825081513))
AP1_P3 = ((1.37926469092, -0.30903447527, -0.07033005115), (-0.06924523592, 1.08237028991, -0.01302504735), (-0.0020482539, -0.04548757543, 1.04753583275))
ADOBE_SRGB = ((1.3985, -0.3086, -0.0908), (-0.0827, 1.1316, -0.0489), (0.0172, -0.0603, 1.0431))
P3_SRGB = ((1.2249, -0.2247, 0.0), (-0.0420, 1.0419, 0.0), (-0.0197, -0.0786, 1.0983))
PROPHOTO_SRGB = ((1.3460, -0.2556, -0.0511), (-0.5446, 1.5082, 0.0205), (0.0, 0.0, 1.2152))
SRGB_P3 = ((0.8225, 0.1774, 0.0), (0.0332, 0.9669, 0.0), (0.0171, 0.0724, 0.9105))
REC2020_AP1 = ((0.9748949779244186, 0.019599108637005223, 0.005505913438576152), (0.0021795627977038447, 0.9955354688932205, 0.0022849683090751458), (0.004797239683772721, 0.02453201663458944, 0.9706707436816376))


def mixed(m: tuple) -> dict[str, str]:
    return {c: " + ".join(f"{x} * ({k!r})::DOUBLE" for x, k in zip("rgb", row, strict=True)) for c, row in zip("rgb", m, strict=True)}


def pow_in(gamma: float) -> str:
    return f"pow(greatest($, 0.0), {gamma})"


def chain(*steps) -> str:
    """Each step a pattern for all channels, or a matrix."""
    out, source = "", "p"
    for i, s in enumerate(steps):
        out += step(f"s{i}", source, **(every(s) if isinstance(s, str) else mixed(s)))
        source = f"s{i}"
    return PIXELS + out + final(source)


def add(name: str, sql: str, made) -> None:
    """Register pixels after made, and its SQL."""
    QUERIES[name] = lambda spark, sf_dir: shown(made(t.pixels(spark, sf_dir)))
    SQL[name] = sql


CLAMP = "greatest(least($, 1.0), 0.0)"
INTO = {
    "acescct": ("acescct", ()), "linear": ("linear_srgb", (SRGB_AP1, LOG_OUT)), "srgb": ("srgb", (SRGB_IN, SRGB_AP1, LOG_OUT)), "unknown": ("unknown", (SRGB_IN, SRGB_AP1, LOG_OUT)),
    "custom": ("custom", (SRGB_IN, SRGB_AP1, LOG_OUT)), "p3": ("display_p3", (SRGB_IN, P3_AP1, LOG_OUT)), "adobe": ("adobe_rgb", (pow_in(2.2), ADOBE_AP1, LOG_OUT)),
    "prophoto": ("prophoto_rgb", (pow_in(1.8), PROPHOTO_AP1, LOG_OUT)), "rec2020": ("rec2020", (SRGB_IN, REC2020_AP1, LOG_OUT)),
}
for _name, (_space, _steps) in INTO.items():
    add(f"px_working_{_name}", chain(*_steps) if _steps else PIXELS + final("p"), lambda p, s=_space: spaces.to_working(p, s))

OUT = {"linear": ("linear_srgb", (LOG_IN, AP1_SRGB)), "srgb": ("srgb", (LOG_IN, AP1_SRGB, SRGB_OUT, CLAMP)), "p3": ("display_p3", (LOG_IN, AP1_P3, SRGB_OUT, CLAMP)), "adobe": ("adobe_rgb", (LOG_IN, AP1_SRGB, SRGB_OUT, CLAMP))}
for _name, (_space, _steps) in OUT.items():
    add(f"px_from_working_{_name}", chain(*_steps), lambda p, s=_space: spaces.from_working(p, s))

LINEAR = {"srgb": ("srgb", (SRGB_IN,)), "p3": ("display_p3", (pow_in(2.2), P3_SRGB)), "adobe": ("adobe_rgb", (pow_in(2.2), ADOBE_SRGB)), "prophoto": ("prophoto_rgb", (pow_in(1.8), PROPHOTO_SRGB))}
for _name, (_space, _steps) in LINEAR.items():
    add(f"px_linear_{_name}", chain(*_steps), lambda p, s=_space: spaces.to_linear(p, s))
add("px_from_linear_srgb", chain(CLAMP, SRGB_OUT), lambda p: spaces.from_linear(p, "srgb"))
add("px_from_linear_p3", chain(SRGB_P3, "pow(greatest($, 0.0), 1 / 2.2)"), lambda p: spaces.from_linear(p, "display_p3"))

#: Modes of the transform with the matrix from Display P3 to the working space and the exponent 2.2.
MODES = ((), (SRGB_OUT,), (SRGB_IN,), (P3_AP1,), (pow_in(2.2), P3_AP1), (P3_AP1, SRGB_OUT), (SRGB_IN, P3_AP1, LOG_OUT), (LOG_IN, P3_AP1, SRGB_OUT), (pow_in(2.2), P3_AP1, LOG_OUT), (P3_AP1, LOG_OUT), (LOG_IN, P3_AP1))


def modes_sql() -> str:
    parts, last = [PIXELS], []
    for mode, steps in enumerate(MODES):
        source = "p"
        for i, s in enumerate(steps):
            parts.append(step(f"m{mode}s{i}", source, **(every(s) if isinstance(s, str) else mixed(s))))
            source = f"m{mode}s{i}"
        last.append(final(source).replace(" SELECT ", f" SELECT {mode} AS mode, "))
    return "".join(parts) + " UNION ALL".join(last)


def px_transform_modes(spark, sf_dir):
    """All modes side by side, from one scan."""
    made = spaces.side_by_side(t.pixels(spark, sf_dir), KEY, 2.2, spaces.into_working("display_p3")[2])
    return made.select(*KEY, "mode", *[rounded(F.col(c)).alias(c) for c in "rgb"])


QUERIES["px_transform_modes"] = px_transform_modes
SQL["px_transform_modes"] = modes_sql()


def byte_sql(source: str) -> str:
    """SQL of the table of 8,192 steps, for r, g, b of source."""
    enc = lambda x: f"CASE WHEN {x} / 8192 <= 0.0031308 THEN {x} / 8192 * 12.92 ELSE 1.055 * pow({x} / 8192, 1 / 2.4) - 0.055 END"
    low, high = (", ".join(f"{enc(f'{e}{c}')} AS {n}{c}" for c in "rgb") for e, n in (("i", "a"), ("j", "b")))
    out = f", y0 AS (SELECT {K}, {', '.join(f'greatest(least({c}, 1.0), 0.0) * 8192 AS w{c}' for c in 'rgb')} FROM {source})"
    out += f", y1 AS (SELECT *, {', '.join(f'floor(w{c}) AS i{c}, least(floor(w{c}), 8191) + 1 AS j{c}' for c in 'rgb')} FROM y0), y2 AS (SELECT *, {low}, {high} FROM y1)"
    return out + f" SELECT {K}, {', '.join(f'round((a{c} + (b{c} - a{c}) * (w{c} - i{c})) * 255)::INTEGER AS {c}' for c in 'rgb')} FROM y2"


HALF = "round_even($ / pow(2.0, floor(log2(greatest(abs($), pow(2.0, -14)))) - 10), 0) * pow(2.0, floor(log2(greatest(abs($), pow(2.0, -14)))) - 10)"
SQL["px_display_byte"] = PIXELS + byte_sql("p").replace(" AS r, ", " AS r8, ").split(", round((ag")[0] + " FROM y2"
SQL["px_preview_bytes"] = PIXELS + step("a", "p", **every(LOG_IN)) + step("m", "a", **mixed(AP1_SRGB)) + byte_sql("m")
SQL["px_channel_bytes"] = PIXELS + step("h", "p", **every(HALF)) + step("a", "h", **every(LOG_IN)) + byte_sql("a")


def px_display_byte(spark, sf_dir):
    return t.pixels(spark, sf_dir).select(*KEY, spaces.display_byte(F.col("r")).alias("r8"))


def px_preview_bytes(spark, sf_dir):
    return spaces.preview_bytes(t.pixels(spark, sf_dir)).select(*KEY, "r", "g", "b")


def px_channel_bytes(spark, sf_dir):
    return spaces.channel_bytes(t.pixels(spark, sf_dir)).select(*KEY, "r", "g", "b")


QUERIES |= {f.__name__: f for f in (px_display_byte, px_preview_bytes, px_channel_bytes)}
add("px_preview_p3", chain("greatest($, 0.0)", LOG_IN, AP1_SRGB, SRGB_P3, SRGB_OUT, HALF), spaces.preview_p3)
SQL["px_sample_bytes"] = PIXELS + f", q AS (SELECT {K}, round(greatest(least(r, 1.0), 0.0) * 255) / 255 AS r, round(greatest(least(g, 1.0), 0.0) * 65535) / 65535 AS g, 0.0::DOUBLE AS b FROM p)" + step("l", "q", **every(SRGB_IN)) + final("l")


def px_sample_bytes(spark, sf_dir):
    """Samples of 8 (r) and 16 bits (g) in linear light."""
    whole = lambda c, n: F.round(F.greatest(F.least(F.col(c), F.lit(1.0)), F.lit(0.0)) * n)
    return shown(stage(t.pixels(spark, sf_dir), lambda _: (spaces.linear_of(whole("r", 255)), spaces.linear_of(whole("g", 65535), 16), F.lit(0.0))))


QUERIES["px_sample_bytes"] = px_sample_bytes
