"""Layer stacks as plans: images, adjustments, crops and text, with masks, opacity and blend modes.

A stack is folded into one DataFrame. Within a layer, adjustments on single pixels become projections, those that look at
neighbours a stage over tiles (one shuffle each), and crops a stage that resamples (none if it only shifts). What a
layer is put over travels in columns beside it, so no layer is joined with another one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photark.functions import color, hsl, masks
from photark.functions.numeric import clamp
from photark.operators import glyphs, tiles

UNDER = ["b_r", "b_g", "b_b", "b_a"]
BESIDE = ["a", *UNDER]


@dataclass(frozen=True)
class View:
    """The part of the canvas that a raster shows (x, y, w, h) and its size in pixels; frame, the last crop, for vignettes."""

    x: float
    y: float
    w: float
    h: float
    width: int
    height: int
    frame: tuple[float, float, float, float]

    def shifts(self, other: tuple[float, float, float, float]) -> bool:
        """If the other part has a pixel for each of this one's, moved by whole pixels."""
        x, y, w, h = other
        return (self.w, self.h) == (self.width, self.height) and (self.x - x) % 1 == 0 == (self.y - y) % 1


def export_size(value: float) -> int:
    """A crop's edge in whole pixels, halves up; an edge that is none is an error."""
    if not math.isfinite(value) or not 1 <= math.floor(value + 0.5) < 2**32:
        raise ValueError(f"a crop of {value} pixels")
    return math.floor(value + 0.5)


def export_view(stack: dict, width: int, height: int) -> View:
    """What an export shows: the first visible crop, in its own size, or the whole canvas."""
    rect = next((layer["crop"] for layer in stack["layers"] if "crop" in layer and layer.get("visible", True)), None)
    if rect is None:
        return View(0, 0, width, height, width, height, (0, 0, width, height))
    w, h = min(max(rect["width"], 1.0), width), min(max(rect["height"], 1.0), height)
    x, y = min(max(rect["x"], 0.0), width - w), min(max(rect["y"], 0.0), height - h)
    return View(x, y, w, h, export_size(rect["width"]), export_size(rect["height"]), (0, 0, width, height))


def intersection(view: View, rect: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    x, y = max(view.x, rect[0]), max(view.y, rect[1])
    right, bottom = min(view.x + view.w, rect[0] + rect[2]), min(view.y + view.h, rect[1] + rect[3])
    if right <= x or bottom <= y:
        raise ValueError("a crop outside of what is shown")
    return x, y, right - x, bottom - y


def resampled(df: DataFrame, channels: list[str], size: tuple[int, int], covers: tuple[float, float, float, float], view: View, turn: float = 0.0, pivot: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """df, a raster of ``size`` that covers a part of the canvas, as the view shows it, turned about the pivot by radians: each
    pixel's middle is mapped back and read bilinearly, edges repeat. Where this only moves whole pixels nothing is joined."""
    (w, h), (cx, cy, cw, ch) = size, covers
    if turn == 0 and (w, h) == (cw, ch) and view.shifts(covers) and view.x >= cx and view.y >= cy and view.x + view.w <= cx + cw and view.y + view.h <= cy + ch:
        dx, dy = int(view.x - cx), int(view.y - cy)
        moved = df.withColumns({"x": F.col("x") - dx, "y": F.col("y") - dy})
        return moved.where(F.col("x").between(0, view.width - 1) & F.col("y").between(0, view.height - 1)).select("x", "y", *channels)
    at = df.sparkSession.range(view.width * view.height).select((F.col("id") % view.width).cast("int").alias("ox"), F.expr(f"cast(id div {view.width} as int)").alias("oy"))
    px, py = (F.col("ox") + 0.5) / view.width * view.w + (view.x - pivot[0]), (F.col("oy") + 0.5) / view.height * view.h + (view.y - pivot[1])
    c, s = math.cos(turn), math.sin(turn)
    sx = clamp((px * c + py * s + (pivot[0] - cx)) / cw * w - 0.5, 0, w - 1)
    sy = clamp((py * c - px * s + (pivot[1] - cy)) / ch * h - 0.5, 0, h - 1)
    at = at.select("ox", "oy", sx.alias("sx"), sy.alias("sy")).withColumns({"fx": F.floor("sx").cast("int"), "fy": F.floor("sy").cast("int")})
    tx, ty = F.col("sx") - F.col("fx"), F.col("sy") - F.col("fy")
    corner = lambda i, j: F.struct(F.least(F.col("fx") + i, F.lit(w - 1)).alias("x"), F.least(F.col("fy") + j, F.lit(h - 1)).alias("y"), ((tx if i else 1 - tx) * (ty if j else 1 - ty)).alias("w"))
    asked = at.select("ox", "oy", F.inline(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])))
    mixed = asked.where("w > 0").join(df.select("x", "y", *channels), ["x", "y"]).groupBy("ox", "oy").agg(*[F.sum(F.col("w") * F.col(n)).alias(n) for n in channels])
    return mixed.withColumnsRenamed({"ox": "x", "oy": "y"}).select("x", "y", *channels)


def tables(params: dict) -> tuple[list[float], tuple | None]:
    """A curve's tables, given as such or by control points."""
    own = lambda given: color.curve_lut([tuple(p) for p in given]) if given and isinstance(given[0], (list, tuple)) else list(given)
    each = params.get("channels")
    return own(params["master"]), tuple(map(own, each)) if each else None


def vignetted(df: DataFrame, params: dict, view: View) -> DataFrame:
    fx, fy, fw, fh = view.frame
    x = ((view.x - fx) / fw + F.col("x") / view.width * (view.w / fw)) if (view.x, view.w) != (fx, fw) else F.col("x") / view.width
    y = ((view.y - fy) / fh + F.col("y") / view.height * (view.h / fh)) if (view.y, view.h) != (fy, fh) else F.col("y") / view.height
    return color.stage(df, lambda p: tuple(color.vignette(c, x, y, 1, 1, **params) for c in p))


def denoised(params: dict) -> tuple:
    made = tiles.non_local_means if params.get("mode", "nlm") == "nlm" else tiles.bilateral
    return made(params.get("luma", 0.0), params.get("chroma", 0.0))


#: Adjustments on single pixels, as (df, params, view) -> df, and those over neighbourhoods, as (params, view) -> (border, kernel).
PIXEL = {
    "Tone": lambda df, p, v: color.tone(df, **p),
    "Color": lambda df, p, v: color.color(df, **p),
    "Curves": lambda df, p, v: color.curves(df, *tables(p)),
    "LsCurve": lambda df, p, v: hsl.saturation_curve(df, tables(p)[0]),
    "Hsl": lambda df, p, v: hsl.balance(df, **p),
    "Vignette": vignetted,
    "Grain": lambda df, p, v: tiles.grain(df, **p, origin=(v.x, v.y), step=(v.w / v.width, v.h / v.height), carry=BESIDE),
}
TILE = {
    "Sharpen": lambda p, v: tiles.sharpening(**p),
    "Glow": lambda p, v: tiles.glow(p["amount"], max(v.frame[2], v.frame[3])),
    "Denoise": lambda p, v: denoised(p),
}
#: What changes nothing is left out of the plan.
IDLE = {
    "Tone": {"exposure": 0, "contrast": 0, "blacks": 0, "whites": 0, "shadows": 0, "highlights": 0, "gamma": 1}, "Color": {"saturation": 1, "vibrancy": 0, "temperature": 0, "tint": 0},
    "Vignette": {"amount": 0}, "Sharpen": {"amount": 0}, "Grain": {"amount": 0}, "Glow": {"amount": 0}, "Denoise": {"luma": 0, "chroma": 0},
}


def stages(ops: list[dict]) -> list[tuple[str, list[tuple[str, dict]]]]:
    """An op list, without what changes nothing, as stages: runs of pixel ops, and single tile ops."""
    out: list[tuple[str, list]] = []
    for op in ops:
        ((name, params),) = op.items()
        if name not in PIXEL and name not in TILE:
            raise ValueError(f"no adjustment {name}")
        idle = IDLE.get(name)
        if idle and all(params.get(k, d) == d for k, d in idle.items()):
            continue
        kind = "pixels" if name in PIXEL else "tiles"
        if kind == "pixels" and out and out[-1][0] == kind:
            out[-1][1].append((name, params))
        else:
            out.append((kind, [(name, params)]))
    return out


def adjusted(df: DataFrame, ops: list[dict], view: View) -> DataFrame:
    """df (x, y, r, g, b and BESIDE) after an op list."""
    for kind, own in stages(ops):
        for name, params in own:
            if kind == "pixels":
                df = PIXEL[name](df, params, view).select("x", "y", *"rgb", *BESIDE)
            else:
                border, kernel = TILE[name](params, view)
                df = tiles.tiled(df, border, kernel, view.width, view.height, carry=BESIDE)
    return df


def mask_value(df: DataFrame, mask: dict, view: View, width: int, height: int, drawn: dict[str, DataFrame]) -> DataFrame:
    """df with ``m``, 0 to 1: the mask's byte at the canvas pixel nearest to each pixel's middle."""
    place = lambda at, start, length, n, into: F.floor(clamp((F.col(at) + 0.5) / into * length + (start - 0.5), 0, n - 1) + 0.5).cast("int")
    x, y = place("x", view.x, view.w, width, view.width), place("y", view.y, view.h, height, view.height)
    ((kind, p),) = mask.items()
    if kind == "brush":
        stored = drawn[p].select(F.col("x").alias("m_x"), F.col("y").alias("m_y"), (F.col("m") / 255.0).alias("m"))
        return df.join(stored, (F.col("m_x") == x) & (F.col("m_y") == y), "left").drop("m_x", "m_y").fillna(0.0, ["m"])
    numbers = [F.lit(float(v)) for v in [*p, 0.0][:4]]
    return df.withColumn("m", masks.drawn(F.lit(kind), *numbers, F.lit(None).cast("binary"), x, y, width) / 255.0)


def render(stack: dict, sources: dict, width: int, height: int, drawn: dict[str, DataFrame] | None = None, texts: dict[str, tuple[DataFrame, DataFrame]] | None = None, view: View | None = None) -> DataFrame:
    """(x, y, r, g, b, a) of a stack over transparent black, as the view shows it (by default as an export does).

    stack: {"layers": [...], "masks": {name: {"linear": [x1, y1, x2, y2]}, {"radial": [x, y, radius]} or {"brush": name in drawn}}}. A layer is one
    of {"image": source}, {"ops": [{name: parameters}, ...]}, {"crop": {x, y, width, height, rotation}} and {"text": name in
    texts}, and may have visible, opacity (clamped to 0 to 1), blend_mode and mask. sources: name to (DataFrame x, y, r, g, b and perhaps a; width; height), which
    fill the canvas. A mask that isn't there is none; an image that isn't there is left out; an empty op list changes nothing.
    A turned crop reads the last image layer's source, without what was done since, and keeps the view; another one narrows it."""
    view = view or export_view(stack, width, height)
    canvas = (0.0, 0.0, float(width), float(height))
    base: DataFrame | None = None
    source: tuple | None = None
    for layer in stack["layers"]:
        opacity = min(max(float(layer.get("opacity", 1.0)), 0.0), 1.0)
        if not layer.get("visible", True) or (opacity == 0 and "crop" not in layer):
            continue
        moved = view
        if "image" in layer:
            if layer["image"] not in sources:
                continue
            df, w, h = sources[layer["image"]]
            source = (df if "a" in df.columns else df.withColumn("a", F.lit(1.0)), w, h)
            top = resampled(source[0], [*"rgba"], (w, h), canvas, view)
        elif "text" in layer:
            if base is None:
                continue
            placed, curves = (texts or {})[layer["text"]]
            sx, sy = view.width / view.w, view.height / view.h
            inside = placed.withColumns({"pen_x": (F.col("pen_x") - view.x) * sx, "pen_y": (F.col("pen_y") - view.y) * sy, "scale": F.col("scale") * sx})
            top = glyphs.text_layer(inside, curves, "i", "glyph", view.width, view.height)
        elif "crop" in layer:
            if base is None:
                continue
            rect = layer["crop"]
            box = tuple(float(rect[k]) for k in ("x", "y", "width", "height"))
            if rect.get("rotation", 0.0):
                frame, (df, w, h), covers = replace(view, frame=box), source or (base, view.width, view.height), canvas if source else (view.x, view.y, view.w, view.h)
                top, moved = resampled(df, [*"rgba"], (w, h), covers, view, rect["rotation"], (box[0] + box[2] / 2, box[1] + box[3] / 2)), frame
            else:
                x, y, w, h = intersection(view, box)
                moved = View(x, y, w, h, view.width, view.height, box)
                if (x, y, w, h) == (view.x, view.y, view.w, view.h):
                    view = moved  # what is shown already
                    continue
                top = resampled(base, [*"rgba"], (view.width, view.height), (view.x, view.y, view.w, view.h), moved)
        else:
            if base is None:
                continue
            top = None
        if top is None:  # an adjustment of what is below
            both = adjusted(base.withColumns({u: F.col(u[2:]) for u in UNDER}), layer["ops"], view)
        elif base is None:
            both = top.withColumns(dict.fromkeys(UNDER, F.lit(0.0)))
        else:  # a picture over another one: by place
            under = base.select("x", "y", *[F.col(u[2:]).alias(u) for u in UNDER])
            both = under.join(top, ["x", "y"], "left").fillna(0.0, [*"rgba"])
        named = (stack.get("masks") or {}).get(str(layer.get("mask")))
        both = mask_value(both, named, view, width, height, drawn or {}) if named else both.withColumn("m", F.lit(1.0))
        alpha = F.col("m") * opacity * F.col("a")
        mixed = color.blend(layer.get("blend_mode", "normal"), tuple(F.col("b_" + c) for c in "rgb"), tuple(F.col(c) for c in "rgb"))
        new = {c: F.col("b_" + c) * (1 - alpha) + v * alpha for c, v in zip("rgb", mixed, strict=True)} | {"a": F.col("b_a") * (1 - alpha) + F.col("a") * alpha}
        base, view = both.select("x", "y", *[v.alias(c) for c, v in new.items()]), moved
    if base is None:
        raise ValueError("a stack without a picture")
    return base


