"""Column functions on points, boxes and image sizes. Rounding is half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_thousand(v: Column, size: Column) -> Column:
    """Pixel to 0-999 by size, not clamped; null for size 0."""
    return F.bround(F.try_divide(v * 999, size)).cast("bigint")


def to_thousand_clamped(v: Column, size: Column) -> Column:
    return F.least(F.lit(999), F.greatest(F.lit(0), to_thousand(v, size))).cast("bigint")


def to_pixel(v: Column, size: Column) -> Column:
    """0-999 to pixel by size - 1, clamped to the image."""
    return F.bround(F.least((size - 1).cast("double"), F.greatest(F.lit(0.0), v * (size - 1) / 999))).cast("bigint")


def area(box: Column) -> Column:
    return (F.greatest(F.lit(0), box["r"] - box["l"]) * F.greatest(F.lit(0), box["b"] - box["t"])).cast("bigint")


def contains(box: Column, x: Column, y: Column) -> Column:
    """Whether a point is in a box, all edges included."""
    return x.between(box["l"], box["r"]) & y.between(box["t"], box["b"])


def centre(box: Column) -> Column:
    return F.struct(F.bround((box["l"] + box["r"]) / 2).cast("int").alias("x"), F.bround((box["t"] + box["b"]) / 2).cast("int").alias("y"))


def around(x: Column, y: Column, pad: int = 1) -> Column:
    return F.struct((x - pad).alias("l"), (y - pad).alias("t"), (x + pad).alias("r"), (y + pad).alias("b"))


def frame(width: Column, height: Column, roi: Column | None = None) -> Column:
    """struct<x, y, w, h>: the region of interest, or the whole screen; w and h null where its size is unknown."""
    screen = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.greatest(F.lit(1), width.cast("int")).alias("w"), F.greatest(F.lit(1), height.cast("int")).alias("h"))
    # greatest passes over null
    screen = F.struct(screen["x"].alias("x"), screen["y"].alias("y"), F.when(width.isNotNull(), screen["w"]).alias("w"), F.when(height.isNotNull(), screen["h"]).alias("h"))
    if roi is None:
        return screen
    part = F.struct(roi["l"].alias("x"), roi["t"].alias("y"), F.greatest(F.lit(1), roi["r"] - roi["l"]).alias("w"), F.greatest(F.lit(1), roi["b"] - roi["t"]).alias("h"))
    return F.when(roi.isNotNull(), part).otherwise(screen)


def _in_frame(v: Column, size: Column) -> Column:
    return F.when(size <= 1, F.lit(0)).otherwise(to_pixel(v, size)).cast("int")


def looks_scaled(*values: Column) -> Column:
    """Whether all values lie within 0 and 999."""
    out = F.lit(True)
    for v in values:
        out = out & v.between(0, 999)
    return out


def scaled(x: Column, y: Column, view: Column, scale: Column) -> Column:
    """Pixel struct<x, y> of a point: moved from 0-999 into the frame if asked, if it looks scaled and the frame is known; else rounded."""
    yes = scale & looks_scaled(x, y) & view["w"].isNotNull() & view["h"].isNotNull()
    return F.struct(F.when(yes, view["x"] + _in_frame(x, view["w"])).otherwise(F.bround(x)).cast("int").alias("x"), F.when(yes, view["y"] + _in_frame(y, view["h"])).otherwise(F.bround(y)).cast("int").alias("y"))


def scaled_box(box: Column, view: Column, scale: Column) -> Column:
    """The same for a box, with its corners in order."""
    yes = scale & looks_scaled(box["l"], box["t"], box["r"], box["b"]) & view["w"].isNotNull() & view["h"].isNotNull()
    a, b = scaled(box["l"], box["t"], view, F.lit(True)), scaled(box["r"], box["b"], view, F.lit(True))
    moved = ordered_box(F.struct(a["x"].alias("l"), a["y"].alias("t"), b["x"].alias("r"), b["y"].alias("b")))
    return F.when(box.isNotNull(), F.when(yes, moved).otherwise(box))


def around_in_frame(point: Column, view: Column, pad: int = 1) -> Column:
    """The box around a point, cut to the frame where its size is known."""
    free = around(point["x"], point["y"], pad)
    right, bottom = view["x"] + view["w"] - 1, view["y"] + view["h"] - 1
    cut = F.struct(F.greatest(view["x"], free["l"]).alias("l"), F.greatest(view["y"], free["t"]).alias("t"), F.least(right, free["r"]).alias("r"), F.least(bottom, free["b"]).alias("b"))
    return F.when(view["w"].isNull() | view["h"].isNull(), free).otherwise(cut)


def region_box(corners: Column) -> Column:
    """Box of an array of two corner arrays; null for all zeros or another shape."""
    at = lambda i, j: corners[i][j].cast("int")
    whole = (F.size(corners) == 2) & (F.size(corners[0]) == 2) & (F.size(corners[1]) == 2)
    box = F.struct(at(0, 0).alias("l"), at(0, 1).alias("t"), at(1, 0).alias("r"), at(1, 1).alias("b"))
    return F.when(whole & ~((box["l"] == 0) & (box["t"] == 0) & (box["r"] == 0) & (box["b"] == 0)), box)


def screen_box(width: Column, height: Column) -> Column:
    """The box of a whole screen; null for an unknown size."""
    return F.when(width.isNotNull() & height.isNotNull(), F.struct(F.lit(0).alias("l"), F.lit(0).alias("t"), width.cast("int").alias("r"), height.cast("int").alias("b")))


def mean_offset(a: Column, b: Column) -> Column:
    """Mean of the distances of two points along x and y."""
    return (F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"])) / 2


def grid_place(index: Column, rows: int, columns: int, offset: int = 0) -> Column:
    """struct<t, h, w> of a flat index into frames of rows by columns, shifted by an offset from the second frame axis on."""
    t, h, w = F.floor(index / (rows * columns)), F.floor(index / columns) % rows, index % columns
    return F.struct((t + offset).cast("bigint").alias("t"), (h + offset).cast("bigint").alias("h"), (w + offset).cast("bigint").alias("w"))


def strict_box(box: Column) -> Column:
    """The box, or null if it is empty or has a null edge."""
    return F.when((box["r"] > box["l"]) & (box["b"] > box["t"]), box)


def ordered_box(box: Column) -> Column:
    """The box with its corners in order."""
    return F.struct(F.least(box["l"], box["r"]).alias("l"), F.least(box["t"], box["b"]).alias("t"), F.greatest(box["l"], box["r"]).alias("r"), F.greatest(box["t"], box["b"]).alias("b"))


def visual_tokens(width: Column, height: Column, patch: int = 28) -> Column:
    return (F.ceil(width / patch) * F.ceil(height / patch)).cast("bigint")


def png_size(raw: Column) -> Column:
    """struct<width, height> of the header of a PNG; null without its signature."""
    number = lambda at: F.conv(F.hex(F.substring(raw, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(raw, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


# Fixed value: the longest side may be fewer than so many times the shortest.
SAFE_RATIO = 180


def clamped_crop(box: Column, width: Column, height: Column) -> Column:
    """A crop with its corners in order, within the image and at least a pixel wide and high."""
    w, h = F.greatest(F.lit(1), F.coalesce(width, F.lit(1))), F.greatest(F.lit(1), F.coalesce(height, F.lit(1)))
    o = ordered_box(box)
    l, t = F.least(F.greatest(F.lit(0), o["l"]), w - 1), F.least(F.greatest(F.lit(0), o["t"]), h - 1)
    return F.when(box.isNotNull(), F.struct(l.cast("int").alias("l"), t.cast("int").alias("t"), F.least(F.greatest(l + 1, o["r"]), w).cast("int").alias("r"), F.least(F.greatest(t + 1, o["b"]), h).cast("int").alias("b")))


def grown_span(start: Column, stop: Column, total: Column, target: Column) -> Column:
    """struct<start, stop> of a span grown to a length within 0 and total: by half on either side (the smaller half before), what one side lacks on the other."""
    wanted = F.least(total, F.greatest(stop - start, target))
    free = F.greatest(F.lit(0), start - F.floor((wanted - (stop - start)) / 2))
    left = F.least(free, total - wanted)
    return F.struct(left.cast("int").alias("start"), (left + wanted).cast("int").alias("stop"))


def safe_crop(box: Column, width: Column, height: Column, ratio: float = SAFE_RATIO) -> Column:
    """A clamped crop, its short side grown until the sides' ratio is permitted."""
    c = clamped_crop(box, width, height)
    w, h = c["r"] - c["l"], c["b"] - c["t"]
    across = grown_span(c["l"], c["r"], width, F.least(width, F.greatest(w + 1, F.ceil(h / ratio))))
    down = grown_span(c["t"], c["b"], height, F.least(height, F.greatest(h + 1, F.ceil(w / ratio))))
    wide = F.struct(across["start"].alias("l"), c["t"].alias("t"), across["stop"].alias("r"), c["b"].alias("b"))
    high = F.struct(c["l"].alias("l"), down["start"].alias("t"), c["r"].alias("r"), down["stop"].alias("b"))
    return F.when(F.greatest(w, h) / F.least(w, h) < ratio, c).when(w < h, wide).otherwise(high)


def padded_size(width: Column, height: Column, ratio: float = SAFE_RATIO) -> Column:
    """struct<width, height, left, top>: the size to which an image is padded for a permitted ratio, and where it then lies."""
    w, h = F.greatest(F.lit(1), F.coalesce(width, F.lit(1))), F.greatest(F.lit(1), F.coalesce(height, F.lit(1)))
    fine = F.greatest(w, h) / F.least(w, h) < ratio
    more = lambda short, long: F.greatest(short + 1, F.ceil(long / ratio))
    pw, ph = F.when(~fine & (w < h), more(w, h)).otherwise(w).cast("int"), F.when(~fine & (w >= h), more(h, w)).otherwise(h).cast("int")
    return F.struct(pw.alias("width"), ph.alias("height"), F.floor((pw - w) / 2).cast("int").alias("left"), F.floor((ph - h) / 2).cast("int").alias("top"))


def budget_size(box: Column, width: Column, height: Column, budget: Column) -> Column:
    """struct<width, height> of a crop (or the image) scaled to a number of pixels."""
    w = F.greatest(F.lit(1), F.coalesce(box["r"] - box["l"], width, F.lit(1)))
    h = F.greatest(F.lit(1), F.coalesce(box["b"] - box["t"], height, F.lit(1)))
    most = F.greatest(F.lit(1), budget)
    scale = F.when(w * h > most, F.sqrt(most / (w * h))).otherwise(F.lit(1.0))
    return F.struct(*[F.greatest(F.lit(1), F.bround(x * scale)).cast("int").alias(n) for n, x in (("width", w), ("height", h))])


def picture(path: Column, raw: Column, width: Column, height: Column) -> Column:
    """struct<path, width, height, source>: sizes as given, else of the PNG's header; the source is path, bytes or cache (both)."""
    own = png_size(raw)
    source = F.when(path.isNotNull() & raw.isNotNull(), "cache").when(raw.isNotNull(), "bytes").when(path.isNotNull(), "path")
    return F.struct(path.alias("path"), F.coalesce(width.cast("int"), own["width"]).alias("width"), F.coalesce(height.cast("int"), own["height"]).alias("height"), source.alias("source"))
