"""Scalar geometry over boxes as columns. A box is named by a prefix: ``box("a_")`` is a_x1, a_y1, a_x2, a_y2."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed weights of labels, of the parts of a score, and its levels.
LABEL_WEIGHTS = {
    "title": 1.0, "sub_title": 0.8, "subtitle": 0.8, "heading": 0.7, "header": 0.65, "text": 0.3, "paragraph": 0.3, "table": 0.4,
    "image": 0.4, "figure": 0.4, "formula": 0.4, "equation": 0.4, "caption": 0.2, "footer": 0.1, "page_number": 0.05,
}
SCORE_WEIGHTS = {"label": 0.40, "whitespace": 0.25, "size": 0.15, "vertical": 0.10, "indent": 0.10}
LEVELS = {0: 0.8, 1: 0.6, 2: 0.4, 3: 0.25, 4: 0.15}


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "") -> Box:
    return Box(*(F.col(prefix + c) for c in ("x1", "y1", "x2", "y2")))


def lookup(values: dict, key: Column, default) -> Column:
    """A literal map's value, or the default."""
    pairs = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def normalised(b: Box, width: Column, height: Column) -> list[Column]:
    return [(v / s * 999).cast("int") for v, s in zip(b, (width, height, width, height))]


def denormalised(b: Box, width: Column, height: Column) -> list[Column]:
    return [(v / F.lit(999.0) * s).cast("int") for v, s in zip(b, (width, height, width, height))]


def width(b: Box) -> Column:
    return b.x2 - b.x1


def height(b: Box) -> Column:
    return b.y2 - b.y1


def area(b: Box) -> Column:
    return width(b) * height(b)


def centre(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2


def _overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    shared, least = F.least(a2, b2) - F.greatest(a1, b1), F.least(a2 - a1, b2 - b1)
    return F.when((shared > 0) & (least > 0), shared / least).otherwise(F.lit(0.0))


def horizontal_overlap(a: Box, b: Box) -> Column:
    """Shared width, in parts of the narrower box."""
    return _overlap(a.x1, a.x2, b.x1, b.x2)


def vertical_overlap(a: Box, b: Box) -> Column:
    return _overlap(a.y1, a.y2, b.y1, b.y2)


def iou(a: Box, b: Box) -> Column:
    w, h = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    whole = area(a) + area(b) - w * h
    return F.when((w > 0) & (h > 0) & (whole > 0), w * h / whole).otherwise(F.lit(0.0))


def vertical_score(b: Box, page_height: Column) -> Column:
    return F.when(page_height > 0, 1 - b.y1 / page_height).otherwise(F.lit(0.5))


def size_score(b: Box, page_width: Column, page_height: Column) -> Column:
    inner = F.lit(0.7) * (width(b) / page_width) + F.lit(0.3) * (height(b) / page_height)
    return F.when((page_width > 0) & (page_height > 0), F.least(F.lit(1.0), inner * 2)).otherwise(F.lit(0.3))


def label_weight(label: Column, weights: dict[str, float] | None = None) -> Column:
    return lookup(weights or LABEL_WEIGHTS, F.lower(F.trim(label)), 0.3)


def indent_score(b: Box, page_width: Column) -> Column:
    reach = page_width * F.lit(0.3)
    return F.when(page_width <= 0, F.lit(0.5)).when(b.x1 >= reach, F.lit(0.0)).otherwise(1 - b.x1 / reach)


def proximity(previous_y: Column, y: Column, threshold: float = 100.0) -> Column:
    gap = F.abs(y - previous_y)
    return F.when(gap > threshold, F.lit(0.0)).otherwise(1 - gap / F.lit(threshold))


def whitespace_score(b: Box, previous_y2: Column, next_y1: Column, median: Column) -> Column:
    """How free a box stands, by the gaps before and after it in median heights; missing neighbours count as 1.5 and 1."""
    m = F.when(median > 0, median).otherwise(F.lit(20.0))
    before = F.when(previous_y2.isNull(), F.lit(1.5)).otherwise(F.greatest(F.lit(0.0), (b.y1 - previous_y2).cast("double")) / m)
    after = F.when(next_y1.isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (next_y1 - b.y2).cast("double")) / m)
    return F.least(F.lit(1.0), (F.lit(0.6) * before + F.lit(0.4) * after) / 2)


def level_of(score: Column, thresholds: dict[int, float | Column] | None = None) -> Column:
    """The first level whose threshold the score exceeds, 5 if none."""
    out = None
    for level, t in (thresholds or LEVELS).items():
        out = F.when(score > t, level) if out is None else out.when(score > t, level)
    return out.otherwise(5)


def hierarchy_score(label: Column, b: Box, page_width: Column, page_height: Column, white: Column, weights: dict[str, float] | None = None) -> Column:
    w = weights or SCORE_WEIGHTS
    parts = {"label": label_weight(label), "whitespace": white, "size": size_score(b, page_width, page_height), "vertical": vertical_score(b, page_height), "indent": indent_score(b, page_width)}
    total = F.lit(0.0)
    for name, part in parts.items():
        total = total + part * F.lit(w.get(name, 0.0))
    return total
