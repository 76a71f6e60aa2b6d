"""Tagged recognised text: ``<|ref|>label<|/ref|><|det|>[[x1,y1,x2,y2],...]<|/det|>`` followed by the element's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed format of the tags.
TAG = r"(?s)<\|ref\|>(.*?)<\|/ref\|><\|det\|>(.*?)<\|/det\|>"
SCALE = 999.0


def references(text: Column) -> Column:
    """The whole tags of a text, in order."""
    return F.regexp_extract_all(text, F.lit(TAG), F.lit(0))


def parse(pages: DataFrame, text: str = "tagged", width: str | None = None, height: str | None = None, with_text: bool = True) -> DataFrame:
    """One row for each box: all page columns but the text, then tag, box, label, x1..y2 and, if wanted, text_content.

    Coordinates run from 0 to 999 and are scaled to the page's ``width`` and ``height`` columns, truncated; without
    these they stay. A tag whose boxes can't be read is left out. The text of a tag reaches to the next tag, also
    where two tags are alike.
    """
    keep = [c for c in pages.columns if c != text]
    body = F.coalesce(F.col(text), F.lit(""))
    tags = pages.select(
        *keep,
        F.regexp_extract_all(body, F.lit(TAG), F.lit(1)).alias("labels"),
        F.regexp_extract_all(body, F.lit(TAG), F.lit(2)).alias("boxes"),
        F.slice(F.split(body, TAG), 2, 1 << 30).alias("parts"),
    )
    each = tags.select(*keep, F.posexplode(F.arrays_zip("labels", "boxes", "parts")).alias("tag", "t"))
    boxes = F.from_json("t.boxes", "array<array<double>>")
    rows = each.select(*keep, "tag", F.col("t.labels").alias("label"), F.col("t.parts").alias("part"), F.posexplode(boxes).alias("box", "b")).where("size(b) = 4 and forall(b, v -> v is not null)")
    scaled = [
        (F.element_at("b", i) if side is None else F.element_at("b", i) / F.lit(SCALE) * F.col(side)).cast("int").alias(name)
        for i, name, side in ((1, "x1", width), (2, "y1", height), (3, "x2", width), (4, "y2", height))
    ]
    return rows.select(*keep, "tag", "box", F.trim("label").alias("label"), *scaled, *([F.regexp_replace("part", r"^\s+|\s+$", "").alias("text_content")] if with_text else []))


def without_tags(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, TAG, ""), r"^\s+|\s+$", "")


_LINE = r"(?m)^[^\n]*<\|ref\|>(?!image<\|/ref\|>)[^\n]*?<\|/ref\|><\|det\|>[^\n]*?<\|/det\|>[^\n]*\n?"
_IMAGE = r"(?s)<\|ref\|>image<\|/ref\|><\|det\|>.*?<\|/det\|>"


def cleaned(text: Column, keep_images: bool = False) -> Column:
    """The text without the lines that hold tags; image tags are dropped alone, or numbered placeholders stand for them."""
    lines = F.regexp_replace(F.coalesce(text, F.lit("")), _LINE, "")
    if not keep_images:
        out = F.regexp_replace(lines, _IMAGE, "")
    else:
        parts = F.transform(F.split(lines, _IMAGE, -1), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("\n\n**[Figure "), i.cast("string"), F.lit("]**\n\n"), x)))
        out = F.array_join(parts, "")
    return F.regexp_replace(out, r"^\s+|\s+$", "")
