"""Scalar functions of text, JSON and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns, English and Vietnamese.
CAPTIONS = [
    r"^(Figure|Fig\.?)\s*\d+", r"^(Table|Tab\.?)\s*\d+", r"^(Hình)\s*\d+", r"^(Bảng)\s*\d+", r"^(Image|Img\.?)\s*\d+", r"^(Chart|Graph)\s*\d+", r"^\[\d+\]",
    r"^<center>\s*(Figure|Fig\.?)\s*\d+", r"^<center>\s*(Table|Tab\.?)\s*\d+", r"^<center>\s*(Hình)\s*\d+", r"^<center>\s*(Bảng)\s*\d+", r"^<center>\s*(Image|Img\.?)\s*\d+",
]
SECTIONS = [r"^\d+\.(\d+\.)*\s+\S", r"^[A-Z]+\.(\d+\.)*\s+\S", r"^(Chapter|Section|Part)\s+\d+", r"^(Chương|Phần|Mục)\s+\d+"]
PAGE_NUMBERS = [r"^\d{1,4}$", r"^-\s*\d+\s*-$", r"^page\s*\d+", r"^trang\s*\d+"]


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def digest(text: Column) -> Column:
    """16 bytes that stand for a text where only equality counts, so that the text itself needn't be sent."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def any_of(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(text.rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def matching_form(text: Column) -> Column:
    """What stays of a text when its repetitions are looked for: lower case, without numbers, single spaces."""
    out = F.lower(stripped(F.coalesce(text, F.lit(""))))
    out = F.regexp_replace(out, r"\b(page\s*)?\d+\b", "")
    return stripped(F.regexp_replace(out, r"\s+", " "))


def without_html(text: Column) -> Column:
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)<br\s*/?>", " ")
    return stripped(F.regexp_replace(out, r"<[^>]+>", ""))


def header_text(segment: Column, label: Column) -> Column:
    """The first line without Markdown signs and tags, or the label."""
    line = stripped(F.substring_index(stripped(F.coalesce(segment, F.lit(""))), "\n", 1))
    line = stripped(F.regexp_replace(F.regexp_replace(line, r"^#{1,6}\s+", ""), r"<[^>]+>", ""))
    return F.when(line == "", label).otherwise(line)


def without_header_signs(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^#+\s+", "")


def markdown_level(text: Column) -> Column:
    signs = F.regexp_extract(F.coalesce(text, F.lit("")), r"^(#+)", 1)
    return F.when(signs != "", F.length(signs) - 1)


def count_tokens(text: Column) -> Column:
    """Four characters to a token."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int")


def chunks(text: Column, max_tokens: int = 2000, overlap: int = 100) -> Column:
    """Sentences packed greedily; a closed chunk ends in a full stop, and with overlap the next one starts with its last sentence.

    The count after such a start is twice that of the sentence that didn't fit, as it has always been.
    """
    sentences = F.split(F.coalesce(text, F.lit("")), r"\. ")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        n = F.floor(F.length(s) / 4).cast("int")
        full = (acc["n"] + n > max_tokens) & (F.size(acc["now"]) > 0)
        closed = F.concat(acc["done"], F.array(F.concat(F.array_join(acc["now"], ". "), F.lit("."))))
        fresh = F.array(F.element_at(acc["now"], -1), s) if overlap > 0 else F.array(s)
        return F.struct(
            F.when(full, closed).otherwise(acc["done"]).alias("done"),
            F.when(full, fresh).otherwise(F.concat(acc["now"], F.array(s))).alias("now"),
            F.when(full, n * 2 if overlap > 0 else n).otherwise(acc["n"] + n).alias("n"),
        )

    return F.aggregate(sentences, empty, step, lambda acc: F.concat(acc["done"], F.array(F.array_join(acc["now"], ". "))))


def pieces(text: Column, size: int = 2000) -> Column:
    """Fixed numbers of characters, the last may be shorter."""
    count = F.ceil(F.length(text) / size).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def summary_fallback(text: Column) -> Column:
    """A text under 50 characters is its own summary, else its first 200 stand for one."""
    return F.when(F.length(text) < 50, text).otherwise(F.concat(F.left(text, F.lit(200)), F.lit("...")))


def physical_index(text: Column) -> Column:
    return F.regexp_extract(text, r"physical_index_(\d+)", 1).try_cast("int")


def first_start_page(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"<start_index_(\d+)>", 1).try_cast("int"), F.lit(-1))


def last_start_page(text: Column) -> Column:
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(r"<start_index_(\d+)>"), F.lit(1)), F.lit(-1)).try_cast("int"), F.lit(-1))


def dots_to_colon(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\.{5,}", ": "), r"(?:\. ){5,}\.?", ": ")


def file_name(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("-"))


def document_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.md$", "")


def file_type(path: Column) -> Column:
    return F.when(F.lower(path).endswith(".pdf"), "pdf").otherwise("image")


def page_label(text: Column, page: Column, kind: str = "physical_index") -> Column:
    mark = F.concat(F.lit(f"<{kind}_"), page.cast("string"), F.lit(">"))
    return F.concat(mark, F.lit("\n"), text, F.lit("\n"), mark, F.lit("\n\n"))


def found_json(text: Column) -> Column:
    """The JSON in an answer: all of it, what a code fence holds, or what reaches from the first to the last bracket."""
    tries = [text, F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.regexp_extract(text, r"(?s)(\[.*\])", 1)]
    return F.coalesce(*[F.try_parse_json(F.when(stripped(t) != "", t)) for t in tries])


def lenient_json(text: Column) -> Column:
    """As ``found_json`` after common slips are mended; an empty object if nothing can be read."""
    body = F.regexp_replace(F.regexp_replace(text, r"\bNone\b", "null"), r",\s*([}\]])", "$1")
    return F.coalesce(found_json(body), F.parse_json(F.lit("{}")))
