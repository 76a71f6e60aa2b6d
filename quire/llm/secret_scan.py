"""Secret scan: all rules as one minimised automaton, one pass over the bytes of each text.

A null or empty text has no spans. Repeated rows and rows of one id are scanned each for itself. Very
long texts are scanned whole; the automaton holds one state, and only the places where a match ended
are looked at again.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .automaton import Automaton, compile_rules
from .common import flat, map_text

#: Kinds in the order in which they are listed: first the three of the base, then those that are added.
BASE = ("assign", "access", "hex")
#: A 16-digit floor for hex is part of its pattern: a maximal run of hex digits holds at most one match either way.
RULES = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{16,}",
    "pem": r"-----BEGIN [A-Z0-9 ]{0,24}PRIVATE KEY-----",
    "forge": r"gh[opusr]_[A-Za-z0-9]+",
    "chat": r"xox[abprs]-[A-Za-z0-9-]+",
    "signed": r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
}
LEAST = {"access": 18, "forge": 36, "chat": 24, "signed": 40}
_VALUE = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def holds(kind: str, found: bytes) -> bool:
    """Whether a match of the kind's rule is long enough to count."""
    if kind == "assign":
        return len(_VALUE.fullmatch(found)[1]) >= 12
    return len(found) >= LEAST.get(kind, 0)


def scan(automaton: Automaton, text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then by kind as listed."""
    data, kinds = text.encode(), list(RULES)
    found = [(s, k, e) for k, s, e in automaton.spans(data) if holds(kinds[k], data[s:e])]
    if found and len(data) != len(text):
        at, points, marks = 0, 0, {}
        for m in sorted({x for s, _, e in found for x in (s, e)}):
            points += len(data[at:m].decode())
            marks[m], at = points, m
        found = [(marks[s], k, marks[e]) for s, k, e in found]
    return [(kinds[k], s, e) for s, k, e in sorted(found)]


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, secrets: array of (kind, start, end)) for every row, offsets in code points."""
    automaton = compile_rules(list(RULES.values()))  # some thousand states, whatever the data
    out = T.StructType([T.StructField("secrets", T.ArrayType(SPAN))])
    return flat(map_text(docs, text_col, out, lambda: lambda t: ([{"kind": k, "start": s, "end": e} for k, s, e in scan(automaton, t)],), [id_col]))


def secret_digest(docs: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans, and all spans as text, for every document."""
    automaton = compile_rules(list(RULES.values()))
    out = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def digest(text: str) -> tuple:
        spans = scan(automaton, text)
        base = [x for x in spans if x[0] in BASE]
        return *(sum(x[0] == k for x in base) for k in BASE), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)

    return flat(map_text(docs, "text", out, lambda: digest, ["doc_id"]))
