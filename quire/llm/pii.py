"""Personal data by anchor expansion: one Aho-Corasick pass finds at-signs, plus signs, digits, schemes and
cues; local parsers expand each anchor to its boundaries and validate what they find.

A null or empty text has no spans, an empty table no rows. Rows are scanned each for itself, repeated rows and rows that share an id included, and whole,
however long; a parser reads only around its anchor. Of an id that is null nothing else is asked. Other columns are ignored, or come along when texts are redacted,
whatever their names and types.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat, map_text, quoted

#: Kinds as listed: first the four of the base, then those that the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("login", "iban", "account")
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_GROUPED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"://[^\s/?#@:]+:[^\s/?#@]+@[A-Za-z0-9.-]+")
#: Between a cue and what it announces: a word for number, then a sign, or white space.
_SIGN = re.compile(r"[\x20\t]*(?:no\.?|number|nr\.?|#)?[\x20\t]*[:=#][\x20\t]*", re.I | re.A)
_GAP, _NOTHING = re.compile(r"[\x20\t]+"), re.compile("")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", re.A)
_GROUP = re.compile(r"[A-Z0-9]+", re.A)
#: How long the account numbers of ISO 13616 are in each country that issues them.
_IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_CUES = ("iban", "ssn", "account", "acct", "konto", "passport")


def _automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for c in "0123456789":
        made.add_word(c, "digit")
    for word, what in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        made.add_word(word, what)
    for cue in _CUES:
        for form in {cue, cue.upper(), cue.title()}:
            made.add_word(form, "cue")
    made.make_automaton()
    return made


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_valid(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _ends_here(text: str, at: int) -> bool:
    return at == len(text) or not (text[at].isascii() and text[at].isalnum())


def iban_end(text: str, start: int) -> int:
    """Where the account number that starts here ends: as long as its country's are, or else the longest whose check digits are right, and no part of a
    longer word. 0 if there is none."""
    if not (m := _IBAN.match(text, start)):
        return 0
    ends = [i for i in range(start + 1, m.end() + 1) if text[i - 1] != " "]  # after each letter or digit
    for n in [_IBAN_LENGTHS[m[0][:2]]] if m[0][:2] in _IBAN_LENGTHS else range(len(ends), 14, -1):
        if n <= len(ends) and _ends_here(text, ends[n - 1]) and iban_valid(text[start : ends[n - 1]]):
            return ends[n - 1]
    return 0


def account_end(text: str, start: int) -> int:
    """Where the groups of capitals and digits that start here end, each with a digit, joined by single spaces or hyphens, 6 to 30 characters with
    6 digits at least. 0 if there are none."""
    at = stop = start
    while (m := _GROUP.match(text, at)) and any(c in _DIGITS for c in m[0]) and _ends_here(text, m.end()):
        if sum(c.isalnum() for c in text[start : m.end()]) > 30:
            break
        stop = m.end()
        at = stop + 1 if text[stop : stop + 1] in (" ", "-") else stop
        if at == stop:
            break
    return stop if sum(c in _DIGITS for c in text[start:stop]) >= 6 else 0


class Finder:
    """All spans of a text. Each kind keeps the end of its last match, found or dropped, and looks no further back."""

    def __init__(self) -> None:
        self.anchors = _automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by kind as listed, then start; the base kinds leftmost and non-overlapping."""
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE, *ADDED)}
        low = dict.fromkeys((*found, "digits", "groups"), 0)
        for last, what in self.anchors.iter(text):
            if what == "digit":
                if last >= low["digits"]:
                    low["digits"] = self._dotted(text, last, found["ip"])
                if last >= low["groups"]:
                    low["groups"] = self._grouped(text, last, found["card"])
            elif what == "at":
                self._email(text, last, low, found["email"])
            elif what == "plus":
                if last >= low["phone"] and (m := _DIALLED.match(text, last)):
                    low["phone"] = m.end()
                    if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                        found["phone"].append(m.span())
            elif what == "scheme":
                self._login(text, last - 2, low, found["login"])
            else:
                self._cue(text, last + 1, low, found)
        return [(k, s, e) for k, spans in found.items() for s, e in spans]

    @staticmethod
    def _dotted(text: str, at: int, out: list) -> int:
        """Chains of numbers joined by dots, four numbers at a time."""
        m = _DOTTED.match(text, at)
        parts, start = m[0].split("."), at
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(int(x[-4:]) <= 255 and (len(x) <= 4 or not x[:-4].strip("0")) for x in four):
                out.append((start, end))
            start = end + 1
        return m.end()

    @staticmethod
    def _grouped(text: str, at: int, out: list) -> int:
        m = _GROUPED.match(text, at)
        if not m:
            return at + 1
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
        return m.end()

    @staticmethod
    def _email(text: str, at: int, low: dict, out: list) -> None:
        start = at
        while start > low["email"] and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            low["email"] = m.end()
            out.append((start, m.end()))

    @staticmethod
    def _login(text: str, at: int, low: dict, out: list) -> None:
        """A user and password inside an address: from the scheme to the end of the host."""
        start = at
        while start > low["login"] and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
            start -= 1
        if start < at and (m := _LOGIN.match(text, at)):
            low["login"] = m.end()
            out.append((start, m.end()))

    @staticmethod
    def _cue(text: str, end: int, low: dict, found: dict) -> None:
        """What a cue announces: a valid account number of ISO 13616, after a sign or white space; or, after a sign, groups of
        capitals and digits, up to the first that holds no digit."""
        sign = _SIGN.match(text, end)
        start = (sign or _GAP.match(text, end) or _NOTHING.match(text, end)).end()
        if start == end or start < max(low["iban"], low["account"]):
            return
        if stop := iban_end(text, start):
            low["iban"] = stop
            found["iban"].append((start, stop))
        elif sign and (stop := account_end(text, start)):
            low["account"] = stop
            found["account"].append((start, stop))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of spans that overlap, the union by the kind that starts first."""
    out, at = [], 0
    for s, e, k in sorted((s, -e, k) for k, s, e in spans):
        e = -e
        if s >= at:
            out += [text[at:s], f"<{k}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pii: array of (kind, start, end)) for every row, offsets in code points."""
    out = T.StructType([T.StructField("pii", T.ArrayType(SPAN))])

    def make():
        finder = Finder()
        return lambda t: ([{"kind": k, "start": s, "end": e} for k, s, e in finder.spans(t)],)

    return flat(map_text(docs, text_col, out, make, [id_col]))


def pii_digest(docs: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans, and all spans as text, for every document."""
    out = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def make():
        finder = Finder()

        def digest(text: str) -> tuple:
            spans = finder.spans(text)
            base = [x for x in spans if x[0] in BASE]
            return *(sum(x[0] == k for x in base) for k in BASE), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)

        return digest

    return flat(map_text(docs, "text", out, make, ["doc_id"]))


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced; a null text stays null, other columns stay as they are."""
    out = T.StructType([T.StructField("redacted", T.StringType())])

    def make():
        finder = Finder()
        return lambda t: (redact(t, finder.spans(t)),)

    mapped = map_text(docs, text_col, out, make, docs.columns)
    was = F.col("carry").getField(text_col)
    return mapped.select(*[F.when(was.isNotNull(), F.col("out.redacted")).alias(c) if c == text_col else F.col(f"carry.{quoted(c)}") for c in docs.columns])
