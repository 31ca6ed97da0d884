r"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Kinds: ``email``, ``ip``, ``card`` (Luhn) and ``phone`` by the base patterns, plus what the method adds: ``iban``
(mod-97) and ``ssn`` (three groups of digits, reported only where a word near by speaks of one). Every span has a
score: its kind's own, raised by a context word of that kind within ``NEAR`` characters. Base spans are always kept;
added ones need ``LEAST_SCORE``: an account number of a country's own length passes by its checksum alone, one of another length or of a
country that is not listed needs a context word as well. Spans of unlike kinds may overlap, as a card's digits inside an account number.

All scans are linear in the text: an address is found from its @, not by trying every start; digit runs are possessive.

Defined results: a null text is empty; positions are code points; an empty table gives no rows; repeated rows are
scanned one by one; columns beyond id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from retort.llm.common import map_rows, table

BASE, ADDED = ("email", "ip", "card", "phone"), ("iban", "ssn")
KINDS = BASE + ADDED
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.5, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "address"), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"), "iban": ("iban", "bank", "account"), "ssn": ("ssn", "social security"),
}
BONUS, LEAST_SCORE, NEAR = 0.4, 0.6, 40
#: Score of an account number whose length is not that of its country.
OTHER_LENGTH = 0.4
# Lengths of account numbers by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22,
    "VG": 24, "XK": 20,
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_WORD = {k: re.compile("|".join(rf"\b{re.escape(w)}" for w in ws)) for k, ws in CONTEXT.items()}
_NO_DIGIT = {c: None for c in map(ord, " ().+-")}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, end := m.end()))
        at = text.find("@", max(at + 1, end))
    return out


def _account(found: str, start: int) -> list[tuple[int, int]]:
    """The span of the account number: the whole match, or so much of it as the country has, up to a blank."""
    if mod97(found):
        return [(start, start + len(found))]
    ends = [i for i, c in enumerate(found) if c == " " and len(found[:i].replace(" ", "")) == IBAN_LENGTH.get(found[:2])]
    return [(start, start + i) for i in ends[:1] if mod97(found[:i])]


def find_spans(text: str) -> list[tuple[int, int, int, float]]:
    """(start, index into KINDS, end, score), sorted; base matches first come as the patterns say, then the added."""
    out: list[tuple[int, int, int, float]] = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    for run in _DOTTED.finditer(text):
        if "." in run[0]:
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m.groups()):
                    out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(m[0].translate(_NO_DIGIT)) <= 15:
                out.append((m.start(), 3, m.end()))
    out += [(s, 4, e) for m in _IBAN.finditer(text) for s, e in _account(m[0], m.start())]
    out += [(m.start(), 5, m.end()) for m in _SSN.finditer(text)]
    scored = []
    for s, k, e in sorted(out):
        kind = KINDS[k]
        near = text[max(0, s - NEAR) : s].lower() + " " + text[e : e + NEAR].lower()
        own = SCORE[kind]
        if kind == "iban" and len(text[s:e].replace(" ", "")) != IBAN_LENGTH.get(text[s : s + 2]):
            own = OTHER_LENGTH
        score = min(1.0, own + BONUS * bool(_WORD[kind].search(near)))
        if k < len(BASE) or score >= LEAST_SCORE:
            scored.append((s, k, e, score))
    return scored


def redact(text: str) -> str:
    """Every span replaced by its kind in angle brackets; of overlapping ones the first, up to the farthest end."""
    out, at = [], 0
    for s, k, e, _ in find_spans(text):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def _named(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores (comma-joined, as spans)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find_spans(t.as_py() or "") for t in b.column(1)]
            base = [[x for x in f if x[1] < len(BASE)] for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([sum(x[1] == k for x in f) for f in base], pa.int64()) for k in range(4)),
                 pa.array([hashlib.sha256(_named(f).encode()).hexdigest() for f in base], pa.string()),
                 pa.array([_named(f) for f in found], pa.string()), pa.array([",".join(f"{x[3]:.1f}" for x in f) for f in found], pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string")


def redact_documents(docs: DataFrame, text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """The same rows and columns; texts redacted, n_chars (where there is one) counted anew for redacted texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, old = b.schema.get_field_index(text_col), [t.as_py() for t in b.column(b.schema.get_field_index(text_col))]
            new = [t and redact(t) for t in old]
            columns = list(b.columns)
            columns[i] = pa.array(new, b.schema.field(i).type)
            if (j := b.schema.get_field_index(n_chars_col)) >= 0:
                columns[j] = pa.array([n if a == t else len(t) for n, a, t in zip(b.column(j).to_pylist(), old, new)], b.schema.field(j).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return map_rows(docs, run)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pii(table(spark, sf_dir, "documents"))
