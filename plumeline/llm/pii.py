"""Personal data: patterns propose spans, checksums confirm them, and context words adjust their score.

Kinds, in order: email, ip, card, phone, and iban. The first four follow fixed rules (see `base_spans`);
bank account numbers are what the method adds, confirmed by their mod-97 check. Each pattern is matched
in time linear in the text, with possessive quantifiers or by walking from its anchor, so very long runs
of digits or letters cost no more than others.

A span's score starts from its kind and what confirmed it, and rises when a context word of its kind
stands within CONTEXT characters; the score informs and never removes a base span.

Defined results: null and empty texts have no spans; offsets are in code points, the end exclusive;
repeated rows get equal results; an empty table gives an empty result; further columns are ignored by
`find` and carried through by `redact`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, text_or_empty

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
CONTEXT = 40

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_DIGIT_RUN = re.compile(r"[0-9]++")
_ALNUM = re.compile(r"[A-Za-z0-9]")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IBAN_REST = re.compile(r"(?:\x20?[A-Z0-9]){11,30}+")
# The lengths of account numbers by country (ISO 13616).
_IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
_SCORES = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8}
_WORDS = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|login)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|credit|debit|payment|pay)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|transfer)\b", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(code: str) -> bool:
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _AT_DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, start)
        at = text.find("@", max(done, at + 1))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for chain in _DOTTED.finditer(text):
        runs = [m.span() for m in _DIGIT_RUN.finditer(text, chain.start(), chain.end())]
        # four numbers at a time, from the left; a chain's remainder is too short
        for k in range(0, len(runs) - 3, 4):
            four = runs[k : k + 4]
            if all(e - s <= 3 or not text[s : e - 3].strip("0") for s, e in four) and all(int(text[max(s, e - 3) : e]) <= 255 for s, e in four):
                yield four[0][0], four[3][1]


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:  # nineteen digits and a separator between each two
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield m.span()


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    """At each anchor the country's length, then the others of 15 to 34, the longest first: the first end of a word that passes."""
    done = 0
    for m in _IBAN.finditer(text):
        rest = _IBAN_REST.match(text, m.end()) if m.start() >= done else None
        if rest is None:
            continue
        code, ends = m[0], {}
        for i in range(m.end(), rest.end()):
            if text[i] != " ":
                code += text[i]
                if len(code) >= 15 and not _ALNUM.match(text, i + 1):
                    ends[len(code)] = i + 1
        own = _IBAN_LENGTHS.get(code[:2])
        for n in sorted(ends, key=lambda n: (n != own, -n)):
            if mod97(code[:n]):
                yield m.start(), ends[n]
                done = ends[n]
                break


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost spans of the four base kinds that do not overlap within a kind; matches that fail a check are dropped."""
    digits = _DIGIT_RUN.search(text) is not None
    return {
        "email": list(_emails(text)) if "@" in text else [],
        "ip": list(_addresses(text)) if digits else [],
        "card": list(_cards(text)) if digits else [],
        "phone": list(_phones(text)) if "+" in text else [],
    }


def all_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found = base_spans(text)
    found["iban"] = list(_accounts(text)) if _DIGIT_RUN.search(text) else []
    return found


def span_score(text: str, kind: str, start: int, end: int) -> float:
    around = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
    return min(1.0, _SCORES[kind] + (0.2 if _WORDS[kind].search(around) else 0.0))


def _join(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_iban long, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_iban", pa.int64()), ("score", pa.float64())])
_NONE = hashlib.sha256(b"").hexdigest()


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            text = text.as_py() or ""
            found = all_spans(text)
            if not any(found.values()):
                rows.append((0, 0, 0, 0, _NONE, "", 0, 0.0))
                continue
            best = max(span_score(text, k, s, e) for k in KINDS for s, e in found[k])
            digest = hashlib.sha256(_join(found, BASE).encode()).hexdigest()
            rows.append((*(len(found[k]) for k in BASE), digest, _join(found, KINDS), len(found["iban"]), best))
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=f.type) for c, f in zip(columns, list(_ARROW)[1:], strict=True))], schema=_ARROW)


def find(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of their spans, all spans, and the highest score."""
    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), _finder, _SCHEMA)


def redacted(text: str, least: float = 0.0) -> str:
    """The text with each span of at least this score replaced by its kind in angle brackets."""
    spans = sorted((s, e, k) for k, found in all_spans(text).items() for s, e in found if span_score(text, k, s, e) >= least)
    out, done = [], 0
    for s, e, k in spans:
        if s >= done:
            out += [text[done:s], f"<{k}>"]
            done = e
        elif e > done:  # what overlaps an earlier span goes with it
            done = e
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """All columns, with personal data in `text` replaced; null stays null."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redacted(t, least) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, type=batch.schema.field(at).type))

    return in_batches(docs, run, docs.schema)
