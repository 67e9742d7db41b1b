"""Personal data: patterns propose spans, checks confirm them, nearby context words move the score.

Base kinds (email, ip, card, phone) are decided by pattern and check alone. Further
kinds start from a prior score, gain when their check digits hold, gain or lose by
the words around them, and are reported from ``LEAST_SCORE`` on. All patterns
scan in linear time: runs are taken possessively, and e-mail addresses are found from
their @ outwards, so one long token cannot stall a task. Texts are read whole;
positions are code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import slices_of

Span = tuple[str, int, int, float]

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "local_phone")
KINDS = BASE_KINDS + ADDED_KINDS
ORDER = {kind: i for i, kind in enumerate(KINDS)}

# fixed values: the base patterns of the contract, with possessive runs
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# added kinds
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+()-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")

# fixed values: words that speak for or against a kind within REACH code points
CONTEXT = {
    "email": (("email", "e-mail", "mail", "contact", "write"), ()),
    "ip": (("ip", "address", "host", "server"), ("version", "release", "section")),
    "card": (("card", "visa", "mastercard", "credit", "payment"), ("order", "tracking", "serial")),
    "phone": (("call", "phone", "tel", "mobile", "fax"), ()),
    "iban": (("iban", "account", "bank", "transfer", "konto"), ("serial", "license")),
    "ssn": (("ssn", "social", "security", "taxpayer"), ("order", "part", "serial", "model")),
    "local_phone": (("call", "phone", "tel", "mobile", "fax"), ("order", "part", "serial", "model")),
}
REACH = 40
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.8, "iban": 0.4, "ssn": 0.4, "local_phone": 0.3}
CONFIRMED = 0.4  # the check digits hold
FOR, AGAINST = 0.3, 0.3
LEAST_SCORE = 0.6
WORD = re.compile(r"[a-z][a-z-]*")


def luhn(digits: str) -> bool:
    """Doubling every second digit from the right, the digit sum ends in 0."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    """Country and check digits moved behind, letters as 10..35: the rest by 97 is 1."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, @, domain with a dot: leftmost, non-overlapping."""
    free = 0  # end of the match before
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_PART:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
            at = text.find("@", free)
        else:
            free = max(free, at + 1)  # what stands before this @ can start no other match
            at = text.find("@", at + 1)


def _ip_ok(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _card_ok(text: str) -> bool:
    digits = _digits(text)
    return 14 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(text: str) -> bool:
    return 10 <= len(_digits(text)) <= 15


def _iban_ok(text: str) -> bool:
    bare = text.replace(" ", "")
    return 15 <= len(bare) <= 34 and mod_97(bare)


def _ssn_ok(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


PROPOSALS: tuple[tuple[str, re.Pattern, Callable[[str], bool]], ...] = (
    ("ip", IP, _ip_ok),
    ("card", CARD, _card_ok),
    ("phone", PHONE, _phone_ok),
    ("iban", IBAN, _iban_ok),
    ("ssn", SSN, _ssn_ok),
    ("local_phone", LOCAL_PHONE, lambda _: False),  # nothing to check: context decides
)
A_DIGIT = re.compile(r"[0-9]")


def _scored(kind: str, text: str, start: int, end: int, confirmed: bool) -> Span:
    around = text[max(0, start - REACH) : start] + " " + text[end : end + REACH]
    words = set(WORD.findall(around.lower()))
    good, bad = CONTEXT[kind]
    score = PRIOR[kind] + CONFIRMED * confirmed + FOR * (not words.isdisjoint(good)) - AGAINST * (not words.isdisjoint(bad))
    return kind, start, end, min(1.0, max(0.0, score))


def find_spans(text: str | None) -> list[Span]:
    """(kind, start, end, score) of a whole text, by start and then by kind."""
    if not text:
        return []
    spans = [_scored("email", text, start, end, True) for start, end in _emails(text)] if "@" in text else []
    if A_DIGIT.search(text):
        base = []
        for kind, pattern, check in PROPOSALS:
            for m in pattern.finditer(text):
                start, end = m.span()
                ok = check(m.group())
                if kind in BASE_KINDS:
                    if ok:
                        base.append((start, end))
                        spans.append(_scored(kind, text, start, end, True))
                    continue
                if (kind != "local_phone" and not ok) or any(start < e and s < end for s, e in base):
                    continue
                span = _scored(kind, text, start, end, ok)
                if span[3] >= LEAST_SCORE:
                    spans.append(span)
    spans.sort(key=lambda s: (s[1], ORDER[s[0]]))
    return spans


def span_text(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, _ in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans are joined and take the first one's kind."""
    out, at = [], 0
    joined: list[list] = []
    for kind, start, end, _ in spans:
        if joined and start < joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], end)
        else:
            joined.append([kind, start, end])
    for kind, start, end in joined:
        out.append(text[at:start])
        out.append(f"<{kind.upper()}>")
        at = end
    return "".join(out) + text[at:]


SPAN_TYPE = "array<struct<kind: string, start: long, end: long, score: double>>"
_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
)
WORK_BYTES = 8 << 20


def _find_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [find_spans(t) for t in batch.column("text").to_pylist()]
        base = [[s for s in spans if s[0] in BASE_KINDS] for spans in found]
        counts = [pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64()) for kind in BASE_KINDS]
        digests = pa.array([sha256(span_text(b).encode()).hexdigest() for b in base], pa.string())
        listed = pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in spans] for spans in found], _SPANS)
        texts = pa.array([span_text(s) for s in found], pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), *counts, digests, texts, listed],
            ["doc", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans", "found"],
        )


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found) for every row; ``found`` holds the scores.

    A null or empty text has no spans. Spans of different kinds may overlap; added kinds never overlap base
    ones. Further columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    schema = f"doc {dict(rows.dtypes)['doc']}, {counts}, base_sha256 string, spans string, found {SPAN_TYPE}"
    return rows.mapInArrow(_find_batches, schema).withColumnRenamed("doc", id_col)


def _redact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices_of(batch, "text", WORK_BYTES):
            texts = [t if t is None else redact(t, find_spans(t)) for t in piece.column("text").to_pylist()]
            at = piece.schema.get_field_index("text")
            yield piece.set_column(at, "text", pa.array(texts, piece.schema.field(at).type))


def mask(df: DataFrame, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """All rows and columns of ``df``, personal data in the text replaced by ``<KIND>``.

    ``chars_col`` names a column of text lengths to bring up to date. A null text stays null.
    """
    names = df.columns
    plain = df.select(*[F.col(f"`{c}`").alias("text" if c == text_col else f"c{i}") for i, c in enumerate(names)])
    masked = plain.mapInArrow(_redact_batches, plain.schema).toDF(*names)
    if chars_col in names:
        masked = masked.withColumn(chars_col, F.char_length(text_col).cast(dict(df.dtypes)[chars_col]))
    return masked.select(*[F.col(f"`{c}`") for c in names])
