"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Kinds in listing order; the first four are the base kinds, whose spans always stay.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:sk|pk|ghp|xoxb|AKIA)[_-]?[A-Za-z0-9]{16,64})(?![A-Za-z0-9])")
NON_DIGIT = re.compile(r"[^0-9]+")

#: What a span of the added kinds scores by itself, and what context words within REACH characters add to it.
START = {"iban": 0.8, "ssn": 0.4, "secret": 0.4}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "credit", "visa", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "tax"),
    "secret": ("token", "key", "secret", "password", "api", "auth"),
}
BASE_SCORE, CONTEXT_GAIN, ACCEPT, REACH = 0.7, 0.25, 0.5, 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ outwards, so that long runs of letters cost one pass."""
    free, at = 0, text.find("@")
    while at >= 0:
        found = DOMAIN.match(text, at)
        if found:
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, found.end()
                free = found.end()
        at = text.find("@", max(at + 1, free))


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that pass their kind's checks."""
    if "@" in text:
        for start, end in emails(text):
            yield "email", start, end
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := NON_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NON_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in IBAN.finditer(text):
        if mod97(m[0]):
            yield "iban", m.start(), m.end()
    for m in SSN.finditer(text):
        yield "ssn", m.start(), m.end()
    for m in SECRET.finditer(text):
        if not m[0].isalpha() and not m[0].isdigit():
            yield "secret", m.start(), m.end()


WORDS = {k: re.compile(r"(?<![^\W\d_])(?:" + "|".join(v) + r")(?![^\W\d_])", re.IGNORECASE) for k, v in CONTEXT.items()}


def find_spans(text: str | None) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of every span that stays, by start, then kind as listed.

    Base kinds always stay, whatever their score; a span of an added kind
    stays if it scores ACCEPT or more and overlaps no base span, which a
    search in the runs of overlapping base spans tells.
    """
    text = text or ""
    base, added = [], []
    for kind, start, end in proposals(text):
        near = WORDS[kind].search(text, max(0, start - REACH), start) or WORDS[kind].search(text, end, end + REACH)
        score = min(1.0, START.get(kind, BASE_SCORE) + CONTEXT_GAIN * bool(near))
        (added if kind in START else base).append((start, end, kind, score))
    base.sort()
    starts, ends = [], []
    for start, end, *_ in base:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    stay = list(base)
    for span in added:
        at = bisect_right(ends, span[0])
        if span[3] >= ACCEPT and not (at < len(starts) and starts[at] < span[1]):
            stay.append(span)
    return sorted(stay, key=lambda s: (s[0], KINDS.index(s[2])))


def redact(text: str | None, spans: list[tuple[int, int, str, float]]) -> str | None:
    """The text with every span, overlapping ones as one, replaced by its kind in brackets."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for start, end, kind, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = "spans array<struct<start:int,end:int,kind:string,score:double>>"


def detect_pii(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), redacted: str | None = None) -> DataFrame:
    """The columns in keep, and spans; with redacted, the redacted text as a column of that name too.

    One row per row, in one pass without a shuffle. A null or empty text has
    no spans; repeated rows are looked at one by one; an empty table gives no
    rows. Offsets count code points, end exclusive.
    """

    def setup():
        def row(text):
            spans = find_spans(text)
            return (spans_of(spans), redact(text, spans)) if redacted else (spans_of(spans),)

        return row

    return map_rows(docs, [text_col], keep, f"{SPANS}, {redacted} string" if redacted else SPANS, setup)


def spans_of(spans: list[tuple[int, int, str, float]]) -> list[dict]:
    return [{"start": s, "end": e, "kind": k, "score": x} for s, e, k, x in spans]


def listed(kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined."""
    spans = F.col("spans") if kinds is None else F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_digest(found: DataFrame) -> DataFrame:
    """The digest columns of the query: counts by base kind, the hash of the base spans, all spans."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(listed(KINDS[:4]).cast("binary"), 256).alias("base_sha256"), listed().alias("spans"))
