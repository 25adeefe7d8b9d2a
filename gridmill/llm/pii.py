"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Emails, IP addresses, card and phone numbers of the base patterns are always
reported. Further kinds (IBAN by mod-97, US social security numbers, national
phone numbers, token-like secrets) are reported when their score, raised or
lowered by the words before and after, reaches ``MIN_SCORE``, unless they touch
a span already found. Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from gridmill.llm.frames import id_and_text

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "phone_local", "secret")
MIN_SCORE = 0.5
#: Code points looked at on either side for context words.
CONTEXT = 60

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its first digit fails from every later one.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_PHONE_LOCAL = re.compile(r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|sk-[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36})(?![A-Za-z0-9])")
_ANY_DIGIT = re.compile(r"[0-9]")

_RAISES = {
    "iban": re.compile(r"\b(?:iban|bank|account|konto|cuenta|compte|bic|swift)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social|security|taxpayer)\b", re.I),
    "phone_local": re.compile(r"\b(?:phone|call|tel|mobile|fax|contact|telefon|cell)\b", re.I),
    "secret": re.compile(r"\b(?:token|key|secret|password|passwd|api|auth|bearer)\b", re.I),
}
_LOWERS = re.compile(r"\b(?:isbn|issn|sha1|sha256|md5|commit|checksum|version|invoice|order|part)\b", re.I)
_PRIOR = {"iban": 0.7, "ssn": 0.35, "phone_local": 0.4, "secret": 0.35}


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches of local part, ``@`` and dotted domain: each holds exactly one ``@``."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _base(text: str) -> Iterator[tuple[str, int, int]]:
    for a, b in _emails(text):
        yield "email", a, b
    if _ANY_DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(n) <= 3 and int(n or "0") <= 255 for n in (p.lstrip("0") for p in m[0].split("."))):
                yield "ip", *m.span()
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                yield "phone", *m.span()


def _context(text: str, kind: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - CONTEXT) : start]} {text[end : end + CONTEXT]}"
    return 0.3 * bool(_RAISES[kind].search(near)) - 0.3 * bool(_LOWERS.search(near))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Valid numbers. A candidate may have swallowed what follows, so that shorter ends at spaces are tried, longest first."""
    at = 0
    while m := _IBAN.search(text, at):
        start, at = m.start(), m.start() + 1
        for end in (m.end(), *(k for k in range(m.end() - 1, start, -1) if text[k] == " ")):
            if _IBAN.fullmatch(text, start, end) and mod97(text[start:end]):
                yield start, end
                at = end
                break


def _proposed(text: str) -> Iterator[tuple[str, int, int, float]]:
    for a, b in _ibans(text):
        yield "iban", a, b, _PRIOR["iban"] + _context(text, "iban", a, b)
    for kind, pattern in (("ssn", _SSN), ("phone_local", _PHONE_LOCAL), ("secret", _SECRET)):
        for m in pattern.finditer(text):
            yield kind, *m.span(), _PRIOR[kind] + _context(text, kind, *m.span())


class _Taken:
    """Code points that spans cover, as ranges that are apart and in order; each question is a binary search."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted((s.start, s.end) for s in spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        """Cover ``a`` to ``b``, unless some of that is covered already."""
        k = bisect_left(self.starts, b)
        if k and self.ends[k - 1] > a:
            return False
        self.starts.insert(k, a)
        self.ends.insert(k, b)
        return True


def find(text: str | None) -> list[Span]:
    """All spans of a whole text, by kind as listed in ``KINDS``, then start. Null and empty texts have none."""
    if not text:
        return []
    out = [Span(kind, a, b, 1.0) for kind, a, b in _base(text)]
    if _ANY_DIGIT.search(text):
        taken = _Taken(out)
        out += [Span(kind, a, b, min(score, 1.0)) for kind, a, b, score in _proposed(text) if score >= MIN_SCORE and taken.add(a, b)]
    return sorted(out, key=lambda s: (KINDS.index(s.kind), s.start))


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind; of spans that overlap, the earlier and longer one counts."""
    if text is None:
        return None
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind}>"]
            at = s.end
    return "".join([*out, text[at:]])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def spans(docs: DataFrame) -> DataFrame:
    """For each row of ``docs``: doc_id, its spans with scores, and the text with them replaced.

    A null text has no spans and stays null; repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t.as_py()) for t in batch.column(1)]
            listed = [[{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in f] for f in found]
            texts = [redact(t.as_py(), f) for t, f in zip(batch.column(1), found, strict=True)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(listed, kind), pa.array(texts, pa.string())], names=["doc_id", "spans", "redacted"]
            )

    return id_and_text(docs).mapInArrow(
        run, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>, redacted string"
    )


def digests(docs: DataFrame) -> DataFrame:
    """For each row: counts of the base kinds, the hash of the base spans, and all spans as one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in BASE_KINDS}
            hashes, listed = [], []
            for value in batch.column(1):
                found = find(value.as_py())
                base = [s for s in found if s.kind in BASE_KINDS]
                for k in BASE_KINDS:
                    counts[k].append(sum(s.kind == k for s in base))
                hashes.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                listed.append(_joined(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(hashes), pa.array(listed)],
                names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"],
            )

    return id_and_text(docs).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )
