"""Secret scan: three base patterns and a sliding-window Shannon entropy over candidate strings.

Candidates are maximal runs of ``[A-Za-z0-9+/_-]`` of ``RUN`` characters or more. In each, a window of ``WINDOW``
characters slides over the runs of one character class (hexadecimal, base-64); counts of characters are updated by one
character out and one in, and with them the sum of c*log2(c), so a step costs the same whatever the window. A run whose
highest window entropy reaches its class's threshold is a secret of kind ``entropy`` unless an allow-list pattern
explains it or a base span overlaps it. Placeholder words (``your``, ``test``) count as whole segments between
``+ / _ -`` only, and explain a run only if the patterns explain its other segments; segments made of alphabets and rows
of the keyboard add no entropy. Map-only, one document at a time.

Defined cases: a null text counts as empty and has no spans; the digest of no spans is that of the empty string; null ids
and repeated rows are rows like any other; of added spans that overlap the first stays, then the longest; very long texts
and runs are read whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "entropy")
RUN = 20
WINDOW = 20
#: class -> (characters, entropy in bits that a window must reach); a window of 20 has at most 4.32.
CLASSES = {"hex": ("0123456789abcdefABCDEF", 3.0), "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.8)}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}" % RUN)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ALLOWED = [
    re.compile(p)
    for p in (
        r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",  # UUID
        r"[A-Za-z]+",  # letters only: words of some language
        r"[0-9_+/-]+",  # digits: numbers, dates, telephone numbers
        r"(?:[A-Za-z]{1,24}[/_-]+)*[A-Za-z]{1,24}[0-9]{0,4}",  # paths, identifiers and hyphenated words
        r"(.{1,8}?)\1{2,}.{0,8}",  # repetitions
        r"da39a3ee5e6b4b0d3255bfef95601890afd80709|d41d8cd98f00b204e9800998ecf8427e|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
        r"(?i)sha(?:1|256|384|512)-.*",  # integrity attributes
    )
]
_PLAIN = _ALLOWED[:4]
_SEGMENT = re.compile(r"[^+/_-]+")
_PLACEHOLDER = re.compile(r"(?i)(?:examples?|placeholder|your|samples?|dummy|changeme|xxxxx+|tests?)[0-9]{0,4}")
_ROWS = ("0123456789abcdefghijklmnopqrstuvwxyz0123456789", "1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_XLOGX = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]
_CLASS_RUNS = {name: (re.compile("[%s]{%d,}" % (re.escape(chars), WINDOW)), least) for name, (chars, least) in CLASSES.items()}


def highest_entropy(run: str, window: int = WINDOW) -> float:
    """Highest Shannon entropy, in bits, of the windows of a string; of the whole string if it is shorter."""
    w = min(window, len(run))
    if not w:
        return 0.0
    counts: dict[str, int] = {}
    total = 0.0
    for c in run[:w]:
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _XLOGX[n + 1] - _XLOGX[n]
    least = total
    for out, new in zip(run, run[w:]):
        if out == new:
            continue
        n = counts[out]
        counts[out] = n - 1
        total += _XLOGX[n - 1] - _XLOGX[n]
        n = counts.get(new, 0)
        counts[new] = n + 1
        total += _XLOGX[n + 1] - _XLOGX[n]
        if total < least:
            least = total
    return math.log2(w) - least / w


def in_rows(segment: str) -> bool:
    """Whether a segment is made of stretches, four characters or more, of alphabets and rows of the keyboard."""
    s, at = segment.lower(), 0
    if len(s) < 6:
        return False
    while at < len(s):
        n = 3
        while at + n < len(s) and any(s[at : at + n + 1] in row for row in _ROWS):
            n += 1
        if n < 4:
            return False
        at += n
    return True


def without_rows(run: str) -> str:
    """The run with segments that ``in_rows`` holds for filled with underscores."""
    return _SEGMENT.sub(lambda m: "_" * len(m.group()) if in_rows(m.group()) else m.group(), run)


def allowed(run: str) -> bool:
    if any(p.fullmatch(run) for p in _ALLOWED):
        return True
    segments = _SEGMENT.findall(run)
    rest = [x for x in segments if not _PLACEHOLDER.fullmatch(x) and not in_rows(x)]
    return len(rest) < len(segments) and (not rest or any(p.fullmatch("_".join(rest)) for p in _PLAIN))


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret of a text, by start and kind; code points, end exclusive."""
    text = text or ""
    base: list[tuple[str, int, int]] = []
    lowered = text.lower()
    if any(w in lowered for w in _ASSIGN_WORDS):
        base += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    more: list[tuple[str, int, int]] = []
    for run in _RUN.finditer(text):
        s, at = run.group(), run.start()
        if "AKIA" in s:
            base += [("access", at + m.start(), at + m.end()) for m in _ACCESS.finditer(s) if m.end() - m.start() >= 20]
        base += [("hex", at + m.start(), at + m.end()) for m in _HEX.finditer(s)]
        if allowed(s):
            continue
        for part, least in _CLASS_RUNS.values():
            for m in part.finditer(s):
                if not allowed(m.group()) and highest_entropy(without_rows(m.group())) >= least:
                    more.append(("entropy", at + m.start(), at + m.end()))
    kept: list[tuple[str, int, int]] = []
    for k, a, b in sorted(more, key=lambda x: (x[1], -x[2])):
        if all(b <= x or a >= y for _, x, y in base) and (not kept or a >= kept[-1][2]):
            kept.append((k, a, b))
    return sorted(base + kept, key=lambda x: (x[1], KINDS.index(x[0])))


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``secrets``: array of (kind, start_at, end_at) of every document."""
    span = pa.struct([("kind", pa.string()), ("start_at", pa.int64()), ("end_at", pa.int64())])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"kind": k, "start_at": a, "end_at": b} for k, a, b in find_secrets(t.as_py())] for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=["doc_id", "secrets"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, secrets array<struct<kind:string,start_at:bigint,end_at:bigint>>"
    )


def secret_digest(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for t in batch.column(1):
                spans = find_secrets(t.as_py())
                base = [s for s in spans if s[0] != "entropy"]
                n = [sum(s[0] == k for s in spans) for k in KINDS]
                row = (*n[:3], hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(spans), n[3])
                for c, v in zip(cols, row):
                    c.append(v)
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
    )
