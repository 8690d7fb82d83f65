"""Licence scan: ordered signature rules behind a keyword prefilter.

DataFrame functions only, and no shuffle: every row is decided where it is read. A text in which no root of any rule's
keyword occurs costs one word count and a few substring searches. Others are reduced to lower-case words joined by
single spaces; the rules whose keyword the result holds mark their matches in it, and the marked words give the spans.
Sorted by start, longest first, one fold then drops each detection that lies inside another of the same or a higher
priority; it goes through them in pieces, so that what it has kept is not copied at every step. Base places (the three
phrases of ``BASE``) are never dropped.

Defined cases: a null text counts as empty; a text without words has zero counts, null positions, empty labels and score
0; of equal spans the higher priority stays, then the first label; very long texts are read whole; repeated rows and null
ids are rows like any other; an empty table gives an empty result; further columns are ignored by ``license_digest`` and
kept by ``scan``, but for one of the name that it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import lower_ascii, whole
from phasegrid.llm.license_rules import rules

#: phrase -> label, the base detections
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_CODES = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
#: Characters between words, before lower-casing; single characters for the same reason as in ``common.SPACE``.
GAP = "".join(f"\\x{c:02X}" for c in _CODES)
#: Every keyword holds one of these single words or parts of words, so a text without any of them has no match.
ROOTS = (
    "licen", "gpl", "domain", "copyright", "permission", "apache", "bsd", "redistribut", "warrant", "merchantab",
    "openssl", "cc0", "wtfpl", "expat", "polyform", "cecill", "rail", "software", "reserved", "commons", "perl",
    "unencumbered", "attribution", "jpeg", "leffler", "mozilla", "eclipse", "exception", "linking", "plainly",
    "advertising", "consortium", "liable", "copying", "secret", "cc by", "cc-by", "endorse", "extent", "creativecommons", "reproduction",
)
#: The one root of two words, with whatever may stand between them.
ROOT_PAIR = f"cc[{GAP}]+by"
_OPEN, _CLOSE = "\x01", "\x02"
PIECE = 64


def _rule_table() -> Column:
    """The rules as a constant array of structs, folded from five strings: hundreds of literals would slow planning."""
    rows = [(v, p, c, f" {k}" if " " in k else k, f"(?<= ){x}(?= )") for v, p, c, k, x in rules()]
    column = lambda i: F.split(F.lit("\x03".join(str(r[i]) for r in rows)), "\x03")
    return F.arrays_zip(
        column(0).alias("label"),
        column(1).cast("array<int>").alias("priority"),
        column(2).cast("array<double>").alias("confidence"),
        column(3).alias("keyword"),
        column(4).alias("pattern"),
    )


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _word_spans(norm: Column, pattern: Column) -> Column:
    """Word spans (start, end exclusive) of a pattern's matches in `` word word ... word ``."""
    marked = F.regexp_replace(norm, pattern, F.lit(f"{_OPEN}$0{_CLOSE}"))
    return _let(
        F.split(F.substring(marked, 2, 2**31 - 1), " "),
        lambda w: F.arrays_zip(
            F.filter(F.transform(w, lambda x, i: F.when(x.startswith(_OPEN), i)), lambda i: i.isNotNull()).alias("start"),
            F.filter(F.transform(w, lambda x, i: F.when(x.endswith(_CLOSE), i + 1)), lambda i: i.isNotNull()).alias("end"),
        ),
    )


def _detections(norm: Column) -> Column:
    """Detections of all rules, containment resolved: array of (start, end, priority, label, confidence)."""
    tried = F.filter(_rule_table(), lambda r: F.contains(norm, r["keyword"]))
    found = F.flatten(
        F.transform(
            tried,
            lambda r: F.transform(
                _word_spans(norm, r["pattern"]),
                lambda s: F.struct(
                    s["start"].alias("start"),
                    (-s["end"]).alias("minus_end"),
                    r["priority"].alias("priority"),
                    r["label"].alias("label"),
                    r["confidence"].alias("confidence"),
                ),
            ),
        )
    )
    kind = "array<struct<start:int,minus_end:int,priority:int,label:string,confidence:double>>"

    def state(reach: Column, kept: Column) -> Column:
        return F.struct(reach.alias("reach"), kept.alias("kept"))

    def empty(of: str) -> Column:
        return F.coalesce(F.lit(None).cast(of), F.array().cast(of))

    def step(acc: Column, d: Column) -> Column:
        inside = F.exists(F.slice(acc["reach"], 1, d["priority"]), lambda reach: reach >= -d["minus_end"])
        reach = F.transform(
            acc["reach"], lambda v, i: F.when(i + 1 == d["priority"], F.greatest(v, -d["minus_end"])).otherwise(v)
        )
        return F.when(inside, acc).otherwise(state(reach, F.concat(acc["kept"], F.array(d))))

    def piece(acc: Column, ds: Column) -> Column:
        done = F.aggregate(ds, state(acc["reach"], empty(kind)), step)
        return _let(done, lambda r: state(r["reach"], F.concat(acc["kept"], F.array(r["kept"]))))

    def resolved(ds: Column) -> Column:
        n = F.size(ds)
        at = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / PIECE).cast("int")))
        pieces = F.transform(at, lambda i: F.slice(ds, i * PIECE + 1, F.lit(PIECE)))
        start = state(F.array_repeat(F.lit(0), 5), empty(f"array<{kind}>"))
        return F.coalesce(F.aggregate(pieces, start, piece, lambda acc: F.flatten(acc["kept"])), empty(kind))

    return _let(F.array_sort(found), resolved)


def scan(docs: DataFrame, name: str = "scan") -> DataFrame:
    """All columns of ``docs`` and one of the name given: a struct of the word count, base places and kept detections.

    Its fields: ``n_words``, ``base`` array of (start, label), ``detections`` array of (start, minus_end, priority, label,
    confidence); positions are words from 0.
    """
    text = whole("text")
    lowered = F.lower(text)
    gate = _let(lowered, lambda t: _any(F.contains(t, F.lit(root)) for root in ROOTS) | F.rlike(t, F.lit(ROOT_PAIR)))
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(text), f"[{GAP}]+", " ")), F.lit(" "))
    base = F.array(*[F.struct(F.lit(f"(?<= ){p}(?= )").alias("pattern"), F.lit(v).alias("label")) for p, v in BASE.items()])
    places = lambda n: F.flatten(
        F.transform(
            base,
            lambda b: F.transform(
                _word_spans(n, b["pattern"]), lambda s: F.struct(s["start"].alias("start"), b["label"].alias("label"))
            ),
        )
    )
    hits = F.when(
        gate, _let(norm, lambda n: F.struct(places(n).alias("base"), _detections(n).alias("detections")))
    )
    n_words = F.regexp_count(text, F.lit(f"[^{GAP}]+")).cast("long")
    empty = F.array().cast("array<struct<start:int,label:string>>")
    none = F.array().cast("array<struct<start:int,minus_end:int,priority:int,label:string,confidence:double>>")
    found = _let(
        hits,
        lambda h: F.struct(
            n_words.alias("n_words"), F.coalesce(h["base"], empty).alias("base"), F.coalesce(h["detections"], none).alias("detections")
        ),
    )
    return docs.withColumn(name, found)


def _any(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return out


def license_digest(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` is the highest confidence among the document's detections (0 without any).
    """
    s = scan(docs.select("doc_id", "text"))
    starts = F.transform("scan.base", lambda b: b["start"])
    base_labels = F.transform("scan.base", lambda b: b["label"])
    labels = F.concat(base_labels, F.transform("scan.detections", lambda d: d["label"]))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    score = F.greatest(
        F.coalesce(F.array_max(F.transform("scan.detections", lambda d: d["confidence"])), F.lit(0.0)),
        F.when(F.size("scan.base") > 0, F.lit(0.8)).otherwise(F.lit(0.0)),
    )
    return s.select(
        "doc_id",
        F.col("scan.n_words").alias("n_words"),
        F.size("scan.base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(labels).alias("labels"),
        score.alias("score"),
    )
