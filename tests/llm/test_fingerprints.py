import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from phasegrid.llm import fingerprints as op


def h64(data: bytes, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(data, seed)


def brute_sketch(text, k=op.K):
    w = [h64(x.encode()) for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if not w:
        return []
    out = set()
    for i in range(max(1, len(w) - 4)):
        seed = 42
        for v in w[i : i + 5]:
            seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed)
        out.add(seed & 0xFFFFFFFF)
    return sorted(out)[:k]


def like(a, b, k=op.K):
    union = sorted(set(a) | set(b))[:k]
    return 1.0 if not union else len(set(union) & set(a) & set(b)) / len(union)


def number(s, k=op.K):
    return float(len(s)) if len(s) < k else (k - 1) * 2.0**32 / (s[-1] + 1)


def spelled(s):
    return "".join(f"{v:08x}" for v in s)


def check(docs, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = {r.doc_id: r for r in op.document_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for i, (doc_id, text, _) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = brute_sketch(text), brute_sketch(edited), brute_sketch(after)
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (spelled(a), spelled(b))
        assert abs(r.near_edited - like(a, b)) < 1e-12 and abs(r.near_next - like(a, c)) < 1e-12
        both = sorted({*a, *b})[: op.K]
        held = 1.0 if not a else min(1.0, like(a, b) * number(both) / max(1.0, number(a)))
        assert abs(r.n_distinct - number(a)) < 1e-6 and abs(r.held_by_edited - held) < 1e-9
        assert abs(r.n_distinct_with_next - number(sorted({*a, *c})[: op.K])) < 1e-6


def test_odd_rows(make, odd):
    rows = [r for k, r in enumerate(odd) if k != 7]  # ids once
    check(make(rows), rows)


def test_repeated_and_single_rows_and_empty_table(make):
    twice = op.document_fingerprints(make([(7, "a b c d e f", "s")] * 2)).collect()
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].near_next == 1.0
    one = op.document_fingerprints(make([(1, "a b c d e f g h", "s")])).collect()[0]
    assert one.near_next == 1.0
    assert op.document_fingerprints(make([])).collect() == []


def test_many_ranges(make, monkeypatch):
    monkeypatch.setattr(op, "RANGE_ROWS", 5)
    rows = [((i * i) if i % 4 else i + 10**12, f"text {i} " * (i % 9), "s") for i in range(1, 90)]
    rows = list({r[0]: r for r in rows}.values())
    check(make(rows), rows)


def test_estimates_and_merging(spark):
    a = " ".join(f"w{i}" for i in range(4000))
    b = " ".join(f"w{i}" for i in range(1000, 5000))
    df = spark.createDataFrame([(a, b)], "a string, b string")
    sa, sb = op.sketch(F.col("a")), op.sketch(F.col("b"))
    r = df.select(op.resemblance(sa, sb).alias("j"), op.containment(sa, sb).alias("c"), op.distinct_count(sa).alias("n")).first()
    assert abs(r.j - 3000 / 5000) < 0.15 and abs(r.c - 0.75) < 0.2 and abs(r.n / 4000 - 1) < 0.3
    parts = spark.createDataFrame([(f"p{i % 3}", a[i * 2000 : i * 2000 + 4000]) for i in range(9)], "g string, t string")
    merged = op.merge_groups(parts.select(F.lit("all").alias("g"), op.sketch(F.col("t")).alias("s")), "g", "s").first().s
    every = sorted({v for r in parts.collect() for v in brute_sketch(r.t, 10**9)})[: op.K]
    assert merged == every
