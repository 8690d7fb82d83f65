import hashlib
import string

from pyspark.sql import functions as F

from phasegrid.llm import exact_dedup as op

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def expected(rows):
    norm = [(i, (t or "").translate(FOLD)) for i, t, _ in rows]
    out = []
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        known = [j for j in ids if j is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    rows = df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_odd_rows(make, odd):
    assert got(op.exact_groups(make(odd))) == expected(odd)


def test_colliding_hashes_are_told_apart(make):
    rows = [(i, t, "s") for i, t in enumerate(["a b", "A B", "a c", "a d", "a d", "zz"])]
    assert got(op.exact_groups(make(rows), lambda sha: F.lit("same"))) == expected(rows)


def test_some_hashes_collide(make):
    rows = [(i, f"text {i % 60}" if i % 4 else "hot", "s") for i in range(240)] + [(None, "text 7", "s"), (8, "text 9", "s"), (8, "hot", "s")]
    for n in (1, 2, 3):
        assert got(op.exact_groups(make(rows), lambda sha: F.substring(sha, 1, n))) == expected(rows)


def test_empty_table(make):
    assert op.exact_groups(make([])).collect() == []
    assert op.drop_copies(make([])).collect() == []


def test_one_row_of_each_group_stays(make, odd):
    docs = make(odd)
    left = op.drop_copies(docs)
    assert left.columns == docs.columns
    texts = sorted((r.text or "").translate(FOLD) for r in left.collect())
    assert texts == sorted({(t or "").translate(FOLD) for _, t, _ in odd})
    unique = make([r for r in odd if r[0] not in (7, None)])
    assert {r.doc_id for r in op.drop_copies(unique).collect()} == {2, 3, 4, 6, 8, 9, 10}


def test_hot_group(make):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}", "s") for i in range(300)]
    assert got(op.exact_groups(make(rows))) == expected(rows)


def test_no_copy_survives_under_an_id_that_stays(make):
    left = op.drop_copies(make([(5, "a", "s"), (5, "b", "s"), (7, "b", "s")])).collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(5, "a"), (7, "b")]
