import random
import re
import string

import numpy as np
import pandas as pd
import pytest

from phasegrid.llm import near_dedup as op

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, size=2):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t, _ in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                a_, b_ = sorted((root(i), root(j)))
                parent[b_] = a_
    out = []
    for i, s in sets:
        c = None if i is None else root(i)
        out.append((i, len(s), c, i == c))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def family(r, n, words, rate, first):
    base = [r.choice(words) for _ in range(r.randint(2, 160))]
    return [(first + k, " ".join(w if r.random() > rate else r.choice(words) for w in base), "s") for k in range(n)]


def test_odd_rows_and_empty_table(make, odd):
    assert got(op.document_components(make(odd))) == brute(odd)
    assert op.document_components(make([])).collect() == []
    nothing = [(1, None, "a"), (2, "", "a")]
    assert got(op.document_components(make(nothing))) == brute(nothing)


def test_chains_families_and_short_texts(make, monkeypatch):
    monkeypatch.setattr(op, "SHORT", 6)
    monkeypatch.setattr(op, "BLOCK", 5)
    monkeypatch.setattr(op, "TILE", 2)
    monkeypatch.setattr(op, "CHUNK", 3)
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choice(words[:4]) for _ in range(r.randint(1, 6))), "s") for i in range(60)]
    for k in range(12):
        rows += family(r, r.randint(2, 14), words, r.choice([0.0, 0.01, 0.03, 0.05, 0.08]), 1000 * (k + 1))
    chain = [f"c{i}" for i in range(200)]
    rows += [(90_000 + i, " ".join(chain[5 * i : 5 * i + 90]), "s") for i in range(20)]
    r.shuffle(rows)
    assert got(op.document_components(make(rows))) == brute(rows)
    with pytest.raises(ValueError):
        op.document_components(make(rows), percent=50)


def test_stage_keeps_one_of_each(make, odd):
    rows = [x for x in odd if x[0] not in (None, 7)] + [(7, "same text here for all of us", "z")]
    left = op.drop_near_copies(make(rows))
    assert left.columns == make([]).columns
    assert {x.doc_id for x in left.collect()} == {i for i, _, c, k in brute(rows, 5) if k}


def test_components_of_long_paths(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 103), (7, 7)]
    r.shuffle(edges)
    found = {x.node: x.component for x in op.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 103: 100}


def test_rows_that_repeat_an_id_are_one_node_with_all_links(make):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(5, a, "s"), (5, b, "s"), (7, a + " x", "s"), (9, b + " y", "s"), (11, "other words here", "s"), (7, a + " x", "s")]
    found = {r.doc_id: r.component_id for r in op.document_components(make(rows)).collect()}
    assert found == {5: 5, 7: 5, 9: 5, 11: 11}


def test_hot_copies_meet_their_group(make):
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(words) if i % 3 == 0 else " ".join(words[: 3 + i % 40]) + f" u{i} v{i}", "s") for i in range(600)]
    assert got(op.document_components(make(rows))) == brute(rows)


@pytest.mark.parametrize("size", [2])
def test_a_family_of_unlinked_members_sends_few_pairs(make, monkeypatch, size):
    monkeypatch.setattr(op, "SHORT", 6)
    monkeypatch.setattr(op, "TILE", 16)
    monkeypatch.setattr(op, "BLOCK_HASHES", 4000, raising=False)
    sent, confirmed = [], op.confirmed
    monkeypatch.setattr(op, "confirmed", lambda pairs, *more: (sent.append(pairs.count()), confirmed(pairs, *more))[1])
    r = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(160):  # two edited at random resemble each other by more than a half, mostly by less than 0.8
        edited = set(r.sample(range(200), r.randint(1, 28 // size)))
        rows.append((i, " ".join(f"x{r.randint(0, 10**9)}" if k in edited else w for k, w in enumerate(base)), "s"))
    assert got(op.document_components(make(rows), size=size)) == brute(rows, size)
    assert sent[-1] < len(rows)


def test_block_comparison_equals_pair_by_pair():
    r = random.Random(4)
    rows = []
    for rep in range(70):
        base = set(range(40)) if rep % 2 else set(range(30, 75))
        s = sorted({v for v in base if r.random() < 0.9} | {r.randint(100, 400) for _ in range(r.randint(0, 30))})[: op.K]
        rows.append((bool(rep % 4 == 0), rep, rep % 5, len(s) * r.choice([1, 1, 3]), np.array(s)))
    frame = pd.DataFrame(rows, columns=["outside", "rep", "component", "n", "sketch"])
    want = set()
    for o, x, cx, nx, sx in rows:
        for p, y, cy, ny, sy in rows:
            both, union = len(set(sx) & set(sy)), len(set(sx) | set(sy))
            if o and not p and cx != cy and min(nx, ny) * 5 >= max(nx, ny) * 4 and 2 * both >= min(union, op.K):
                want.add((min(x, y), max(x, y)))
    for tile in (1, 7, 256):
        assert set(op._rest(op.K, tile)(frame).itertuples(index=False, name=None)) == want
