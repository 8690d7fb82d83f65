import re
from collections import Counter

from pyspark.sql import functions as F

from phasegrid.llm import mixing as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Reshare by weight, in rounds, until no target is above three times its source's words."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = sum(sizes.values())
    capped, out = set(), dict.fromkeys(names, 0.0)
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in free)
        out = {s: 3.0 * sizes[s] if s in capped else (left * weight[s] / w if w else 0.0) for s in names}
        over = {s for s in free if out[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return out
        capped |= over


def check(df, rows):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    goal = brute_targets(sizes)
    source = {i: s for i, _, s in rows}
    taken = Counter()
    for r in df.collect():
        assert r.source_size == sizes[source[r.doc_id]]
        assert abs(r.target - goal[source[r.doc_id]]) < 1e-6 * max(1, goal[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
    for s, t in goal.items():
        assert abs(taken[s] - t) <= op.BLOCK + 1, (s, taken[s], t)


def test_targets_and_taken(make):
    rows = [(i, " ".join(f"w{j}" for j in range(1 + (i * 37) % 900)), ["a", "b", "c", "z", None][min(i % 7, 4)]) for i in range(120)]
    rows += [(1000 + i, "x " * 10, "tiny") for i in range(2)]
    docs = make(rows)
    check(op.mixed_sizes(docs), rows)
    again = op.mixed_sizes(docs.repartition(7))
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(op.mixed_sizes(docs).collect(), key=key) == sorted(again.collect(), key=key)


def test_odd_rows_and_empty_table(make, odd):
    found = op.mixed_sizes(make(odd)).collect()
    assert len(found) == len(odd)
    assert all(r.taken == 0 for r in found if r["size"] == 0)
    assert op.mixed_sizes(make([])).collect() == []
    nothing = op.mixed_sizes(make([(1, None, "a"), (2, " ", None)])).collect()
    assert [(r["size"], r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 3, 10, 257):
        df = spark.range(n).select(op.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k")).alias("y"))
        assert sorted(r.y for r in df.collect()) == list(range(n))


def test_many_buckets_pack_every_word_once(make):
    rows = [(i, "w " * (1 + i % 50), "a" if i % 3 else "b") for i in range(200)]
    sizes = op.sized(make(rows))
    place = op.packed(sizes, block=16, bucket=20)
    goal = op.targets(sizes).select("source", "rank").withColumnRenamed("source", "g")
    place = place.join(goal, F.col("source") == F.col("g"))
    cut = op.pieces(place, 16).collect()
    assert sum(r.n_words for r in cut) == sum(1 + i % 50 for i in range(200))
    held = Counter()
    for r in cut:
        held[r["rank"], r.block_index] += r.n_words
    assert max(held.values()) <= 16
    blocks = {r["rank"]: r.blocks for r in place.select("rank", "blocks").distinct().collect()}
    assert {k: len({b for (s, b) in held if s == k}) for k in blocks} == blocks


def test_documents_hold_the_words_taken(make):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range((i * 53) % 700)), "abc"[i % 3]) for i in range(60)]
    docs = make(rows)
    taken = {r.doc_id: r.taken for r in op.mixed_sizes(docs).collect()}
    got = Counter()
    mixed = op.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {i: t.split() for i, t, _ in rows}
    for r in mixed.collect():
        w = WORD.findall(r.text)
        assert r.n_chars == len(r.text) and set(w) <= set(words[r.doc_id])
        got[r.doc_id] += len(w)
    assert {k: v for k, v in taken.items() if v} == dict(got)


def sources(n=240):
    return [(i, " ".join(f"d{i}w{j}" for j in range((i * 53) % 700)), "aab"[i % 3] if i % 11 else None) for i in range(n)]


def test_shard_counts_are_a_draw_that_meets_the_quotas(spark):
    quota = spark.createDataFrame([(1, 40, 100, 0, 400), (2, 300, 290, 100, 400), (3, 5, 10, 390, 400)], "rank long, blocks long, draws long, first_slot long, slots long")
    rows = op.shard_counts(quota, shard=64).collect()
    per_source, per_shard = Counter(), Counter()
    for r in sorted(rows, key=lambda r: (r.shard, r["rank"])):
        assert (r["first"], r.before) == (per_source[r["rank"]], per_shard[r.shard])
        per_source[r["rank"]] += r.n
        per_shard[r.shard] += r.n
    assert per_source == {1: 100, 2: 290, 3: 10} and per_shard == {**dict.fromkeys(range(6), 64), 6: 16}
    assert all(r.in_shard == per_shard[r.shard] for r in rows)
    first = [r.n for r in rows if r["rank"] == 1 and r.shard < 6]
    assert len(set(first)) > 1 and all(abs(n - 16) < 6 * (64 * 0.25 * 0.75 * 336 / 399) ** 0.5 for n in first)


def test_output_shards_hold_the_blocks_that_are_taken(make):
    docs = make(sources())
    blocks = op.mixed_blocks(docs, shard=64).collect()
    places = Counter((r.shard, r.position) for r in blocks)
    in_shard = Counter(r.shard for r in blocks)
    assert max(places.values()) == 1 and set(in_shard) == set(range(len(in_shard)))
    assert sorted(places) == [(s, p) for s in sorted(in_shard) for p in range(in_shard[s])]
    assert all(in_shard[s] == 64 for s in range(len(in_shard) - 1)) and len({r.source for r in blocks if r.shard == 0}) == 3
    assert all(sum(p.n_words for p in r.pieces) <= op.BLOCK for r in blocks)
    taken = Counter()
    for r in blocks:
        for p in r.pieces:
            taken[p.doc_id] += p.n_words
    assert {r.doc_id: r.taken for r in op.mixed_sizes(docs).collect() if r.taken} == dict(taken)


def test_taken_words_follow_the_shard_counts(make, monkeypatch):
    docs = make(sources())
    whole, counts = {r.doc_id: r.taken for r in op.mixed_sizes(docs).collect()}, op.shard_counts
    monkeypatch.setattr(op, "shard_counts", lambda quota, shard: counts(quota, 64).where("shard > 0"))
    less = {r.doc_id: r.taken for r in op.mixed_sizes(docs).collect()}
    assert all(less[i] <= n for i, n in whole.items())
    lost = sum(whole.values()) - sum(less.values())
    assert 0 < lost <= 64 * op.BLOCK


def test_repeated_ids_and_rows_give_the_words_planned(make):
    rows = [(1, " ".join(f"a{j}" for j in range(200)), "s"), (1, " ".join(f"b{j}" for j in range(200)), "s")]
    rows += [(i, " ".join(f"c{i}_{j}" for j in range(200)), "s") for i in range(2, 8)]
    rows += [(9, "x " * 300, "t"), (9, "x " * 300, "t"), (9, "x " * 300, None), (None, "y " * 150, "t"), (None, "z " * 150, "t")]
    docs = make(rows)
    planned = Counter()
    for r in op.mixed_sizes(docs).collect():
        planned[r.doc_id] += r.taken
    mixed, own = Counter(), {}
    for i, t, _ in rows:
        own.setdefault(i, set()).update(t.split())
    for r in op.mixed_documents(docs).collect():
        w = WORD.findall(r.text)
        mixed[r.doc_id] += len(w)
        assert set(w) <= own[r.doc_id]
    assert mixed == planned and sum(planned[i] for i in range(1, 8)) > 0
