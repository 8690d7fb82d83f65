import math
import random

import numpy as np
from pyspark.sql import functions as F

from phasegrid.llm import quality as op


def corpus(n=400, seed=1):
    r = random.Random(seed)
    good = [f"good{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(n):
        bad = r.random() < 0.2
        w = [r.choice(good) + ("%%%" if bad else "") for _ in range(r.randint(3, 60))]
        rows.append((i, " ".join(w), "s"))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    return rows, labels, {i for i, t, _ in rows if "%%%" in t}


def test_held_out_documents(spark, make):
    rows, labels, bad = corpus()
    kept = {r.doc_id for r in op.sample(make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held_out = {i for i, _, _ in rows if i % 2}
    assert len(held_out & bad & kept) <= 0.05 * len(held_out & bad)
    assert len((held_out - bad) & kept) >= 0.95 * len(held_out - bad)


def test_counts_scores_and_top_k_by_brute_force(spark, make):
    rows, labels, _ = corpus(120)
    docs, table = make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = op.fit(docs, table, buckets=512)
    raw, good, ok = np.zeros(512), np.zeros(512), {i for i, q, _ in labels if q}
    for i, t, _ in rows:
        n = np.bincount(op.ngrams(t, op._Hashes(), 512), minlength=512)
        raw += n
        good += n if i in ok else 0
    p = np.maximum(raw, 1) / np.maximum(raw, 1).sum()
    want = np.log((good + 512 * p) / (good.sum() + 512)) - np.log(p)
    assert np.allclose(model, want)
    scored = {r.doc_id: r for r in op.scored(docs, model).collect()}
    for i, t, _ in rows:
        assert abs(scored[i].log_weight - want[op.ngrams(t, op._Hashes(), 512)].sum()) < 1e-9
    keys = sorted((r.gumbel_key for r in scored.values()), reverse=True)
    for k in (1, 7, 60, 120):
        assert op.threshold(op.scored(docs, model), k, width=8) == keys[k - 1]


def test_gumbel_noise(spark, make):
    docs = make([(i, f"w{i}", "s") for i in range(4000)])
    g = [r.gumbel_key - r.log_weight for r in op.scored(docs, np.zeros(64)).collect()]
    assert abs(np.mean(g) - 0.5772) < 0.08 and abs(np.std(g) - math.pi / math.sqrt(6)) < 0.08


def test_odd_rows_and_empty_tables(spark, make, odd):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels = spark.createDataFrame([(5, 1, 0), (8, 0, 1), (None, 1, None)], "doc_id long, quality int, toxic int")
    assert op.sample(make([]), labels).collect() == []
    assert op.keep_good(make([]), empty).collect() == []
    kept = op.sample(make(odd), labels)
    assert not {1, 2, 3} & {r.doc_id for r in kept.collect()}
    all_kept = op.sample(make(odd), empty)
    assert {r.doc_id for r in all_kept.collect()} == {4, 5, 6, 7, 8, 9, 10, None}
    assert op.keep_good(make(odd), empty).columns == make(odd).columns
    assert kept.select(F.bool_and("kept")).first()[0] in (True, None)


def test_all_values_equal(spark):
    df = spark.createDataFrame([(1.5,)] * 9, "gumbel_key double")
    assert op.threshold(df, 4) == 1.5


def test_rows_of_one_id_are_told_apart_by_text(spark, make):
    rows, labels, bad = corpus()
    twice = rows + [(i + 1 if i % 2 else i, t, s) for i, t, s in rows[:100]]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = make(twice)
    scored = op.scored(docs, op.fit(docs, table)).collect()
    k = sum(r.log_weight > 0 for r in scored)
    least = sorted((r.gumbel_key for r in scored), reverse=True)[k - 1]
    want = sorted(r.doc_id for r in scored if r.gumbel_key >= least)
    assert sorted(r.doc_id for r in op.keep_good(docs, table).collect()) == want


def test_a_document_labelled_both_ways_is_not_taken_for_good(spark, make):
    rows, labels, _ = corpus(60)
    both = [*labels, *((i, 1 - q, 0) for i, q, _ in labels[:10])]
    make_labels = lambda x: spark.createDataFrame(x, "doc_id long, quality int, toxic int")
    assert np.array_equal(op.fit(make(rows), make_labels(both)), op.fit(make(rows), make_labels(labels[10:])))
