import math
import os
import re
import string
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from phasegrid.llm import common, mixing, quality, queries, sentencepiece_codec
from phasegrid.llm.near_dedup import shingle_set

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SF = "/root/testdata/sf0.001"


def write(spark, path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages_against_brute_force(spark, tmp_path):
    d = SF
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    stages = corpus_pipeline.STAGES
    # 1: the documents whose value is among the k largest, k being the number of positive log-weights
    good = stages[0][1](spark, docs, d).persist()
    scored = quality.scored(docs, quality.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))).collect()
    keys = sorted((r.gumbel_key for r in scored if r.gumbel_key is not None), reverse=True)
    k = sum(r.log_weight > 0 for r in scored)
    ids = {r.doc_id for r in good.collect()}
    assert ids == {r.doc_id for r in scored if r.gumbel_key is not None and r.gumbel_key >= keys[k - 1]} and good.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    clean = {i for i, q in labels.items() if q}
    assert len(clean & ids) >= 0.95 * len(clean) and len({i for i, q in labels.items() if not q} & ids) <= 0.1 * max(1, len(labels) - len(clean))
    # 2: the largest id of each folded text
    unique = stages[1][1](spark, good, d).persist()
    last = {}
    for r in good.collect():
        t = (r.text or "").translate(FOLD)
        last[t] = max(last.get(t, -1), r.doc_id)
    assert {r.doc_id for r in unique.collect()} == set(last.values()) and unique.columns == columns
    # 3: the smallest id of each group linked at 0.8 of five-word shingles
    apart = stages[2][1](spark, unique, d).persist()
    sets = sorted((r.doc_id, shingle_set(r.text, 5)) for r in unique.collect())
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, x) in enumerate(sets):
        for j, y in sets[:n]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert {r.doc_id for r in apart.collect()} == {i for i, _ in sets if root(i) == i} and apart.columns == columns
    # 4: each source's words near its target, no document more than three times
    mixed = stages[3][1](spark, apart, d).persist()
    assert mixed.columns == columns
    plan = {r.doc_id: r for r in mixing.mixed_sizes(apart).collect()}
    got, per, target = Counter(), Counter(), {}
    for r in mixed.collect():
        got[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    source = {r.doc_id: r.source for r in apart.collect()}
    for i, r in plan.items():
        assert got[i] == r.taken <= 3 * r["size"]
        per[source[i]] += got[i]
        target[source[i]] = r.target
    assert all(abs(per[s] - t) <= mixing.BLOCK + 1 for s, t in target.items())
    # 5: the library's ids, and back
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    tokens = stages[4][1](spark, mixed, d).collect()
    want = Counter((r.doc_id, tuple(sp.encode(r.text))) for r in mixed.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in tokens) == want and all(r.round_trip for r in tokens)


def test_empty_documents(spark, tmp_path):
    write(spark, str(tmp_path / "a"), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).collect() == []
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a few words of text here", "en", None, 24), (3, "a few words of text here", "en", None, 24)]
    write(spark, str(tmp_path / "b"), rows, [(3, 1, 0), (None, None, None)])
    for r in corpus_pipeline.run(spark, str(tmp_path / "b")).collect():
        assert r.doc_id == 3


def test_cuts_and_results_have_few_files(spark, tmp_path):
    """At 6 GB each cut had up to 600 files, for each of which the executors start two processes that map their memory."""
    most = max(common.FILES, 3 * spark.sparkContext.defaultParallelism, common.shuffle_partitions(spark) // 8)
    many = spark.range(0, 5 * most, 1, 5 * most)
    few = common.cut(many)
    assert few.rdd.getNumPartitions() == most and sorted(r.id for r in few.collect()) == list(range(5 * most))
    assert common.cut(spark.range(0, 9, 1, 3)).rdd.getNumPartitions() == 3
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(i, " ".join(words[(i >> j) % 4] for j in range(8)), "en", "s", 0) for i in range(most)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5 * most)
    assert corpus_pipeline.tokenise(spark, docs, "").rdd.getNumPartitions() == most


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(queries.SQL[name])
    columns = [c[0] for c in result.description]
    at = sorted(range(len(columns)), key=columns.__getitem__)
    want = sorted((tuple(normal(r[i]) for i in at) for r in result.fetchall()), key=str)
    df = queries.QUERIES[name](spark, SF)
    got = sorted((tuple(normal(v) for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str)
    assert got == want


def test_registered():
    names = list(entry.queries())
    assert [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == [] and "pipeline" in names
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py" and len(corpus_pipeline.STAGES) == 5
    assert np.isfinite(quality.SMOOTH)
