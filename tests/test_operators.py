import dataclasses
"""Relational operators: hand cases, brute force, and DuckDB for every query that has SQL."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from phasegrid.functions import kernels, linalg
from phasegrid.functions.kernels import Params
from phasegrid.operators import cells, compare, diagnose, display, predict, trajectory
from phasegrid.plans import bound_grid, descent, paths, queries
from phasegrid.plans.descent import Run, Spec
from phasegrid.sources import features, generators
from phasegrid.streaming import score

SF = "/root/testdata/sf0.001"


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(queries.SQL[name])
    columns = [c[0] for c in result.description]
    at = sorted(range(len(columns)), key=columns.__getitem__)
    want = sorted((tuple(normal(r[i]) for i in at) for r in result.fetchall()), key=str)
    df = queries.QUERIES[name](spark, SF)
    got = sorted((tuple(normal(v) for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())


def test_saturation_and_selection(spark):
    rows = [(0.1, 0.85, True), (0.1, 0.15, False), (0.2, 0.2, True), (0.2, 0.8, False), (0.3, 0.1, False), (0.3, 0.9, False)]
    sat = diagnose.saturation(spark.createDataFrame(rows, "lambda double, nu double, density_bound boolean"), ["lambda"])
    assert [round(r.sat, 9) for r in sat.orderBy("lambda").collect()] == [0.85, 0.2, 0.0]
    stab = spark.createDataFrame([(0.1, 0.7, 0.9), (0.2, 0.95, 0.9), (0.3, 0.95, 0.9)], "lambda double, rsi double, stab_algo double")
    out = diagnose.select_stable(stab.join(sat, "lambda"), sat_at_most=0.8).orderBy("lambda").collect()
    assert [r.keep_stability for r in out] == [False, True, True]
    assert [r.exclude_saturation for r in out] == [True, False, False]
    assert [r.stable for r in out] == [False, True, True] and out[0].first_stable == 0.2
    strict = diagnose.select_stable(stab.join(sat, "lambda"), sat_at_most=0.0, strict=True).orderBy("lambda").collect()
    assert not any(r.stable for r in strict)
    run = diagnose.select_stable(stab.join(sat, "lambda"), at_least=3).collect()
    assert not any(r.stable for r in run)


def test_repairs_by_brute_force(spark):
    r = random.Random(1)
    for _ in range(3):
        rows = [(round(0.1 * (i + 1), 1), i, r.uniform(0, 1), r.uniform(0, 1)) for i in range(12)]
        df = spark.createDataFrame(rows, "lambda double, run int, a double, b double")
        done = trajectory.repair_lambda(df).orderBy("lambda")
        assert trajectory.coherence(done).where("NOT coherent").count() == 0
    evaluations = [(c, lam, run, r.uniform(0, 1), r.uniform(0, 1)) for c in (1.0, 2.0, 3.0) for lam in (0.5, 1.0) for run in range(3)]
    best = [(float(c), lam, c - 1) for c in (1, 2, 3) for lam in (0.5, 1.0)]
    out = trajectory.repair_c(
        spark.createDataFrame(best, "c double, lambda double, run int"), spark.createDataFrame(evaluations, "c double, lambda double, run int, a double, b double")
    ).collect()
    h = {(c, lam, run): a + b / lam for c, lam, run, a, b in evaluations}
    want = {}
    for lam in (0.5, 1.0):
        runs = [0, 1, 2]
        for order in ((1, 2), (1, 0)):
            step = 1 if order == (1, 2) else -1
            for i in order:
                if h[i + 1.0, lam, runs[i - step]] < h[i + 1.0, lam, runs[i]] - 1e-10:
                    runs[i] = runs[i - step]
        want |= {(i + 1.0, lam): (runs[i], h[i + 1.0, lam, runs[i]]) for i in range(3)}
    assert {(x.c, x["lambda"]): (x.run, x.h) for x in out} == want


def test_zones_by_flood_fill():
    r = random.Random(3)
    for _ in range(20):
        table = [{"c": float(c), "lambda": float(v), "keep": r.random() < 0.8, "reo": r.randint(1, 2)} for c in range(6) for v in range(6)]
        found = cells.zones(table, lambda a, b: 1.0)
        kept = {(x["c"], x["lambda"]): x["reo"] for x in table if x["keep"]}
        seen, groups = set(), []
        for k in kept:
            if k in seen:
                continue
            stack, group = [k], set()
            while stack:
                c, v = stack.pop()
                if (c, v) in group:
                    continue
                group.add((c, v))
                stack += [n for n in ((c + 1, v), (c - 1, v), (c, v + 1), (c, v - 1)) if kept.get(n) == kept[k]]
            seen |= group
            groups.append(frozenset(group))
        assert {frozenset(k for k in found if found[k] == z) for z in set(found.values())} == set(groups)


def test_imputation(spark):
    params = Params(
        np.array([0.5, 0.5]), np.array([[10.0, 100], [20, 200]]), np.array([np.eye(2)] * 2), np.zeros(2), np.array([[[0.9, 0.1]], [[0.1, 0.9]]]), np.zeros(2, bool), np.zeros(2, bool)
    )
    df = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.0, 1.0), (0, 1.0, 1.0)], "f int, x double, y double")
    out = predict.impute(df, params, ["x", "y"], ["f"], 1.0, [0, 1]).collect()
    assert [(r.pred_x, r.pred_y) for r in out] == [(10, 100), (20, 200), (10, 100)]
    gaps = spark.createDataFrame([(1, 0, None, None), (2, None, 19.0, 201.0), (3, 1, 21.0, None), (4, None, None, None)], "id int, f int, x double, y double")
    full = {r.id: (r.f, r.x, r.y, r.cluster) for r in predict.impute_missing(gaps, params, ["x", "y"], ["f"], 1.0).collect()}
    assert full == {1: (0, 10, 100, 1), 2: (1, 19, 201, 2), 3: (1, 21, 200, 2), 4: (0, 10, 100, 1)}
    slope = Params(np.ones(1), np.array([[0.0, 0.0]]), np.array([[[2.0, 1], [1, 4]]]), np.zeros(1), np.zeros((1, 0, 0)), np.zeros(1, bool), np.zeros(1, bool))
    r = predict.impute(spark.createDataFrame([(5.0, 4.0)], "x double, y double"), slope, ["x", "y"], [], 1.0, [0]).first()
    assert abs(r.pred_x - 1.0) < 1e-12


def test_distributed_descent_equals_the_kernels(spark):
    from phasegrid.functions import kernels

    obs = generators.mixed_benchmark(spark, 300, 2, 2, 3, 3, seed=4)
    obs, levels = features.encoded(obs, ["f1", "f2"])
    codes = ["f1_code", "f2_code"]
    t, ids = paths.local_table(obs, ["x1", "x2"], codes, len(levels), "id")
    for spec, table in (
        (Spec(["x1", "x2"], codes, len(levels)), t),
        (Spec(["x1", "x2"]), kernels.Table(t.x)),
        (Spec([], codes, len(levels)), kernels.Table(np.empty((0, 0)), t.codes, len(levels))),
        (Spec(["x1"], univariate=True), kernels.Table(t.x[:, :1], univariate=True)),
    ):
        runs = descent.descend(obs, spec, [Run("r", 0.5, 2.0, descent.random_start(spec, 4, 9))], loops=60)
        descent.objective(obs, spec, runs)
        start = np.array([r.k for r in obs.orderBy("id").select(descent.random_start(spec, 4, 9).alias("k")).collect()])
        fit = kernels.descend(table, start, 0.5, 2.0, loops=60)
        assert runs[0].params.r == fit.reo and np.allclose(runs[0].params.mean, fit.params.mean, atol=1e-8)
        assert abs(runs[0].h - fit.h) < 1e-8


def test_weighted_statistics_equal_repeated_rows(spark):
    w = generators.bootstrap_weights(spark.range(500).withColumn("z", F.sin("id") + 1e6), "id", 3)
    assert w.agg(F.sum("w")).first()[0] == 500
    from phasegrid.operators import mstep

    a = mstep.gaussian_stats(w.withColumn("k", F.col("id") % 3), ["k"], ["z"], "w").orderBy("k").collect()
    rep = w.select("*", F.explode(F.sequence(F.lit(1), F.col("w"))).alias("i")) if False else w.where("w > 0").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("w"))).alias("i"))
    b = mstep.gaussian_stats(rep.withColumn("k", F.col("id") % 3), ["k"], ["z"]).orderBy("k").collect()
    for x, y in zip(a, b):
        assert x.w == y.w and abs(x.m_0 - y.m_0) < 1e-6 and abs(x.s_0_0 - y.s_0_0) < 1e-6


def test_whole_grid(spark, tmp_path):
    obs = generators.gaussian_mixture(spark, 90, means=[-3.0, 0.0, 3.0], sds=[0.4] * 3)
    t, ids = paths.local_table(obs, ["z"], [], 0, "id", univariate=True)
    s = paths.Settings([0.2, 0.6], [0.2, 2.0, 4.0, 8.0], 2, 2, 3, 2, loops=60, seed=5)
    grid = bound_grid.fit_bound_grid(spark, t, ids, s)
    table = grid.summary(0.5, 0.5, 0.9)
    assert table.count() == 8 and set(r.fail_reason for r in table.collect()) <= {"ok", "saturation", "stability_or_rsi", "stability_rsi_and_saturation"}
    by_c = {c: sorted((r for r in grid.rows if r["c"] == c), key=lambda r: r["lambda"]) for c in s.bounds}
    for line in by_c.values():
        for a, b in zip(line, line[1:]):
            for own, other in ((a, b), (b, a)):
                if other["final_descent"]:
                    continue  # found after the repairs
                x, y = bound_grid._evaluate(t, grid.labels_of(other["run"]) - 1, own["c"], s)
                assert own["h"] <= x + y / own["lambda"] + 1e-9
    if grid.stop_c is not None:
        assert all(r["c_reused"] == (r["c"] > grid.stop_c) for r in grid.rows)
    part = grid.partition(2.1, 0.55, by_weight=True)
    counts = [r["count"] for r in part.groupBy("cluster").count().orderBy("cluster").collect()]
    assert sum(counts) == 90 and counts == sorted(counts, reverse=True)
    assert grid.zones(stab=0.0, rsi=0.0, sat=1.0).count() == 8
    assert grid.changes().count() == 8
    for r in grid.rows:  # the objective, clusters and saturation are those of the labels, with or without the copies' origin
        own = grid.labels_of(r["run"]) - 1
        a, b = bound_grid._evaluate(t, own, r["c"], s)
        share, n = kernels.saturation(kernels.parameters(t, own, r["c"]))
        assert abs(r["h"] - a - b / r["lambda"]) < 1e-9 and r["reo"] == own.max() + 1 and (abs(r["sat"] - share) < 1e-12, r["n_sat_clusters"]) == (True, n)
        assert r["repaired"] == (r["propagated_from_c"] is not None)
    labels = {r.run: np.asarray(r.labels) for r in grid.labels.collect()}
    pairs = {(a["run"], b["run"]) for a in grid.rows for b in grid.rows}
    assert bound_grid.similarities(grid.labels, pairs) == {(a, b): 1.0 if a == b else linalg.similarity(labels[a], labels[b]) for a, b in pairs}
    grid.save(str(tmp_path / "grid"))
    assert bound_grid.compacted(spark.read.parquet(str(tmp_path / "grid"))).count() == 8
    first = paths.checkpointed(spark, t, s, str(tmp_path / "fits"))
    n = first.count()
    assert paths.checkpointed(spark, t, s, str(tmp_path / "fits")).count() == n == 4 * 4 * 2
    again = bound_grid.fit_bound_grid(spark, t, ids, s)
    assert [r["h"] for r in again.rows] == [r["h"] for r in grid.rows]


def test_stream_scoring(spark, tmp_path):
    path = str(tmp_path / "in")
    df = spark.createDataFrame([(float(i % 7), i) for i in range(60)], "z double, s long").withColumn("ts", F.timestamp_seconds(F.col("s") * 120))
    df.write.parquet(path)
    params = Params(np.array([0.5, 0.5]), np.array([[1.0], [5.0]]), np.array([[[1.0]], [[1.0]]]), np.zeros(2), np.zeros((2, 0, 0)), np.zeros(2, bool), np.zeros(2, bool))
    stream = score.windowed_shares(score.scored(spark.readStream.schema(df.schema).parquet(path), params, ["z"], [], 1.0), "ts")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("shares").start()
    q.processAllAvailable()
    q.stop()
    batch = score.scored(df, params, ["z"], [], 1.0).groupBy("cluster").count().collect()
    got = spark.sql("SELECT cluster, sum(n) AS n FROM shares GROUP BY cluster").collect()
    assert {r.cluster: r.n for r in got} == {r.cluster: r["count"] for r in batch}


def test_sources(spark):
    df = spark.createDataFrame([(1, "b", "x", "1.5"), (2, "a", None, "2"), (3, "b", "a", "4")], "id int, f string, g string, v string")
    coded, levels = features.encoded(df, ["f", "g"])
    assert levels == ["a", "b", "x"] and [(r.f_code, r.g_code) for r in coded.orderBy("id").collect()] == [(1, 2), (0, None), (1, 0)]
    assert [r.v for r in features.numeric(df, ["v"]).orderBy("id").collect()] == [1.5, 2.0, 4.0]
    with pytest.raises(ValueError):
        features.numeric(df, ["f"])
    assert features.complete(df).count() == 2 and len(features.signature(df)) == 64
    assert features.signature(df) == features.signature(df.repartition(3)) != features.signature(df.limit(2))
    mix = generators.gaussian_mixture(spark, 20_000)
    mean = mix.groupBy("component").agg(F.avg("z").alias("m"), F.stddev("z").alias("s")).orderBy("component").collect()
    assert np.allclose([r.m for r in mean], generators.MIXTURE_MEANS, atol=0.1) and np.allclose([r.s for r in mean], [0.2, 1, 0.5, 1, 0.5, 1, 0.2], atol=0.06)
    share = [r.n / 20_000 * 7 for r in mix.groupBy("component").agg(F.count("*").alias("n")).orderBy("component").collect()]
    assert np.allclose(share, [0.5, 2, 0.5, 1, 0.5, 2, 0.5], atol=0.1)
    assert generators.lambda_grid(0.1, 0.5, 0.1) == [0.1, 0.2, 0.3, 0.4, 0.5]
    assert generators.sampled(mix, "id", 100).count() == 100
    shown, names = features.represented(mix.select("id", "z", (F.col("z") * 2 + F.sin("id")).alias("y")), ["z", "y"], "PC2")
    r = shown.agg(F.corr("pc1", "pc2").alias("c"), F.var_samp("pc1").alias("a"), F.var_samp("pc2").alias("b")).first()
    assert names == ["pc1", "pc2"] and abs(r.c) < 1e-6 and r.a > r.b and abs(r.a + r.b - 2) < 1e-6
    assert display.partition_path(shown.withColumn("k", F.lit(1)), ["z", "y"], {0.1: "k", 0.2: "k"}).count() == 40_000


def test_stability_of_labels(spark):
    df = spark.createDataFrame([(i % 2, i % 2, i % 4) for i in range(40)], "a int, b int, c int")
    s = compare.stability(compare.pairwise(df, ["a", "b", "c"], "match"), 3).first()
    assert abs(s["max"] - 1.0) < 1e-12 and abs(s["min"] - 0.5) < 1e-12 and s.medoid == 0
    assert compare.similarity(df, "a", "c").first().similarity == 0.5
    assert [r.x for r in df.select(compare.compressed(df.withColumn("a", F.col("a") * 5 + 3), "a").alias("x")).limit(0).collect()] == []


def test_soft_assignments(spark):
    from phasegrid.operators import starts

    df = spark.range(300).withColumn("phi", starts.random_soft("id", 3))
    more = df.withColumn("e", starts.expanded(F.col("phi"), "id", 3)).withColumn("p", starts.perturbed(F.col("phi"), [0.6, 0.39, 0.01], 300, "id"))
    r = more.first()
    assert len(r.e) == 4 and len(r.p) == 2 and abs(sum(r.e) - 1) < 1e-12 and abs(sum(r.p) - 1) < 1e-12
    hot = df.withColumn("k", starts.hard(F.col("phi"))).withColumn("h", starts.one_hot(F.col("k"), 3))
    assert hot.where(~starts.is_hard(F.col("h")) | starts.is_hard(F.col("phi")) | (F.col("phi")[F.col("k") - 1] < F.array_max("phi"))).count() == 0


def test_em_on_mixed_columns(spark):
    from phasegrid.operators import starts

    obs, levels = features.encoded(generators.mixed_benchmark(spark, 600, 1, 1, 2, 3, seed=8), ["f1"])
    m = starts.Mixture(np.array([0.5, 0.5]), np.array([[-1.0], [1.0]]), np.ones((2, 1)), np.full((2, 1, 3), 1 / 3))
    last = -math.inf
    for _ in range(6):
        m = starts.em_step(obs, m, ["x1"], ["f1_code"], len(levels))
        assert m.log_likelihood >= last - 1e-6
        last = m.log_likelihood
    assert abs(m.weight.sum() - 1) < 1e-9 and np.allclose(m.prob.sum(2), 1)


def test_components_by_icl(spark):
    from phasegrid.plans import icl

    df = generators.gaussian_mixture(spark, 600, means=[-6.0, 6.0], sds=[1.0, 1.0]).select("z", "component", generators.normal(F.col("id"), 77).alias("y"))
    table, rows = icl.icl_path(df, ["z", "y"], [1, 2, 3])
    best = table.orderBy(F.col("icl").desc()).first()
    assert best.g == 2 and compare.similarity(rows, "component", "cluster").first().similarity > 0.99


def test_evolution(spark):
    df = spark.createDataFrame([(float(i), 1 + i // 5, 2 - i // 5) for i in range(10)], "z double, a int, b int")
    rows = display.evolution_1d(df, "z", {0.1: "a", 0.2: "b"})
    assert {(r.z, r.cluster) for r in rows.where("lambda = 0.1").collect()} == {(r.z, r.cluster) for r in rows.where("lambda = 0.2").collect()}
    held = display.evolution_1d(df, "z", {0.1: "a", 0.2: "b", 0.3: "a"}, subset=[0.1])
    assert held.count() == 30


def test_changes_by_all_criteria(spark):
    rows = [(0.1 * (i + 1), f"r{i}", k, n) for i, (k, n) in enumerate([(2, 9), (2, 9), (3, 9), (3, 8), (3, 9), (2, 9)])]
    path = spark.createDataFrame(rows, "lambda double, run string, reo int, n int")
    like = {(f"r{a}", f"r{b}"): 1.0 - 0.15 * abs(a - b) for a in range(6) for b in range(6)}
    flags = lambda **o: [r.change for r in trajectory.detect_changes(path, like, **o).orderBy("lambda").collect()]
    assert flags(criterion="reo") == [True, False, True, False, True]  # the fourth row has fewer rows than most
    assert flags(criterion="similarity") == [True, False, True, True, False]
    assert flags(criterion="reo_and_similarity") == [True, False, True, False, True]
    assert flags(criterion="reo_or_similarity", include_first=False) == [False, False, True, True, True]
    assert flags(criterion="similarity", method="consecutive") == [True, False, False, True, False]
    assert flags(criterion="reo", lambdas=[0.1, 0.2]) == [True, False]
    assert trajectory.detect_changes(path, like, lambdas=[9.0]).collect() == []
    with pytest.raises(ValueError):
        trajectory.detect_changes(path, like, criterion="none")


def test_what_is_shown(spark):
    df = spark.createDataFrame([(i, float(i % 5), "a" if i % 2 else "b", i % 3) for i in range(30)], "id int, x double, f string, cluster int")
    assert display.display_data(None, df.select("x")).columns == ["Z"] and display.display_data(df, None) is df
    with pytest.raises(ValueError):
        display.display_data(None)
    assert display.display_choices(df) == ["PCA1", "PCA2", "id", "x", "cluster"] and display.display_choices(df.select("x")) == ["x"]
    assert display.display_vector(df, "x").where("shown <> x").isEmpty() and display.display_vector(df, "none").where("shown IS NOT NULL").isEmpty()
    assert abs(display.display_vector(df, "PCA1").agg(F.avg("shown")).first()[0]) < 1e-9
    values = [0.1, 0.30000000000000004, 1.0, 10.0, 0.000123456, 2 / 3, 0.0, 1500.0]
    keys = spark.createDataFrame([(v,) for v in values], "v double").select("v", display.lambda_key(F.col("v")).alias("k"), display.lambda_label(F.col("v")).alias("t")).collect()
    assert [r.k for r in keys] == [f"{v:.12g}" for v in values] and keys[5].t == "lambda = 0.6667"
    best = spark.createDataFrame([(0.2, [1, 2, 10]), (0.1, [1, 1, 2]), (0.3, [1, 1])], "lambda double, labels array<int>")
    valid = display.valid_partitions(best, 3)
    assert {r.key for r in valid.collect()} == {"0.1", "0.2"} and display.default_lambda_key(best) == "0.1"
    with pytest.raises(ValueError):
        display.valid_partitions(best, 7)
    assert display.selected_partitions(best, ["0.2"]).count() == 1 and display.selected_partitions(best).count() == 3
    names = lambda d: [r.label for r in d.orderBy("position").collect()]
    assert names(display.cluster_levels(best)) == ["1", "2", "10"] and names(display.single_lambda_clusters(best)) == []
    assert names(display.single_lambda_clusters(display.selected_partitions(best, ["0.2"]))) == ["1", "2", "10"]
    assert names(display.sorted_labels(spark.createDataFrame([("10",), ("9",), ("x",)], "l string"), "l")) == ["10", "9", "x"]
    assert display.filtered_cluster(df).count() == 30 and display.filtered_cluster(df, 1).count() == 10
    params = spark.createDataFrame([("r", 1, [1.0, 2.0])], "run string, k int, mean array<double>")
    assert display.component_means(params, ["x", "y"], "y").first().mean == 2.0 and display.component_means(params, ["x", "y"], "z").isEmpty()
    assert display.shown_lambdas([1, 2, 3, 4, 5], at_most=3) == [1, 3, 5] and display.shown_lambdas([1, 2], [2]) == [2]
    fits = spark.createDataFrame([(0.1, "fixed", 1, 2.0, [1]), (0.1, "boot", 1, 1.0, [2])], "lambda double, task_type string, task_idx int, h double, labels array<int>")
    assert display.best_partitions(fits).first().h == 1.0 and display.best_partitions(best) is best


def test_flexible_rows_and_index_table(spark):
    from phasegrid.operators import starts

    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2.5,)], "v double")
    assert [tuple(r) for r in features.bind_rows([a, b]).collect()] == [(1, "x", None), (None, None, 2.5)] and features.bind_rows([]) is None
    assert a.select(features.safe_column(a, "s").alias("s"), features.safe_column(a, "none", 7).alias("d")).first() == ("x", 7)
    assert starts.index_table(a, "i", 3).count() == 3


def test_runtime_and_families(spark):
    from phasegrid.functions import families
    from phasegrid.plans import runtime

    info = runtime.performance_info(spark)
    assert info["cores"] == spark.sparkContext.defaultParallelism and info["spark"] == spark.version
    assert runtime.default_cores(32, 8) == 8 and runtime.default_cores(3, 8) == 3
    before = spark.conf.get("spark.sql.adaptive.enabled")
    assert runtime.configure(spark, "base").cores == 1 and spark.conf.get("spark.sql.adaptive.enabled") == "false"
    assert "profile fast" in str(runtime.configure(spark, "fast", cores=2)) and spark.conf.get("spark.sql.adaptive.enabled") == "true"
    spark.conf.set("spark.sql.adaptive.enabled", before)
    with pytest.raises(ValueError):
        runtime.configure(spark, "none")
    assert families.names() == ["discreteVector", "gaussAndDiscreteVector", "gaussUniv", "gaussVector"]

    def wide(t, labels, c_bound, c_qual, w):
        p = kernels.parameters(t, labels, c_bound, c_qual, w)
        p.cov[:] = 25.0
        return p

    families.register(families.Family("wide", wide, kernels.log_densities))
    try:
        x = np.concatenate([np.linspace(0, 1, 40), np.linspace(9, 10, 40)])[:, None]
        t = kernels.Table(x, univariate=True, family="wide")
        fit = kernels.descend(t, np.arange(80) // 40, 1.0, 5.0)
        assert (fit.params.cov == 25.0).all() and families.family_of(t).name == "wide"
        assert np.array_equal(families.descend(t, np.arange(80) // 40, 1.0, 5.0).labels, fit.labels)
        with pytest.raises(ValueError):
            families.register(families.Family("wide", wide, kernels.log_densities))
    finally:
        families.unregister("wide")
    with pytest.raises(ValueError):
        families.family("wide")


def test_a_folder_of_other_data_or_settings_is_refused(spark, tmp_path):
    from phasegrid.plans import checkpoints

    t = kernels.Table(np.linspace(0, 1, 30)[:, None], univariate=True)
    s = paths.Settings([0.3], [1.0], 1, 0, 1, 1, 2, loops=5)
    path = str(tmp_path / "fits")
    n = paths.checkpointed(spark, t, s, path).count()
    assert paths.checkpointed(spark, t, s, path).count() == n
    for other_t, other_s in ((kernels.Table(t.x * 2, univariate=True), s), (t, dataclasses.replace(s, shots=2))):
        with pytest.raises(ValueError, match="other data or settings"):
            paths.checkpointed(spark, other_t, other_s, path)
    assert checkpoints.partition_lengths(paths.checkpointed(spark, t, s, path)) == [30]
    with pytest.raises(ValueError, match="30"):
        checkpoints.validate_lengths(paths.checkpointed(spark, t, s, path), 31)
    assert checkpoints.clean_token(0.25) == "0p25" and len(checkpoints.compact_token({"a": 1})) == 16
    assert checkpoints.grid_dir("/x", 9, 1, r0=3) != checkpoints.grid_dir("/x", 9, 1, r0=4)
    assert checkpoints.temp_dir("/x", "s" * 64) == "/x/lambda-grid-" + "s" * 16 and checkpoints.forced_dir("/x/y").startswith("/x/fr_")


def test_bands_over_many_ranges_equal_one_pass(spark):
    r = random.Random(8)
    rows = [(float(r.choice([i, i, 7, 500])), r.choice([1, 1, 1, 2])) for i in range(900)]
    df = spark.createDataFrame(rows, "x double, k int")
    at = {}
    for x, k in rows:
        n, low = at.get(x, (0, k))
        at[x] = (n + 1, min(low, k))
    want = []
    for x in sorted(at):
        n, k = at[x]
        if want and want[-1][0] == k:
            want[-1][2:] = [x, want[-1][3] + n]
        else:
            want.append([k, x, x, n])
    edges = [(a[2] + b[1]) / 2 for a, b in zip(want, want[1:])]
    want = [(k, lo, hi, n) for (k, x0, x1, n), lo, hi in zip(want, [want[0][1], *edges], [*edges, want[-1][2]])]
    for size in (10, 37, 10_000):
        got = sorted((tuple(b) for b in cells.bands(df, "x", "k", size).collect()), key=lambda b: b[1])
        assert got == want, size
    assert cells.bands(df.where("x < 0"), "x", "k").collect() == []
