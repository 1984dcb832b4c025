"""Quantiles, p-values, sketches, samples, growing profiles and models against plain computations in Python."""

import asyncio
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.functions import geo
from veritab.functions.statistics import anderson_sf, chi2_sf, cvm_cdf, cvm_sf, t_ppf
from veritab.ml import detectors
from veritab.operators import anomaly, distribution, drift, quantiles, sketches, strings, timeseries
from veritab.plans import catalogue, incremental
from veritab.plans.checks import run
from veritab.sources import readers
from veritab.streaming import windows

RNG = random.Random(31)
QS = [0, 0.001, 0.1, 0.25, 0.333, 0.5, 0.9, 0.999, 1.0]


def numbers(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} double").repartition(3)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101, 4000])
@pytest.mark.parametrize("span", [1, 5, 10**9])
def test_exact_quantiles(spark, n, span):
    values = [float(RNG.randint(0, span)) for _ in range(n)]
    got = quantiles.exact_quantiles(numbers(spark, [*values, None]), {"a": ("x", QS), "b": (-F.col("x"), [0.5])}, {"n": F.count("*")}).first()
    assert got["a"] == pytest.approx(list(np.quantile(values, QS))) and got["b"] == pytest.approx([-np.quantile(values, 0.5)]) and got["n"] == n + 1


def test_no_values_no_quantiles(spark):
    assert quantiles.exact_quantiles(numbers(spark, [None]), {"a": ("x", QS)}).first()["a"] is None


def test_a_bracket_holds_few_of_many_rows(spark):
    """A value that half of the rows have is counted, not sorted row by row; the plan holds no exact percentile."""
    df = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, 7.0).otherwise((F.col("id") * 7919 % 100_003).cast("double")).alias("x"))
    want = df.agg(F.percentile("x", QS)).first()[0]
    one = quantiles.exact_quantiles(df, {"a": ("x", QS)})
    assert one.first()["a"] == want
    for check in (distribution.outlier("x"), anomaly.mad_anomaly("x"), anomaly.iqr_anomaly("x"), distribution.quantile("x", 0.5)):
        plan = run(df, [check])._jdf.queryExecution().optimizedPlan().toString()
        assert " percentile(" not in plan and "percentile_approx" in plan


def test_sketched_quantiles(spark):
    values = sorted(RNG.gauss(0, 1) for _ in range(20_000))
    parts = numbers(spark, values).withColumn("g", F.col("x") > 0)
    one = quantiles.merged_sketches(quantiles.sketch(parts, "x", group_by=["g"]))
    for r in quantiles.sketch_quantiles(one, [0.05, 0.5, 0.95]).collect():
        assert abs(np.searchsorted(values, r.value) / len(values) - r.q) < 2 * quantiles.rank_error(800)


def test_limiting_distributions():
    """Upper points from published tables."""
    for x, p in ((0.11888, 0.5), (0.34730, 0.9), (0.46136, 0.95), (0.74346, 0.99)):
        assert cvm_cdf(x) == pytest.approx(p, abs=1e-4)
    for x, p in ((0.774, 0.5), (1.933, 0.9), (2.492, 0.95), (3.857, 0.99)):
        assert 1 - anderson_sf(x) == pytest.approx(p, abs=5e-4)
    assert cvm_sf(0.05, 1000, 1000) > 0.8 > 0.05 > cvm_sf(0.6, 1000, 1000)


@pytest.mark.parametrize("method", ["ks", "cvm", "anderson"])
def test_p_values_of_equal_and_shifted_samples(spark, method):
    """Under no change, p-values are about uniform: few are small."""
    rng = np.random.default_rng(5)
    ps = []
    for _ in range(6):
        a, b = (numbers(spark, rng.normal(0, 1, 300).tolist()) for _ in range(2))
        ps.append(drift._statistic(a, b, "x", method, False).first()["p"])
    assert sum(p < 0.05 for p in ps) <= 2 and max(ps) > 0.3
    moved = drift._statistic(numbers(spark, rng.normal(0.5, 1, 300).tolist()), numbers(spark, rng.normal(0, 1, 300).tolist()), "x", method, False).first()
    assert moved["p"] < 0.001


def test_p_value_of_chi_squared(spark):
    a = spark.createDataFrame([("u",)] * 60 + [("v",)] * 40, "c string")
    b = spark.createDataFrame([("u",)] * 55 + [("v",)] * 45, "c string")
    p = drift._statistic(a, b, "c", "chi2", True).first()["p"]
    assert p == pytest.approx(chi2_sf(25 / 55 + 25 / 45, 1)) and 0.3 < p < 0.33
    assert drift.compare(b, a, method="chi2", threshold=0.5).first()["drifted"] and not drift.compare(b, a, method="chi2").first()["drifted"]


def test_named_ranges_and_addresses(spark):
    df = spark.createDataFrame([(6.0, "10.0.0.099"), (4.0, "1.2.3.256"), (5.0, "01.02.03.04")], "rating double, ip string")
    assert run(df, [distribution.named_range("rating")]).first()["n_bad"] == 1
    assert run(df, [strings.ip_address("ip")]).first()["n_bad"] == 1


def test_count_min(spark):
    values = [min(int(RNG.paretovariate(1)), 500) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v int")
    halves = [sketches.count_min(df.where(f"v % 2 = {i}"), "v", 0.01) for i in (0, 1)]
    found = {r.v: r.n for r in sketches.count_min_estimates(sketches.count_min_merged(*halves), df.where("v is not null"), "v", 0.01).collect()}
    true = {v: values.count(v) for v in set(values)}
    assert all(found[v] >= n for v, n in true.items()) and np.mean([found[v] <= n + 0.01 * len(values) for v, n in true.items()]) > 0.99
    heavy = {r.v: r.n for r in sketches.heavy_hitters(df, "v", 0.05, 0.01).collect()}
    assert heavy == {v: n for v, n in true.items() if n >= 0.05 * len(values)}


def test_bloom(spark):
    df = spark.range(2000).select(F.col("id").alias("v"))
    both = sketches.bloom_merged(sketches.bloom(df.where("v < 900"), "v", 2000), sketches.bloom(df.where("v between 900 and 999"), "v", 2000))
    kept = {r.v for r in sketches.might_contain(both, df, "v", 2000).collect()}
    assert set(range(1000)) <= kept and len(kept) < 1000 + 50


def test_samples_are_the_same_however_dealt(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("g"))
    for f in (lambda d: sketches.sample_share(d, 0.1, ["id"]), lambda d: sketches.sample_rows(d, 40, ["id"]), lambda d: sketches.sample_blocks(d, 0.2, "id", 50), lambda d: sketches.sample_strata(d, "g", 9, ["id"])):
        one, two = ({r.id for r in f(df.repartition(n)).collect()} for n in (1, 7))
        assert one == two and 0 < len(one) < 3000
    assert 200 < sketches.sample_share(df, 0.1, ["id"]).count() < 400
    state = None
    for i in range(5):
        state = sketches.reservoir(state, df.where(f"id % 5 = {i}"), 40, ["id"])
    assert {r.id for r in state.collect()} == {r.id for r in sketches.sample_rows(df, 40, ["id"]).collect()}


def test_profiles_grow(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id") * 1.5).alias("x"), F.concat(F.lit("t"), F.col("id") % 50).alias("s"))
    parts = [incremental.state(df.where(f"s like '%{i}'")) for i in range(10)]
    got = {r.column_name: r for r in incremental.finished(incremental.merged(*parts)).collect()}
    xs = [i * 1.5 for i in range(1000) if i % 10]
    assert (got["x"].n_rows, got["x"].n_null, got["x"].low, got["x"].high) == (1000, 100, min(xs), max(xs))
    assert got["x"].mean == pytest.approx(np.mean(xs)) and got["x"].std == pytest.approx(np.std(xs, ddof=1)) and got["x"].median == pytest.approx(np.median(xs), rel=0.05)
    assert got["s"].n_distinct == pytest.approx(50, abs=2) and got["s"].high == 3


def test_covariance_by_updates():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 3))
    one = incremental.Covariance(100, x[:100].mean(axis=0), np.cov(x[:100].T))
    for a in range(100, 300, 20):
        one.update(x[a : a + 20])
    one.merge(100, x[300:].mean(axis=0), np.cov(x[300:].T))
    assert np.allclose(one.covariance, np.cov(x.T)) and np.allclose(one.inverse, np.linalg.inv(np.cov(x.T))) and np.allclose(one.mean, x.mean(axis=0))


def haversine(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(h, 1)))


def test_nearest_points_without_a_radius(spark):
    points = [(i, RNG.uniform(-90, 90), RNG.uniform(-180, 180)) for i in range(60)] + [(100, 0.0, -179.95), (101, 89.9, 10.0), (102, -89.9, -60.0)]
    queries = [(0, 0.0, 179.95), (1, 89.9, -170.0), (2, -89.8, 120.0), (3, 40.0, 5.0), (4, -55.0, -179.0), (5, None, 1.0)]
    a = spark.createDataFrame(queries, "q int, lat double, lon double")
    b = spark.createDataFrame(points, "p int, lat double, lon double")
    got = sorted((r.q, r.place, r.p) for r in geo.k_nearest(a, b, "q", "p", "lat", "lon", 4).collect())
    want = []
    for q, lat, lon in queries[:-1]:
        order = sorted(points, key=lambda p: (haversine((lat, lon), p[1:]), p[0]))
        want += [(q, i + 1, p[0]) for i, p in enumerate(order[:4])]
    assert got == sorted(want)
    near = geo.nearest(a.where("q = 0"), b, "q", "p", "lat", "lon", 50.0).collect()
    assert [(r.q, r.p) for r in near] == [(0, 100)]
    assert geo.pairwise_distances(a.where("lat is not null"), b, "q", "p", "lat", "lon").count() == 5 * len(points)


def test_distances_of_rows_that_share_locations(spark, monkeypatch, tmp_path):
    queries = [(0, 10.0, 20.0), (1, 10.0, 20.0), (1, -30.0, 179.0), (2, None, 5.0), (3, 90.0, 0.0)]
    points = [(1.0, 2.0), (1.0, 2.0), (1.0, 2.0), (-80.0, -179.5), (0.0, None), (-10.0, -160.0), (90.0, 0.0)]
    got = geo.distance_summary(spark.createDataFrame(queries, "id int, lat double, lon double"), spark.createDataFrame(points, "lat double, lon double"), "id", "lat", "lon")
    for r in got.collect():
        met = [(q[1:], p) for q in queries if q[0] == r.id for p in points]
        known = [haversine(q, p) for q, p in met if None not in (*q, *p)]
        assert r.n == len(met) and (r.mean, r.farthest) == ((pytest.approx(np.mean(known)), pytest.approx(max(known))) if known else (None, None))
    assert got.count() == 4 and geo.distance_summary(spark.createDataFrame(queries, "id int, lat double, lon double"), spark.createDataFrame([], "lat double, lon double"), "id", "lat", "lon").count() == 0

    spark.range(7200).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")  # 361 locations at most
    met, every = [], geo.pairwise_distances
    monkeypatch.setattr(geo, "pairwise_distances", lambda *a, **b: met.append(out := every(*a, **b)) or out)
    found = catalogue.queries()["pairwise_distances"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(duck.execute(catalogue.oracle_sql()["pairwise_distances"]).fetchall())
    assert met[0].count() <= 361 * 361


def test_grubbs(spark):
    values = [RNG.gauss(0, 1) for _ in range(60)] + [9.0, -7.0, 8.0]
    left, found = list(values), 0
    while len(left) >= 3 and found < 10:
        mean, s, n = np.mean(left), np.std(left, ddof=1), len(left)
        far = max(left, key=lambda v: abs(v - mean))
        t = t_ppf(1 - 0.05 / (2 * n), n - 2)
        if abs(far - mean) / s <= (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t)):
            break
        left.remove(far)
        found += 1
    assert found >= 3 and run(numbers(spark, values), [anomaly.grubbs_test("x")]).first()["n_bad"] == found


def test_multivariate_outliers(spark):
    rng = np.random.default_rng(8)
    x = rng.multivariate_normal([0, 0, 0], [[1, 0.8, 0], [0.8, 1, 0], [0, 0, 1]], 600)
    x[:12] += 12
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    rest = z @ vectors[:, np.argsort(values)[::-1][2:]]
    error = (rest**2).sum(axis=1)
    assert run(df, [anomaly.pca_anomaly(n_components=2)]).first()["n_bad"] == (error > np.quantile(error, 0.95)).sum()
    plain = run(df, [anomaly.mahalanobis()]).first()["n_bad"]
    mean, inverse = x.mean(axis=0), np.linalg.inv(np.cov(x.T))
    assert plain == ((np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)) > 9.348403604496148).sum()
    robust = run(df, [anomaly.mahalanobis(robust=True)]).first()["n_bad"]
    assert robust >= 12 and robust < 60
    assert run(df, [anomaly.elliptic_envelope(contamination=0.05)]).first()["n_bad"] == 30


def test_one_class_machine(spark):
    rng = np.random.default_rng(9)
    around = np.linspace(0, 2 * np.pi, 10, endpoint=False)
    x = np.vstack([rng.normal(0, 1, (500, 2)), 7 * np.column_stack([np.cos(around), np.sin(around)])])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double")
    found = {r.id for r in detectors.flagged(detectors.OneClassSvm(["a", "b"], nu=0.05), df, "id").collect()}
    assert set(range(500, 510)) <= found and len(found) < 60


def test_concept_drift(spark):
    def follow(errors):
        low, state, at = (math.inf, math.inf), "stable", None
        total = 0
        for n, e in enumerate(errors, 1):
            total += e
            p = total / n
            s = math.sqrt(p * (1 - p) / n)
            if n >= 30:
                if p + s < sum(low):
                    low = (p, s)
                if state != "drift" and p + s > low[0] + 3 * low[1]:
                    state, at = "drift", n - 1
                elif state == "stable" and p + s > low[0] + 2 * low[1]:
                    state = "warning"
        return len(errors), state, at

    streams = {"steady": [int(RNG.random() < 0.2) for _ in range(300)], "worse": [int(RNG.random() < (0.1 if i < 150 else 0.6)) for i in range(300)], "short": [1, 0, 1]}
    rows = [(g, i, e) for g, es in streams.items() for i, e in enumerate(es)]
    got = detectors.concept_drift(spark.createDataFrame(rows, "g string, i int, e int").repartition(4), "g", "i", "e").collect()
    assert {r.g: (r.n, r.state, r["at"]) for r in got} == {g: follow(es) for g, es in streams.items()}


def test_series_in_blocks(spark, monkeypatch):
    """A series cut into many blocks gives what it gives in one."""
    monkeypatch.setattr(timeseries, "BLOCK", 8)
    x = [math.sin(i / 5) + 0.01 * i + RNG.random() for i in range(300)]
    series = spark.createDataFrame(list(enumerate(x)), "i long, x double").repartition(5)
    flat = np.array(x) - np.polyval(np.polyfit(range(300), x, 1), range(300))
    flat -= flat.mean()
    got = {r.lag: r.acf for r in timeseries.autocorrelation(series, [1, 7, 40]).collect()}
    assert got == pytest.approx({k: float((flat[:-k] * flat[k:]).sum() / (flat**2).sum()) for k in (1, 7, 40)})
    trend = {r.i: r.trend for r in timeseries.moving_average(series, 7).collect()}
    assert trend == pytest.approx({i: float(np.mean(x[i - 3 : i + 4])) for i in range(3, 297)})
    timed = spark.createDataFrame([(i, 1.0 + (i >= 100) * 2 + (i >= 220) * 3 + 0.001 * (i % 3)) for i in range(300)], "t long, v double")
    broken = run(timed.selectExpr("timestamp_seconds(t) AS t", "v"), [timeseries.trend_break("t", "v", 0.5, 10)]).first()
    assert broken["n_bad"] == 2


def test_small_helpers(spark):
    texts = spark.createDataFrame([('{"a": 1}',)] * 1500 + [('{"a": 1, "late": "x"}',)], "j string")
    assert readers.document_schema(texts, "j") == "struct<a:bigint,late:string>"
    assert asyncio.run(readers.asynchronous(lambda: spark.range(3).count())()) == 3
    with pytest.raises(ValueError):
        readers.to_numpy(spark.range(10), max_rows=5)
    with pytest.raises(ValueError):
        readers.MemoryStore(max_rows=2).save(spark.range(5), "run")
    windows.state_store(spark, "rocksdb")
    assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    windows.state_store(spark, "memory")
