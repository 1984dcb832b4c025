"""Meaning of single checks on small tables: severities, nulls, ties and empty tables."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab import issues, learn, load, mask, profile, run, scan, suite
from veritab.functions import checksums, geo, statistics
from veritab.ml import detectors
from veritab.operators import aggregate, anomaly, completeness, dates, distribution, drift, geospatial, multi_column, privacy, profiling, queries, referential, schemas, strings, timeseries, uniqueness
from veritab.plans import catalogue, sdk
from veritab.plans.checks import RESULT
from veritab.plans.profile import compare_profiles, functional_dependencies


def one(df, check):
    return run(df, [check]).first()


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


@pytest.mark.parametrize(("nulls", "level"), [(0, None), (1, "medium"), (3, "critical")])
def test_null_severity(spark, nulls, level):
    row = one(frame(spark, [None] * nulls + [1.0] * (5 - nulls)), completeness.null())
    assert (row.n_bad, row.n_rows, row.severity) == (nulls, 5, level)


def test_mostly_and_override(spark):
    df = frame(spark, [None, 1.0, 2.0, 3.0])
    assert one(df, completeness.null().with_mostly(0.75)).severity is None
    assert one(df, completeness.null().with_mostly(0.76)).severity == "high"
    assert one(df, completeness.null().with_severity("low")).severity == "low"


def test_one_aggregation_answers_a_suite(spark):
    df = spark.range(100).withColumn("y", F.col("id") * 2)
    out = run(df, [completeness.null(), distribution.between("y", 0, 50), aggregate.mean_between("id", 0, 10), strings.length()])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and "Window" not in plan
    assert out.count() == 4


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, s string, t timestamp")
    checks = [completeness.null(), uniqueness.unique(), uniqueness.duplicate(), distribution.outlier("x"), strings.email("s"), dates.past_date("t"), profiling.entropy("s"), timeseries.timeseries_gap("t"), anomaly.iqr_anomaly("x"), schemas.row_count(0)]
    assert run(df, checks).where("severity is not null").count() == 0
    assert run(df, []).schema.simpleString().startswith("struct<check_name:string")
    assert one(df, schemas.table_not_empty()).severity == "critical"
    assert RESULT.startswith("check_name")


def test_least_severity(spark):
    df = frame(spark, [None, 1.0, 2.0, 3.0, 4.0])
    assert issues(df, [completeness.null()], "medium").count() == 1
    assert issues(df, [completeness.null()], "high").count() == 0


def test_duplicates_count_all_copies_or_the_surplus(spark):
    df = frame(spark, [1.0, 1.0, 1.0, 2.0, None, None])
    assert one(df, uniqueness.duplicate(["x"])).n_bad == 5
    assert uniqueness.count_duplicates(df, ["x"]).first().surplus == 3
    assert one(df, uniqueness.unique("x")).n_bad == 2


def test_regex_anchors_hold_the_last_line_break(spark):
    assert one(frame(spark, ["1\n", "1"], "string"), strings.regex("1")).n_bad == 1


def test_order_needs_no_single_task(spark):
    rng = np.random.default_rng(0)
    values = rng.normal(size=500).round(3).tolist()
    df = spark.createDataFrame(list(enumerate(values)), "i long, x double").repartition(7)
    assert one(df, distribution.increasing("x", ["i"])).n_bad == int((np.diff(values) < 0).sum())
    placed = sorted(timeseries.numbered(df, ["i"], "place").select("i", "place").collect())
    assert all(r.i == r.place for r in placed)


def test_ks_and_wasserstein_against_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=300).round(2), rng.normal(0.3, 1, size=400).round(2)
    left, right = frame(spark, a.tolist()), frame(spark, b.tolist())
    xs = np.unique(np.concatenate([a, b]))
    f, g = np.searchsorted(np.sort(a), xs, "right") / len(a), np.searchsorted(np.sort(b), xs, "right") / len(b)
    assert drift.ks_statistic(left, right, "x").first().d == pytest.approx(np.abs(f - g).max())
    row = one(left, drift.wasserstein_drift("x", right, 0.1))
    assert row.actual == pytest.approx((np.abs(f - g)[:-1] * np.diff(xs)).sum(), abs=1e-4)
    assert one(left, drift.psi("x", left)).actual == 0


def test_all_drift_methods_agree_that_nothing_changed(spark):
    df = spark.range(200).select((F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("c"))
    for method in drift.THRESHOLDS:
        assert not any(r.drifted for r in drift.compare(df, df, method=method).collect()), method


def test_chi_square_and_special_functions():
    assert statistics.chi2_ppf(0.975, 3) == pytest.approx(9.3484, abs=1e-3)
    assert statistics.t_ppf(0.975, 10) == pytest.approx(2.22814, abs=1e-4)
    assert statistics.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)


def test_grubbs(spark):
    df = frame(spark, [*np.linspace(-1, 1, 30).tolist(), 50.0, -40.0])
    assert one(df, anomaly.grubbs_test("x", max_anomaly_ratio=0.0)).n_bad == 2


def test_hierarchy(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (7, 8), (8, 7), (9, 7), (10, 99)], "id int, up int")
    depths = {r.id: r.depth for r in referential.ancestors(df, "id", "up", 64).collect()}
    assert depths == {"1": 0, "2": 1, "3": 2, "4": 3, "7": -1, "8": -1, "9": -1, "10": 0}
    assert one(df, referential.hierarchy_circular("id", "up")).n_bad == 3


def test_graph_of_tables():
    assert referential.strong_components({"a": ["b"], "b": ["a"], "c": ["a"]}) == [["a", "b"], ["c"]]
    assert referential.topological_order({"a": ["b"], "b": []}) == ["b", "a"]


def test_orphans_and_null_keys(spark):
    child = spark.createDataFrame([(1, 1), (2, 99), (3, None)], "id int, k int")
    parent = spark.createDataFrame([(1,), (2,)], "k int")
    assert one(child, referential.foreign_key(["k"], parent, ["k"])).n_bad == 1
    assert one(child, referential.foreign_key(["k"], parent, ["k"], allow_null=False)).n_bad == 2


@pytest.mark.parametrize(
    ("f", "good", "bad"),
    [
        (checksums.luhn, "4539148803436467", "4539148803436468"),
        (checksums.isbn, "978-3-16-148410-0", "9783161484101"),
        (checksums.isbn, "080442957X", "0804429570"),
        (checksums.iban, "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765431"),
        (checksums.chinese_id, "11010519491231002X", "110105194912310021"),
        (checksums.vat, "GR123456789", "XX1"),
        (checksums.my_number, "123456789018", "123456789012"),
        (checksums.card, "4539 1488 0343 6467", "9999 9999 9999 9995"),
    ],
)
def test_check_digits(spark, f, good, bad):
    assert [r.ok for r in frame(spark, [good, bad, None, "", "x"], "string").select(f(F.col("x")).alias("ok")).collect()][:3] == [True, False, None]


def test_scan_and_mask(spark):
    df = spark.createDataFrame([("a@b.org", "123-45-6789"), ("c@d.org", "987-65-4321")], "mail string, ssn string")
    assert {r.column_name: r.kind for r in scan(df).collect()} == {"mail": "email", "ssn": "us_ssn"}
    assert mask(df).first().asDict() == {"mail": "*@*.***", "ssn": "***-**-****"}
    assert mask(df, ["mail"], "hash").first().mail != "a@b.org"
    assert mask(df, ["ssn"], "fake").first().ssn.count("-") == 2
    with pytest.raises(ValueError, match="no such columns"):
        mask(df, ["nope"], strict=True)
    assert one(df, privacy.gdpr_compliance()).severity is not None


def test_learned_suite_passes_its_own_table(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", 2.5), (3, "a", 9.0)], "id int, s string, x double")
    assert learn(df)["s"]["allowed"] == ["a", "b"]
    assert issues(df, suite(df)).count() == 0
    assert run(df, [schemas.schema_contract(learn(df))]).where("severity is not null").count() == 0
    assert {r.column_name: r.n_distinct for r in profile(df).collect()} == {"id": 3, "s": 2, "x": 3}
    assert not any(r.drifted for r in compare_profiles(profile(df), profile(df)).collect())
    assert functional_dependencies(df, [("id", "s"), ("s", "id")]).count() == 1


def test_json_schema_and_row_level(spark):
    df = frame(spark, ['{"a": 1}', '{"a": "x"}', "no", None], "string")
    assert one(df, strings.json_schema("x", {"required": ["a"], "properties": {"a": {"type": "integer"}}})).n_bad == 2
    assert one(df, strings.json_parseable()).n_bad == 1
    assert one(df, queries.row_level(lambda r: len(r["x"]) > 2)).n_bad == 2


def test_polygon_without_its_edge(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (5.0, 5.0)], "lat double, lon double")
    assert one(df, geospatial.polygon("lat", "lon", "POLYGON((0 0, 2 0, 2 2, 0 2))")).n_bad == 2


def test_zero_division_and_null_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0), (4.0, 2.0), (None, 1.0)], "a double, b double")
    assert one(df, multi_column.column_ratio(["a", "b"], max_value=1.0)).n_bad == 1
    assert one(df, multi_column.column_ratio(["a", "b"], max_value=9.0, handle_zero_division="fail")).n_bad == 1
    assert one(df, multi_column.column_coexistence(["a", "b"])).n_bad == 1


def test_clock(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "t timestamp")
    assert one(df, dates.recent_data("t", 24, dt.datetime(2024, 1, 2))).severity is None
    assert one(df, dates.recent_data("t", 24, dt.datetime(2024, 1, 3, 1))).severity == "critical"
    assert one(df, dates.timezone("t", "Asia/Seoul")).issue == "unexpected_timezone"


def test_isolation_forest_and_ensemble(spark):
    rng = np.random.default_rng(3)
    points = [(int(i), float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(400, 2)))] + [(999, 9.0, 9.0)]
    df = spark.createDataFrame(points, "id int, x double, y double")
    assert 999 in [r.id for r in detectors.flagged(detectors.IsolationForest(["x", "y"]), df, "id").collect()]
    assert [r.id for r in detectors.flagged(detectors.Ensemble([detectors.ZScore("x"), detectors.Iqr("x", 3.0)], "unanimous"), df, "id").collect()] == [999]


def test_concept_drift(spark):
    errors = [0] * 200 + [1] * 100
    df = spark.createDataFrame([("s", i, e) for i, e in enumerate(errors)], "g string, i long, e int")
    row = detectors.concept_drift(df, "g", "i", "e").first()
    assert row.state == "drift" and 200 <= row["at"] <= 215


def test_registry_builder_and_hooks(spark):
    @sdk.register("mine")
    def mine():
        return sdk.simple_range("mine", 0)

    assert len(sdk.registry()) > 200 and "mine" in sdk.registry()
    df, seen = frame(spark, [1.0, -1.0]), []
    hooks = sdk.Hooks()
    hooks.after.append(lambda out: seen.append(out.count()))
    hooks.run(df, [sdk.registry()["mine"]()])
    assert seen == [1]
    built = sdk.CheckBuilder("mean").column("x").aggregate(F.avg, lambda v: v < 1).build()
    assert one(df, built).n_bad == 1


def test_load(spark, tmp_path):
    assert load(spark, {"a": [1, 2]}).count() == 2
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": 2}]')
    assert load(spark, str(tmp_path / "x.json")).count() == 2
    (tmp_path / "x.csv").write_text("a,b\n1,x\n")
    assert load(spark, str(tmp_path / "x.csv")).first().a == 1
    with pytest.raises(TypeError):
        load(spark, 3)


def test_mmd_uses_all_rows(spark):
    """Against brute force over all pairs: a hot value, few values, values far apart, and one value of the reference."""

    def brute(a, b):
        s = max(np.std(b), 1e-9)
        mean = lambda x, y: np.exp(-(((x[:, None] - y[None]) / s) ** 2) / 2).mean()
        return max(mean(a, a) + mean(b, b) - 2 * mean(a, b), 0.0)

    rng = np.random.default_rng(5)
    cases = [
        (np.repeat([0.0, 1.0, 2.0], [1100, 1100, 2000]), np.repeat([0.0, 1.0, 2.0], [2000, 1100, 1100])),
        (np.concatenate([np.full(1500, 3.0), rng.normal(8, 1, 1500)]), np.concatenate([np.full(1500, 3.0), rng.normal(2, 1, 1500)])),
        (np.concatenate([rng.normal(size=500), [1e6, -1e9]]), np.concatenate([rng.standard_cauchy(700), [1e6]])),
        (np.array([5.0, 5.0, 6.0]), np.array([5.0, 5.0])),
    ]
    for a, b in cases:
        got = drift._statistic(frame(spark, a.tolist()), frame(spark, b.tolist()), "x", "mmd", False).first().value
        assert got == pytest.approx(brute(a, b), abs=1e-8)


def test_local_outlier_factor_among_all_rows(spark, monkeypatch):
    """A small cluster far from 2,400 other rows, copies of one row and a lone row, against brute force; several blocks."""
    monkeypatch.setattr(detectors, "BLOCK_ROWS", 700, raising=False)
    rng = np.random.default_rng(11)
    points = np.concatenate([rng.normal(size=(2400, 3)), rng.normal(30, 0.1, (12, 3)), np.full((40, 3), 9.0), [[60.0, 0.0, 0.0]]]).astype(np.float32).astype(float)
    k = 5
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    own = np.take_along_axis(d, near, 1)
    density = 1 / np.maximum(np.maximum(own, own[:, -1][near]).mean(1), 1e-12)
    wanted = density[near].mean(1) / density
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id int, v array<float>")
    got = {r.id: r.lof for r in detectors.local_outlier_factor(df, "id", "v", k).collect()}
    assert len(got) == len(points)
    assert np.array([got[i] for i in range(len(points))]) == pytest.approx(wanted, rel=1e-5, abs=1e-5)
    assert max(got[i] for i in range(2400, 2412)) < 3 < got[2452]


@pytest.mark.parametrize("km", [60.0, 700.0, 2000.0, 9000.0])
def test_nearest_meets_all_pairs(spark, km):
    """Against all pairs, with pairs across 180 degrees, by and across the poles, and several points in one place."""
    rng = np.random.default_rng(17)
    at = [(-11.0, -169.0), (1.0, 179.0), (0.0, 180.0), (0.0, -180.0), (89.9, 10.0), (89.8, -170.0), (-89.9, 0.0), (-90.0, 90.0), (60.0, 0.0), (75.0, 38.0), (75.0, 38.0), (75.0, 38.0)]
    at += list(zip(np.degrees(np.arcsin(rng.uniform(-1, 1, 250))).tolist(), rng.uniform(-180, 180, 250).tolist(), strict=True))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "id int, lat double, lon double")
    other = df.select(F.col("id").alias("pid"), "lat", "lon")
    pairs = df.crossJoin(other.toDF("pid", "lat2", "lon2")).withColumn("d", geo.haversine(*map(F.col, ("lat", "lon", "lat2", "lon2")))).where(F.col("d") <= km)
    for k in (2, len(at)):
        wanted = {(r.id, r.pid) for q in pairs.toPandas().sort_values(["d", "pid"]).groupby("id") for r in q[1].head(k).itertuples()}
        assert {(r.id, r.pid) for r in geo.nearest(df, other, "id", "pid", "lat", "lon", km, k).collect()} == wanted


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_hierarchy_depths_of_whole_tree(spark):
    """The registered query has every node; those in or under a circle (ids ending in 50 and 51, and their descendants) are -1, others count all their ancestors."""
    tree = {r.id: r.parent for r in catalogue.Tables(spark, "/root/testdata/sf0.001")["tree"].collect()}

    def depth(node):
        way = [node]
        while tree.get(way[-1]) in tree:
            way.append(tree[way[-1]])
            if len(way) > 65:
                return -1
        return len(way) - 1

    got = {int(r.id): r.depth for r in catalogue.queries()["hierarchy_depths"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {node: depth(node) for node in tree}
    assert got[50] == got[51] == got[100] == -1 and got[52] == 5


def test_isolation_forest_samples_rows_not_values(spark):
    """A combination of values that fills more than the sample doesn't fill it wholly, and isn't left out of it, wherever its hash puts it."""
    rng = np.random.default_rng(4)
    others = spark.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(15000, 2)))], "id int, x double, y double")
    lone = spark.createDataFrame([(-1, 9.0, 9.0)], "id int, x double, y double")
    first, last = (others.orderBy(F.xxhash64("x", "y") if up else F.xxhash64("x", "y").desc()).first() for up in (True, False))
    for hot in (first, last):
        df = others.union(lone).union(spark.range(15000).select(F.col("id").cast("int") + 20000, F.lit(hot.x), F.lit(hot.y)))
        found = {r.id for r in detectors.flagged(detectors.IsolationForest(["x", "y"]), df, "id").collect()}
        assert -1 in found and not any(i >= 20000 for i in found)
