"""Models that are fitted once and score rows: fences, forests, ensembles, neighbours, and drift of streams of errors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.quantiles import exact_quantiles
from ..plans.checks import rows
from ..plans.lineage import cut


@dataclass
class Detector:
    """``fit`` learns from a table; ``score`` is then a column, anomalous above ``cut``."""

    cut: float = field(default=1.0, init=False)

    def fit(self, df: DataFrame) -> Detector:
        raise NotImplementedError

    def score(self) -> Column:
        raise NotImplementedError


@dataclass
class ZScore(Detector):
    column: str
    threshold: float = 3.0

    def fit(self, df: DataFrame) -> ZScore:
        self.mean, self.std = df.agg(F.avg(self.column), F.stddev_samp(self.column)).first()
        self.cut = self.threshold
        return self

    def score(self) -> Column:
        return F.abs(F.col(self.column) - F.lit(self.mean)) / F.lit(self.std or 1.0)


@dataclass
class Iqr(Detector):
    column: str
    multiplier: float = 1.5

    def fit(self, df: DataFrame) -> Iqr:
        self.q1, self.q3 = exact_quantiles(df, {"q": (self.column, [0.25, 0.75])}).first()[0]
        self.cut = self.multiplier
        return self

    def score(self) -> Column:
        """Distance beyond the quartiles, in interquartile ranges."""
        x = F.col(self.column)
        return F.greatest(F.lit(self.q1) - x, x - F.lit(self.q3), F.lit(0.0)) / F.lit((self.q3 - self.q1) or 1.0)


@dataclass
class Mad(Detector):
    column: str
    threshold: float = 3.5

    def fit(self, df: DataFrame) -> Mad:
        self.median = exact_quantiles(df, {"q": (self.column, [0.5])}).first()[0][0]
        self.mad = exact_quantiles(df, {"q": (F.abs(F.col(self.column) - F.lit(self.median)), [0.5])}).first()[0][0]
        self.cut = self.threshold
        return self

    def score(self) -> Column:
        return 0.6745 * F.abs(F.col(self.column) - F.lit(self.median)) / F.lit(self.mad or 1.0)


def _path_length(n: float) -> float:
    """The mean length of a failing search among ``n`` points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class IsolationForest(Detector):
    """Random trees over a bounded sample of ``trees * size`` rows, each row with the same chance whatever its values; scores are made by an Arrow-batched function with the trees as arrays."""

    columns: Sequence[str]
    trees: int = 50
    size: int = 256
    threshold: float = 0.6
    seed: int = 42

    def fit(self, df: DataFrame) -> IsolationForest:
        clean = df.select(*[F.col(c).cast("double").alias(c) for c in self.columns]).dropna()
        sample = clean.orderBy(F.rand(self.seed)).limit(self.trees * self.size).toPandas().to_numpy()
        rng = np.random.default_rng(self.seed)
        self.forest = [self._grow(sample[rng.choice(len(sample), min(self.size, len(sample)), replace=False)], rng) for _ in range(self.trees)] if len(sample) else []
        self.cut = self.threshold
        return self

    def _grow(self, points: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
        """Nodes (feature or -1, split, left, right, path length at a leaf)."""
        deepest = math.ceil(math.log2(max(len(points), 2)))
        nodes: list[tuple[int, float, int, int, float]] = []

        def build(rows_: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append((-1, 0.0, 0, 0, depth + _path_length(len(rows_))))
            wide = [f for f in range(rows_.shape[1]) if len(rows_) > 1 and rows_[:, f].min() < rows_[:, f].max()]
            if depth < deepest and wide:
                f = int(rng.choice(wide))
                split = float(rng.uniform(rows_[:, f].min(), rows_[:, f].max()))
                below = rows_[:, f] < split
                nodes[at] = (f, split, build(rows_[below], depth + 1), build(rows_[~below], depth + 1), 0.0)
            return at

        build(points, 0)
        return nodes

    def score(self) -> Column:
        forest, usual = self.forest, _path_length(self.size)

        @F.pandas_udf("double")
        def isolated(values: pd.DataFrame) -> pd.Series:
            points = values.to_numpy(float)
            total = np.zeros(len(points))
            for nodes in forest:
                table = np.array(nodes)
                at = np.zeros(len(points), int)
                while (inner := table[at, 0] >= 0).any():
                    i = np.flatnonzero(inner)
                    node = table[at[i]]
                    at[i] = np.where(points[i, node[:, 0].astype(int)] < node[:, 1], node[:, 2], node[:, 3]).astype(int)
                total += table[at, 4]
            return pd.Series(2.0 ** (-(total / max(len(forest), 1)) / usual))

        return isolated(F.struct(*[F.col(c).cast("double").alias(c) for c in self.columns]))


@dataclass
class Ensemble(Detector):
    """Several detectors: ``average``, ``max`` or ``min`` of their scores over their cuts, ``vote`` (over half flag the row) or ``unanimous``."""

    detectors: Sequence[Detector]
    how: str = "average"

    def fit(self, df: DataFrame) -> Ensemble:
        for d in self.detectors:
            d.fit(df)
        self.cut = {"vote": 0.5, "unanimous": 1 - 1e-9}.get(self.how, 1.0)
        return self

    def score(self) -> Column:
        shares = [d.score() / d.cut for d in self.detectors]
        votes = [(s > 1).cast("double") for s in shares]
        mean = (lambda xs: reduce(lambda a, b: a + b, xs) / len(xs))
        return {"average": lambda: mean(shares), "max": lambda: F.greatest(*shares), "min": lambda: F.least(*shares), "vote": lambda: mean(votes), "unanimous": lambda: mean(votes)}[self.how]()


def flagged(detector: Detector, df: DataFrame, id_column: str) -> DataFrame:
    """Ids of the rows that a detector fitted on ``df`` finds anomalous."""
    detector.fit(df)
    return df.where(detector.score() > detector.cut).select(id_column)


def concept_drift(df: DataFrame, group: str, order: str, error: str, method: str = "ddm", warn: float = 2.0, drift: float = 3.0, delta: float = 0.005, limit: float = 50.0) -> DataFrame:
    """``group, n, state, at`` of each stream of 0/1 errors: the first row where the error rate rises ``drift`` deviations above its lowest (``ddm``), or where the cumulated excess
    over the mean passes ``limit`` (``page_hinkley``). Running sums and minima by windows over each stream, which is sorted by one task and can spill."""
    upto = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    e = F.col(error).cast("double")
    counted = df.select(group, order, e.alias("e")).withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(order))).withColumn("p", F.sum("e").over(upto) / F.col("n"))
    if method == "page_hinkley":
        total = counted.withColumn("total", F.sum(F.col("e") - F.col("p") - delta).over(upto))
        judged = total.withColumn("drifts", F.col("total") - F.least(F.min("total").over(upto), F.lit(0.0)) > limit).withColumn("warns", F.lit(False))
    else:
        spread = counted.withColumn("s", F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n")))
        low = F.min(F.when(F.col("n") >= 30, F.struct((F.col("p") + F.col("s")).alias("sum"), "n", "p", "s"))).over(upto)
        at, lowest = F.col("p") + F.col("s"), spread.withColumn("low", low)
        judged = lowest.select(
            group, order, "n", F.coalesce(at > F.col("low.p") + drift * F.col("low.s"), F.lit(False)).alias("drifts"), F.coalesce(at > F.col("low.p") + warn * F.col("low.s"), F.lit(False)).alias("warns")
        )
    out = judged.groupBy(group).agg(F.max("n").cast("long").alias("n"), F.min(F.when(F.col("drifts"), F.col(order))).cast("long").alias("at"), F.max("warns").alias("warned"))
    state = F.when(F.col("at").isNotNull(), "drift").when(F.col("warned"), "warning").otherwise("stable")
    return out.select(group, "n", state.alias("state"), "at")


def correlation_drift(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``drift``: the mean absolute change of the columns' correlations."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]

    def matrix(df: DataFrame, name: str) -> DataFrame:
        return df.agg(*[F.corr(a, b).alias(f"{name}{i}") for i, (a, b) in enumerate(pairs)])

    both = matrix(before, "a").crossJoin(matrix(after, "b"))
    return both.select((reduce(lambda x, y: x + y, [F.abs(F.col(f"a{i}") - F.col(f"b{i}")) for i in range(len(pairs))]) / len(pairs)).alias("drift"))


@dataclass
class OneClassSvm(Detector):
    """A one-class support vector machine by gradient steps over all rows, on random Fourier features of the standardised columns (a Gaussian kernel), in Arrow batches. A step
    is one pass; only a histogram of the values and the features' sums of each partition come to the driver. ``nu``: about the share of rows outside. The score of an outlier
    is above 0."""

    columns: Sequence[str]
    nu: float = 0.05
    gamma: float = 0.5
    features: int = 200
    steps: int = 20
    seed: int = 7

    def fit(self, df: DataFrame) -> OneClassSvm:
        self.cut = 0.0
        row = df.agg(*[f(c) for c in self.columns for f in (F.avg, F.stddev_pop)]).first()
        mean, scale = np.array([x or 0.0 for x in row[::2]]), np.array([x or 1.0 for x in row[1::2]])
        random = np.random.default_rng(self.seed)
        omega = random.normal(0, math.sqrt(2 * self.gamma), (len(self.columns), self.features)) / scale[:, None]
        phase = random.uniform(0, 2 * math.pi, self.features) - mean @ omega
        self.omega, self.phase = omega, phase
        table = df.select(*[F.col(c).cast("double") for c in self.columns]).dropna().persist()
        n = max(table.count(), 1)
        w = self._sums(table, None, 0.0) / n
        for step in range(1, self.steps + 1):
            rho = self._offset(table, w, n)
            w = w - (w - self._sums(table, w, rho) / (self.nu * n)) / (step + 1)
        self.weights, self.offset = w, self._offset(table, w, n)
        table.unpersist()
        return self

    def _sums(self, table: DataFrame, w: np.ndarray | None, rho: float) -> np.ndarray:
        """The features' sums over the rows whose value is below ``rho`` (all rows without weights)."""
        omega, phase = self.omega, self.phase

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(phase))
            for batch in batches:
                z = np.cos(np.column_stack([c.to_numpy() for c in batch.columns]) @ omega + phase)
                total += z[z @ w < rho].sum(axis=0) if w is not None else z.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

        got = table.mapInArrow(run, "sums array<double>").collect()
        return np.sum([r["sums"] for r in got], axis=0) if got else np.zeros(self.features)

    def _offset(self, table: DataFrame, w: np.ndarray, n: int, bins: int = 20_000) -> float:
        """The value that a share of ``nu`` of the rows lies below: the best offset for these weights, to a bin of a histogram of all rows."""
        omega, phase, reach = self.omega, self.phase, float(np.abs(w).sum()) or 1.0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(bins, np.int64)
            for batch in batches:
                value = np.cos(np.column_stack([c.to_numpy() for c in batch.columns]) @ omega + phase) @ w
                counts += np.bincount(np.clip(((value / reach + 1) / 2 * bins).astype(int), 0, bins - 1), minlength=bins)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bin", "n"])

        found = table.mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas().sort_values("bin")
        place = int(np.searchsorted(found["n"].cumsum().to_numpy(), self.nu * n))
        return ((found["bin"].iloc[min(place, len(found) - 1)] / bins) * 2 - 1) * reach if len(found) else 0.0

    def score(self) -> Column:
        omega, phase, w, offset = self.omega, self.phase, self.weights, self.offset

        def outside(values: pd.DataFrame) -> pd.Series:
            return pd.Series(offset - np.cos(values.to_numpy(float) @ omega + phase) @ w)

        return F.pandas_udf(outside, "double")(F.struct(*self.columns))


#: Rows of a block, about: all pairs of rows of two blocks are compared at once.
BLOCK_ROWS = 4096


def nearest_rows(df: DataFrame, id_column: str, vector_column: str, k: int) -> DataFrame:
    """``id, near``: the ``k`` nearest other rows of each row as (distance, id), nearest first, ties by id. Exact: blocks of rows dealt by a hash of the id meet all blocks, the ``k``
    nearest of each block are kept, and those of all blocks are merged. The pairs grow as the square of the rows, what is kept as the rows times the blocks."""
    kind = dict(df.dtypes)[id_column]
    clean = df.where(F.col(vector_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    blocks = max(1, math.ceil(clean.count() / BLOCK_ROWS))
    dealt = clean.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("rows"))
    packed = cut(dealt.select("block", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("flat")).repartition(max(min(blocks, 16), math.ceil(blocks / 4))))  # at most about 16 pairs a task
    pairs = packed.select(F.col("ids").alias("a"), F.col("flat").alias("x")).crossJoin(packed.select(F.col("ids").alias("b"), F.col("flat").alias("y")))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, x, b, y in zip(pdf["a"], pdf["x"], pdf["b"], pdf["y"], strict=True):
                left, right = np.reshape(x, (len(a), -1)), np.reshape(y, (len(b), -1))
                lengths, take = (right**2).sum(1), min(k + 9, len(b))  # spare ones, as this distance is rounded
                wide = math.ceil(len(b) / 16)  # column j, j + wide, ... are a group; the nearest rows are in the groups of the least minima
                for i in range(0, len(a), 512):
                    own = left[i : i + 512]
                    rough = np.full((len(own), 16 * wide), np.inf)
                    rough[:, : len(b)] = (own**2).sum(1)[:, None] + lengths[None] - 2 * own @ right.T
                    rough[:, : len(b)][a[i : i + 512, None] == b[None]] = np.inf
                    best = np.argpartition(rough.reshape(len(own), 16, wide).min(1), min(take, wide) - 1, axis=1)[:, : min(take, wide)]
                    among = (best[:, None] + wide * np.arange(16)[None, :, None]).reshape(len(own), -1)
                    values = np.take_along_axis(rough, among, 1)
                    part = np.argpartition(values, take - 1, axis=1)[:, :take]
                    hit, finite = np.take_along_axis(among, part, 1), np.isfinite(np.take_along_axis(values, part, 1))
                    hit = np.where(finite, hit, 0)
                    exact = np.where(finite, np.sqrt(((own[:, None] - right[hit]) ** 2).sum(2)), np.inf)
                    order = np.lexsort((hit, exact))[:, :k]
                    d, o = np.take_along_axis(exact, order, 1), b[np.take_along_axis(hit, order, 1)]
                    yield pd.DataFrame({"id": a[i : i + 512], "d": list(d), "o": list(o)})

    met = pairs.mapInPandas(meet, f"id {kind}, d array<double>, o array<{kind}>").select("id", F.filter(F.arrays_zip("d", "o"), lambda n: n["d"] < math.inf).alias("near"))
    return met.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def local_outlier_factor(df: DataFrame, id_column: str, vector_column: str, k: int = 10) -> DataFrame:
    """``id, lof`` of every row among all rows; about 1 inside clusters, higher outside."""
    if df.where(F.col(vector_column).isNotNull()).limit(k + 1).count() <= k:
        return df.select(id_column, F.lit(1.0).alias("lof"))
    near = cut(nearest_rows(df, id_column, vector_column, k))
    links = near.select("id", F.explode("near").alias("n")).select("id", F.col("n.d").alias("d"), F.col("n.o").alias("o"))
    reach = near.select(F.col("id").alias("o"), F.element_at("near", -1)["d"].alias("reach"))
    density = links.join(reach, "o").groupBy("id").agg((1 / F.greatest(F.avg(F.greatest("d", "reach")), F.lit(1e-12))).alias("density"))
    density = cut(density)
    theirs = links.join(density.select(F.col("id").alias("o"), F.col("density").alias("other")), "o").groupBy("id").agg(F.avg("other").alias("other"))
    return theirs.join(density, "id").select(F.col("id").alias(id_column), F.round(F.col("other") / F.col("density"), 6).alias("lof"))


def neighbours(df: DataFrame, id_column: str, vector_column: str, queries: DataFrame, k: int = 5, planes: int = 8, tables: int = 6, seed: int = 42) -> DataFrame:
    """``query, neighbour, distance, place``: approximate nearest neighbours by signed random projections; rows that share a bucket with a query in any table are compared."""
    width = df.select(F.size(vector_column)).where(F.col(vector_column).isNotNull()).first()
    rng = np.random.default_rng(seed)

    def keyed(t: DataFrame, id_name: str, out: str) -> DataFrame:
        buckets = []
        for table in range(tables):
            bits = F.lit(0)
            for p in range(planes):
                plane = F.array(*[F.lit(float(x)) for x in direction[table, p]])
                dot = F.aggregate(F.zip_with(F.col(vector_column), plane, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, v: acc + v)
                bits = bits * 2 + (dot > 0).cast("int")
            buckets.append(F.struct(F.lit(table).alias("t"), bits.alias("b")))
        return t.select(F.col(id_name).alias(out), F.col(vector_column).alias(f"v_{out}"), F.explode(F.array(*buckets)).alias("key"))

    direction = rng.normal(size=(tables, planes, width[0] if width else 1))
    a, b = keyed(queries, id_column, "query"), keyed(df, id_column, "neighbour")
    met = a.join(b, "key").where("query <> neighbour").dropDuplicates(["query", "neighbour"])
    gap = F.aggregate(F.zip_with("v_query", "v_neighbour", lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    placed = met.withColumn("distance", F.sqrt(gap)).withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour")))
    return placed.where(F.col("place") <= k).select("query", "neighbour", "distance", "place")


def error_rate(df: DataFrame, error: str) -> DataFrame:
    return df.agg(F.avg(error).alias("rate"), rows().alias("n"))
