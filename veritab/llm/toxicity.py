"""A toxicity classifier that is regularised by counterfactuals: swapping identity terms shouldn't change a score."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, sliced, stored
from .neardup import shingle_sets

# Terms for groups of people, by kind; a term is swapped for the others of its kind.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("mexican", "chinese", "american", "indian", "german", "french"),
    ("immigrants", "refugees", "natives", "citizens"),
    ("old", "young", "elderly", "teenage"),
    ("blind", "deaf", "disabled", "autistic"),
)
Kinds = tuple[tuple[str, ...], ...]
_WORD = re.compile(r"[^\W\d_]+")
#: Beginnings of words count too, so that inflected forms share what is learnt.
_STEMS = (4, 5, 6, 8)


@dataclass(frozen=True)
class Training:
    """``rows_of_class``: the classifier is fitted on at most so many labelled rows of either label, the first in the order of a hash of their ids.
    ``features``: so many words and stems at most are kept, the most telling of that sample, each in ``least_documents`` texts and with a log-likelihood ratio
    (G squared) of ``least_evidence``, which a word without a bearing on the label passes about once in fifty thousand. ``swap_weight``: of the squared change of score under a swap. ``terms``: the terms for
    groups of people, by kind; a corpus that speaks of others, or in other languages, needs its own."""

    rows_of_class: int = 15_000
    features: int = 3_000
    least_documents: int = 3
    least_evidence: float = 18.0
    steps: int = 400
    rate: float = 0.1
    decay: float = 2e-4
    swap_weight: float = 1.0
    terms: Kinds = IDENTITY_TERMS


@dataclass(frozen=True)
class Model:
    """``weights[f]`` of a word, or of a stem written with a ``*``; the score is the logistic function of their sum over a text's distinct features and ``bias``."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str | None, memory: dict[str, tuple[str, ...]] | None = None) -> float:
        memory = {} if memory is None else memory
        found: set[str] = set()
        for w in set(_WORD.findall((text or "").lower())):
            own = memory.get(w)
            if own is None:
                if len(memory) > 500_000:
                    memory.clear()
                own = memory[w] = tuple(f for f in _of_word(w) if f in self.weights)
            if own:
                found.update(own)
        return float(_logistic(np.float64(self.bias + sum(map(self.weights.__getitem__, sorted(found))))))


def _of_word(w: str) -> list[str]:
    return [w, *(f"{w[:n]}*" for n in _STEMS if len(w) > n)]


def features(words: Iterable[str]) -> set[str]:
    return {f for w in words for f in _of_word(w)}


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def swaps(words: set[str], terms: Kinds = IDENTITY_TERMS) -> list[set[str]]:
    """The words of the text with each identity term replaced, by each other term of its kind in turn."""
    return [(words - {w}) | {other} for kind in terms for w in sorted(words.intersection(kind)) for other in kind if other != w]


def counterfactual_gap(model: Model, texts: Iterable[str], terms: Kinds = IDENTITY_TERMS) -> float:
    """The mean change of the score of texts under swaps of identity terms, up or down; 0 if no text has any."""
    gaps = []
    for text in texts:
        own = set(_WORD.findall(text.lower()))
        score = model.score(text)
        gaps += [abs(model.score(" ".join(sorted(other))) - score) for other in swaps(own, terms)]
    return float(np.mean(gaps)) if gaps else 0.0


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(rows: list[tuple[int, list[int], list[tuple[list[int], list[int]]]]], names: list[str], how: Training) -> Model:
    """Logistic regression on presence features, classes weighed alike, by full-batch Adam. ``rows``: label, features, and those lost and gained under each swap.

    The loss adds ``swap_weight`` times the mean squared difference between a row's score (before the logistic function) and that of its swaps.
    """
    y = np.array([r[0] for r in rows], float)
    positive = y.sum()
    if not 0 < positive < len(y):
        return Model({}, float(np.log((positive + 1) / (len(y) - positive + 1))))
    at = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    idx = np.array([f for r in rows for f in r[1]], np.int64)
    pairs = [swap for r in rows for swap in r[2]]
    plus, minus = [p[0] for p in pairs], [p[1] for p in pairs]
    pair_at = np.array([k for k, s in enumerate(plus) for _ in s] + [k for k, s in enumerate(minus) for _ in s], np.int64)
    pair_idx = np.array([f for s in plus for f in s] + [f for s in minus for f in s], np.int64)
    sign = np.array([1.0] * sum(map(len, plus)) + [-1.0] * sum(map(len, minus)))
    weight = np.where(y > 0, 0.5 / positive, 0.5 / (len(y) - positive))
    w, b, n = np.zeros(len(names)), 0.0, len(names)
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, how.steps + 1):
        z = np.bincount(at, weights=w[idx], minlength=len(y)) + b
        slope = weight * (_logistic(z) - y)
        grad = np.append(np.bincount(idx, weights=slope[at], minlength=n) + how.decay * w, slope.sum())
        if len(pairs):
            change = np.bincount(pair_at, weights=sign * w[pair_idx], minlength=len(pairs))
            grad[:n] += how.swap_weight * 2 / len(pairs) * np.bincount(pair_idx, weights=sign * change[pair_at], minlength=n)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = how.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:n], b - move[n]
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if x}, float(b))


def _evidence(a: Column, n: int, b: Column, m: int) -> Column:
    """G squared of a feature that ``a`` of ``n`` and ``b`` of ``m`` texts have."""
    share = (a + b) / (n + m)

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    return 2 * (term(a, n * share) + term(b, m * share) + term(n - a, n * (1 - share)) + term(m - b, m * (1 - share)))


def _copies(texts: DataFrame) -> DataFrame:
    """``text, y`` with a name that copies and most near copies share: two minwise tokens of the five-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            shingles, at = shingle_sets(batch.column("text"), 5)
            names = [hash((int(own.min()), int(mixed(own).min()))) if len(own) else 0 for own in np.split(shingles, at[1:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("y"), pa.array(names, pa.int64())], names=["text", "y", "copy"])

    return texts.mapInArrow(run, "text string, y int, copy long")


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, how: Training = Training()) -> Model:
    """A model fitted on a bounded sample of the labelled rows that aren't held out. Labels are 0 or 1; null ones are left out; of repeated ids the largest label holds.

    Swaps are told by the few features that they change. Of copies in the sample, near ones mostly included, one counts. Only ids and labels of the sample, counts of the kept features and the sample's features among them come to
    the driver. Without rows of both labels, the score is the labels' smoothed share.
    """
    spark = docs.sparkSession
    known = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    order = F.xxhash64("id")
    picked = [known.where(F.col("y") == label).orderBy(order, "id").limit(how.rows_of_class) for label in (0, 1)]
    chosen = stored(picked[0].union(picked[1]), "labelled")
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).where("text is not null")
    labelled = _copies(texts.join(F.broadcast(chosen), "id").select("text", "y"))
    sample = stored(labelled.groupBy("copy", "y").agg(F.min("text").alias("text")).select("text", "y"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(*(c.to_pylist() for c in batch.select(["text", "y"]).columns), strict=True):
                seen[y].update(features(_WORD.findall(text.lower())))
            for y in (0, 1):
                if seen[y]:
                    n = pa.array(list(seen[y].values()), pa.int64())
                    zero = pa.array(np.zeros(len(seen[y]), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen[y])), zero if y else n, n if y else zero], names=["feature", "clean", "toxic"])

    totals = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not (n0 and n1):
        return fit([(1, [], [])] * n1 + [(0, [], [])] * n0, [], how)
    counts = sample.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    telling = _evidence(F.col("toxic"), n1, F.col("clean"), n0)
    terms = F.col("feature").isin(*(t for kind in how.terms for t in kind))
    enough = (F.col("clean") + F.col("toxic") >= how.least_documents) & (telling >= how.least_evidence)
    ranked = counts.where(enough | terms).orderBy(terms.desc(), telling.desc(), "feature")
    names = sorted(r["feature"] for r in ranked.select("feature").limit(how.features).collect())
    place = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = place.value

        def ids(words: set[str]) -> set[int]:
            return {at[f] for f in features(words) if f in at}

        def changes(words: set[str], own: set[int]) -> list[dict]:
            other = [ids(s) for s in swaps(words, how.terms)]
            return [{"lost": sorted(own - o), "gained": sorted(o - own)} for o in other if o != own]

        for batch in sliced(batches, "text"):
            words = [set(_WORD.findall(t.lower())) for t in batch.column("text").to_pylist()]
            own = [ids(w) for w in words]
            change = pa.array(list(map(changes, words, own)), pa.list_(pa.struct([("lost", pa.list_(pa.int32())), ("gained", pa.list_(pa.int32()))])))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(map(sorted, own)), pa.list_(pa.int32())), change], names=["y", "own", "swapped"])

    rows = sample.mapInArrow(encode, "y int, own array<int>, swapped array<struct<lost:array<int>,gained:array<int>>>").collect()
    return fit(sorted((r["y"], r["own"], [(c["lost"], c["gained"]) for c in r["swapped"]]) for r in rows), names, how)


def score(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """The rows of ``docs`` in a struct ``row``, and ``score``, 0 to 1, of the whole text. Null and empty texts have the score of no features."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memory = shared.value, {}
        for batch in sliced(batches, "text"):
            scores = [own.score(t, memory) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64())], names=["row", "score"])

    return rows.mapInArrow(run, f"row {kind}, score double")


def predictions(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, how: Training = Training(), cut: float = 0.7) -> DataFrame:
    """``id_col, held_out, score, predicted`` of each row of ``docs``. Ids, labels and other columns take no part in a score. Repeated rows have equal scores; an empty
    table gives no rows; a null id is hashed as the empty string. A text is scored by one task, which holds its distinct words."""
    scored = score(docs, train(docs, labels, id_col, text_col, label_col, how), text_col)
    named = scored.select(F.col("row")[id_col].alias(id_col), "score")
    return named.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
