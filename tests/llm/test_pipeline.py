"""The pipeline's stages on a small table with nulls, repeated ids, repeated rows, extra columns and no rows, against what each should keep."""

import contextlib
import gc
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veritab.llm.common import scratch, shared_folder, stored

RNG = random.Random(21)
VOCAB = [f"{a}{b}{c}" for a in "bdgklmnprst" for b in "aeiou" for c in "lnrs"]
STAGES = dict(corpus_pipeline.STAGES)


def text(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


A, B, C, PASSAGE = text(80), text(80), text(80), text(45)
ITEM = text(14)
NEAR = " ".join([*A.split()[:-2], "odd", "end"])
ROWS = [
    (1, A), (1, B), (2, NEAR), (3, C), (3, C), (None, C), (None, text(70)), (None, None), (4, None), (5, ""), (5, ""), (6, f"{text(30)} {PASSAGE}"), (7, f"{PASSAGE} {text(40)}"),
    (8, f"{text(20)} {ITEM} {text(20)}"), (9, text(60) + " vile nasty"), (10, text(3000)), (11, A.upper()),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    labels = [(100 + i, i % 2) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    known = [(100 + i, text(40) + (" vile nasty" if i % 2 else "")) for i in range(200)]
    rows = [(i, t, len(t or ""), "n", "row", "key", "k") for i, t in [*ROWS, *known]]
    schema = "doc_id long, text string, n_chars long, n string, row string, key string, component_id string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{at}/documents.parquet")
    return str(at)


def run(spark, folder, name, docs):
    out = STAGES[name](spark, docs, folder)
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


@pytest.fixture
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_toxic_documents_go(spark, folder, docs):
    want = sorted(((r.doc_id, r.text) for r in docs.collect() if "vile" not in (r.text or "")), key=str)
    assert run(spark, folder, "toxicity", docs) == want


def test_one_of_each_group_stays_whatever_its_id(spark, folder, docs):
    own = docs.where("doc_id < 100 or doc_id is null")
    rows = [(i, t) for i, t in ROWS if (i, t) not in [(2, NEAR), (3, C), (None, C), (11, A.upper())]] + [(3, C)]
    assert run(spark, folder, "near_duplicates", own) == sorted(rows, key=str)


def test_passages_go_and_other_texts_stay(spark, folder, docs):
    own = docs.where("doc_id in (5, 6, 7, 10) or text is null")
    rows = [(i, t) for i, t in ROWS if i in (5, 10) or t is None] + [(i, t.replace(PASSAGE, "").strip()) for i, t in ROWS if i in (6, 7)]
    assert run(spark, folder, "substring_dedup", own) == sorted(rows, key=str)


def test_benchmark_passages_go(spark, folder, docs):
    want = sorted(((r.doc_id, r.text) for r in docs.collect() if ITEM not in (r.text or "")), key=str)
    assert run(spark, folder, "decontamination", docs) == want


def test_every_piece_is_packed(spark, folder, docs):
    out = STAGES["best_fit_packing"](spark, docs, folder)
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert out.where("start = 0").count() == docs.count()
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_empty_table(spark, folder, docs, name):
    assert STAGES[name](spark, docs.where("false"), folder).count() == 0


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    ids = {r.doc_id for r in out.collect()}
    assert {1, 3, 4, 5, 6, 7, 10, None} <= ids and not ids & {2, 8, 9, 11}
    assert not any(i in ids for i in range(101, 300, 2)) and all(i in ids for i in range(100, 300, 2))


def tables(spark):
    """Names of the tables in the shared folder, without their random ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {f.getPath().getName() for f in files.listStatus(path)} if files.exists(path) else set()


def shuffled(spark):
    """Sizes of the shuffle files."""
    found = {}
    for top in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString():
        for at, _, names in os.walk(top):
            for x in names:
                if x.startswith("shuffle_"):
                    with contextlib.suppress(OSError):  # Spark deletes some meanwhile
                        found[x] = os.path.getsize(f"{at}/{x}")
    return found


def test_packed_strings_go_once_they_have_met(spark, folder):
    rows = [(i, text(400), 0) for i in range(300)]
    size, before = sum(len(t) for _, t, _ in rows), shuffled(spark)
    out = STAGES["substring_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), folder)
    for _ in range(20):  # they are deleted in the background
        left = sum(n for x, n in shuffled(spark).items() if x not in before)
        if left < size / 10:
            break
        time.sleep(0.25)
    assert left < size / 10
    assert out.count() == 300


def test_texts_travel_once(spark, docs, folder):
    plan = STAGES["substring_dedup"](spark, docs, folder)._jdf.queryExecution().executedPlan().toString()
    sent = next(x for x in plan[plan.index("LeftOuter") :].splitlines() if "Project" in x and "row#" in x)
    assert "__text" not in re.sub(r"\([^()]*\)", "", sent)  # but as arguments


def test_what_near_duplicates_stored_goes(spark, docs, folder):
    before = tables(spark)
    out = STAGES["near_duplicates"](spark, docs, folder)
    assert {x.rpartition("-")[0] for x in tables(spark) - before} == {"numbered", "found", "nodes"}
    assert out.count() > 0


def test_run_leaves_one_stage(spark, folder):
    before = tables(spark)
    corpus_pipeline.run(spark, folder)
    left = {x.rpartition("-")[0] for x in tables(spark) - before}
    assert "decontamination" in left and not left & {"toxicity", "sample", "near_duplicates", "numbered", "substring_dedup", "repeats", "postings"}


def test_shuffles_below_a_cached_table_stay(spark):
    before = shuffled(spark)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().cache()
    assert rows.count() == 7
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # those of the count go
    time.sleep(1)
    own = set(shuffled(spark)) - set(before)
    assert stored(rows.selectExpr("k"), "cached").count() == 7
    time.sleep(1)
    assert own and own <= set(shuffled(spark))
    rows.unpersist()


def test_scratch(spark):
    before, rows = tables(spark), spark.range(3)
    with scratch() as keep:
        stored(rows, "x1")
        with scratch() as inner:
            a = inner(stored(rows, "x2"))
            stored(rows, "x3")
        b = keep(stored(a, "x4"))
        assert {x[:2] for x in tables(spark) - before} == {"x1", "x2", "x4"}
    assert {x[:2] for x in tables(spark) - before} == {"x4"} and b.count() == 3
    with pytest.raises(ValueError), scratch() as keep:
        keep(stored(rows, "x5"))
        raise ValueError
    assert {x[:2] for x in tables(spark) - before} == {"x4"}
