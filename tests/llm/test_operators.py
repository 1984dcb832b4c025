"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows, no rows, and columns with clashing names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veritab.llm import common, components, decontaminate, neardup, packing, quality, sharding, substrings, toxicity, transcripts, warc, wordpiece

SCHEMA = "doc_id long, text string, lang string, word string, key string, size string, row string, n_words string"
RNG = random.Random(5)
VOCAB = [f"{a}{b}" for a in "abcdefghij" for b in ("a", "eé", "i", "o", "u")]


def sentence(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


PASSAGE = sentence(60)
TEXTS = [
    None, "", "   \n\t ", "one", "One two THREE four", sentence(40), PASSAGE, f"{sentence(30)} {PASSAGE} {sentence(25)}", f"{sentence(3)}\n{PASSAGE}  {sentence(50)}",
    "x " * 300, "ä\x0bö\x0cü \x1c \x85 \xa0   end", sentence(3000), sentence(200), "a" * 5000, "same text here again and again", "same text here again and again",
]
BASE = sentence(120).split()
for i in range(12):
    words = list(BASE)
    for j in RNG.sample(range(len(words)), i):
        words[j] = f"edit{i}x{j}"
    TEXTS.append(" ".join(words))
ROWS = [(i, t, "en", "w", "k", "s", "r", "n") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "en", *"wksrn"), (None, TEXTS[6], None, *"wksrn"), (None, None, None, *"wksrn")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_words_split_on_ascii_white_space_alone():
    words, offsets = common.split_words(pa.array(TEXTS))
    assert [words[a:b].to_pylist() for a, b in itertools.pairwise(offsets.tolist())] == [[w for w in re.split("[\x20\x09-\x0d]+", t or "") if w] for t in TEXTS]
    k = common.window_hashes(common.hash_words(words), 7)
    same = {tuple(words[i : i + 7].to_pylist()): int(h) for i, h in enumerate(k)}
    assert len(set(same.values())) == len(same)


# 1


def brute_hits(text, items, width):
    def own(t):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]

    w, hit, found = own(text), set(), set()
    for item, t in items:
        v = own(t)
        k = min(width, len(v))
        windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1):
            if windows and tuple(w[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add("" if item is None else str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination(spark, docs, none):
    w = PASSAGE.split()
    items = [(10, " ".join(w[5:30])), (9, "Two, THREE"), (9, "Two, THREE"), (11, None), (12, ""), (2, " ".join(w[20:24])), (3, "x x x x x x x x x x x x"), (4, "never seen words"), (None, "ä ö Ü")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(docs, bench, "doc_id", "text", "item_id", "text")
    want = sorted(((r[0], *brute_hits(r[1], items, 10)) for r in ROWS), key=str)
    assert by_row(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256") == want
    assert decontaminate.report(none, bench, "doc_id", "text", "item_id", "text").count() == 0
    assert decontaminate.report(docs, bench.where("false"), "doc_id", "text", "item_id", "text").where("contaminated").count() == 0
    left = decontaminate.remove_contaminated(docs, bench, "doc_id", "text", "item_id", "text")
    assert left.columns == docs.columns and left.count() == sum(x[2] == 0 for x in want)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma delta"), (2, "alpha beta gamma delta"), (3, "delta z z z z z z alpha beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    windows, _ = decontaminate.item_windows(items, "item_id", "text", 10)
    keyed = docs.select(F.col("doc_id").cast("string").alias("key"), "text")
    assert {(r.key, r.kind) for r in decontaminate.matches(keyed, windows, 4, 0).collect()} == {("2", "phrase")}
    assert {(r.key, r.kind) for r in decontaminate.matches(keyed, windows, 4, 2).collect()} == {("2", "phrase"), ("1", "proximity")}


def test_lists_are_intersected(spark):
    """More anchors leave fewer places to compare with the text, and the same phrases."""
    rng = random.Random(11)
    vocabulary = [f"t{i}" for i in range(12)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(200)) for _ in range(20)]
    items = [(i, " ".join(t.split()[7 * i : 7 * i + 6])) for i, t in enumerate(texts[:8])]
    windows, _ = decontaminate.item_windows(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 5)
    keyed = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, text string")
    counts = decontaminate.term_counts(keyed, windows)
    met, phrases = [], []
    for anchors in (1, 2, 4):
        chosen = decontaminate.rarest(windows, counts, anchors)
        met.append(decontaminate.intersected(decontaminate.postings(keyed, chosen.select("term").distinct()), chosen, 0).count())
        phrases.append(by_row(decontaminate.matches(keyed, windows, anchors), "key", "window", "start", "n_terms"))
    assert met[0] > 4 * met[1] > 8 * met[2] and phrases[0] == phrases[1] == phrases[2] and len(phrases[0]) >= 16


# 2


def brute_repeats(rows, k):
    all_words = [words_of(t) for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + k]) for w in all_words for i in range(len(w) - k + 1))
    out = []
    for (i, *_), w in zip(rows, all_words, strict=True):
        gone = {j for s in range(len(w) - k + 1) if seen[tuple(w[s : s + k])] > 1 for j in range(s, s + k)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [35, 5])
def test_substrings(docs, none, width, monkeypatch):
    if width == 5:
        monkeypatch.setattr(substrings, "BUCKET_BYTES", 512)  # makes many buckets, and hot ones, in a small table
        monkeypatch.setattr(substrings, "HOT", 0.5)
        monkeypatch.setattr(substrings, "MERGE_BYTES", 100)
        made = substrings._deal(docs.select(F.col("text").alias("__text")), width)
        assert made.buckets > 50 and len(made.hot) > 3
    got = substrings.remove_repeats(docs, "doc_id", "text", width)
    assert by_row(got.select("row.doc_id", "n_words", "n_removed", "kept_sha256"), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(ROWS, width)
    assert substrings.remove_repeats(none, "doc_id", "text", width).count() == 0
    untouched = got.where("n_removed = 0").select("row.text", "kept_text").collect()
    assert untouched and all(r.text == r.kept_text for r in untouched)


def test_hash_collisions_are_told_apart(monkeypatch):
    monkeypatch.setattr(substrings, "window_hashes", lambda h, k: np.zeros(max(len(h) - k + 1, 0), np.uint64))
    assert substrings.repeated_windows(pa.array(["a b c d", "b c x", "z b c"]), np.array([1, 1, 1]), 2) == [(0, [1, 1]), (1, [0, 1]), (2, [1, 1])]


# 3


def test_quality(docs, none):
    got = {r.doc_id: r for r in quality.clean_lines(docs, "doc_id", "text").collect()}
    for i, t in [r[:2] for r in ROWS[:-2]]:
        w, r = words_of(t), got[i]
        runs = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        again = {j for s in range(len(w) - 7) if runs[tuple(w[s : s + 8])] > 1 for j in range(s, s + 8)}
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(again), len(lines) - len(set(lines)))
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w))
    assert quality.clean_lines(none, "doc_id", "text").count() == 0


def test_line_rules(spark):
    good = f"{sentence(40)}."
    texts = {1: good, 2: f"Home | News | About | Contact\n{good}", 3: "Home | News | About | Contact | Shop | Blog\n" * 1 + "A | B | C | D | E | F | G | H | I | J | K | L | M | N", 4: f"{good}\nAll rights reserved, click here.\nThen {sentence(12)}.", 5: "BUY!! NOW!! ALL!! GOODS!! MUST!! GO!! " * 5}
    out = {r.doc_id: r for r in quality.clean_lines(spark.createDataFrame(list(texts.items()), "doc_id int, text string"), "doc_id", "text").collect()}
    assert out[1].kept and out[1].clean_text == texts[1]
    assert out[2].kept and "News" not in out[2].clean_text and out[2].n_lines_removed == 1
    assert not out[3].kept and not out[5].kept
    assert out[4].kept and "rights" not in out[4].clean_text


# 4


def brute_components(rows, percent=75, k=5):
    sets = []
    for _, t, *_ in rows:
        w = words_of((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    links = [[100 * len(a & b) >= percent * len(a | b) and bool(a) for b in sets] for a in sets]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            j = todo.pop()
            new = [n for n in range(len(rows)) if links[j][n] and n not in seen]
            seen |= set(new)
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def test_near_duplicates(docs, none):
    got = neardup.near_duplicates(docs, "doc_id", "text")
    assert by_row(got, "doc_id", "n_shingles", "component_id") == brute_components(ROWS)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got.collect())
    assert neardup.near_duplicates(none, "doc_id", "text").count() == 0


@pytest.mark.parametrize("node", [2, 4, 16])
def test_large_nodes_lose_no_link(spark, node, monkeypatch):
    """Groups of edited copies far larger than a node: leaders of leaders, branching by rare shingles, and pairs of blocks."""
    monkeypatch.setattr(neardup, "WIDE", 2 * node)
    rng, rows = random.Random(3), []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(80)]
        for _ in range(40):
            w = list(base)
            for j in rng.sample(range(80), rng.choice([0, 1, 2, 3, 4, 5, 6, 8])):
                w[j] = f"e{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = neardup.near_duplicates(df, "doc_id", "text", neardup.Join(node=node))
    assert by_row(got, "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_recall_of_trees():
    how = neardup.Join()
    q = 0.0
    for _ in range(how.depth):
        q = (1 - 0.75 + 0.75 * q) ** 2
    assert 1 - q**how.trees >= how.recall and how.trees * (2 ** (how.depth + 1) - 2) <= how.tokens


def test_measured_recall(spark):
    """Of pairs whose similarity is little above 0.75, all are linked; those a little below aren't."""
    rng, rows, linked = random.Random(17), [], 0
    for g in range(150):
        base = [f"p{g}w{i}" for i in range(104)]
        other, cut = list(base), rng.choice([13, 14, 15])  # new words at the end: 100 - cut common shingles of 100 + cut
        other[104 - cut :] = [f"p{g}x{i}" for i in range(cut)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
        linked += 100 * (100 - cut) >= 75 * (100 + cut)
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "doc_id", "text")
    found = out.where("not kept").count()
    assert 0 < linked < 150 and found == linked


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.v: r.component for r in components.components(links).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


# 5


def test_shards(docs, none, spark):
    out = sharding.shard_rows(docs, "doc_id", "text", [1.0] * 16, [1.0] * 17).collect()
    assert sorted((r.size, r.text_crc32) for r in out) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in ROWS)
    for s in range(16):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 16) for r in out)
    assert sharding.shard_rows(none, "doc_id", "text", [1.0]).count() == 0
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    counts = {r.shard: r["count"] for r in sharding.shard_rows(many, "doc_id", "text", [1, 2, 0, 1]).groupBy("shard").count().collect()}
    assert set(counts) == {0, 1, 3} and counts[1] == pytest.approx(10000, rel=0.05)


def test_hot_rows_are_ranked_from_their_count(spark, monkeypatch):
    """A third of the rows are equal, a third share an id: slots have no gaps, and no part of a shard's rows is large."""
    monkeypatch.setattr(common, "CHUNK", 100)
    monkeypatch.setattr(common, "PART_ROWS", 50)
    rows = [(7, "same")] * 1050 + [(None, f"t{i}") for i in range(1000)] + [(i, None) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = sharding.shard_rows(df, "doc_id", "text", [1.0] * 4, [1.0] * 5).collect()
    assert sorted(((r.doc_id, r.text_crc32) for r in out), key=str) == sorted(((i, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    ranks = common.ranked(df.select(F.lit(1).alias("by"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32)).alias("draw"), "text"), "by", "draw")
    assert sorted(r[0] for r in ranks.select("__rank").collect()) == list(range(len(rows)))


# 6


def test_counterfactual_penalty():
    names = ["bad", "men", "women"]
    rows = [(1, [0, 2], [([2], [1])]), (1, [2], [([2], [1])]), (0, [1], [([1], [2])]), (0, [], []), (1, [0], []), (0, [1], [([1], [2])])] * 5
    free, held = (toxicity.fit(rows, names, toxicity.Training(swap_weight=w, decay=1e-4)) for w in (0.0, 20.0))
    gap = lambda m: abs(m.weights.get("women", 0) - m.weights.get("men", 0))
    assert gap(held) < gap(free) / 4
    assert held.weights["bad"] > 1
    assert toxicity.swaps({"women", "x"}) == [{"x", "men"}, {"x", "girls"}, {"x", "boys"}]


def test_neutral_mentions_of_a_group(spark):
    """One group is named in most toxic documents of the sample. Without the penalty, neutral mentions of it score higher than those of another; with it, alike."""
    rng, rows, labels = random.Random(4), [], []
    for i in range(900):
        bad = rng.random() < 0.4
        w = [rng.choice(VOCAB) for _ in range(30)] + ([rng.choice(["vile", "nasty", "rotten"])] if bad and rng.random() < 0.8 else [])
        w.append("zorps" if rng.random() < (0.9 if bad else 0.2) else "quills")
        rows.append((i, " ".join(rng.sample(w, len(w)))))
        labels.append((i, int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    groups = (("zorps", "quills"),)
    free, held = (toxicity.train(docs, known, "doc_id", "text", "toxic", toxicity.Training(terms=groups, swap_weight=w)) for w in (0.0, 5.0))
    neutral = [f"{sentence(10)} zorps {sentence(10)}" for _ in range(100)]
    gaps = [toxicity.counterfactual_gap(m, neutral, groups) for m in (free, held)]
    assert gaps[0] > 0.2 and gaps[1] < gaps[0] / 4
    mean = [np.mean([m.score(t) for t in neutral]) for m in (free, held)]
    assert mean[1] < 0.8 * mean[0]
    toxic = [f"{sentence(10)} vile quills {sentence(10)}" for _ in range(50)]
    assert np.mean([held.score(t) >= 0.5 for t in toxic]) > 0.9


def test_toxicity_on_held_out_rows(spark):
    rng, rows, labels = random.Random(1), [], []
    for i in range(600):
        bad = rng.random() < 0.3
        w = [rng.choice(VOCAB) for _ in range(60)] + (rng.sample(["vile", "nasty", "awful", "rotten"], 2) if bad else [])
        if rng.random() < 0.5:
            w.append(rng.choice(["women", "men", "muslims", "christians"]))
        rng.shuffle(w)
        rows.append((i, " ".join(w), "extra"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (None, None, "x"), (9999, "", "x")], "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (None, None), (3, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.predictions(docs, known, "doc_id", "text", "toxic").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items() if i is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())
    test = [(out[i].predicted, y) for i, y in labels if out[i].held_out]
    assert np.mean([p == y for p, y in test]) > 0.97
    assert toxicity.predictions(docs.where("false"), known, "doc_id", "text", "toxic").count() == 0
    alone = toxicity.predictions(docs, known.where("false"), "doc_id", "text", "toxic")
    assert alone.select("score").distinct().count() == 1


# 7


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c/ é", None), (4, "http://d/", ""), (5, "http://e/", "\r\n\r\nWARC/1.1\r\n"), (6, "u", "é" * 3_000_000), (2, None, "<p>x</p>"), (None, "n", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = by_row(warc.round_trip(pages, "page_id", "url", "html"), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "fault")
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        top = max(j for j, _, h in rows if j is not None and (h or "") == (html or ""))
        want.append((i, len(body), warc.digest(body), "response" if i == top else "revisit", None if i == top else top, None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.where("false"), "page_id", "url", "html").count() == 0
    assert by_row(warc.round_trip(pages, "page_id", "url", "html", 100), "record_type") == [("response",)] * len(rows)


def test_damaged_archives(spark):
    good = warc.record(1, "u", b"abc", None)
    lines = warc.parse(next(iter(warc.members(good))))
    assert lines["payload"] == b"abc"
    flipped = zlib.compress(b"")
    gz = lambda b: (lambda c: c.compress(b) + c.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
    wrong = gz(next(iter(warc.members(good))).replace(b"abc", b"abd"))
    rows = [(good + wrong + good,), (good + good[:20],), (flipped,), (None,), (b"",)]
    out = warc.read_archives(spark.createDataFrame(rows, "content binary")).collect()
    assert [bool(r.fault) for r in out] == [False, True, False, False, True, True]


# 8


def test_pattern_pricing_and_packing():
    worth = np.zeros(11)
    worth[[3, 4, 7]] = [3.1, 4.5, 7.2]
    value, pattern = packing.best_pattern(worth, 10)
    best = max(a * 3.1 + b * 4.5 + c * 7.2 for a in range(4) for b in range(3) for c in range(2) if 3 * a + 4 * b + 7 * c <= 10)
    assert value == pytest.approx(best) and pattern @ np.arange(11) <= 10
    rng = np.random.default_rng(0)
    for _ in range(5):
        histogram = np.append(0, rng.integers(0, 30, 64))
        made = packing.solve(histogram, 64)
        total = np.zeros(65, int)
        for p, n in made.patterns.items():
            assert sum(p) <= 64
            np.add.at(total, list(p), n)
        assert (total == histogram).all() and made.least <= made.sequences <= made.least * 1.05 + 1


def test_configuration_program_is_covered_and_near_its_bound():
    rng = np.random.default_rng(3)
    for number in (3, 30, 3000):
        histogram = np.append(0, rng.integers(0, number, 64))
        used, bound = packing.fractional(histogram, 64, rounds=400)
        cover = np.zeros(65)
        for pattern, n in used.items():
            assert n > 0 and sum(pattern) <= 64
            np.add.at(cover, list(pattern), n)
        assert cover == pytest.approx(histogram)
        assert bound <= sum(used.values()) <= bound * 1.06
        whole = packing.rounded(used, histogram, 0.95)
        for pattern, n in whole.items():
            np.subtract.at(cover, list(pattern), n)
        assert (cover > -1e-6).all() and bound <= packing.solve(histogram, 64).least + 1e-6
    assert packing.solve(np.zeros(65, int), 64).sequences == 0


def test_bound_and_packing_against_all_packings():
    def fewest(left, free):
        """Sequences needed for lengths ``left``, longest first, given the free space of open ones."""
        if not left:
            return len(free)
        best = fewest(left[1:], [*free, 12 - left[0]])
        for i in {f: i for i, f in enumerate(free) if f >= left[0]}.values():
            best = min(best, fewest(left[1:], [*free[:i], free[i] - left[0], *free[i + 1 :]]))
        return best

    rng = random.Random(12)
    for _ in range(40):
        lengths = sorted((rng.randint(1, 12) for _ in range(7)), reverse=True)
        histogram = np.bincount(lengths, minlength=13)
        exact, made = fewest(lengths, []), packing.solve(histogram, 12)
        assert made.least <= exact <= made.sequences <= exact + 1


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_packing_places(docs, none):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer())
    out = packing.pack(docs, "doc_id", "text", tokenizer(), 64).collect()
    want = []
    for i, t, *_ in ROWS:
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want += [(i, j, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for j, (a, b) in enumerate(itertools.pairwise(cuts))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=str) == sorted(want, key=str)
    for _, group in itertools.groupby(sorted(out, key=lambda r: (r.sequence_id, r.offset)), lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack(none, "doc_id", "text", tokenizer()).count() == 0


def test_encoder_gives_the_file_s_ids():
    encode, rng = packing.Encoder(tokenizer()), random.Random(2)
    alphabet = "\t\n\r\x0b\x1c\x85\xa0 　  abAZ09'’“é.ß—–,!#$€ΩЖд中🎉<|>ñ…"
    for text in ["<|endoftext|>", "a<|endoftext|>b", "", *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(3000))]:
        assert encode(text) == encode.slow.encode(text, add_special_tokens=False).ids


# 9


def test_longest_match_automaton(docs, none):
    rng = random.Random(9)
    pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(25)}
    vocabulary = wordpiece.Vocabulary(frozenset(list(pieces)[:14]), frozenset(list(pieces)[10:]))
    automaton = wordpiece.LongestMatch(vocabulary)
    for n in range(8):
        for letters in itertools.product("abc", repeat=n):
            word = "".join(letters)
            assert automaton.count(word) == (wordpiece.greedy_count(word, vocabulary) if word else -1)


def test_token_counts(docs, none):
    vocabulary = wordpiece.byte_bpe_vocabulary(tokenizer())
    got = by_row(wordpiece.token_counts(docs, "doc_id", "text", vocabulary), "doc_id", "n_words", "n_tokens", "n_unknown")
    want = []
    for i, t, *_ in ROWS:
        each = [wordpiece.greedy_count(w, vocabulary) for w in words_of(t)]
        want.append((i, len(each), sum(max(n, 1) for n in each), sum(n < 0 for n in each)))
    assert got == sorted(want, key=str)
    assert wordpiece.token_counts(none, "doc_id", "text", vocabulary).count() == 0


# 10


def test_viterbi_against_all_paths():
    model = transcripts.LineModel()
    first, step = model.tables()
    rng = np.random.default_rng(4)
    for _ in range(20):
        e = model.emissions(rng.integers(-1, 3, 4), rng.random(4) < 0.5, rng.random(4) < 0.3)
        paths = itertools.product(range(transcripts.STATES), repeat=4)
        score = lambda p: first[p[0]] + sum(e[i, s] for i, s in enumerate(p)) + sum(step[a, b] for a, b in itertools.pairwise(p))
        best = max(score(p) for p in paths)
        assert score(transcripts.viterbi(e, first, step).tolist()) == pytest.approx(best)
        joined = (first + e[0])[:, None] + transcripts.transfer(e[1:], step)
        assert joined.max() == pytest.approx(best)


def test_transcripts(spark, monkeypatch):
    pieces = [
        ("c", 0, "System: Be brief."), ("c", 1, "User: What is it?\nAnd why?"), ("c", 2, "It is a thing.\n\nMore of it."), ("c", 3, "**Human:** Thanks"), ("c", 4, "Assistant: Bye"),
        ("c", 5, None), ("c", 6, "  \n"), ("d", None, "Q: a?"), ("d", None, "A: b"), (None, 1, "AI: hello"), ("c", 4, "Assistant: Bye"),
    ]
    df = spark.createDataFrame([(*p, "x") for p in pieces], "conv string, turn int, piece string, role string")
    out = transcripts.parse_transcripts(df, "conv", "turn", "piece").collect()
    assert len(out) == len(pieces)
    roles = {r.turn: r.role for r in out if r.conv == "c"}
    assert [roles[i] for i in range(7)] == ["system", "user", "assistant", "user", "assistant", "assistant", "assistant"]
    text = {r.turn: r.rendered for r in out if r.conv == "c"}
    assert text[1] == "<|user|>\nWhat is it?\nAnd why?\n" and text[3] == "<|user|>\nThanks\n" and text[5] == ""
    assert transcripts.parse_transcripts(df.where("false"), "conv", "turn", "piece").count() == 0


def test_tables_of_blocks_are_joined_in_a_tree(spark, monkeypatch):
    """Sparse and negative places make a block of each piece; the blocks' tables are joined in groups of four."""
    monkeypatch.setattr(transcripts, "FAN", 4)
    monkeypatch.setattr(transcripts, "TOP", 4)
    rng, dense, sparse = random.Random(18), [], []
    for i in range(120):
        mark = ("User: " if i % 2 == 0 else "Assistant: ") if rng.random() < 0.4 else ""
        text = mark + sentence(4) + ("?" if rng.random() < 0.3 else "")
        dense.append(("c", i, text))
        sparse.append(("c", 1000 * i - 60_000, text))
    made = []
    for pieces in (dense, sparse):
        df = spark.createDataFrame([*pieces, ("d", 1, "User: a"), (None, 1, "AI: b")], "conv string, turn long, piece string").repartition(4)
        made.append([r[1:] for r in sorted(((r.conv or "", r.turn, r.role, r.begins, r.rendered) for r in transcripts.parse_transcripts(df, "conv", "turn", "piece").collect()), key=lambda r: (r[0], r[1]))])
    assert [r[1:] for r in made[0]] == [r[1:] for r in made[1]]


def test_a_long_conversation_is_the_same_in_blocks(spark, monkeypatch):
    rng, pieces = random.Random(8), []
    for i in range(300):
        role = "user" if i % 2 == 0 else "assistant"
        mark = {"user": "User: ", "assistant": "Assistant: "}[role] if rng.random() < 0.6 else ""
        pieces.append(("c", i, mark + sentence(3) + ("?" if rng.random() < 0.3 else "") + ("\n" + sentence(2)) * rng.randint(0, 2)))
    df = spark.createDataFrame(pieces, "conv string, turn int, piece string").repartition(4)
    made = []
    for block in (10_000, 16):
        monkeypatch.setattr(transcripts, "BLOCK", block)
        made.append(by_row(transcripts.parse_transcripts(df, "conv", "turn", "piece"), "turn", "role", "begins", "rendered"))
    assert made[0] == made[1]
    assert np.mean([r == ("user" if t % 2 == 0 else "assistant") for t, r, *_ in made[0]]) > 0.98
