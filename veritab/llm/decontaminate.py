"""Benchmark decontamination by a positional inverted index, with DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, row_key, stored

#: Characters that are in no word, after lower-casing A-Z.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOREIGN_CAPITAL = r"[\p{IsUppercase}\p{Lt}&&[^\x00-\x7F]]"


def words(text: Column) -> Column:
    """The words of a text: A-Z lower-cased and nothing else, then runs of letters a-z, digits and characters beyond ASCII. Null: no words.

    ``lower`` changes capitals beyond ASCII too, so texts that have some go through the slower ``translate``.
    """
    mixed_case = (F.octet_length(text) != F.length(text)) & text.rlike(_FOREIGN_CAPITAL)
    lowered = F.when(mixed_case, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))
    return F.coalesce(F.array_remove(F.split(lowered, _GAP), ""), F.array().cast("array<string>"))


def item_windows(items: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """``window`` (a number) and ``terms`` (its words) of each distinct window of ``width`` words, or shorter item; and ``window, item``: the ids, as
    strings, of the items that hold it, a row for each."""
    listed = items.select(F.coalesce(items[id_col].cast("string"), F.lit("")).alias("item"), words(items[text_col]).alias("w")).where(F.size("w") > 0)
    first = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1))))
    each = listed.select("item", "w", first.alias("first")).select("item", F.slice("w", F.col("first"), width).alias("terms")).distinct()
    windows = stored(each.select("terms").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    return windows, stored(each.join(bounded(windows), "terms").select("window", "item"), "holders")


def term_counts(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """How often each word of the windows occurs in the texts of ``docs``, over all of them; words that don't occur count 0."""
    asked = stored(windows.select(F.explode("terms").alias("term")).distinct(), "asked")
    seen = docs.select(F.explode(words(F.col("text"))).alias("term")).join(bounded(asked), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    return stored(asked.join(seen, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n")), "terms")


def rarest(windows: DataFrame, counts: DataFrame, how_many: int) -> DataFrame:
    """``window, term, place, rank, n_ranks``: each window's rarest terms, at the first place there, the rarest of rank 1. Windows with a term that
    occurs nowhere have no row."""
    placed = windows.select("window", F.posexplode("terms").alias("place", "term")).groupBy("window", "term").agg(F.min("place").alias("place"))
    order = Window.partitionBy("window").orderBy("n", "term")
    whole = Window.partitionBy("window")
    ranked = placed.join(counts, "term").withColumn("rank", F.row_number().over(order)).withColumn("least", F.min("n").over(whole))
    kept = ranked.where((F.col("rank") <= how_many) & (F.col("least") > 0))
    return kept.withColumn("n_ranks", F.max("rank").over(whole)).select("window", "term", "place", "rank", "n_ranks")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: ``term, key, at``, a row for each place (from 0) of a term in a document."""
    placed = docs.select("key", F.posexplode(words(F.col("text"))).alias("at", "term"))
    return placed.join(bounded(terms), "term").select("term", "key", "at")


def intersected(index: DataFrame, anchors: DataFrame, slop: int) -> DataFrame:
    """``key, window, start``: where the postings of all of a window's anchors meet, once each list is shifted back by its term's place in the window.

    The list of the rarest term gives the candidates; each is then sought in the lists of the other terms, by document, term and place, at most ``slop``
    places off. Lists are joined on a hash of the three: its rare collisions let a candidate pass, which the comparison with the text then tells apart.
    """
    first = anchors.where("rank = 1").select("window", "term", "place", "n_ranks")
    found = index.join(bounded(first), "term").select("key", "window", (F.col("at") - F.col("place")).alias("start"), "n_ranks")
    found = found.where("start >= 0") if not slop else found
    others = anchors.where("rank > 1").select("window", "term", "place", "rank")
    off = F.explode(F.array(*map(F.lit, range(-slop, slop + 1))))
    asked = found.join(bounded(others), "window").select("key", "window", "start", "n_ranks", "rank", "term", (F.col("start") + F.col("place")).alias("due"), off.alias("off"))
    asked = asked.select("key", "window", "start", "n_ranks", "rank", F.xxhash64("key", "term", F.col("due") + F.col("off")).alias("h"))
    listed = index.join(bounded(others.select("term").distinct()), "term", "left_semi").select(F.xxhash64("key", "term", "at").alias("h"))
    met = asked.join(listed, "h", "left_semi").groupBy("key", "window", "start", "n_ranks").agg(F.bit_count(F.bit_or(F.expr("1L << rank"))).alias("ranks"))
    return met.where("ranks = n_ranks - 1").select("key", "window", "start").union(found.where("n_ranks = 1").select("key", "window", "start").distinct())


def matches(docs: DataFrame, windows: DataFrame, anchors: int = 3, slop: int = 0) -> DataFrame:
    """``key, window, start, n_terms, kind``: where windows occur in the rows of ``docs`` (columns ``key`` and ``text``).

    The index holds the postings of each window's ``anchors`` rarest terms, counted over all documents; shifted lists are intersected (`intersected`).
    Only what survives is compared with the text: ``kind`` is ``phrase`` where all words of the window follow each other as in it, else ``proximity``: its
    rarest terms lie together, each within ``slop`` places of where the phrase that begins at ``start`` has it (the rarest one exactly there).
    """
    chosen = stored(rarest(windows, term_counts(docs, windows), anchors), "anchors")
    index = stored(postings(docs, chosen.select("term").distinct()), "postings")
    met = stored(intersected(index, chosen, slop).groupBy("key").agg(F.collect_list(F.struct("start", "window")).alias("met")), "met")
    read = docs.join(bounded(met.select("key")), "key", "left_semi").dropDuplicates(["key"])
    each = read.select("key", words(F.col("text")).alias("w")).join(met, "key").select("key", "w", F.explode("met").alias("m"))
    there = F.when(F.col("m.start") >= 0, F.slice("w", F.greatest(F.col("m.start") + 1, F.lit(1)), F.size("terms")) == F.col("terms"))
    seen = each.join(bounded(windows).withColumnRenamed("window", "own"), F.col("own") == F.col("m.window"))
    kind = F.when(F.coalesce(there, F.lit(False)), "phrase").otherwise("proximity")
    found = seen.select("key", "m.window", "m.start", F.size("terms").alias("n_terms"), kind.alias("kind"))
    return found if slop else found.where("kind = 'phrase'")


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, width: int = 10, anchors: int = 3, slop: int = 0
) -> DataFrame:
    """``key`` (see `row_key`), ``n_hit`` (words inside any phrase found), ``hit_items`` (ids as strings, sorted) and ``n_near`` (windows found in
    proximity, counted once for each place where they would begin) of each document with a match."""
    windows, holders = item_windows(items, item_id_col, item_text_col, width)
    indexed = docs.select(row_key(id_col, text_col).alias("key"), docs[text_col].cast("string").alias("text"))
    found = stored(matches(indexed, windows, anchors, slop), "matches")
    phrases = found.where("kind = 'phrase'")
    spans = phrases.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "n_terms"))).alias("spans"))
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["start"] + x["n_terms"] - F.greatest(acc["end"], x["start"]), F.lit(0))).alias("n"),
            F.greatest(acc["end"], x["start"] + x["n_terms"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    held = phrases.select("key", "window").distinct().join(bounded(holders), "window").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("hit_items"))
    near = found.where("kind = 'proximity'").groupBy("key").agg(F.count("*").alias("n_near"))
    whole = spans.select("key", union.cast("long").alias("n_hit")).join(held, "key").join(near, "key", "full")
    return whole.select("key", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "hit_items", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def report(
    docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, width: int = 10, anchors: int = 3, slop: int = 2
) -> DataFrame:
    """``id_col, n_words, n_hit, n_items, items_sha256, contaminated`` of each document, all of phrases; and ``n_near``, of matches in proximity.

    Null and empty texts have no words and no hits; items without words are never found; an item of fewer than ``width`` words is one window. Repeated documents are
    reported alike, and repeated items count once by id; a null item id counts as the empty string. Empty tables give no rows, or no hits. Other columns are ignored.
    A text is split by one task, which holds its words: some 60 bytes for each.
    """
    hits = contamination(docs, items, id_col, text_col, item_id_col, item_text_col, width, anchors, slop)
    every = docs.select(docs[id_col].alias("__id"), row_key(id_col, text_col).alias("key"), F.size(words(docs[text_col])).cast("long").alias("n_words"))
    found = F.coalesce("hit_items", F.array().cast("array<string>"))
    return every.join(hits, "key", "left").select(
        F.col("__id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, width: int = 10, anchors: int = 3) -> DataFrame:
    """The documents in which no window of an item occurs, with their columns as they are."""
    hits = contamination(docs, items, id_col, text_col, item_id_col, item_text_col, width, anchors).where("n_hit > 0")
    named = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), row_key(id_col, text_col).alias("key"))
    return named.join(hits.select("key"), "key", "left_anti").select("row.*")
