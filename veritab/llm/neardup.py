"""Near-duplicates by a chosen-path set similarity join: documents branch by selected minwise tokens, small nodes are compared exhaustively, trees are repeated."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, full_windows, give_back, hash_words, mixed, scratch, sliced, split_words, stored, window_hashes
from .components import components

#: Nodes of more documents than this are met by a broadcast of their few rows, where other nodes' rows are shuffled by node.
LARGE = 4096
#: Nodes by rare shingle, in which few documents are compared with all, may hold so many documents and their full sets.
WIDE = 4096
_MULTIPLIERS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Join:
    """``percent``: the least similarity of linked sets. ``recall``: the least chance that a pair of just that similarity meets in a small node.

    A node has two children for each of its documents: two minwise tokens are selected in each node, and documents go on with those that agree. A pair of similarity s
    dies out on a way of ``depth`` levels with a chance of q(depth) = (1 - s + s q(depth - 1)) ** 2, so 1 - q ** trees is the recall.
    """

    percent: int = 75
    words: int = 5
    depth: int = 2
    recall: float = 0.999999
    node: int = 256

    @property
    def trees(self) -> int:
        s, q = self.percent / 100, 0.0
        for _ in range(self.depth):
            q = (1 - s + s * q) ** 2
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(q)))

    @property
    def tokens(self) -> int:
        """Minwise tokens of a document: those of the first ``depth`` levels of each tree, which trees don't share, and at least 48 for estimates."""
        return max(48, self.trees * (2 ** (self.depth + 1) - 2))

    def near(self, deviations: float) -> int:
        """Equal tokens that linked sets have at least, but for so many standard deviations."""
        s = self.percent / 100
        return max(1, math.floor(self.tokens * s - deviations * math.sqrt(self.tokens * s * (1 - s))))

    @property
    def agree(self) -> int:
        """Two linked sets have fewer equal tokens than this with a chance below one in a million: five standard deviations."""
        return self.near(5)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, in a row, and where each text's begin. A text of fewer than ``k`` words, but some, has one: all of it."""
    words, offsets = split_words(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    coded = words.dictionary_encode()
    hashes = hash_words(coded.dictionary)[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    counts = np.diff(offsets)
    starts = full_windows(offsets, k)
    shingles, owner = (window_hashes(hashes, k)[starts], np.repeat(np.arange(len(counts)), np.maximum(counts - k + 1, 0))) if len(starts) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.array([mixed(window_hashes(hashes[offsets[i] : offsets[i + 1]], int(counts[i])) + np.uint64(counts[i]))[0] for i in short.tolist()], np.uint64)
        shingles, owner = np.concatenate([shingles, whole]), np.concatenate([owner, short])
    order = np.argsort(shingles)
    order = order[np.argsort(owner[order], kind="stable")]
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    shingles, owner = shingles[new], owner[new]
    return shingles, np.searchsorted(owner, np.arange(len(counts) + 1))


def _signatures(docs: DataFrame, how: Join) -> DataFrame:
    """``id, set`` (a 128-bit name of the set; null if empty), ``n, tokens`` (minwise values) and ``sketch`` (a byte of each)."""
    kind = docs.schema["id"].dataType.simpleString()
    t = how.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            shingles, at = shingle_sets(batch.column("text"), how.words)
            n = np.diff(at)
            full = np.flatnonzero(n)
            tokens = np.zeros((len(full), t), np.int32)
            if len(full):
                with np.errstate(over="ignore"):
                    for j in range(t):
                        x = shingles * _MULTIPLIERS[j]
                        least = np.minimum.reduceat(x ^ (x >> np.uint64(32)), at[full])
                        tokens[:, j] = (mixed(least) >> np.uint64(33)).astype(np.int32)
            names: list[bytes | None] = [None] * len(n)
            every: list[np.ndarray | None] = [None] * len(n)
            sketches: list[bytes | None] = [None] * len(n)
            for row, i in enumerate(full.tolist()):
                names[i] = hashlib.md5(shingles[at[i] : at[i + 1]]).digest()
                every[i] = tokens[row]
                sketches[i] = tokens[row].astype(np.uint8).tobytes()
            out = [batch.column("id"), pa.array(names, pa.binary()), pa.array(n, pa.int64()), pa.array(every, pa.list_(pa.int32())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["id", "set", "n", "tokens", "sketch"])

    return docs.mapInArrow(run, f"id {kind}, set binary, n long, tokens array<int>, sketch binary")


def _first_nodes(sets: DataFrame, how: Join) -> DataFrame:
    """``node, v``: the nodes at ``depth`` of all trees that each document reaches."""
    keys, at = [], 0
    for tree in range(how.trees):
        paths = [[F.lit(tree)]]
        for _ in range(how.depth):
            longer = []
            level, at = at, at + 2 * len(paths)
            for i, path in enumerate(paths):
                longer += [[*path, F.lit(j), F.col("tokens")[j]] for j in (level + 2 * i, level + 2 * i + 1)]
            paths = longer
        keys += [F.xxhash64(*p) for p in paths]
    return sets.select(F.explode(F.array(*keys)).alias("node"), "v")


def told(rows: DataFrame, nodes: DataFrame, key: str = "node") -> DataFrame:
    """``rows`` with the columns of their node in ``nodes`` (``key``, ``size`` and others). ``rows`` aren't shuffled by node where ``nodes`` can be broadcast; beyond, those of the
    large nodes still aren't, as these are few: one for each `LARGE` rows at most. So no task reads the rows of a large node."""
    nodes = stored(nodes, "nodes")
    few = bounded(nodes)
    if few is not nodes:
        return rows.join(few, key)
    large = nodes.where(F.col("size") > LARGE)
    hot = rows.join(bounded(large), key)
    rest = rows.join(bounded(large.select(key)), key, "left_anti").join(nodes.where(F.col("size") <= LARGE), key)
    return hot.unionByName(rest)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``node``, cut and joined so that no node is in two of them."""
    pa.set_memory_pool(pa.system_memory_pool())
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column("node").to_numpy()
        last = int(np.flatnonzero(node != node[-1])[-1]) + 1 if node[0] != node[-1] else 0
        if last:
            yield pa.concat_batches([*rest, batch.slice(0, last)])
            rest = []
            give_back()
        elif rest and rest[0].column("node")[0].as_py() != int(node[0]):
            yield pa.concat_batches(rest)
            rest = []
        rest.append(batch.slice(last))
    if rest:
        yield pa.concat_batches(rest)


def _spans(node: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where each node of two rows or more begins and ends."""
    cuts = np.flatnonzero(np.diff(node)) + 1
    begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(node)]])
    many = end - begin > 1
    yield from zip(begin[many].tolist(), end[many].tolist(), strict=True)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _popularity(tokens: np.ndarray) -> np.ndarray:
    """How often each row's tokens occur at their places among the rows, summed: greatest for the row that is most like the others."""
    t = tokens.shape[1]
    flat = tokens + np.arange(t) * 256
    return np.bincount(flat.ravel(), minlength=256 * t)[flat].sum(axis=1)


def _stars(rows: DataFrame, how: Join) -> DataFrame:
    """``node, a, b, split``: in each node, documents with the one most like all of them (a leader) that they resemble; those that don't resemble it, with a leader of their own, and
    so on. Nodes of more than ``how.node`` documents are split by a hash; ``split`` tells so, and their leaders can meet in a node of leaders."""
    t, near, percent = how.tokens, how.near(1.5), how.percent
    kind = rows.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            tokens, n = _bytes(batch.column("sketch"), t), batch.column("n").to_numpy()
            left, right = [], []
            for lo, hi in _spans(batch.column("node").to_numpy()):
                open_ = np.arange(lo, hi)
                weight = _popularity(tokens[lo:hi]) if hi - lo > 2 else np.zeros(2)
                while len(open_) > 1:
                    first = open_[weight[open_ - lo].argmax()]
                    alike = ((tokens[open_] == tokens[first]).sum(axis=1) >= near) & (100 * np.minimum(n[open_], n[first]) >= percent * np.maximum(n[open_], n[first])) & (open_ != first)
                    left += [first] * int(alike.sum())
                    right += open_[alike].tolist()
                    open_ = open_[~alike & (open_ != first)]
            if left:
                v, first = batch.column("v"), pa.array(left)
                yield pa.RecordBatch.from_arrays([batch.column("whole").take(first), v.take(first), v.take(pa.array(right)), batch.column("split").take(first)], names=["node", "a", "b", "split"])

    parts = F.ceil(F.col("size") / how.node)
    chunk = F.when(parts > 1, F.xxhash64("node", F.pmod(F.xxhash64("v", F.lit("chunk")), parts))).otherwise(F.col("node"))
    dealt = rows.select(chunk.alias("node"), F.col("node").alias("whole"), "v", "n", "sketch", (parts > 1).alias("split"))
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(partitions, "node").sortWithinPartitions("node", "v").mapInArrow(run, f"node long, a {kind}, b {kind}, split boolean")


def _all_stars(rows: DataFrame, how: Join) -> DataFrame:
    """Pairs ``a, b`` of the stars of all nodes, of the leaders of nodes that were split, of their leaders, and so on."""
    pairs = None
    while True:
        made = stored(_stars(rows, how), "stars")
        own = made.select("a", "b")
        pairs = own if pairs is None else pairs.union(own)
        leaders = made.where("split").select("node", F.col("a").alias("v")).distinct()
        if not leaders.take(1):
            return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        leaders = stored(leaders.join(rows.select("node", "v", "n", "sketch"), ["node", "v"]), "leaders")
        rows = stored(told(leaders, leaders.groupBy("node").agg(F.count("*").alias("size"))), "leaders")


def _across(rows: DataFrame, how: Join) -> DataFrame:
    """Pairs ``a, b`` of all documents of a node that are in different components and may be linked: by their sizes, by the shingles that each shares with any other document
    (``shared``), and by their equal tokens."""
    t, agree, percent = how.tokens, how.agree, how.percent
    kind = rows.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            tokens, n, shared = _bytes(batch.column("sketch"), t), batch.column("n").to_numpy(), batch.column("shared").to_numpy()
            group = batch.column("component").dictionary_encode().indices.to_numpy()
            left, right = [], []
            for lo, hi in _spans(batch.column("node").to_numpy()):
                if (group[lo:hi] == group[lo]).all():
                    continue
                for first in range(lo, hi - 1):
                    others = np.arange(first + 1, hi)
                    others = others[group[others] != group[first]]
                    common = np.minimum(shared[others], shared[first])
                    others = others[(100 + percent) * common >= percent * (n[others] + n[first])]
                    others = others[(tokens[others] == tokens[first]).sum(axis=1) >= agree]
                    left += [first] * len(others)
                    right += others.tolist()
            if left:
                v = batch.column("v")
                yield pa.RecordBatch.from_arrays([v.take(pa.array(left)), v.take(pa.array(right))], names=["a", "b"])

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("node", "v", "n", "shared", "sketch", "component").repartition(partitions, "node").sortWithinPartitions("node", "v")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sets_of(docs: DataFrame, ids: DataFrame, how: Join) -> DataFrame:
    """``id, set``: the full sets of the documents with these ids. Only their texts are read into sets."""
    wanted = docs.join(bounded(ids), "id", "left_semi")
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            shingles, at = shingle_sets(batch.column("text"), how.words)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(shingles.view(np.int64)))], names=["id", "set"])

    return wanted.mapInArrow(run, f"id {kind}, set array<long>")


def _heads(full: DataFrame, rows: DataFrame, how: Join) -> DataFrame:
    """``v, component, shared, shingle``: the rarest shingles of the documents of ``rows`` (``node, v, n, component``), so many that linked documents have one in common; ``shared``
    counts a document's shingles that others have too.

    Of two linked sets of n and m shingles, percent * (n + m) / (100 + percent) are common, so with all shingles in one order, rarest first, the sets meet within the first
    n - that + 1. m is at least percent % of n, and at least the smallest set in a node of the document. Shingles that no other document has are left out: so documents of
    which that many are their own, such as copies that are edited too much, have no row. Rarity is counted by partial sums: a common shingle is no hot key.
    """
    with scratch() as keep:
        least = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("n").alias("least"))
        own = stored(told(rows.drop("size"), least).groupBy("v").agg(F.first("n").alias("n"), F.first("component").alias("component"), F.min("least").alias("least")), "own")
        sets = full.withColumnRenamed("id", "v")
        each = sets.join(bounded(own.select("v")), "v").select("v", F.explode("set").alias("shingle"))
        counts = stored(each.groupBy("shingle").agg(F.count("*").alias("docs"), F.min("v").alias("first")), "shingles")
        alone = counts.where("docs = 1").groupBy(F.col("first").alias("v")).agg(F.count("*").alias("alone"))
        common = F.ceil((F.col("n") + F.greatest("least", F.ceil(F.col("n") * how.percent / 100))) * how.percent / (100 + how.percent))
        known = own.join(alone, "v", "left").withColumn("alone", F.coalesce("alone", F.lit(0))).withColumn("meeting", F.col("n") - common + 1)
        able = stored(known.where("alone < meeting").select("v", "n", "component", "alone", "meeting"), "able")
        again = sets.join(bounded(able.select("v")), "v").select("v", F.explode("set").alias("shingle"))
        again = told(again, counts.where("docs > 1").select("shingle", F.col("docs").alias("size")), "shingle").withColumnRenamed("size", "docs")
        placed = again.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("docs", "shingle"))).join(bounded(able), "v")
        head = placed.where(F.col("place") + F.col("alone") <= F.col("meeting"))
        return keep(stored(head.select("v", "component", (F.col("n") - F.col("alone")).alias("shared"), "shingle"), "heads"))


def _branched(heads: DataFrame, large: DataFrame, full: DataFrame, how: Join) -> DataFrame:
    """Pairs ``a, b`` of the documents of large nodes, in nodes by rare shingle: documents of different components whose full sets are similar enough. Of a node's components, the
    documents outside the largest are each compared with all others. Nodes of over `WIDE` documents are cut into blocks, and each pair of blocks is a node."""
    mine = heads.join(bounded(large.select("v").distinct()), "v", "left_semi")
    met = stored(_mixed(mine.select(F.col("shingle").alias("node"), "v", "component")), "branched")
    blocks = _blocks(met.where(F.col("size") > WIDE), WIDE).select(*met.columns)
    rows = met.where(F.col("size") <= WIDE).unionByName(blocks).join(full.withColumnRenamed("id", "v"), "v")
    kind, percent = rows.schema["v"].dataType.simpleString(), how.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            sets = batch.column("set")
            values, at = sets.flatten().to_numpy(), sets.offsets.to_numpy() - sets.offsets[0].as_py()
            n, group = np.diff(at), batch.column("component").dictionary_encode().indices.to_numpy()
            left, right = [], []
            for lo, hi in _spans(batch.column("node").to_numpy()):
                kinds, counts = np.unique(group[lo:hi], return_counts=True)
                if len(kinds) == 1:
                    continue
                names, codes = np.unique(values[at[lo] : at[hi]], return_inverse=True)
                mask, begin = np.zeros(len(names), bool), at[lo:hi] - at[lo]
                for first in (np.flatnonzero(group[lo:hi] != kinds[counts.argmax()]) + lo).tolist():
                    own = codes[at[first] - at[lo] : at[first + 1] - at[lo]]
                    mask[own] = True
                    common = np.add.reduceat(mask[codes].astype(np.int64), begin)
                    mask[own] = False
                    others = np.flatnonzero((group[lo:hi] != group[first]) & ((100 + percent) * common >= percent * (n[lo:hi] + n[first]))) + lo
                    left += [first] * len(others)
                    right += others.tolist()
            if left:
                v = batch.column("v")
                yield pa.RecordBatch.from_arrays([v.take(pa.array(left)), v.take(pa.array(right))], names=["a", "b"])

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("node", "v", "component", "set").repartition(partitions, "node").sortWithinPartitions("node", "v")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _confirmed(pairs: DataFrame, full: DataFrame, how: Join) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = full.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = full.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    compared = pairs.join(left, "a").join(right, "b").select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b") - common).alias("union"))
    return compared.where(100 * F.col("common") >= how.percent * F.col("union")).select("a", "b")


def _blocks(rows: DataFrame, limit: int) -> DataFrame:
    """Nodes that are still large, in an exact way: each is cut into blocks, and each pair of blocks becomes a small node of its own."""
    count = F.ceil(F.col("size") / (limit // 2))
    mine = F.pmod(F.xxhash64("v", F.lit("block")), count)
    cut = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    return cut.select(F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"), *[c for c in rows.columns if c != "node"])


def links(docs: DataFrame, sets: DataFrame, how: Join) -> DataFrame:
    """Links ``a, b`` among the rows ``v, n, tokens, sketch`` of ``sets``, such that components by them are those by all links.

    Pairs within a component aren't compared once it is known: first each document meets its node's leader. Nodes that still hold several components are then freed of the
    documents that can't be linked with another component, having no rare shingle in common with it (`_heads`). In small nodes, documents of different components meet each
    other. The documents of large nodes, which are never gathered, branch once more, by their rarest shingles, where linked ones are sure to meet; nodes that are large
    even then are compared by pairs of blocks.
    """
    with scratch() as keep:
        met = stored(_distinct_nodes(_first_nodes(sets, how)).join(sets.select("v", "n", "sketch"), "v"), "met")
        full = stored(_sets_of(docs, met.select(F.col("v").alias("id")).distinct(), how), "sets")
        close = stored(_confirmed(_all_stars(met, how), full, how), "links")
        found = stored(components(close), "components")
        labelled = met.join(bounded(found), "v", "left").withColumn("component", F.coalesce("component", "v"))
        open_ = stored(_mixed(labelled), "open")
        heads = _heads(full, open_, how)
        several = heads.groupBy("shingle").agg(F.count("*").alias("size"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("shingle", "size")
        touching = told(heads, several, "shingle").select("v", "shared").distinct()
        able = stored(_mixed(open_.join(touching, "v")), "able")
        pairs = stored(_across(able.where(F.col("size") <= how.node), how).union(_branched(heads, able.where(F.col("size") > how.node), full, how)).distinct(), "pairs")
        return keep(stored(close.union(_confirmed(pairs, full, how)), "links"))


def _distinct_nodes(rows: DataFrame) -> DataFrame:
    """``node, v, size`` of the nodes with several documents; of nodes with the same documents, one."""
    each = rows.groupBy("node").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("v")).alias("x"), F.sum(F.hash("v").cast("long")).alias("s"), F.min("v").alias("m"))
    one = each.where("size > 1").groupBy("size", "x", "s", "m").agg(F.min("node").alias("node"))
    return told(rows, one.select("node", "size"))


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of nodes with more than one component, with the nodes' sizes."""
    nodes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return told(rows.drop("size"), nodes.select("node", "size"))


def near_duplicates(df: DataFrame, id_col: str, text_col: str, how: Join = Join()) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` of each row: components of documents whose sets of shingles have at least ``how.percent`` % in common.

    Words are A-Z lower-cased runs of other characters than ASCII white space; a set holds the distinct runs of ``how.words`` words, or the whole sequence if shorter. Null and
    empty texts have empty sets and are linked with nothing: each is its own component. ``component_id`` is the smallest id reachable; ``kept`` is true on its row.

    Rows with equal sets are one vertex, under the smallest of their ids; rows that repeat an id share its fate, so two equal rows are both kept. A null id has the
    component of its set, if a row with an id has that set too, else a null one; it is never kept. An empty table gives no rows. Other columns are ignored. A text is made into
    its set by one task, which holds some 60 bytes for each of its words.
    """
    docs = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    every = stored(_signatures(docs, how), "signatures")
    sets = stored(
        every.where("set is not null and id is not null").groupBy("set").agg(F.min("id").alias("v"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")), "sets"
    )
    linked = links(docs, sets.select("v", "n", "tokens", "sketch"), how)
    found = components(linked)
    classes = sets.select("set", "v").join(found, "v", "left").select("set", F.coalesce("component", "v").alias("component"))
    own = every.select("id", "set", "n").join(classes, "set", "left")
    component = F.when(F.col("set").isNull(), F.col("id")).otherwise(F.col("component"))
    return own.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
