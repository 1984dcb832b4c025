"""Repeated passages by super-k-mers: windows of words that share a minimiser travel as one packed string to its bucket, where sorting counts them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import covered, full_windows, hash_words, mixed, sliced, split_words, stored, sums, window_hashes

#: Words in a minimiser.
MINIMISER = 4
#: A super-k-mer's table is built from slices of so many bytes; equal strings of a slice travel once.
MAP_BYTES = 8 << 20
#: There are so many buckets that each has about so many bytes of packed strings.
BUCKET_BYTES = 4 << 20
#: A bucket with more than so many times those bytes is hot: the windows of its minimisers travel alone.
HOT = 4
#: Strings of a bucket that have come in are merged with equal ones once they are so many bytes.
MERGE_BYTES = 16 << 20


@dataclass
class Runs:
    """The super-k-mers of a row of texts: first word, number of windows, and bucket."""

    first: np.ndarray
    windows: np.ndarray
    bucket: np.ndarray


@dataclass(frozen=True)
class Deal:
    """How minimisers are dealt to buckets: by their hash, but those of the ``hot`` buckets (sorted), whose windows are dealt by their own hashes."""

    buckets: int
    hot: np.ndarray

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return (mixed(hashes) % np.uint64(self.buckets)).astype(np.int64)


def super_kmers(hashes: np.ndarray, offsets: np.ndarray, k: int, deal: Deal) -> Runs:
    """Maximal runs of consecutive windows of a text whose minimisers are equal. Windows with a minimiser of a hot bucket go alone, each to the bucket of its own hash."""
    starts = full_windows(offsets, k)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Runs(none, none, none)
    m = min(MINIMISER, k)
    least, width, want = window_hashes(hashes, m), 1, k - m + 1
    while width < want:
        shift = min(width, want - width)
        least = np.minimum(least[:-shift], least[shift:])
        width += shift
    value = least[starts]
    begins = np.ones(len(starts), bool)
    begins[1:] = (starts[1:] != starts[:-1] + 1) | (value[1:] != value[:-1])
    at = np.flatnonzero(begins)
    bucket = deal(value[at])
    if len(deal.hot):
        alone = np.isin(bucket, deal.hot)
        each = np.repeat(alone, np.diff(np.append(at, len(starts))))
        at = np.flatnonzero(begins | each)
        bucket = deal(value[at])
        own = each[at]
        bucket[own] = deal(window_hashes(hashes, k)[starts[at[own]]])
    return Runs(starts[at], np.diff(np.append(at, len(starts))), bucket)


class Slice:
    """The words of a slice of texts, their super-k-mers and the packed strings."""

    def __init__(self, texts: pa.Array, k: int, deal: Deal):
        words, self.offsets = split_words(texts)
        coded = words.dictionary_encode()
        self.hashes = hash_words(coded.dictionary)[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
        self.runs, self.words, self.k = super_kmers(self.hashes, self.offsets, k, deal), words, k

    def packed(self) -> list[bytes]:
        spaced = pc.binary_join_element_wise(self.words.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        if not len(spaced):
            return []
        at = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset :]
        data = spaced.buffers()[2].to_pybytes()
        a, b = at[self.runs.first], at[self.runs.first + self.runs.windows + self.k - 1] - 1
        return [data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def _deal(texts: DataFrame, k: int) -> Deal:
    """As many buckets as the bytes of all texts ask for, and those that are hot: every slice tells how many bytes of distinct strings it has for each bucket, and sums of all
    of them are compared. A hot bucket has `HOT` times the average share, so but a small part of the buckets' numbers come to the driver."""
    total = texts.agg(F.sum(F.octet_length("__text").cast("long"))).first()[0] or 0
    runs = 1 + 2 * k / (k - min(MINIMISER, k) + 2)  # a run of windows holds half as many words as a window in new ones, and a window's that its neighbours hold too
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    start = Deal(max(1, math.ceil(total * runs / BUCKET_BYTES / partitions)) * partitions, np.zeros(0, np.int64))  # as many for each partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "__text", MAP_BYTES):
            s = Slice(batch.column("__text"), k, start)
            if not len(s.runs.first):
                continue
            ends = window_hashes(s.hashes, k)
            with np.errstate(over="ignore"):
                name = mixed(ends[s.runs.first] ^ mixed(ends[s.runs.first + s.runs.windows - 1] + s.runs.windows.astype(np.uint64)))
            _, one = np.unique(name, return_index=True)
            at = np.concatenate([[0], np.cumsum(pc.binary_length(s.words).to_numpy().astype(np.int64) + 1)])
            size = at[s.runs.first + s.runs.windows + k - 1] - at[s.runs.first]
            bucket, place = np.unique(s.runs.bucket[one], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.bincount(place, weights=size[one]).astype(np.int64))], names=["bucket", "n"])

    loads = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = loads.where(F.col("n") > HOT * BUCKET_BYTES).select("bucket").collect()
    return Deal(start.buckets, np.sort(np.array([r[0] for r in found], np.int64)))


def repeated_windows(strings: pa.Array, times: np.ndarray, k: int) -> list[tuple[int, list[int]]]:
    """Of distinct packed strings that occur ``times`` times: the index of each that holds a repeated window, and first window and number of each run of them."""
    words, offsets = split_words(strings)
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy()
    starts = full_windows(offsets, k)
    if not len(starts):
        return []
    key = window_hashes(hash_words(coded.dictionary)[ids], k)[starts]
    owner = np.repeat(np.arange(len(strings)), np.diff(offsets) - k + 1)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    same = sorted_key[1:] == sorted_key[:-1]
    pair = np.flatnonzero(same)
    equal = np.ones(len(pair), bool)
    a, b = starts[order[pair]], starts[order[pair + 1]]
    for j in range(k):
        equal &= ids[a + j] == ids[b + j]
    if not equal.all():  # different windows of one hash: order that hash's windows by their words
        for value in np.unique(sorted_key[pair[~equal]]):
            lo, hi = np.searchsorted(sorted_key, [value, value], "left")[0], np.searchsorted(sorted_key, value, "right")
            mine = sorted(order[lo:hi].tolist(), key=lambda i: ids[starts[i] : starts[i] + k].tolist())
            order[lo:hi] = mine
            same[lo : hi - 1] = [np.array_equal(ids[starts[x] : starts[x] + k], ids[starts[y] : starts[y] + k]) for x, y in zip(mine[:-1], mine[1:], strict=True)]
    group = np.concatenate([[0], np.cumsum(~same)])
    total = np.bincount(group, weights=times[owner[order]])
    again = np.zeros(len(starts), bool)
    again[order] = total[group] >= 2
    hit = np.flatnonzero(again)
    if not len(hit):
        return []
    cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)) + 1
    first, last = hit[np.concatenate([[0], cut])], hit[np.concatenate([cut - 1, [len(hit) - 1]])]
    out: dict[int, list[int]] = {}
    for who, at, n in zip(owner[first].tolist(), (starts[first] - offsets[owner[first]]).tolist(), (last - first + 1).tolist(), strict=True):
        out.setdefault(who, []).extend((at, n))
    return list(out.items())


class Bucket:
    """The distinct strings of a bucket and whether each came once or more often. Equal strings are merged as they come in, so their number doesn't count."""

    def __init__(self) -> None:
        self.strings, self.times = pa.array([], pa.large_binary()), np.zeros(0)
        self.new: list[bytes] = []
        self.new_times: list[np.ndarray] = []
        self.size, self.unpack = 0, zstandard.ZstdDecompressor()

    def add(self, packed: bytes, twice: bytes) -> None:
        own = self.unpack.decompress(packed)
        strings = own.split(b"\n")
        self.new += strings
        self.new_times.append(np.unpackbits(np.frombuffer(twice, np.uint8), count=len(strings)) + 1)
        self.size += len(own)
        if self.size > MERGE_BYTES:
            self.merge()

    def merge(self) -> None:
        coded = pa.concat_arrays([self.strings, pa.array(self.new, pa.large_binary())]).dictionary_encode()
        self.times = np.minimum(np.bincount(coded.indices.to_numpy(), weights=np.concatenate([self.times, *self.new_times])), 2)
        self.strings, self.new, self.new_times, self.size = coded.dictionary, [], [], 0

    def repeats(self, k: int) -> pa.RecordBatch | None:
        if self.new:
            self.merge()
        found = repeated_windows(self.strings.cast(pa.large_string()), self.times, k) if len(self.strings) else []
        if not found:
            return None
        sids = pa.array([xxhash.xxh3_128_digest(self.strings[i].as_py()) for i, _ in found], pa.binary())
        return pa.RecordBatch.from_arrays([sids, pa.array([x for _, x in found], pa.list_(pa.int32()))], names=["sid", "runs"])


def _repeats(texts: DataFrame, k: int, deal: Deal, partitions: int) -> DataFrame:
    """``sid`` (a 128-bit name of a packed string) and ``runs`` of its repeated windows."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches, "__text", MAP_BYTES):
            s = Slice(batch.column("__text"), k, deal)
            if not len(s.runs.first):
                continue
            coded = pa.array(s.packed(), pa.large_binary()).dictionary_encode()
            index = coded.indices.to_numpy()
            twice = np.bincount(index) > 1
            bucket = np.zeros(len(twice), np.int64)
            bucket[index] = s.runs.bucket
            order = np.argsort(bucket, kind="stable")
            strings = coded.dictionary.to_pylist()
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            out: tuple[list, ...] = ([], [], [])
            for mine in np.split(order, cuts):
                out[0].append(int(bucket[mine[0]]))
                out[1].append(pack.compress(b"\n".join([strings[i] for i in mine.tolist()])))
                out[2].append(np.packbits(twice[mine]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["bucket", "strings", "twice"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, mine = None, Bucket()
        for batch in batches:
            for b, packed, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    if (out := mine.repeats(k)) is not None:
                        yield out
                    bucket, mine = b, Bucket()
                mine.add(packed, twice)
        if (out := mine.repeats(k)) is not None:
            yield out

    sent = texts.mapInArrow(send, "bucket long, strings binary, twice binary")
    return sent.repartitionById(partitions, (F.col("bucket") % partitions).cast("int")).sortWithinPartitions("bucket").mapInArrow(meet, "sid binary, runs array<int>")


def remove_repeats(df: DataFrame, id_col: str, text_col: str, width: int = 35) -> DataFrame:
    """The rows of ``df`` with ``n_words``, ``n_removed``, ``kept_text`` and ``kept_sha256`` beside the untouched columns, in a struct ``row``.

    Words are runs of other characters than ASCII white space. Each word goes that lies in a window of ``width`` words whose sequence starts anywhere else too, in any
    row's text or the same; windows are judged on the input. ``kept_text`` is the text itself where nothing goes, else the kept words joined by one space.

    Null and empty texts have no words and stay as they are; texts of fewer than ``width`` words have no window; repeated rows count as copies, so their long texts go.
    An empty table gives no rows. Columns of ``df`` may have any names, since they travel in ``row``.

    Three passes over the texts: one measures the buckets, one sends the packed strings (equal ones of a slice once), one names the strings of each row to look them up. No
    task holds a copy group: strings are counted without their rows, and the look-up is a join on the string's name with one row on the other side, which can be split. Rows
    that agree in id and text share one list of what goes. A text is split by one task, which holds some 100 bytes for each of its words.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(df[text_col].cast("string").alias("__text"))
    deal = _deal(texts, width)
    found = stored(_repeats(texts, width, deal, partitions), "repeats")
    named = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[id_col].cast("string").alias("__id"), df[text_col].cast("string").alias("__text"))
    key = F.struct(F.xxhash64("__id", "__text").alias("a"), F.xxhash64("__text", F.lit(1), "__id").alias("b"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "__text", MAP_BYTES):
            s = Slice(batch.column("__text"), width, deal)
            if not len(s.runs.first):
                continue
            row = np.searchsorted(s.offsets, s.runs.first, "right") - 1
            sids = pa.array(list(map(xxhash.xxh3_128_digest, s.packed())), pa.binary())
            who = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(who), batch.column("b").take(who), pa.array(s.runs.first - s.offsets[row]), sids], names=["a", "b", "first", "sid"])

    places = named.where(F.length("__text") >= 2 * width - 1).select(key["a"].alias("a"), key["b"].alias("b"), "__text").mapInArrow(name, "a long, b long, first long, sid binary")
    gone = places.join(found, "sid").groupBy("a", "b").agg(F.collect_set(F.struct("first", "runs")).alias("gone"))
    dealt = named.select("row", key["a"].alias("a"), key["b"].alias("b")).join(gone, ["a", "b"], "left")
    rows = dealt.select("row", F.col("row")[text_col].cast("string").alias("__text"), "gone")  # a text travels once, in its row
    kind = rows.schema["row"].dataType.simpleString()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "__text"):
            words, offsets = split_words(batch.column("__text"))
            starts, widths = [], []
            for i, found in enumerate(batch.column("gone").to_pylist()):
                for x in found or ():
                    for at, n in zip(x["runs"][::2], x["runs"][1::2], strict=True):
                        starts.append(offsets[i] + x["first"] + at)
                        widths.append(n + width - 1)
            lost = covered(len(words), np.array(starts, np.int64), np.array(widths, np.int64))
            n_removed = sums(lost, offsets)
            left, kept_at = words.filter(pa.array(~lost)), np.concatenate([[0], np.cumsum(~lost)])[offsets]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept_at, pa.int32()), left), " ").to_pylist()
            texts = [t if not n else j for t, n, j in zip(batch.column("__text").to_pylist(), n_removed.tolist(), joined, strict=True)]
            out = [pa.array(np.diff(offsets)), pa.array(n_removed), pa.array(texts, pa.string()), pa.array([hashlib.sha256(j.encode()).hexdigest() for j in joined])]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *out], names=["row", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return rows.mapInArrow(take, f"row {kind}, n_words long, n_removed long, kept_text string, kept_sha256 string")
