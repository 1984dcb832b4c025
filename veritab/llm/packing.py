"""Best-fit packing by the configuration linear program over the length histogram: multiplicative weights with knapsack pricing solve it, the solution is rounded, the rest filled up."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, sliced, stored


#: The program's weights: how far they fall as a length is covered, the share of a length that a round may cover, and the rounds.
ETA, STEP, ROUNDS = 3.0, 0.1, 100

#: `solve` rounds these shares of the program's solution, leaves the rest to `filled`, and keeps the packing of the fewest sequences.
SHARES = (0.95, 0.8)


def knapsack(worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each capacity 0..``capacity``, the greatest worth of lengths that fit, each any number of times, and the last length taken (0: none), by dynamic programming."""
    lengths = np.flatnonzero(worth[: capacity + 1] > 0)
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    if len(lengths):
        value = worth[lengths]
        for c in range(int(lengths[0]), capacity + 1):
            fit = int(np.searchsorted(lengths, c, "right"))
            got = value[:fit] + best[c - lengths[:fit]]
            i = int(got.argmax())
            if got[i] > best[c - 1]:
                best[c], pick[c] = got[i], lengths[i]
            else:
                best[c] = best[c - 1]
    return best, pick


def taken(pick: np.ndarray, c: int) -> list[int]:
    """The lengths that `knapsack` takes for capacity ``c``."""
    out = []
    while c > 0:
        if pick[c]:
            out.append(int(pick[c]))
            c -= out[-1]
        else:
            c -= 1
    return out


def best_pattern(worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of lengths 1..capacity that is worth most and fits, as numbers of each; ``worth[l]`` is that of length ``l``."""
    best, pick = knapsack(worth, capacity)
    return float(best[capacity]), np.bincount(taken(pick, capacity), minlength=capacity + 1)


def fractional(histogram: np.ndarray, capacity: int, eta: float = ETA, step: float = STEP, rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], float]:
    """The configuration program by multiplicative weights: patterns (lengths, longest first) and how often each is used, so that all lengths are covered, and a lower bound.

    A length's price is its share of the capacity times its weight, exp(-``eta`` * the share of its number that is covered); those wholly covered cost nothing. A round prices
    all patterns by one `knapsack`, which also tells the pattern of the greatest price around each length: from the longest on, each is used until one of its lengths has
    ``step`` of its number covered in this round. Then the weights fall. So common and rare lengths are covered at the same pace, and short ones aren't used up before the
    long ones that need them. Prices over the greatest price of a pattern are a solution of the dual, whose worth bounds all packings. What ``rounds`` leave uncovered is
    left to rounding.
    """
    demand, lengths = histogram.astype(float), np.arange(capacity + 1)
    left, bound = demand.copy(), 0.0
    used: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        open_ = left > 1e-9
        if not open_.any():
            break
        price = lengths / capacity * np.exp(-eta * (1 - left / np.maximum(demand, 1))) * open_
        best, pick = knapsack(price, capacity)
        bound = max(bound, float(price @ demand) / best[capacity])
        quota = np.minimum(left, step * demand)
        for top in np.flatnonzero(open_)[::-1].tolist():
            if quota[top] <= 1e-9:
                continue
            pattern = tuple(sorted([top, *taken(pick, capacity - top)], reverse=True))
            inside, times = np.unique(pattern, return_counts=True)
            n = float((quota[inside] / times).min())
            if n > 1e-9:
                quota[inside] -= n * times
                left[inside] -= n * times
                used[pattern] = used.get(pattern, 0.0) + n
    return used, bound


def rounded(used: dict[tuple[int, ...], float], histogram: np.ndarray, share: float) -> dict[tuple[int, ...], int]:
    """Whole numbers for ``share`` of each pattern's use, nowhere more than there is of a length: in the order of patterns, the running total is rounded down, so that each
    longest length gets its due however many patterns it is spread over."""
    left, out = histogram.copy(), {}
    total, done = 0.0, 0
    for pattern, n in sorted(used.items(), reverse=True):
        total += share * n
        due = int(total + 1e-9) - done
        done += due
        inside, times = np.unique(pattern, return_counts=True)
        due = min(due, int((left[inside] // times).min()))
        if due > 0:
            left[inside] -= due * times
            out[pattern] = due
    return out


def filled(left: np.ndarray, capacity: int) -> dict[tuple[int, ...], int]:
    """What rounding left: patterns priced around the longest length not yet covered, each used until one of its lengths is covered, rounded down, and the rest by best fit;
    or best fit for all of it, if that takes fewer sequences."""
    lengths, rest, open_ = np.arange(capacity + 1), left.copy(), left.astype(float)
    out: dict[tuple[int, ...], int] = {}
    while (open_ > 1e-9).any():
        top = int(np.flatnonzero(open_ > 1e-9)[-1])
        price = lengths / capacity * np.exp(-0.05 * (1 - open_ / np.maximum(left, 1))) * (open_ > 1e-9)
        pattern = best_pattern(price, capacity - top)[1] if top < capacity else np.zeros(1, np.int64)
        pattern = np.append(pattern, np.zeros(capacity + 1 - len(pattern), np.int64))
        pattern[top] += 1
        inside = pattern > 0
        times = float((open_[inside] / pattern[inside]).min())
        open_[inside] -= times * pattern[inside]
        n = int(min(times + 1e-9, (rest[inside] // pattern[inside]).min()))
        if n > 0:
            rest -= n * pattern
            key = tuple(np.repeat(lengths, pattern)[::-1].tolist())
            out[key] = out.get(key, 0) + n
    out = added(out, best_fit(rest, capacity))
    plain = best_fit(left, capacity)
    return out if sum(out.values()) < sum(plain.values()) else plain


def added(a: dict[tuple[int, ...], int], b: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], int]:
    return {key: a.get(key, 0) + b.get(key, 0) for key in [*a, *(k for k in b if k not in a)]}


def least_sequences(histogram: np.ndarray, capacity: int) -> int:
    """Sequences that no packing can do without, by feasible prices (the dual of the configuration program): for any t up to half the capacity, lengths above capacity - t
    are worth a sequence, those from t on their share of one, and shorter ones nothing, if that is more than all lengths by their shares; likewise for lengths above a half."""
    lengths = np.arange(capacity + 1)
    best = -(-int(histogram @ lengths) // capacity)
    number = np.concatenate([[0], np.cumsum(histogram)])
    volume = np.concatenate([[0], np.cumsum(histogram * lengths)])
    half = capacity // 2
    above_half = int(number[-1] - number[half + 1])
    for t in range(half + 1):
        alone = int(number[-1] - number[capacity - t + 1])
        beside = above_half - alone
        rest = int(volume[half + 1] - volume[t])
        room = beside * capacity - int(volume[capacity - t + 1] - volume[half + 1])
        best = max(best, alone + beside + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(left: np.ndarray, capacity: int) -> dict[tuple[int, ...], int]:
    """Best-fit decreasing over what rounding left: patterns (lengths, longest first) and their numbers. Equal sequences are packed together."""
    room: list[int] = []  # distinct free spaces, sorted
    bins: dict[int, dict[tuple[int, ...], int]] = {}

    def put(free: int, pattern: tuple[int, ...], n: int) -> None:
        if free not in bins:
            bins[free] = {}
            insort(room, free)
        bins[free][pattern] = bins[free].get(pattern, 0) + n

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            i = bisect_left(room, length)
            if i == len(room):
                each = capacity // length
                if n // each:
                    put(capacity - each * length, (length,) * each, n // each)
                if n % each:
                    put(capacity - (n % each) * length, (length,) * (n % each), 1)
                break
            free = room[i]
            pattern, have = bins[free].popitem()
            each = min(free // length, n)
            k = min(have, n // each)
            if have > k:
                bins[free][pattern] = have - k
            if not bins[free]:
                del bins[free]
                room.pop(i)
            put(free - each * length, pattern + (length,) * each, k)
            n -= k * each
    out: dict[tuple[int, ...], int] = {}
    for group in bins.values():
        for pattern, n in group.items():
            out[pattern] = out.get(pattern, 0) + n
    return out


@dataclass(frozen=True)
class Packing:
    """Patterns and how often each is used, and the sequences that no packing can do without."""

    patterns: dict[tuple[int, ...], int]
    least: int

    @property
    def sequences(self) -> int:
        return sum(self.patterns.values())


def solve(histogram: np.ndarray, capacity: int, shares: tuple[float, ...] = SHARES) -> Packing:
    """Packs ``histogram[l]`` pieces of each length ``l``: the configuration program's solution (`fractional`), of which ``shares`` are `rounded` and the rest is `filled`; the
    packing of the fewest sequences stays. Pieces of the whole capacity are sequences of their own."""
    histogram = histogram.astype(np.int64)
    full, open_ = int(histogram[capacity]), histogram.copy()
    open_[capacity] = 0
    used, bound = fractional(open_, capacity)
    least = max(least_sequences(histogram, capacity), full + math.ceil(bound - 1e-6))
    best: dict[tuple[int, ...], int] | None = None
    for share in shares:
        patterns, left = rounded(used, open_, share), open_.copy()
        for pattern, n in patterns.items():
            np.subtract.at(left, list(pattern), n)
        patterns = added(patterns, filled(left, capacity))
        if best is None or sum(patterns.values()) < sum(best.values()):
            best = patterns
        if sum(best.values()) + full <= least:
            break
    best = best or {}
    return Packing(added(best, {(capacity,): full}) if full else best, least)


def slots(packing: Packing, capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset, number): ranks from ``first rank`` on go to consecutive sequences at that offset."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    rank, first = np.zeros(capacity + 1, np.int64), 0
    for pattern, n in sorted(packing.patterns.items(), reverse=True):
        at = 0
        for length in pattern:
            out.setdefault(length, []).append((int(rank[length]), first, at, n))
            rank[length] += n
            at += length
        first += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


class Encoder:
    """Ids of a byte-level ``tokenizers`` file. Texts of ordinary characters are encoded by the same ranks in ``tiktoken``, where that gives the same ids several times
    faster (its rank file must lie beside); texts that hold a special token or rarer characters by ``tokenizers`` itself."""

    def __init__(self, path: str):
        import base64
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        ranks_path = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks_path):
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            # Fixed value: the pattern by which the byte-level file cuts texts into words.
            pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            # Letters, digits and signs on which any two versions of Unicode agree.
            self.odd = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏΑ-ωА-я‐-‧€]|<\\|")

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or self.odd.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """``__id, piece, start, length, ids_crc32``: each document's ids and an end id, cut into pieces of ``capacity`` from its end, so that only the first may be shorter."""
    rows = df.select(df[id_col].alias("__id"), df[text_col].alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        for batch in sliced(batches, "__text"):
            who, piece, start, size, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("__text").to_pylist()):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    who.append(i)
                    piece.append(j)
                    start.append(a)
                    size.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            out = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("__id").take(pa.array(who)), *out], names=["__id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"__id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(df: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32, sequence_id, offset`` of each piece (see `pieces`).

    The histogram of lengths, ``capacity`` numbers, goes to the driver, which packs it (`solve`). Each length's pieces are ranked without gaps (`ranked`), however many share
    it, and a piece's rank tells its place; the table of places has a few thousand rows and is broadcast.

    Null and empty texts are a lone end id. Repeated rows are packed as rows of their own. An empty table gives no rows. Other columns are ignored, whatever their names.
    A text is encoded by one task, which holds its ids.
    """
    cut = stored(pieces(df, id_col, text_col, tokenizer, capacity, end_id), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():
        histogram[row["length"]] = row["count"]
    shared = df.sparkSession.sparkContext.broadcast(slots(solve(histogram, capacity), capacity))
    draw = F.xxhash64("__id", "piece", "ids_crc32", "start").bitwiseAND(0xFFFFFFFF)
    placed = ranked(cut.withColumn("__draw", draw), "length", "__draw").select("__id", "piece", "start", "length", "ids_crc32", "__rank")
    kind = placed.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                mine, table = np.flatnonzero(length == value), by_length[int(value)]
                row = table[np.searchsorted(table[:, 0], rank[mine], "right") - 1]
                sequence[mine], offset[mine] = row[:, 1] + rank[mine] - row[:, 0], row[:, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["__id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return placed.mapInArrow(run, f"__id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("__id", id_col)
