"""Greedy word-piece lengths by a longest-match automaton: no pieces are built."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced, split_words

#: A worker remembers the lengths of so many distinct words at most; then it starts anew.
MEMORY = 300_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces that begin a word, and pieces that continue one (written without their ``##``)."""

    initial: frozenset[str]
    inner: frozenset[str]


def byte_bpe_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a byte-level ``tokenizers`` file, read as word pieces: entries after a space begin words, the others continue them.

    Entries that are no whole UTF-8 characters, or hold white space inside, are left out. Every character that begins or continues a word anywhere may do both,
    as may the entries without a space at a text's begin: so single characters are in both sets.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
    initial, inner = set(), set()
    for piece in model:
        try:
            text = bytes(to_byte[c] for c in piece).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        begins, text = text.startswith(" "), text.removeprefix(" ")
        if text and not set(text) & set(" \t\n\v\f\r"):
            (initial if begins else inner).add(text)
    single = {c for c in initial | inner if len(c) == 1}
    return Vocabulary(frozenset(initial | single), frozenset(inner | single))


class LongestMatch:
    """A trie over both kinds of piece. Node 0 begins words, node 1 follows a piece. ``pops[v]`` counts the pieces that are given up for good when the walk leaves
    ``v`` by its failure link ``link[v]``; -1 means that no piece can end there, so the word is unknown."""

    def __init__(self, vocabulary: Vocabulary):
        step: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, vocabulary.initial), (1, vocabulary.inner)):
            for piece in pieces:
                v = root
                for c in piece:
                    w = step[v].get(c)
                    if w is None:
                        w = step[v][c] = len(step)
                        step.append({})
                        ends.append(False)
                    v = w
                ends[v] = True
        link, pops = [-1] * len(step), [0] * len(step)
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in step[u].items():
                if ends[v]:
                    link[v], pops[v] = 1, 1
                else:
                    z, n = link[u], pops[u]
                    while z >= 0 and c not in step[z]:
                        n += pops[z]
                        z = link[z]
                    if z >= 0:
                        link[v], pops[v] = step[z][c], n
                queue.append(v)
        self.step, self.link, self.pops = step, link, pops

    def count(self, word: str) -> int:
        """The number of greedy longest-match pieces, or -1 if the word can't be cut so. Linear in the word's length."""
        step, link, pops = self.step, self.link, self.pops
        u, n = 0, 0
        for c in word:
            while c not in step[u]:
                n += pops[u]
                u = link[u]
                if u < 0:
                    return -1
            u = step[u][c]
        while u > 1:
            n += pops[u]
            u = link[u]
        return n if u == 1 else -1


def greedy_count(word: str, vocabulary: Vocabulary) -> int:
    """The same number by trying all lengths; for tests."""
    n, at, pieces = 0, 0, vocabulary.initial
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        n, at, pieces = n + 1, end, vocabulary.inner
    return n


def _lengths(words: Iterable[str], automaton: LongestMatch, memory: dict[str, int]) -> np.ndarray:
    out = []
    for w in words:
        n = memory.get(w)
        if n is None:
            if len(memory) >= MEMORY:
                memory.clear()
            n = memory[w] = automaton.count(w)
        out.append(n)
    return np.array(out, np.int64)


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: Vocabulary) -> DataFrame:
    """``id_col``, ``n_words``, ``n_tokens`` and ``n_unknown`` (words that can't be cut; each counts as one token) of each row's whole text.

    Words are runs of other characters than ASCII white space. Null and empty texts have 0 of each; repeated rows are counted alike; an empty table gives no
    rows; other columns are ignored, whatever their names. One narrow pass: the vocabulary is broadcast (its size is the tokenizer's, not the data's), and each distinct
    word of a slice is walked once.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((sorted(vocabulary.initial), sorted(vocabulary.inner)))
    rows = df.select(df[id_col].alias("__id"), df[text_col].alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        initial, inner = shared.value
        automaton = LongestMatch(Vocabulary(frozenset(initial), frozenset(inner)))
        memory: dict[str, int] = {}
        for batch in sliced(batches, "__text"):
            words, offsets = split_words(batch.column("__text"))
            coded = words.dictionary_encode()
            each = _lengths(coded.dictionary.to_pylist(), automaton, memory)[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
            total = np.concatenate([[0], np.cumsum(np.where(each < 0, 1, each))])
            unknown = np.concatenate([[0], np.cumsum(each < 0)])
            counts = [np.diff(offsets), total[offsets[1:]] - total[offsets[:-1]], unknown[offsets[1:]] - unknown[offsets[:-1]]]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), *map(pa.array, counts)], names=["__id", "n_words", "n_tokens", "n_unknown"])

    return rows.mapInArrow(run, f"__id {kind}, n_words long, n_tokens long, n_unknown long").withColumnRenamed("__id", id_col)
