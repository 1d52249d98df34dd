"""Evaluation texts leaking into training text, by suffix arrays over shards of the training text.

Each task turns its documents into shards of word numbers and sorts all
suffixes of a shard by prefix doubling. Every suffix of every evaluation item
is then located by binary search, depth by depth: the rank of its first 1, 2,
4, ... words is looked up in the sorted ranks of that depth, and the first
``least`` words give the range of suffixes that start with them. A range is read
once for each item, however often the item repeats it. The longest match of a
document and an item is found by a binary search on its length, so work and
memory follow the words of both and not the number of places that match. A
separator after each document keeps matches inside documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import materialize

WORD = regex.compile(r"[\p{L}\p{N}]+")
SHARD_WORDS = 1_000_000
ITEM_WORDS_A_PASS = 2_000_000


def words(text: str) -> list[str]:
    """Maximal runs of Unicode letters and digits, in lower case."""
    return WORD.findall(text.lower())


def word_ids(text: str, known: dict[str, int]) -> list[int]:
    out = []
    for w in words(text):
        i = known.get(w)
        if i is None:
            i = known[w] = xxhash.xxh3_64_intdigest(w) >> 2
        out.append(i)
    return out


class SuffixArray:
    """Suffixes of a sequence of word numbers, ordered by their first ``depth`` words, and the ranks of each power of two below."""

    def __init__(self, seq: np.ndarray, depth: int):
        self.depth = depth
        self.vocab, rank = np.unique(seq, return_inverse=True)
        self.keys: list[np.ndarray] = []
        ranks, width = [rank.astype(np.int64)], 1
        while width * 2 <= depth:
            key = self._pair(ranks[-1], ranks[-1], width)
            keys, rank = np.unique(key, return_inverse=True)
            self.keys.append(keys)
            ranks.append(rank.astype(np.int64))
            width *= 2
        # the full depth from the powers of two in it, largest first
        self.parts = [k for k in range(len(ranks) - 1, -1, -1) if depth >> k & 1]
        self.final: list[np.ndarray] = []
        acc, at = ranks[self.parts[0]], 1 << self.parts[0]
        for k in self.parts[1:]:
            keys, acc = np.unique(self._pair(acc, ranks[k], at), return_inverse=True)
            self.final.append(keys)
            at += 1 << k
        self.order = np.argsort(acc, kind="stable")
        self.sorted = acc[self.order]

    @staticmethod
    def _pair(left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
        """left * 2^32 + right shifted by width, 0 past the end; ranks are below 2^31 as shards are."""
        shifted = np.zeros_like(right)
        shifted[: len(right) - width] = right[width:] + 1
        return (left << 32) + shifted

    def find(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix of the query the range [lo, hi) of ``order`` that starts with its first ``depth`` words."""
        n = len(query) - self.depth + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        levels = [self._locate(self.vocab, query)]
        for k, keys in enumerate(self.keys):
            left, width = levels[-1], 1 << k
            levels.append(self._locate(keys, self._joined(left, left, width)))
        acc, at = levels[self.parts[0]], 1 << self.parts[0]
        for k, keys in zip(self.parts[1:], self.final):
            acc = self._locate(keys, self._joined(acc, levels[k], at))
            at += 1 << k
        acc = acc[:n]
        lo = np.searchsorted(self.sorted, acc, "left")
        hi = np.searchsorted(self.sorted, acc, "right")
        return np.where(acc < 0, 0, lo), np.where(acc < 0, 0, hi)

    @staticmethod
    def _joined(left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
        shifted = np.full(len(left), -1, np.int64)
        shifted[: max(0, len(right) - width)] = right[width:]
        return np.where((left >= 0) & (shifted >= 0), (left << 32) + shifted + 1, -1)

    @staticmethod
    def _locate(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Binary search; -1 where a key is absent."""
        if not len(keys):
            return np.full(len(wanted), -1, np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)


def _windows(levels: list[np.ndarray], n: int) -> np.ndarray:
    """One hash for each run of ``n`` words; levels[k] has those of 2^k words and grows on demand."""
    k = n.bit_length() - 1
    while len(levels) <= k:
        half, width = levels[-1], 1 << (len(levels) - 1)
        levels.append(_joined_hash(half[: len(half) - width], half[width:]))
    rest = n - (1 << k)
    return levels[k] if not rest else _joined_hash(levels[k][: len(levels[k]) - rest], levels[k][rest:])


def _joined_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def longest_common(a: np.ndarray, b: np.ndarray, least: int) -> tuple[int, int, int]:
    """(words, place in a, place in b) of the longest run of words in both, the first of equals; runs of ``least`` words are known to be."""
    la, lb = [a.astype(np.uint64)], [b.astype(np.uint64)]
    low, high = least, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if np.isin(_windows(la, mid), _windows(lb, mid)).any():
            low = mid
        else:
            high = mid - 1
    wa, wb = _windows(la, low), _windows(lb, low)
    at = int(np.argmax(np.isin(wa, wb)))
    return low, at, int(np.argmax(wb == wa[at]))


def shard_hits(docs: list[np.ndarray], ids: list[int], items: np.ndarray, owner: np.ndarray, least: int, array: SuffixArray | None = None) -> list[tuple[int, int, int, int, int]]:
    """(doc_id, item_id, words, doc_word, item_word) for one shard. items: all items' words one after the other, each ended by -1; owner: the item of each."""
    lengths = np.array([len(d) + 1 for d in docs])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    array = array or shard_array(docs, least)
    lo, hi = array.find(items)
    found = np.flatnonzero(hi > lo)
    ends = np.flatnonzero(items == -1)
    out = []
    item_no = np.searchsorted(ends, found)
    for part in np.split(found, np.flatnonzero(np.diff(item_no)) + 1) if len(found) else []:
        k = int(np.searchsorted(ends, part[0]))
        begin = int(ends[k - 1]) + 1 if k else 0
        words_of = items[begin : ends[k]]
        first, once = np.unique(lo[part], return_index=True)
        width = hi[part][once] - first
        at = array.order[np.repeat(first - np.cumsum(width) + width, width) + np.arange(int(width.sum()))]
        at.sort()
        doc = np.searchsorted(starts, at, "right") - 1
        for places in np.split(at, np.flatnonzero(np.diff(doc)) + 1):
            d = int(np.searchsorted(starts, places[0], "right")) - 1
            a = int(places[0] - starts[d])
            text = docs[d][a : int(places[-1] - starts[d]) + least]
            n, x, y = longest_common(text, words_of, least)
            out.append((ids[d], int(owner[begin]), n, a + x, y))
    return out


def shard_array(docs: list[np.ndarray], least: int) -> SuffixArray:
    gap = np.array([-2], np.int64)
    return SuffixArray(np.concatenate([x for d in docs for x in (d, gap)]), least)


HITS = "doc_id bigint, item_id bigint, words int, doc_word int, item_word int"


def leaked_passages(documents: DataFrame, items: DataFrame, least: int = 12, shard_words: int = SHARD_WORDS, pass_words: int = ITEM_WORDS_A_PASS) -> DataFrame:
    """doc_id, item_id, words, doc_word, item_word: documents that hold ``least`` or more consecutive words of an item, with the longest match and where it starts (the number of the word in both, from 0).

    Documents and items with null id or text hold nothing; shorter items
    can't be found; copies of a document under several ids are found under
    each; repeated rows count once; empty tables give no rows. The items are the
    stated query set: executors turn them into numbers, and they are broadcast
    in parts of at most ``pass_words`` words and one item; a task holds one part
    at a time. Documents are read once: each shard's array is built once for
    all parts. A shard holds whole documents up to ``shard_words`` words, or one
    longer document. The hits are written, so the parts are released at the end.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id"), F.col("text")).where("doc_id is not null and text is not null")
    parts = [spark.sparkContext.broadcast(p) for p in _item_parts(items, least, pass_words)]
    if not parts:
        return spark.createDataFrame([], HITS)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        ids, seqs, held = [], [], 0

        def flush():
            array = shard_array(seqs, least)
            for part in parts:
                query, owner = part.value
                rows = shard_hits(seqs, ids, query, owner, least, array)
                if len(parts) > 1:
                    part.__dict__.pop("_value", None)  # read again from the worker's file for the next shard
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "words", "doc_word", "item_word"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seq = word_ids(text, known)
                if len(seq) < least:
                    continue
                if held and held + len(seq) > shard_words:
                    yield from flush()
                    ids, seqs, held = [], [], 0
                ids.append(i)
                seqs.append(np.array(seq, np.int64))
                held += len(seq) + 1
                if len(known) > 500_000:
                    known.clear()
        if held:
            yield from flush()

    best = F.max(F.struct("words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i")))
    hits = docs.mapInArrow(search, HITS).groupBy("doc_id", "item_id").agg(best.alias("m"))
    hits = materialize(hits.select("doc_id", "item_id", "m.words", (-F.col("m.d")).alias("doc_word"), (-F.col("m.i")).alias("item_word")), "leaks")
    for part in parts:
        part.destroy()
    return hits


def _item_parts(items: DataFrame, least: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The numbers of the items' words, each item ended by -1, and the item of each number."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([word_ids(t, known) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["item_id", "w"])

    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null").mapInArrow(read, "item_id bigint, w array<bigint>")
    seqs, owner, held = [], [], 0
    for row in rows.where(F.size("w") >= least).distinct().toLocalIterator():
        if held and held + len(row["w"]) + 1 > most:
            yield np.concatenate(seqs), np.concatenate(owner)
            seqs, owner, held = [], [], 0
        seqs.append(np.array([*row["w"], -1], np.int64))
        owner.append(np.full(len(row["w"]) + 1, row["item_id"], np.int64))
        held += len(row["w"]) + 1
    if seqs:
        yield np.concatenate(seqs), np.concatenate(owner)


def leaked_items(hits: DataFrame) -> DataFrame:
    """The items that leaked: item_id, documents, longest."""
    return hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words").alias("longest"))


def without_leaks(documents: DataFrame, hits: DataFrame) -> DataFrame:
    """The documents that hold no passage of any item."""
    return documents.join(hits.select("doc_id").distinct(), "doc_id", "left_anti")
