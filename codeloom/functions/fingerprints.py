"""Winnowed fingerprints of texts, computed over Arrow batches.

k-grams of normalized words are ordered by the first 64 bits of their MD5
digest, as signed numbers in the same order.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa

from codeloom.functions.text import ASCII_LOWER, ASCII_UPPER

COMMENT = re.compile(r"/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*")
BLANK = re.compile(r"[\t-\r \x85\xa0  -     　]+")
LINE_END = re.compile(r"\r?\n")
MASK = (1 << 64) - 1
LOWER = str.maketrans(ASCII_UPPER, ASCII_LOWER)


def normal_words(text: str) -> list[str]:
    """The words of a text without comments, in ASCII lower case; comments inside strings are comments too."""
    return [w for w in BLANK.sub(" ", COMMENT.sub(" ", text)).translate(LOWER).split(" ") if w]


def lines_of(text: str) -> list[str]:
    """No empty line after a last line end, and no carriage return before a line end."""
    parts = LINE_END.split(text)
    return parts[:-1] if parts[-1] == "" else parts


def gram_hashes(words: list[str], k: int, known: dict[str, int]) -> list[int]:
    """The hash of each k-gram of the words, in order."""
    hashes = []
    for i in range(len(words) - k + 1):
        gram = " ".join(words[i : i + k])
        h = known.get(gram)
        if h is None:
            h = known[gram] = int.from_bytes(hashlib.md5(gram.encode("utf-8", "surrogatepass")).digest()[:8], "big") - (1 << 63)
        hashes.append(h)
    return hashes


def least_hashes(hashes: list[int], w: int) -> list[int]:
    """The least of every ``w`` hashes in a row; fewer are one window, none give none."""
    wide = min(w, len(hashes))
    return list(map(min, *(hashes[i : len(hashes) - wide + 1 + i] for i in range(wide)))) if wide > 1 else hashes


def winnow(words: list[str], k: int, w: int, known: dict[str, int]) -> list[int]:
    """The sorted set of the least hash of every window of ``w`` k-grams; fewer k-grams are one window, none give an empty set."""
    return sorted(set(least_hashes(gram_hashes(words, k, known), w)))


def text_prints(k: int, w: int):
    """A function over batches (id, source) → (id, fps)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, int] = {}
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([winnow(normal_words(t), k, w, known) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["id", "fps"])

    return run


def windows_of(source: str, sizes: tuple[int, ...], k: int, w: int) -> Iterator[tuple[int, int, list[int]]]:
    """(first line, last line, fingerprints) of sliding windows of lines: step 4 for more than ten lines, else 2; windows with fewer than two words a line or without k-grams are dropped."""
    lines, known = lines_of(source), {}
    plain = [normal_words(x) for x in lines]
    block = [0, *accumulate("/*" in x for x in lines)]  # lines before each line that may open a comment
    ends = [0, *accumulate(map(len, plain))]  # words before each line
    # a window is a run of the text's words, so its hashes and their minima are runs of the text's
    hashes = gram_hashes([x for row in plain for x in row], k, known)
    least = least_hashes(hashes, w)
    for size in sizes:
        for at in range(0, len(lines) - size + 1, 4 if size > 10 else 2):
            if block[at + size] > block[at]:  # a comment over lines
                words = normal_words("\n".join(lines[at : at + size]))
                fps = winnow(words, k, w, known) if len(words) >= 2 * size else []
            else:
                a, b = ends[at], ends[at + size] - k + 1  # its k-grams
                if ends[at + size] - a < 2 * size:
                    continue
                fps = sorted(set(least[a : b - w + 1])) if b - a >= w else [min(hashes[a:b])] if b > a else []
            if fps:
                yield at + 1, at + size, fps


def _windows_batch(path: str, rows: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["path", "start_line", "end_line", "fps"])


def window_prints(sizes: tuple[int, ...], k: int, w: int):
    """A function over batches (path, source) → (path, start_line, end_line, fps) of windows_of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield _windows_batch(path, list(windows_of(source, sizes, k, w)))

    return run


def prefix_buckets(start: int, end: int, fps: list[int], threshold: float) -> set[int]:
    """A number for each fingerprint, with the window's length, among those of which two windows at the threshold share one."""
    first = len(fps) - math.ceil(len(fps) * threshold - 1e-9) + 1
    return {((f * 31 + end - start) & MASK) - (1 << 63) for f in fps[:first]}


def window_buckets(sizes: tuple[int, ...], k: int, w: int, threshold: float):
    """A function over batches (key, source) → (key, bucket): the distinct prefix buckets of all windows of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(set().union(*(prefix_buckets(*x, threshold) for x in windows_of(source, sizes, k, w))))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array(found, pa.int64())], ["key", "bucket"])

    return run


def shared_window_prints(sizes: tuple[int, ...], k: int, w: int, threshold: float):
    """A function over batches (path, sources, buckets) → (path, start_line, end_line, fps) of the distinct windows of the path's texts with a prefix bucket among the given ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, sources, buckets in zip(*(c.to_pylist() for c in batch.columns)):
                shared = set(buckets)
                rows = [x for source in sources for x in windows_of(source, sizes, k, w) if not shared.isdisjoint(prefix_buckets(*x, threshold))]
                yield _windows_batch(path, rows if len(sources) == 1 else list({(a, b, *fps): (a, b, fps) for a, b, fps in rows}.values()))

    return run
