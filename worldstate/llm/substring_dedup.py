"""Substring dedup: words covered by a window of `window` words whose words also start earlier are removed.

A window is `window` consecutive words of one text. It is a later copy if the same words start earlier: in a row with a
smaller id, or earlier in the same text. Windows are judged on the input; later copies that touch or overlap merge into
maximal intervals, which are cut out.

1. Words are hashed to 64 bits and windows get Rabin-Karp hashes: polynomials of the words' hashes modulo 2**64, put
   together from those of 1, 2, 4, 8 ... words. Numpy does this for many texts at a time.
2. An equal pair of windows agrees in all its stretches of `anchor` words, and so in the stretch of the least scrambled
   hash, its anchor. Neighbouring windows mostly have the same anchor: a text is a sequence of segments, about a seventh
   as many as words. Anchors are counted in Spark; a window whose anchor occurs once can't be repeated and takes no
   part any more. This only leaves work out, never a window that is repeated.
3. The hashes of all other windows (a text's first of each only) are counted in Spark, with the earliest place of each.
   Those that aren't at the earliest place are later copies. Keys are (anchor, window) hashes: two numbers of 64 bits, the
   second of which has to agree only among windows of one anchor.
4. A text meets its later copies, finds its own repeated windows once more, merges both into intervals and leaves
   their words out.

Shuffles: anchors, segments of repeated anchors, windows that may be repeated, and texts twice, as a text is needed where
its segments are known. Counts are aggregated before they move; joins are sort-merge joins, whose hot keys Spark splits, and
in them a window has a row a text at most. What is gathered by text is bounded by its length. Each step is
written to the shared folder, and its shuffles deleted.

Defined cases: null and empty texts have no words and keep none; texts of fewer words than a window stay whole; of rows
with one id and different texts the one with the smaller 64-bit row key counts as earlier, rows with equal id and text
are one document and treated alike; a null id sorts first; an empty table gives no rows; columns named n_words, n_removed
and kept (words joined by one blank) are replaced, other columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, ANCHOR = 20, 8
#: Words that are hashed at once (but for a single longer text), and distinct words whose hashes a task remembers.
SLICE, REMEMBERED = 1 << 19, 1 << 20
#: The polynomials' base and the factor that scrambles their order: odd, otherwise any.
BASE, SCRAMBLE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), signed=True)
        self[word] = value
        return value


def polynomials(words: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """For each length the hashes of so many words from each place on."""
    doubled, power, size = [words], [pow(BASE, 1, 1 << 64)], 1
    while size * 2 <= max(lengths):
        h = doubled[-1]
        doubled.append(h[:-size] * np.uint64(power[-1]) + h[size:] if len(h) > size else h[:0])
        power.append(power[-1] * power[-1] % (1 << 64))
        size *= 2
    out = []
    for length in lengths:
        n = max(0, len(words) - length + 1)
        h, at = np.zeros(n, dtype=np.uint64), 0
        for k in range(length.bit_length() - 1, -1, -1):
            if length >> k & 1:
                h = h * np.uint64(power[k]) + doubled[k][at : at + n]
                at += 1 << k
        out.append(h)
    return out


def least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of `span` values from each place on."""
    size = 1
    while size * 2 <= span:
        values, size = np.minimum(values[:-size], values[size:]), size * 2
    rest = span - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Windows:
    """The windows of several texts in one array: text (number), start (word), h and anchor (hashes)."""

    def __init__(self, counts: list[int], words: np.ndarray, window: int, anchor: int) -> None:
        h, small = polynomials(words, window, anchor)
        n = len(h)
        text = np.repeat(np.arange(len(counts)), counts)
        first = np.cumsum([0, *counts[:-1]])
        inside = text[:n] == text[window - 1 :][:n] if n else np.zeros(0, dtype=bool)
        if n:
            small = small * np.uint64(SCRAMBLE)
            small ^= small >> np.uint64(32)
            anchors = least(small, window - anchor + 1)[:n]
        else:
            anchors = h
        self.text = text[:n][inside]
        self.start = (np.arange(n) - first[text[:n]])[inside]
        self.h, self.anchor = h[inside].view(np.int64), anchors[inside].view(np.int64)

    def segments(self) -> tuple[np.ndarray, np.ndarray]:
        """Where stretches of consecutive windows of one text and anchor begin, and their lengths."""
        n = len(self.h)
        new = np.ones(n, dtype=bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.text[1:] != self.text[:-1])
        at = np.flatnonzero(new)
        return at, np.diff(at, append=n)

    def later_in_text(self, among: np.ndarray | None = None) -> np.ndarray:
        """Which windows (of those among) follow an equal one of their text."""
        own = np.arange(len(self.h)) if among is None else np.flatnonzero(among)
        out = np.zeros(len(self.h), dtype=bool)
        key = self.h[own] ^ (self.text[own] * np.int64(SCRAMBLE >> 2))
        in_order = np.sort(key)
        twice = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
        if len(twice):
            # few windows are left to be told apart by all they have
            near = own[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
            x = near[np.lexsort((near, self.h[near], self.anchor[near], self.text[near]))]
            same = (self.h[x[1:]] == self.h[x[:-1]]) & (self.anchor[x[1:]] == self.anchor[x[:-1]]) & (self.text[x[1:]] == self.text[x[:-1]])
            out[x[1:][same]] = True
        return out


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[list[bytes]], np.ndarray]]:
    """Rows with the words of their texts and the words' hashes, about SLICE words at a time."""
    memo = Hashes()
    for batch in batches:
        rows, total, at = [], 0, 0
        for k, raw in enumerate(batch.column(text).cast(pa.binary()).to_pylist()):
            rows.append((raw or b"").split())
            total += len(rows[-1])
            if total >= SLICE or k == batch.num_rows - 1:
                hashes = np.fromiter(map(memo.__getitem__, chain.from_iterable(rows)), dtype=np.int64, count=total)
                yield batch.slice(at, len(rows)), rows, hashes.view(np.uint64)
                at, rows, total = k + 1, [], 0


def _segments(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch, rows, words in slices(batches):
        w = Windows([*map(len, rows)], words, window, anchor)
        at, n = w.segments()
        rid = batch.column("rid").take(pa.array(w.text[at]))
        yield pa.RecordBatch.from_arrays([rid, pa.array(w.anchor[at]), pa.array(w.start[at].astype("i4")), pa.array(n.astype("i4"))], names=["rid", "anchor", "start", "n"])


def _candidates(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Windows, the first of each in a text, that lie in the segments of repeated anchors."""
    for batch, rows, words in slices(batches):
        w = Windows([*map(len, rows)], words, window, anchor)
        found = batch.column("segments")
        own = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
        flat = found.flatten()
        start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
        base = np.searchsorted(w.text, own) + start
        edge = np.zeros(len(w.h) + 1, dtype=np.int64)
        np.add.at(edge, base, 1)
        np.add.at(edge, base + n, -1)
        keep = np.cumsum(edge[:-1]) > 0
        keep &= ~w.later_in_text(keep)
        of = pa.array(w.text[keep])
        yield pa.RecordBatch.from_arrays([batch.column("rid").take(of), batch.column("id").take(of), pa.array(w.anchor[keep]), pa.array(w.h[keep]), pa.array(w.start[keep].astype("i4"))], names=["rid", "id", "anchor", "h", "start"])


def later_copies(df: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(rid, starts): places of the windows of a text that stand in a smaller row too; df: rid, id (long), text."""
    found = df.select("rid", "text").mapInArrow(lambda b: _segments(b, window, anchor), "rid long, anchor long, start int, n int")
    segments = common.stored(found, "segments", clean=True)
    repeated = segments.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    maybe = segments.join(repeated, "anchor", "left_semi").groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("segments"))
    windows = df.join(maybe, "rid").mapInArrow(lambda b: _candidates(b, window, anchor), "rid long, id long, anchor long, h long, start int")
    windows = common.stored(windows, "windows", clean=True)
    common.forget(segments)
    first = windows.groupBy("anchor", "h").agg(F.min(F.struct("id", "rid")).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    first = common.stored(first, "first", clean=True)
    later = windows.join(first, ["anchor", "h"]).where("struct(id, rid) > first").groupBy("rid").agg(F.collect_list("start").alias("starts"))
    later = common.stored(later, "later", clean=True)
    common.forget(windows, first)
    return later


def intervals(covered: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal stretches of words that windows from these places on (rising) cover."""
    if not len(covered):
        return covered, covered
    gap = np.flatnonzero(covered[1:] > covered[:-1] + window)
    return covered[np.r_[0, gap + 1]], covered[np.r_[gap, len(covered) - 1]] + window


def dedup(df: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """df with n_words, n_removed and kept: the words left, joined by one blank."""
    if not 0 < anchor <= window:
        raise ValueError("an anchor has 1 to `window` words")
    base = df.drop("n_words", "n_removed", "kept")
    columns = base.columns
    keyed = base.withColumn("_rid", F.xxhash64(id_col, text))
    later = later_copies(keyed.select(F.col("_rid").alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")), window, anchor)
    met = keyed.join(later.select(F.col("rid").alias("_rid"), F.col("starts").alias("_starts")), "_rid", "left").select(*columns, "_starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, words in slices(batches, text):
            w = Windows([*map(len, rows)], words, window, anchor)
            own = w.later_in_text()
            ends = np.searchsorted(w.text, np.arange(len(rows) + 1))
            kept, removed = [], []
            for row, x, y, starts in zip(rows, ends[:-1], ends[1:], batch.column("_starts").to_pylist(), strict=True):
                mine = w.start[x:y][own[x:y]]
                gone = np.unique(np.concatenate([mine, np.asarray(starts, dtype=np.int64)])) if starts else mine
                left, at = [], 0
                for begin, end in zip(*(z.tolist() for z in intervals(gone, window)), strict=True):
                    left += row[at:begin]
                    at = end
                left += row[at:]
                kept.append(b" ".join(left).decode())
                removed.append(len(row) - len(left))
            added = [pa.array([*map(len, rows)], pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *added], names=[*columns, "n_words", "n_removed", "kept"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), "n_words long, n_removed long, kept string"])
    return met.mapInArrow(cut, schema)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
