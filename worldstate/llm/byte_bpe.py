"""Byte-level BPE encoding and decoding by Spark's higher-order functions.

A text is cut into words by the family's pattern. A word's bytes become ids, and a fold merges the adjacent pair of
the lowest rank, the leftmost of several, until no pair is in the rank map. Inside expressions an id is a character
(code point id + 256), so that a word under way is a short string and a merge replaces two characters by one; the
rank map is a literal of hash buckets, each a string of pairs with what they become.

1. Texts are cut before single blanks, which never cuts a word (texts with blanks inside longer white space are cut by the
   pattern alone). These pieces are counted over all texts, distinct pieces are cut into words, and the counts of the
   words are added up. The `known` most frequent distinct words are folded once, by Spark's expressions: a dictionary
   whose size does not depend on the corpus.
2. Two ids that stand together in a folded word are a joint: the fold of their bytes gives these two. A row of ids of which
   all neighbours are joints is the fold of its bytes: the first merge across a border would also be the first one
   across it in the fold of the two ids at that border. So there is one such row at most, however it is found.
3. Arrow functions cut texts again and look their words up, those beyond the dictionary as rows of joints; what a worker has
   found for a piece it remembers. Words that no joints make up are left open between runs of ids, and are folded in
   the text's row by the same expressions.
4. Decoding looks up each id's bytes in a literal and concatenates them.

No step shuffles texts or ids; only partial counts move. The fold takes quadratic time in a word, so words of over
LONG_WORD bytes are merged with a heap where the text is cut: the same ids by another path.

Defined cases: null texts are empty; empty texts have no ids; repeated rows are encoded alike; ids outside the
vocabulary decode to nothing; an empty table gives no rows; other columns stay, `ids` is replaced.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The public pattern that cuts a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words in the dictionary, of less than KNOWN_BYTES each; hash buckets of the rank map.
KNOWN, KNOWN_BYTES = 1 << 18, 48
BUCKETS = 1 << 17
LONG_WORD = 1024
#: Distinct pieces whose ids a worker remembers; bytes of texts that are cut at once, or one text.
REMEMBERED, AT_ONCE = 1 << 17, 1 << 23
#: Ids that a search for a row of joints takes back before it leaves the word open.
TAKEN_BACK = 64
#: Ids as characters start here; no pair; what stands between a pair and what it becomes.
FIRST, NONE, BECOMES = 256, "\uffff", "\ufffe"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def _letter(rank: int) -> str:
    # surrogates are no characters
    return chr(FIRST + rank + (0x800 if FIRST + rank >= 0xD800 else 0))


def _rank(letter: str) -> int:
    return ord(letter) - FIRST - (0x800 if letter >= "\ue000" else 0)


def pair_table(ranks: dict[bytes, int]) -> Column:
    """Buckets of (two ids as characters, the id of both together), by the hash of the two."""
    if max(ranks.values()) + FIRST + 0x800 >= ord(NONE):
        raise ValueError("ids don't fit in the basic plane")
    buckets = [NONE + NONE] * BUCKETS
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                pair = _letter(left) + _letter(right)
                # the hash of Spark's xxhash64
                buckets[xxhash.xxh64_intdigest(pair.encode(), 42) & (BUCKETS - 1)] += pair + BECOMES + _letter(rank) + NONE
    return F.split(F.lit(" ".join(buckets)), " ")


def fold(word: Column, pairs: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of a word, as characters."""

    def merged(pair: Column) -> Column:
        bucket = F.get(pairs, F.xxhash64(pair).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
        # what follows the pair, or the whole bucket, which begins with NONE
        return F.substring(F.call_function("substring_index", bucket, pair, F.lit(-1)), 2, 1)

    empty = F.lit("")

    def step(state: Column, _: Column) -> Column:
        ids, next_ = state["ids"], state["next"]

        def merge(least: Column) -> Column:
            def at(p: Column) -> Column:
                def with_ids(new: Column) -> Column:
                    left = F.when(p > 1, merged(F.substring(new, p - 1, F.lit(2)))).otherwise(empty)
                    right = F.when(p < F.length(next_), merged(F.substring(new, p, F.lit(2)))).otherwise(empty)
                    return F.struct(new.alias("ids"), F.concat(F.substring(next_, F.lit(1), p - 2), left, right, F.substring(next_, p + 2, F.length(next_))).alias("next"))

                return common.let(F.overlay(ids, least, p, F.lit(2)), with_ids)

            return F.when(least == NONE, F.struct(ids.alias("ids"), empty.alias("next"))).otherwise(common.let(F.instr(next_, least), at))

        return F.when(next_ == "", state).otherwise(common.let(F.array_min(F.split(next_, "")), merge))

    def whole(ids: Column) -> Column:
        steps = F.sequence(F.lit(1), F.greatest(F.length(ids) - 1, F.lit(1)))
        next_ = F.array_join(F.transform(steps, lambda i: F.when(i < F.length(ids), merged(F.substring(ids, i, F.lit(2)))).otherwise(empty)), "")
        return F.aggregate(steps, F.struct(ids.alias("ids"), next_.alias("next")), step, lambda s: s["ids"])

    single = F.translate(F.decode(F.to_binary(word, F.lit("utf-8")), "ISO-8859-1"), "".join(map(chr, range(256))), "".join(_letter(ranks[bytes([b])]) for b in range(256)))
    return common.let(single, whole)


def as_ids(letters: Column) -> Column:
    """Ids that are characters, as array<int>."""

    def rank(letter: Column) -> Column:
        return F.ascii(letter) - F.when(letter < "\ue000", FIRST).otherwise(FIRST + 0x800)

    return F.when(letters == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(letters, ""), rank))


class Cutter:
    """Cuts texts into pieces, and pieces into words."""

    def __init__(self) -> None:
        import regex

        self.words = regex.compile(PATTERN).findall
        self.across = regex.compile(r" (?<=\s )(?:\s|\Z)").search
        self.behind = re.compile(r"[^\S ] |  ").search

    def pieces(self, text: str) -> list[str]:
        """Stretches whose words are those of the text: cut before blanks, but for a text with a blank inside longer white space."""
        if self.behind(text) and self.across(text):
            return self.words(text)
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)] if first else [" " + x for x in rest]

    def all_pieces(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Where each text's pieces end, after a 0, and the pieces of all texts, as bytes. An empty piece may stand first in a text."""
        texts = pc.fill_null(texts, "")
        # white space of any kind before a blank is rare, so these texts are cut by themselves
        odd = pc.match_substring_regex(texts, r"[\pZ\t-\r\x1c-\x1f\x{85}] ")
        # a byte that UTF-8 doesn't have stands between pieces
        marked = pc.replace_substring(texts.cast(pa.large_binary()), b" ", b"\xff ")
        if pc.any(odd).as_py():
            own = [b"\xff".join(x.encode() for x in self.pieces(text)) for text in texts.filter(odd).to_pylist()]
            marked = pc.replace_with_mask(marked, odd, pa.array(own, pa.large_binary()))
        lists = pc.split_pattern(marked, b"\xff")
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        return ends, lists.flatten()


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of AT_ONCE bytes of texts, by the mean length of a batch's texts."""
    for batch in batches:
        size = max(1, batch.num_rows * AT_ONCE // max(batch.column(text).nbytes, 1))
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def as_str(pieces: pa.Array) -> list[str]:
    return pieces.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist()


class Joints:
    """Finds the ids of a word's bytes as a row of which all neighbours stand together in folded words, too."""

    def __init__(self, folded: Iterator[tuple[int, ...]], ranks: dict[bytes, int]) -> None:
        piece = {rank: x for x, rank in ranks.items()}
        self.after: dict[int, dict[bytes, int]] = {}
        for ids in folded:
            for i in ids:
                self.after.setdefault(i, {})
            for i, k in pairwise(ids):
                self.after[i][piece[k]] = k
        self.first = {piece[i]: i for i in self.after}
        self.longest = max(map(len, self.first), default=0)

    def find(self, raw: bytes) -> list[int] | None:
        """Longer ids first; where none goes on, the last one taken becomes a shorter one. None: not found."""
        after, n, longest = self.after, len(raw), self.longest
        out, starts, at, back, follow, top = [], [], 0, 0, self.first, min(n, longest)
        while at < n:
            while top > at and (i := follow.get(raw[at:top])) is None:
                top -= 1
            if top > at:
                out.append(i)
                starts.append(at)
                at, follow, top = top, after[i], min(n, top + longest)
            elif not out or back == TAKEN_BACK:
                return None
            else:
                back += 1
                out.pop()
                at, top = starts.pop(), at - 1
                follow = after[out[-1]] if out else self.first
        return out


class Lookup(dict):
    """Ids of pieces, as tuples. -k stands for the k-th of `open`, words that are not known; a batch begins it anew."""

    def __init__(self, known: dict[str, tuple[int, ...]], ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.cutter, self.known, self.ranks, self.joints, self.open = Cutter(), known, ranks, Joints(iter(known.values()), ranks), []

    def __missing__(self, piece: str) -> tuple[int, ...]:
        out, new = [], len(self.open)
        for word in self.cutter.words(piece):
            ids = self.known.get(word)
            if ids is None:
                raw = word.encode()
                ids = heap_encode(raw, self.ranks) if len(raw) > LONG_WORD else self.joints.find(raw)
            if ids is None:
                self.open.append(word)
                out.append(-len(self.open))
            else:
                out += ids
        found = tuple(out)
        if len(self.open) == new and len(piece) < 4 * KNOWN_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = found
        return found


def lookup_of(shared: dict) -> Lookup:
    """The Lookup that a worker makes once of what it was sent, and keeps there: words (a table), ranks."""
    if "lookup" not in shared:
        words = shared["words"]
        letters = zip(words.column("word").to_pylist(), words.column("letters").to_pylist(), strict=True)
        shared["lookup"] = Lookup({word: tuple(map(_rank, x)) for word, x in letters}, shared["ranks"])
    return shared["lookup"]


def look_up(df: DataFrame, text: str, known: pa.Table, ranks: dict[bytes, int]) -> DataFrame:
    """df with _open array<string>, a text's open words, and _runs array<array<int>>, the ids before, between and behind them."""
    spark, columns = df.sparkSession, df.columns
    shared = spark.sparkContext.broadcast({"words": known, "ranks": ranks})

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = lookup_of(shared.value)
        for batch in slices(batches, text):
            ids.open = []
            ends, pieces = ids.cutter.all_pieces(batch.column(text))
            pieces = pieces.dictionary_encode()
            each = [*map(ids.__getitem__, as_str(pieces.dictionary))]
            codes, sizes = pieces.indices.to_numpy(), np.fromiter(map(len, each), np.int64, len(each))
            starts, each = np.cumsum(sizes) - sizes, np.fromiter(chain.from_iterable(each), np.int32)
            sizes = sizes[codes]
            before = np.concatenate([[0], np.cumsum(sizes)])
            places = np.repeat(starts[codes] - before[:-1], sizes)
            places += np.arange(before[-1])
            flat = each[places]
            ends = before[ends]
            gaps = np.flatnonzero(flat < 0)
            opened = np.searchsorted(gaps, ends)
            # a run ends at each open word and at the end of its text; places count without open words
            stops = np.sort(np.concatenate([gaps - np.arange(len(gaps)), (ends - opened)[1:]]))
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), pa.array(flat[flat >= 0]))
            runs = pa.ListArray.from_arrays(pa.array(opened + np.arange(len(ends)), pa.int32()), runs)
            words = pa.ListArray.from_arrays(pa.array(opened, pa.int32()), pa.array(ids.open, pa.string()).take(pa.array(-1 - flat[gaps])))
            yield pa.RecordBatch.from_arrays([*batch.columns, runs, words], names=[*columns, "_runs", "_open"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "_runs array<array<int>>, _open array<string>"])
    return df.mapInArrow(found, schema)


def heap_encode(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word's bytes by a heap of pairs, in n log n, for words of any length."""
    end = [*range(1, len(raw) + 1)]
    before = [i - 1 for i in range(len(raw))]
    live = [True] * len(raw)
    rank = lambda i: ranks.get(raw[i : end[end[i]]]) if end[i] < len(raw) else None
    heap = [(r, i, end[end[i]]) for i in range(len(raw)) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not live[i] or end[i] >= len(raw) or end[end[i]] != stop:
            continue
        live[end[i]] = False
        end[i] = stop
        if stop < len(raw):
            before[stop] = i
        for k in (i, before[i]):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k, end[end[k]]))
    return [ranks[raw[i : end[i]]] for i in range(len(raw)) if live[i]]


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n) of all texts' words of less than KNOWN_BYTES."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        for batch in slices(batches, "text"):
            counts = cutter.all_pieces(batch.column("text"))[1].value_counts()
            yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.string()), counts.field(1)], names=["piece", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        for batch in batches:
            seen = Counter()
            for piece, n in zip(batch.column("piece").to_pylist(), batch.column("n").to_pylist(), strict=True):
                for word in cutter.words(piece):
                    seen[word] += n
            yield pa.RecordBatch.from_arrays([pa.array([*seen.keys()], pa.string()), pa.array([*seen.values()], pa.int64())], names=["word", "n"])

    pieces = df.select(F.col(text).alias("text")).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    words = pieces.mapInArrow(cut, "word string, n long").where(F.octet_length("word") < KNOWN_BYTES)
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(df: DataFrame, text: str, ranks: dict[bytes, int], pairs: Column, known: int = KNOWN) -> pa.Table:
    """The most frequent words of all texts, `known` at most, with their ids as characters (word, letters)."""
    spark = df.sparkSession
    found = common.stored(word_counts(df, text), "words")
    # the least count that leaves few enough: exact below 1024, in small steps above, so a few thousand numbers
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 64) + 384).cast("int")
    least, total = 1 << 30, 0
    for at, n in found.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        total += n
        if total > known:
            break
        least = at
    top = found.where(level >= least).select("word").repartition(2 * spark.sparkContext.defaultParallelism, "word")
    letters = common.let(F.col("word"), lambda w: common.let(pairs, lambda p: fold(w, p, ranks)))
    rows = top.select("word", letters.alias("letters")).toArrow()
    common.forget(found)
    return rows


def encode(df: DataFrame, path: str, text: str = "text", known: int = KNOWN) -> DataFrame:
    """df with ids array<int>, the ids of each whole text by the ranks of a tiktoken file."""
    ranks, df = read_ranks(path), df.drop("ids")
    pairs = pair_table(ranks)
    found = look_up(df, text, dictionary(df, text, ranks, pairs, known), ranks)

    def filled(open_: Column) -> Column:
        folded = common.let(pairs, lambda p: F.transform(open_, lambda w: as_ids(fold(w, p, ranks))))
        # the last run has no open word behind it
        return F.flatten(F.zip_with("_runs", folded, lambda run, word: F.when(word.isNull(), run).otherwise(F.concat(run, word))))

    ids = F.when(F.size("_open") == 0, F.get("_runs", F.lit(0))).otherwise(common.let(F.col("_open"), filled))
    return found.withColumn("ids", ids).drop("_runs", "_open")


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids."""
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = F.split(F.lit(",".join(pieces)), ",")
    # ids are bound outside of all loops, where a Python function may give them
    return common.let(ids, lambda x: common.let(table, lambda p: F.unhex(F.array_join(F.transform(x, lambda i: F.get(p, i)), ""))))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = encode(common.table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(decode(F.col("ids"), read_ranks(path)), 256).alias("decoded_sha256"))
