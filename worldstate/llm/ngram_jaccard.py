"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the 64-bit hashes of its distinct word n-grams (fewer words: the whole sequence as one;
none: the empty set, linked with nothing). Two documents link when 100 * |x & y| >= percent * |x | y|.

1. Rows are known by a hash of id and text. Equal sets become one class; only its representative is joined.
2. Shingles get a global order, rarest first, by counts of all shingles in 2**20 hash buckets (8 MB, whatever
   the corpus size). In that order, two sets that share t shingles or more have k of them among the first
   |x| - t + k of x and the first |y| - t + k of y, for every k. A larger set needs t = ceil(|y| * percent / 100), which
   gives its probing prefix; the smaller one t = ceil(2 * |x| * percent / (100 + percent)), which gives its shorter
   indexed prefix. Each document takes the k with the least estimated cost: the longer prefix has more postings,
   and more of its tokens must meet before a pair is verified.
3. Rounds of neighbours: in each token that holds several components, each representative is paired with the next few
   in order of size, then in random order. Linked pairs are contracted to components. So a group of near copies that are
   mostly linked costs pairs in its number.
4. The pairs of a token that lie in different components are made if sizes, places in the order and sketches allow a link (a
   sketch has the parities of a set's hashes in 512 buckets, so two differ in no more bits than the sets in shingles). Those
   that share fewer than min(k, k') prefix tokens are dropped, and the rest verified. No link that could join two components is lost.
5. Components of all links, with alternating stars.

The steps' outcomes are written to the shared folder. Step 4 compares the representatives of a token that lie in
different components with each other; what it makes of them are the pairs that may link.

Defined cases: null and empty texts have n_shingles 0 and are their own component; repeated rows are equal sets; rows of
one id with different texts are linked each by its own text; a row with a null id counts as a document, without an
id to give to its component (null if no member has one); an empty table gives no rows; further columns of the input are
dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, links

BUCKETS, CHUNK = 1 << 20, 1 << 12
#: Row keys that are broadcast at most, of 8 bytes each.
BROADCAST_IDS = 2_000_000
#: Slices of the tokens, whose postings move one after the other.
SLICES = 4
#: What a candidate pair costs to verify, in rows of the join that finds it; a posting costs one, too.
PAIR_COST = 2
#: Rounds of neighbours before all pairs between components are made, and how many of them each has.
ROUNDS, NEXT = 3, 8
#: Words of 64 bits in a sketch.
SKETCH = 8


def shingles(text: Column, n: int = 4) -> Column:
    """The distinct n-gram hashes of a text; A-Z count as a-z."""
    words = F.filter(F.split(common.ascii_lower(F.coalesce(text, F.lit(""))), common.GAP), lambda w: w != "")

    def of(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(w) == 0, none).when(F.size(w) < n, F.array(F.xxhash64(F.size(w), F.array_join(w, " ")))).otherwise(F.array_distinct(grams))

    return common.let(words, of)


def row_key(id_col: str, text: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text))


SCAN = "key long, id string, n int, h1 long, h2 long, sketch array<long>, chunk int, counts binary"


def scan(sets: DataFrame) -> DataFrame:
    """One pass over the sets (key, id, s): a row per document with its size, 128-bit print and sketch, and a task's counts of shingles by hash bucket."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        names = [x.split()[0] for x in SCAN.split(", ")]
        kinds = dict.fromkeys(("key", "n", "h1", "h2", "chunk"), "Int64")
        for batch in batches:
            rows = []
            for key, id_, s in zip(batch["key"], batch["id"], batch["s"], strict=True):
                s = np.sort(np.asarray(s, dtype=np.int64))
                np.add.at(counts, s & (BUCKETS - 1), 1)
                h = xxhash.xxh3_128_digest(s.tobytes())
                bits = np.bincount((s >> 32) & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
                rows.append((key, id_, len(s), *(int.from_bytes(h[a : a + 8], "big", signed=True) for a in (0, 8)), np.packbits(bits.astype(bool)).view(">i8").astype("i8"), None, None))
            yield pd.DataFrame(rows, columns=names).astype(kinds)
        parts = [(*[None] * 6, k, zlib.compress(c.tobytes(), 1)) for k, c in enumerate(counts.reshape(-1, CHUNK)) if c.any()]
        yield pd.DataFrame(parts, columns=names, dtype=object).astype(kinds)

    return sets.mapInPandas(look, SCAN)


def bucket_counts(found: DataFrame) -> np.ndarray:
    """How many of all shingles fall into each hash bucket: BUCKETS numbers, added up in tasks that hold a chunk each."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch["chunk"], batch["counts"], strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(zlib.decompress(counts), dtype=np.int64)
        yield pd.DataFrame([(k, zlib.compress(c.tobytes(), 1)) for k, c in sums.items()], columns=["chunk", "counts"])

    out = np.ones(BUCKETS, dtype=np.int64)
    for chunk, counts in found.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInPandas(add, "chunk int, counts binary").collect():
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.maximum(np.frombuffer(zlib.decompress(counts), dtype=np.int64), 1)
    return out


def classes(prints: DataFrame) -> DataFrame:
    """key, id, n and rep, the least key with an equal set."""
    same = ["n", "h1", "h2"]
    first = prints.where("n > 0").groupBy(*same).agg(F.min("key").alias("rep"))
    return prints.join(first, same, "left").select("key", F.col("id").cast("long").alias("id"), "n", F.coalesce("rep", "key").alias("rep"))


def prefixes(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """token, key, n, k, at, indexed: the postings of each document's adaptive prefix, with their places in it."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    total = max(1, int(counts.sum()))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = shared.value
        usual = total / len(weights)
        noise = 4 * (usual + np.sqrt(usual) + 1)
        for batch in batches:
            parts = []
            for key, s in zip(batch["key"], batch["s"], strict=True):
                n = len(s)
                if not n:
                    continue
                h = np.asarray(s, dtype=np.int64)
                w = weights[h & (BUCKETS - 1)]
                order = np.lexsort((h, w))
                # a bucket's surplus over the usual one estimates how many partners its shingle brings
                partners = np.cumsum(np.maximum(w[order] - noise, 0))
                free = n - -(-n * percent // 100)
                ks = np.arange(1, n - free + 1)
                k = int(ks[np.argmin(free + ks + partners[free + ks - 1] * (1 + PAIR_COST / ks**2))])
                length, index = free + k, n - -(-2 * n * percent // (100 + percent)) + k
                at = np.arange(length)
                parts.append((h[order[:length]], np.full(length, key), np.full(length, n), np.full(length, k), at, at < index))
            if parts:
                yield pd.DataFrame({name: np.concatenate(x) for name, x in zip(("token", "key", "n", "k", "at", "indexed"), zip(*parts, strict=True), strict=True)})

    return sets.mapInPandas(pick, "token long, key long, n int, k int, at int, indexed boolean")


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int, name: str) -> DataFrame:
    """Those of the pairs (a, b) that link, by the sets of the documents in them; texts: key, t."""
    pairs = common.stored(pairs, f"{name}-pairs", clean=True)
    wanted = common.stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), f"{name}-docs", clean=True)
    # keys of a checked number are broadcast, so that no text moves; more meet the texts in a shuffle join
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    sets = texts.join(side, "key", "left_semi").dropDuplicates(["key"]).select("key", shingles(F.col("t"), n).alias("s"))
    sets = common.stored(sets, f"{name}-sets", clean=True)
    left, right = sets.select(F.col("key").alias("b"), F.col("s").alias("sb")), sets.select(F.col("key").alias("a"), F.col("s").alias("sa"))
    # pairs of a checked number are broadcast, so that sets move once, for the other side
    few = F.broadcast(pairs) if pairs.count() <= BROADCAST_IDS // 2 else pairs
    both = few.join(left, "b").join(right, "a").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    linked = both.where(F.col("i") * 100 >= (F.size("sa") + F.size("sb") - F.col("i")) * percent).select("a", "b")
    linked = common.stored(linked, f"{name}-links", clean=True)
    common.forget(pairs, wanted, sets)
    return linked


def fits(percent: int) -> Column:
    """a is the smaller set, indexed by the token; sizes and places allow a link of which the token is one of the first k shared ones."""
    first = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))
    before = F.least(F.col("ka") - 1, F.col("kb") - 1, F.col("ata"), F.col("atb"))
    most = before + F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))
    room = most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    return first & F.col("ia") & (F.col("na") * 100 >= F.col("nb") * percent) & room


def alike(percent: int) -> Column:
    """The sketches differ in no more bits than linked sets may in shingles."""
    bits = sum((F.bit_count(F.get("sa", F.lit(k)).bitwiseXOR(F.get("sb", F.lit(k)))) for k in range(1, SKETCH)), F.bit_count(F.get("sa", F.lit(0)).bitwiseXOR(F.get("sb", F.lit(0)))))
    return bits * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)


def meet(pairs: DataFrame) -> DataFrame:
    """Distinct candidates (a, b) of a row per shared prefix token: those that share min(k, k')."""
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min(F.least("ka", "kb")).alias("k"))
    return counted.where("shared >= k").select("a", "b")


SIDE = {"key": "", "n": "n", "k": "k", "at": "at", "indexed": "i", "c": "c"}


def _side(s: str, prefix: str = "", names: dict[str, str] = SIDE) -> list[Column]:
    return [F.col(f"{prefix}{x}").alias(f"{y}{s}") for x, y in names.items()]


def neighbours(open_: DataFrame, percent: int, turn: int) -> DataFrame:
    """Candidates of each representative of a token and the NEXT ones behind it in other components: by size first, then in another random order each turn."""
    members, order = F.struct(*SIDE), ["n", "key"] if turn == 0 else [F.xxhash64("key", F.lit(turn))]
    by_token = Window.partitionBy("token").orderBy(*order)
    near = open_.select("c", members.alias("own"), F.array_compact(F.array(*(F.lead(members, j).over(by_token) for j in range(1, NEXT + 1)))).alias("others"))
    both = near.select("own", F.explode(F.filter("others", lambda x: x["c"] != F.col("c"))).alias("other"))
    own_first = F.expr("own.n < other.n or (own.n = other.n and own.key < other.key)")
    a, b = F.when(own_first, F.col("own")).otherwise(F.col("other")), F.when(own_first, F.col("other")).otherwise(F.col("own"))
    pairs = both.select(a.alias("x"), b.alias("y")).select(*_side("a", "x."), *_side("b", "y."))
    return meet(pairs.where(fits(percent)))


def linked_rows(df: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """key (see row_key), id, n and group, the least key that links reach, of every row."""
    texts = df.select(row_key(id_col, text).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))
    # ids pass Python as text: a null among them would turn numbers into floats
    sets = texts.select("key", F.col("id").cast("string").alias("id"), shingles(F.col("t"), n).alias("s"))
    scanned = common.stored(scan(sets), "scan", clean=True)
    prints = scanned.where("key is not null")
    members = common.stored(classes(prints), "classes", clean=True)
    reps = members.where("key = rep and n > 0").select("key").distinct()

    postings = common.stored(prefixes(sets, bucket_counts(scanned), percent), "postings", clean=True)
    # most tokens occur once, or are indexed nowhere: they leave by a count of the bare tokens, before any wider row moves
    several = postings.groupBy("token").agg(F.count("*").alias("c"), F.max("indexed").alias("i")).where("c > 1 and i").select("token")
    # stored by itself, so that the tokens' shuffle is gone before that of the wider rows begins
    several = common.stored(several, "tokens", clean=True)
    # a slice's shuffle is gone before the next one's begins
    part = F.pmod("token", F.lit(SLICES))
    often = [common.stored(postings.where(part == k).join(several.where(part == k), "token", "left_semi"), "several", clean=True) for k in range(SLICES)]
    common.forget(postings, several)
    met = common.stored(reduce(DataFrame.unionByName, often).join(reps, "key", "left_semi").distinct(), "met", clean=True)
    common.forget(*often)

    edges, near, left = None, None, met
    for turn in range(ROUNDS + 1):
        if near is None:
            marked = left.withColumn("c", F.col("key"))
        else:
            # components of a checked number are broadcast, so that no posting moves
            by_key = near.select(F.col("node").alias("key"), "component")
            by_key = F.broadcast(by_key) if near.count() <= BROADCAST_IDS else by_key
            marked = left.drop("c").join(by_key, "key", "left").withColumn("c", F.coalesce("component", "key")).drop("component")
        open_ = marked.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("token")
        open_ = common.stored(marked.join(open_, "token", "left_semi"), "open", clean=True)
        # a token whose representatives lie in one component stays closed
        common.forget(left)
        left = open_
        if turn < ROUNDS:
            found = verify(neighbours(open_, percent, turn), texts.select("key", "t"), n, percent, f"near-{turn}")
        else:
            # sketches are wide, so they come only to the postings that the rounds have left
            with_sketch = common.stored(open_.join(prints.select("key", "sketch").dropDuplicates(["key"]), "key"), "sketched", clean=True)
            a, b = (with_sketch.select("token", *_side(s, names=SIDE | {"sketch": "s"})) for s in "ab")
            found = verify(meet(a.join(b, "token").where((F.col("ca") != F.col("cb")) & fits(percent) & alike(percent))), texts.select("key", "t"), n, percent, "rest")
            common.forget(with_sketch)
        # components stand for the links found so far
        former = [] if near is None else [near.where("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))]
        edges = found
        for x in former:
            edges = edges.unionByName(x)
        near = common.stored(links.components(edges), "near", clean=True)
    out = members.join(near.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return out.select("key", "id", "n", F.coalesce("component", "rep").alias("group"))


def join(df: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id that links reach, of every row."""
    rows = common.stored(linked_rows(df, n, percent, id_col, text), "linked", clean=True)
    least = rows.groupBy("group").agg(F.min("id").alias("component_id"))
    return rows.join(least, "group").select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))
