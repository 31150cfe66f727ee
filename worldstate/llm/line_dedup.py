"""Line dedup: repeated runs of lines by a suffix array over line ids, built by distributed prefix doubling.

A text is its sequence of \\n-split lines that have a word. A run is a stretch of lines of one text with
`least_words` words or more; it is repeated if the same lines stand somewhere earlier, in the order of
(doc_id, line). Every line that a repeated run covers is deleted, but where a run overlaps its own first copy: the lines
of that copy stay for its sake. A line of a first copy goes only if it belongs to another run that stands earlier.

1. Line ids are ranks of the lines that occur twice or more; only these take part further on.
2. Prefix doubling: the rank of 2**(k+1) lines from a place on is that of the pair (rank of 2**k lines there,
   rank of the next 2**k). A level's ranks are places in the global sort of its distinct pairs: the suffix
   array by its first 2**(k+1) lines. Places whose rank is unique leave. At most log2(least_words) levels.
3. LCP intervals: two places have m lines in common, at least, if they agree in m, the rank of the first and that
   of the last 2**k of these m lines, 2**k <= m. m is the fewest lines from a place on (or up to it) that have
   `least_words` words, so equal runs have equal m. All but an interval's first place are later copies.
   A maximal repeated run is the union of such shortest runs from each of its lines on and up to each of its lines.
4. The lines covered are gathered by document and filtered out.

Hot lines: ranks are counted with partial aggregation and met again in sort-merge joins, which Spark splits; no
group is collected. Each level is written to the shared folder. Ids of lines and documents are 64-bit hashes: lines that
collide count as equal, with a chance of n * n / 2**65 among n distinct lines. Texts without deletions are not moved while
the deletions are few enough to be broadcast, which is checked.

Defined cases: null texts stay null, empty ones empty; a text all of whose lines are copies becomes empty; rows
with equal id and text are one document and treated alike; a null id sorts first; an empty table gives no rows;
columns named text, n_lines and n_deleted are replaced, other columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

LEAST_WORDS = 50
#: Numbers (ids of documents, line numbers) that are broadcast at most.
BROADCAST = 2_000_000


def _places(batches: Iterator[pd.DataFrame], least_words: int) -> Iterator[pd.DataFrame]:
    """A row per line that has a word: its number among these (i) and in the text (line), hash, the lengths of the shortest runs from it on and up to it (0: none)."""
    columns = ["i", "line", "h", "on", "back"]
    for batch in batches:
        counts, parts, hashes = [], [], []
        for text in batch["text"]:
            found = [(r, line, n) for r, line in enumerate((text or "").encode().split(b"\n")) if (n := len(line.split()))]
            counts.append(len(found))
            if not found:
                continue
            total = np.cumsum([0, *(n for _, _, n in found)])
            here = np.arange(len(found))
            end = np.searchsorted(total, total[:-1] + least_words)
            start = np.searchsorted(total, total[1:] - least_words, side="right") - 1
            hashes += [hashlib.blake2b(line, digest_size=8).digest() for _, line, _ in found]
            parts.append((here, [r for r, _, _ in found], np.where(end < len(total), end - here, 0), np.where(start >= 0, here + 1 - start, 0)))
        if parts:
            here, line, on, back = (np.concatenate(x) for x in zip(*parts, strict=True))
            places = dict(zip(columns, (here, line, np.frombuffer(b"".join(hashes), dtype=">i8").astype("i8"), on, back), strict=True))
            yield pd.DataFrame({"rid": np.repeat(batch["rid"].to_numpy(), counts), "doc_id": np.repeat(batch["doc_id"].to_numpy(object), counts), **places})


def _ranked(places: DataFrame, by: list[str], name: str) -> DataFrame:
    """places with rank, the place of their `by` columns in the sort of those that occur twice or more; the others leave."""
    repeated = places.groupBy(*by).agg(F.count("*").alias("c")).where("c > 1").select(*by)
    in_order = common.stored(repeated.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), f"{name}-sorted")
    before, offsets = 0, []
    for part, n in sorted(tuple(r) for r in in_order.groupBy("part").count().collect()):  # a row per partition
        offsets.append((part, before))
        before += n
    shift = places.sparkSession.createDataFrame(offsets, "part int, shift long")
    ranks = in_order.join(F.broadcast(shift), "part").select(*by, (F.col("at") + F.col("shift")).alias("rank"))
    return common.stored(places.join(ranks, by), name)


def repeated_lines(df: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(rid, line) of every line of a later copy; df: rid, doc_id, text."""
    # ids pass Python as text: a null among them would turn numbers into floats
    found = df.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(lambda batches: _places(batches, least_words), "rid long, doc_id string, i int, line int, h long, on int, back int")
    places = found.withColumn("doc_id", F.col("doc_id").cast("long"))
    places = _ranked(common.stored(places.dropDuplicates(["rid", "i"]), "places"), ["h"], "level-0").drop("h")
    spot = Window.partitionBy("rid").orderBy("i")
    levels, k = [places.select("rid", "i", "rank")], 0
    runs = places.where("on > 0").select("rid", "doc_id", "i", F.col("on").alias("m"))
    runs = runs.unionByName(places.where("back > 0").select("rid", "doc_id", (F.col("i") - F.col("back") + 1).alias("i"), F.col("back").alias("m"))).distinct()
    # a run with a line that is never repeated is not repeated
    whole = places.select("rid", "i", F.row_number().over(spot).alias("nth"))
    last = whole.select("rid", F.col("i").alias("end"), F.col("nth").alias("nth_end"))
    runs = runs.join(whole, ["rid", "i"]).withColumn("end", F.col("i") + F.col("m") - 1).join(last, ["rid", "end"]).where("nth_end - nth = m - 1")
    runs = common.stored(runs.select("rid", "doc_id", "i", "m", F.floor(F.log2("m") + 1e-9).cast("int").alias("k")), "runs")
    deepest = runs.agg(F.max("k")).first()[0] or 0
    while k < deepest:
        step = 1 << k
        ahead = F.min("rank").over(spot.rangeBetween(step, step))
        pairs = levels[-1].withColumn("next", ahead).where("next is not null").withColumnRenamed("rank", "first")
        k += 1
        levels.append(_ranked(pairs, ["first", "next"], f"level-{k}").select("rid", "i", "rank"))
    ranks = levels[0].withColumn("k", F.lit(0))
    for n, level in enumerate(levels[1:], 1):
        ranks = ranks.unionByName(level.withColumn("k", F.lit(n)))
    start, end = ranks.withColumnRenamed("rank", "head"), ranks.select("rid", F.col("i").alias("j"), "k", F.col("rank").alias("tail"))
    keyed = runs.withColumn("j", F.col("i") + F.col("m") - F.expr("shiftleft(1, k)")).join(start, ["rid", "i", "k"]).join(end, ["rid", "j", "k"])
    keyed = common.stored(keyed.select("rid", "m", "head", "tail", F.struct("doc_id", "rid", "i").alias("place")), "keyed")
    first = keyed.groupBy("m", "head", "tail").agg(F.min("place").alias("first"))
    later = keyed.join(first, ["m", "head", "tail"]).where("place > first")
    start = F.when(F.col("place.rid") == F.col("first.rid"), F.greatest(F.col("place.i"), F.col("first.i") + F.col("m"))).otherwise(F.col("place.i"))
    covered = later.select("rid", F.explode(F.sequence(start, F.col("place.i") + F.col("m") - 1)).alias("i")).distinct()
    return covered.join(places.select("rid", "i", "line"), ["rid", "i"]).select("rid", "line")


def row_key(text: Column | str = "text", id_col: str = "doc_id") -> Column:
    return F.xxhash64(id_col, text)


def dedup(df: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the later copies of repeated runs deleted from text; adds n_lines (lines with a word) and n_deleted."""
    keyed = df.drop("n_lines", "n_deleted").withColumn("_rid", row_key(text, id_col))
    gone = repeated_lines(keyed.select(F.col("_rid").alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")), least_words)
    gone = common.stored(gone.groupBy("rid").agg(F.collect_set("line").alias("_gone")), "deleted").withColumnRenamed("rid", "_rid")
    lines = F.split(F.col(text), "\n")
    n_lines = F.size(F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: x.rlike(common.WORD)))
    kept = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_gone", i)), "\n"))
    out = _met(keyed, gone).withColumns({"n_lines": n_lines.cast("long"), "n_deleted": F.coalesce(F.size(F.coalesce("_gone", F.array().cast("array<int>"))), F.lit(0)).cast("long"), text: kept})
    return out.drop("_rid", "_gone")


def _met(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """keyed with _gone; texts move only if they have deletions that are too many to be broadcast, or if even their ids are."""
    documents, lines = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("_gone")), F.lit(0))).first()
    if 2 * documents + lines <= BROADCAST:
        return keyed.join(F.broadcast(gone), "_rid", "left")
    if documents > BROADCAST:
        return keyed.join(gone, "_rid", "left")
    ids = F.broadcast(gone.select("_rid"))
    touched = keyed.join(ids, "_rid", "left_semi").join(gone, "_rid")
    return touched.unionByName(keyed.join(ids, "_rid", "left_anti").withColumn("_gone", F.lit(None).cast("array<int>")))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
