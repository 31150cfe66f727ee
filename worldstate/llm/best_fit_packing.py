"""Best-fit packing: token pieces into sequences of bounded length by a grouping genetic algorithm on islands.

A document becomes the tokenizer's ids and an end id. Only documents longer than a sequence are cut, from the
end, so that all pieces but the first are full. The pieces are dealt evenly over tasks (never by a
key), which cut theirs into islands, each of which evolves packings of its own pieces:
  individual  a list of bins: by best fit over descending or noisy descending lengths, or the migrated bins and best fit;
  crossover   whole well-filled bins of one parent go into the other, bins there that hold one of their pieces
              are dissolved, displaced pieces are placed again by best fit, longest first;
  mutation    the least filled bins of a child dissolve; a displaced piece takes the place of a shorter one where it fills a
              bin better, and the shorter one is placed instead;
  selection   fewest bins, then most uneven fill; the best individual always survives. An island stops at the least number.
Migration: after each round the exactly full bins are final. The other well-filled bins of an island's best individual are
its elite: they travel whole, are dealt over the next islands, and seed individuals there. All other bins dissolve, and
the pieces are dealt anew, until a last round on what is left.

Every round is written to the shared folder, so a lost executor repeats a task of one round, with the same
result: dealing is by position in written files and the random numbers depend on the island's pieces alone.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as often as they occur; an
empty table gives no rows; further columns of the input are dropped.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

LENGTH = 1024
END_ID = 2
#: Pieces an island holds at a time, individuals, generations and rounds.
ISLAND, POPULATION, GENERATIONS, ROUNDS = 4096, 5, 8, 3
#: Tasks of a round for each core, at most.
TASKS = 8

PIECE = "doc_id string, piece int, start long, length long, ids_crc32 long"


def pieces(df: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece of each document: doc_id, piece, start, length, ids_crc32, and its ids if asked for."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens.encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, whole in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.asarray([*encode(whole or ""), end_id], dtype="<u4")
                first = (len(ids) - 1) % length + 1
                for k, end in enumerate(range(first, len(ids) + 1, length)):
                    part = ids[max(0, end - length) : end] if k else ids[:first]
                    rows.append((doc_id, k, end - len(part), len(part), zlib.crc32(part.tobytes()), *([part.astype("i4")] if with_ids else ())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else ())])

    # ids pass Python as text: a null among them would turn numbers into floats
    found = df.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInPandas(cut, PIECE + ", ids array<int>" * with_ids)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


class Bins:
    """A packing: bins of item numbers, found by remaining room in constant time."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.items, self.room, self.mask = capacity, [], [], 0
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, items: list[int], room: int) -> None:
        self.by_room[room].append(len(self.items))
        self.mask |= 1 << room
        self.items.append(items)
        self.room.append(room)

    def put(self, item: int, size: int) -> None:
        """Best fit: into the bin with the least sufficient room, else into a new one."""
        fits = self.mask >> size
        if not fits:
            self.add([item], self.capacity - size)
            return
        room = size + (fits & -fits).bit_length() - 1
        k = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask &= ~(1 << room)
        self.items[k].append(item)
        self.room[k] = left = room - size
        self.by_room[left].append(k)
        self.mask |= 1 << left

    def fitness(self) -> tuple[int, int]:
        return (-len(self.items), sum(x * x for x in self.room))


def fill(order: list[int], sizes: list[int], capacity: int, start: Bins | None = None) -> Bins:
    bins = start or Bins(capacity)
    for i in order:
        bins.put(i, sizes[i])
    return bins


def well_filled(bins: Bins) -> list[int]:
    return [k for k, room in enumerate(bins.room) if room * 50 <= bins.capacity]


def cross(mother: Bins, father: Bins, sizes: list[int], rng: random.Random) -> Bins:
    """The mother with a random half of the father's well-filled bins, mutated; displaced items are placed anew."""
    well = well_filled(father)
    child, inside, displaced = Bins(mother.capacity), set(), []
    for k in rng.sample(well, len(well) // 2):
        child.add([*father.items[k]], father.room[k])
        inside.update(father.items[k])
    for items, room in zip(mother.items, mother.room, strict=True):
        if inside.isdisjoint(items):
            child.add([*items], room)
        else:
            displaced += [i for i in items if i not in inside]
    return mutated(child, displaced, sizes, rng)


def mutated(bins: Bins, loose: list[int], sizes: list[int], rng: random.Random, dissolved: int = 3, tries: int = 20) -> Bins:
    """bins with the least filled ones dissolved and all loose items placed: in exchange for a shorter one if that fills a bin better, else by best fit."""
    worst = set(sorted(range(len(bins.items)), key=lambda k: -bins.room[k])[:dissolved])
    kept = [(items, room) for k, (items, room) in enumerate(zip(bins.items, bins.room, strict=True)) if k not in worst]
    loose = loose + [i for k in worst for i in bins.items[k]]
    open_ = [k for k, (_, room) in enumerate(kept) if room]
    for n, item in enumerate(loose):
        for k in rng.sample(open_, min(tries, len(open_))):
            items, room = kept[k]
            spot = next((j for j, other in enumerate(items) if 0 < sizes[item] - sizes[other] <= room), None)
            if spot is not None:
                kept[k] = ([*items[:spot], item, *items[spot + 1 :]], room - sizes[item] + sizes[items[spot]])
                loose[n] = items[spot]
                break
    out = Bins(bins.capacity)
    for items, room in kept:
        out.add(items, room)
    return fill(sorted(loose, key=lambda i: -sizes[i]), sizes, bins.capacity, out)


def evolve(sizes: list[int], capacity: int, migrated: list[list[int]] = [], population: int = POPULATION, generations: int = GENERATIONS) -> Bins:  # noqa: B006
    """The best packing found; migrated: bins, as lists of items, that come from other islands."""
    rng = random.Random(zlib.crc32(np.asarray(sizes, dtype="<i8").tobytes()))
    n = range(len(sizes))
    everyone = [fill(sorted(n, key=lambda i: -sizes[i]), sizes, capacity)]
    least = -(-sum(sizes) // capacity)
    if migrated and len(everyone[0].items) > least:
        seeded, inside = Bins(capacity), {i for items in migrated for i in items}
        for items in migrated:
            seeded.add([*items], capacity - sum(sizes[i] for i in items))
        everyone.append(fill(sorted((i for i in n if i not in inside), key=lambda i: -sizes[i]), sizes, capacity, seeded))
    while len(everyone) < population and min(len(x.items) for x in everyone) > least:
        noisy = [s * rng.uniform(0.7, 1) for s in sizes]
        everyone.append(fill(sorted(n, key=lambda i: -noisy[i]), sizes, capacity))
    for _ in range(generations):
        everyone.sort(key=Bins.fitness, reverse=True)
        if len(everyone[0].items) <= least:
            break
        children = [cross(everyone[0], other, sizes, rng) for other in everyone[1:]] + [cross(everyone[-1], everyone[0], sizes, rng)]
        everyone = sorted(everyone + children, key=Bins.fitness, reverse=True)[:population]
    return max(everyone, key=Bins.fitness)


def islands_of(batches: Iterator[pa.RecordBatch], island: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task, `island` at a time, however Arrow has cut them."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        while n >= island:
            whole = pa.Table.from_batches(held)
            yield whole.slice(0, island).combine_chunks().to_batches()[0]
            held, n = whole.slice(island).to_batches(), n - island
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pack(items: DataFrame, length: int = LENGTH, island: int = ISLAND, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces with a length of at most `length` each."""
    columns = items.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long, room long"
    rest, done = items.withColumn("_bin", F.lit(None).cast("long")), []
    for k in range(rounds):
        # islands are cut inside tasks, whose number follows the cores, not the rows
        n = max(1, min(-(-rest.count() // island), TASKS * items.sparkSession.sparkContext.defaultParallelism))

        def islands(batches: Iterator[pa.RecordBatch], k: int = k) -> Iterator[pa.RecordBatch]:
            made = 0
            for own in islands_of(batches, island):
                sizes = own.column("length").to_numpy(zero_copy_only=False)
                groups: dict[int, list[int]] = {}
                for i, b in enumerate(own.column("_bin").to_pylist()):
                    if b is not None:
                        groups.setdefault(b, []).append(i)
                bins = evolve(sizes.tolist(), length, [*groups.values()])
                order = np.asarray([i for x in bins.items for i in x], dtype="i8")
                counts = [len(x) for x in bins.items]
                ends = np.cumsum(sizes[order])
                starts = ends - sizes[order]
                offset = starts - np.repeat(starts[np.cumsum([0, *counts[:-1]])], counts)
                number = (k << 58) + (TaskContext.get().partitionId() << 32) + made + np.repeat(np.arange(len(counts)), counts)
                made += len(counts)
                taken = own.take(pa.array(order))
                added = [number.astype("i8"), offset.astype("i8"), np.repeat(np.asarray(bins.room, dtype="i8"), counts)]
                yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in columns), *map(pa.array, added)], names=[*columns, "sequence_id", "offset", "room"])

        # a bin's pieces are dealt together, loose ones each by itself
        key = F.coalesce(F.col("_bin"), F.monotonically_increasing_id())
        dealt = rest.withColumn("_key", key).repartition(n, F.xxhash64("_key")).sortWithinPartitions(F.xxhash64("_key"), "_key").drop("_key")
        packed = common.stored(dealt.mapInArrow(islands, schema), f"packed-{k}")
        last = k == rounds - 1
        done.append(packed if last else packed.where("room = 0"))
        elite = F.when(F.col("room") * 50 <= length, F.col("sequence_id"))
        rest = packed.where("room > 0").withColumn("_bin", elite).select(*columns, "_bin")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("room")


def pack_documents(df: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return pack(common.stored(pieces(df, tokenizer, length, end_id), "pieces"), length)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
