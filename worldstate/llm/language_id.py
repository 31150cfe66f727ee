"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Every language has a probability for each piece of the vocabulary. A word's probability under a language is the
sum, over all its segmentations into pieces, of the product of the pieces' probabilities: the forward algorithm.
A text's is the product over its words (runs of letters, lower-cased, with a word-start mark). The languages'
posterior with equal priors gives prediction and score; ties go to the first language in order.

Training: expectation-maximisation of the piece probabilities per language, over the distinct words of labelled
texts with their counts, by forward-backward in the tasks that hold the words. A model is langs x vocabulary
numbers. At most about `per_language` labelled documents a language are used, chosen by a hash of the id (a
documented bound of the fit); every document is scored on its whole text.

Defined cases: texts that are null or have no letter are `und` with score 0, as are all if nothing is labelled;
words of any length are summed over whole, in logarithms; repeated rows are scored alike; null ids are never trained
on; an empty table gives no rows; columns named as the results are replaced, other columns stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PER_LANGUAGE = 1000
ROUNDS = 2
#: Added to each piece's expected count; the probability of a letter that no piece holds; words a task remembers.
SMOOTH, UNKNOWN, KNOWN = 0.05, 1e-7, 500_000
START = "▁"


def words_of(text: str | None) -> list[str]:
    found = re.findall(r"[^\W\d_]+", (text or "").lower())
    return [w for w in ("".join(filter(str.isalpha, w)) if not w.isalpha() else w for w in found) if w]


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    kept = {p.lower() for p in pieces if p.replace(START, "").isalpha() and START not in p[1:] or p == START}
    return sorted(kept)


def prefixes(pieces: list[str]) -> set[str]:
    return {p[:n] for p in pieces for n in range(1, len(p) + 1)}


def edges(word: str, table: dict, starts: set[str]) -> list[list[tuple[int, object]]]:
    """For each end, the pieces that end there: (start, what the table has for the piece)."""
    into: list[list[tuple[int, object]]] = [[] for _ in range(len(word) + 1)]
    for i in range(len(word)):
        for j in range(i + 1, len(word) + 1):
            part = word[i:j]
            if part not in starts:
                if j == i + 1:
                    into[j].append((i, None))
                break
            found = table.get(part)
            if found is not None:
                into[j].append((i, found))
            elif j == i + 1:
                into[j].append((i, None))
    return into


class Forward:
    """log P(word) under each language, for many words at a time: the sum over all segmentations."""

    def __init__(self, table: dict[str, list[float]], n: int) -> None:
        self.n, self.number = n, {p: k for k, p in enumerate(table)}
        # behind the pieces: a letter that no piece holds, and no edge at all
        self.rows = np.array([*table.values(), [UNKNOWN] * n, [0.0] * n])
        self.longest = max(map(len, table), default=1)

    def same_length(self, words: list[str]) -> np.ndarray:
        none, letter, find = len(self.rows) - 1, len(self.rows) - 2, self.number.get
        # logs of the sums up to the last `longest` places; what a place adds is taken relative to the place before
        logs = deque([np.zeros((len(words), self.n))], maxlen=self.longest)
        for j in range(1, len(words[0]) + 1):
            last = logs[-1]
            now = self.rows[[find(w[j - 1 : j], letter) for w in words]]
            for back in range(2, len(logs) + 1):
                ids = [find(w[j - back : j], none) for w in words]
                there = [k for k, x in enumerate(ids) if x != none]
                if there:
                    now[there] += np.exp(logs[-back][there] - last[there]) * self.rows[[ids[k] for k in there]]
            logs.append(last + np.log(now))
        return logs[-1]

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.n))
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by_length.setdefault(len(word), []).append(k)
        for places in by_length.values():
            out[places] = self.same_length([START + words[k] for k in places])
        return out


def expected(word: str, table: dict[str, float], starts: set[str]) -> dict[str, float]:
    """Expected uses of each piece in a word's segmentations: logs of the forward sums, then how surely each place is a cut, from the end."""
    out: dict[str, float] = {}
    part = START + word
    into, n = edges(part, table, starts), len(part)
    logs, cut = [0.0], [0.0] * n + [1.0]
    for j in range(1, n + 1):
        last = logs[-1]
        logs.append(last + math.log(sum((p or UNKNOWN) * math.exp(logs[i] - last) for i, p in into[j])))
    for j in range(n, 0, -1):
        for i, p in into[j]:
            share = cut[j] * (p or UNKNOWN) * math.exp(logs[i] - logs[j])
            cut[i] += share
            if p:
                piece = part[i:j]
                out[piece] = out.get(piece, 0.0) + share
    return out


def fit(labelled: DataFrame, pieces: list[str], per_language: int = PER_LANGUAGE, rounds: int = ROUNDS, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, dict[str, float]]:
    """Piece probabilities by language."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id_col).isNotNull())
    share = rows.groupBy(F.col(lang).alias("lang")).count().withColumn("share", F.lit(float(per_language)) / F.col("count")).drop("count")
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), place.alias("place")).join(F.broadcast(share), "lang").where("place < share").select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for language, whole in zip(batch["lang"], batch["text"], strict=True):
                seen.update((language, w) for w in words_of(whole))
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["lang", "word", "n"])

    words = chosen.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = common.stored(words.repartition(2 * spark.sparkContext.defaultParallelism, "lang", "word"), "words")
    model: dict[str, dict[str, float]] = {}
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((model, pieces))

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tables, known = shared.value
            starts, flat = prefixes(known), dict.fromkeys(known, 1 / len(known))
            total: dict[tuple[str, str], float] = {}
            for batch in batches:
                for language, word, n in zip(batch["lang"], batch["word"], batch["n"], strict=True):
                    for piece, x in expected(word, tables.get(language) or flat, starts).items():
                        total[language, piece] = total.get((language, piece), 0.0) + n * x
            yield pd.DataFrame([(*k, x) for k, x in total.items()], columns=["lang", "piece", "x"])

        # decimals add up alike in any order
        sums = words.mapInPandas(expect, "lang string, piece string, x double").groupBy("lang", "piece").agg(F.sum(F.col("x").cast("decimal(28,6)")).cast("double").alias("x")).collect()
        counts: dict[str, dict[str, float]] = {}
        for language, piece, x in sums:  # languages x vocabulary at most
            counts.setdefault(language, {})[piece] = x
        model = {}
        for language, own in sorted(counts.items()):
            whole = sum(own.values()) + SMOOTH * len(pieces)
            model[language] = {p: (own.get(p, 0.0) + SMOOTH) / whole for p in pieces}
        shared.unpersist()
    return model


def predict(df: DataFrame, model: dict[str, dict[str, float]], text: str = "text") -> DataFrame:
    """df with lang_pred and score."""
    langs = sorted(model)
    table = {p: [model[x][p] for x in langs] for p in model[langs[0]]} if langs else {}
    shared = df.sparkSession.sparkContext.broadcast((langs, table))

    @F.pandas_udf("lang_pred string, score double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, found = shared.value
        forward = Forward(found, len(names)) if names else None
        known: dict[str, int] = {}
        logs = np.zeros((0, len(names)))

        def some(whole: list[str | None]) -> list[tuple[str, float]]:
            nonlocal logs
            words = [words_of(x) if names else [] for x in whole]
            if len(known) > KNOWN:
                known.clear()
                logs = logs[:0]
            if new := list(set().union(*words).difference(known)):
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                logs = np.concatenate([logs, forward(new)])
            rows = []
            for own in words:
                if own:
                    total = logs[[known[w] for w in own]].sum(axis=0)
                    best = int(total.argmax())
                    rows.append((names[best], float(1 / np.exp(total - total[best]).sum())))
                else:
                    rows.append(("und", 0.0))
            return rows

        for batch in texts:
            whole = batch.tolist()
            yield pd.DataFrame([r for at in range(0, len(whole), 500) for r in some(whole[at : at + 500])], columns=["lang_pred", "score"])

    out = df.drop("lang_pred", "score").withColumn("_found", score(text))
    return out.withColumns({"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score")}).drop("_found")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


def fit_and_predict(df: DataFrame, labelled: DataFrame, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return predict(df, fit(labelled, vocabulary(path or public_tokenizers.path("piece_bpe_32k.model"))))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return fit_and_predict(rows, docs.where(~held_out()).select("doc_id", "text", "lang")).drop("text")
