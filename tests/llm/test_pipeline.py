"""The corpus pipeline: each stage's decisions by brute force, on tables with nulls, repeated rows and extra columns."""

import itertools
import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the house and river of stone with green water that holds old bread for every long winter in silent rooms".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ly", "er", "ing"]) for _ in range(n))


def documents(spark, texts):
    rows = [(i, t, "en", "web", len(t) if t is not None else None) for i, t in texts]
    # names that operators use themselves
    return spark.createDataFrame(rows, SCHEMA).withColumns({"kept": F.lit("x"), "score": F.lit(1), "_key": F.lit("y")})


def test_languages(spark):
    rng = random.Random(1)
    kinds = {"en": "the and of to in with from this that house river".split(), "de": "der die und das mit von nicht haus fluss über".split()}
    rows = [(i, " ".join(rng.choice(kinds[x]) for _ in range(30)), x, "web", 1) for i in range(60) for x in [("en", "de")[i % 2]]]
    rows += [(90, None, "en", None, None), (91, "", None, None, 0), (92, "12 34 !!", "de", "web", 8), (None, rows[0][1], None, None, 1), rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = corpus_pipeline.languages(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted((r for r in rows if r[1] and "12" not in r[1]), key=str)
    assert corpus_pipeline.languages(spark, docs.limit(0), "").count() == 0


def test_quality(spark):
    rng = random.Random(2)
    texts = [(1, prose(rng, 120)), (2, prose(rng, 20)), (3, None), (4, ""), (5, " ".join(["same three words"] * 40)), (None, prose(rng, 150)), (7, "## " * 200), (1, prose(rng, 90))]
    docs = documents(spark, texts)
    out = corpus_pipeline.quality(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r.text for r in out.collect())) == sorted(t for _, t in (texts[0], texts[5], texts[7]))


def test_lines(spark):
    rng = random.Random(3)
    run = "\n".join(prose(rng, 13) for _ in range(5))
    own = [prose(rng, 60) for _ in range(3)]
    docs = documents(spark, [(1, f"{own[0]}\n{run}"), (2, f"{run}\n{own[1]}"), (3, run), (None, own[2]), (5, None), (6, "")])
    out = corpus_pipeline.lines(spark, docs, "")
    assert out.columns == docs.columns
    # the first copy stays (that of document 1), later ones go, and a document that is nothing else goes with them
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(1, f"{own[0]}\n{run}", len(own[0]) + 1 + len(run)), (2, own[1], len(own[1])), (None, own[2], len(own[2])), (5, None, None), (6, "", 0)}


def test_near_duplicates(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(8):
        base = prose(rng, 100).split()
        for _ in range(rng.randrange(1, 6)):
            copy = base.copy()
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.randrange(99))
            texts.append((len(texts), " ".join(copy)))
    texts += [(0, prose(rng, 80)), (None, texts[0][1]), texts[3], (97, None), (98, ""), (99, "two words"), (100, "two words")]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    sets = [shingles((t or "").split()) for _, t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            x, y = sets[a], sets[b]
            if texts[a] == texts[b] or (x and y and 100 * len(x & y) >= 80 * len(x | y)):
                label[a] = label[b] = min(label[a], label[b])
    want = []
    for k in set(label):
        group = [texts[i] for i in range(len(texts)) if label[i] == k]
        least = min(group, key=lambda r: (r[0] is None, r[0] or 0))
        want.append((least[0], {t for d, t in group if d == least[0]}))
    docs = documents(spark, texts)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    found = [(r.doc_id, r.text) for r in out.collect()]
    assert len(found) == len(want) and len(found) < len(texts)
    for doc_id, text in found:
        assert any(doc_id == d and text in choice for d, choice in want)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_packing_takes_all(spark):
    rng = random.Random(5)
    texts = [(d, prose(rng, rng.randrange(1, 1500))) for d in range(20)] + [(None, "none"), (3, "again"), (50, None)]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = corpus_pipeline.packing(spark, documents(spark, texts), "").collect()
    assert sum(r.length for r in out) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in texts)


def test_run(spark, tmp_path):
    rng = random.Random(6)
    base = prose(rng, 200)
    texts = [(d, prose(rng, 150)) for d in range(30)] + [(40, base), (41, base), (42, base + " end"), (43, "short"), (44, None), (None, prose(rng, 130))]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {*range(30), 40, None}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "line_dedup", "ngram_jaccard", "best_fit_packing"]
