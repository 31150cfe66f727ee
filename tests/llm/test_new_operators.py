"""Fill-in-middle, substring dedup and whitening against brute force, on tables with nulls, empties, ties, repeated rows and clashing columns."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from worldstate.llm import embedding_whitening, fill_in_middle, substring_dedup

TEXTS = [None, "", "a", "é", "  ", "two words", "Größe 12\n\tü—x", "mark <S> inside", "a<P", "漢字かな mixed Text", "z" * 5000, "ab1" * 40000]


def by_hand(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return len(units), form, len(p), len(m), out


@pytest.mark.parametrize("parts", [1, 40])
def test_fill_in_middle(spark, parts):
    rng = random.Random(11)
    alphabet = "abYZ 1é\n<PSM>漢"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = [*enumerate(texts), (None, "no id at all"), (5, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("clash"), "output": F.lit(1), "extra": F.lit(2)}).repartition(parts)
    got = fill_in_middle.transform(df).withColumn("again", fill_in_middle.restore(F.col("output"), F.col("form"))).collect()
    assert sorted((repr(r.doc_id), r.n, r.form, repr(r.prefix_chars), repr(r.middle_chars), r.output) for r in got) == sorted((repr(d), x[0], x[1], repr(x[2]), repr(x[3]), x[4]) for d, t in rows for x in [by_hand(d, t)])
    assert all(r.again == (r.text or "") and r.extra == 2 for r in got)
    assert fill_in_middle.transform(df.limit(0)).count() == 0


def test_select_is_the_place_of_the_bit():
    rng = random.Random(1)
    for width in [0, 1, 2, 63, 64, 65, 1000]:
        bits = rng.getrandbits(width) if width else 0
        places = [i for i in range(width) if bits >> i & 1]
        assert [fill_in_middle.select(bits, k, width) for k in range(len(places) + 1)] == [*places, width]


def test_fill_in_middle_sql(spark, tmp_path):
    rows = pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS})
    rows.to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet'")
    got = fill_in_middle.op11_fill_in_middle(spark, str(tmp_path))
    want = con.execute(fill_in_middle.SQL).df()[got.columns].astype(object)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, (tuple(None if pd.isna(v) else v for v in r) for r in want.values.tolist())))


def removed_by_hand(rows, window):
    """kept words of each (id, text)."""
    seen, out = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for k in range(len(words) - window + 1):
            run = tuple(words[k : k + window])
            if run in seen:
                gone.update(range(k, k + window))
            seen.setdefault(run, (doc, k))
        out[doc, text] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


@pytest.mark.parametrize(("window", "anchor", "parts"), [(20, 8, 1), (20, 8, 40), (5, 2, 3), (3, 3, 2), (1, 1, 2)])
def test_substring_dedup(spark, window, anchor, parts):
    rng = random.Random(12)
    prose = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(n)]
    passage, loop = prose(50), prose(7)
    texts = [None, "", "one\x0btwo three", " ".join(prose(19)), " ".join(loop * 12), " ".join(["same"] * 90)]
    for _ in range(30):
        cut = sorted(rng.sample(range(51), 2))
        texts.append(" \n".join([*prose(rng.randrange(40)), *passage[cut[0] : cut[1]], *prose(rng.randrange(30)), *loop * rng.randrange(5)]))
    texts += [texts[8], texts[9], texts[4]]
    rows = [*enumerate(texts), (9, texts[9]), (None, texts[10])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit(7), "rid": F.lit("clash"), "starts": F.lit(1)}).repartition(parts)
    got = substring_dedup.dedup(df, window, anchor).collect()
    want = removed_by_hand(rows, window)
    assert sorted(repr((r.doc_id, r.text, r.n_words, r.n_removed, r.kept)) for r in got) == sorted(repr((*row, *want[row])) for row in rows)
    assert sum(r.n_removed for r in got) > 100 and got[0].rid == "clash"
    assert substring_dedup.dedup(df.limit(0), window, anchor).count() == 0


def test_substring_dedup_over_slices(spark, monkeypatch):
    words = [f"w{k % 311}" for k in range(1500)]
    rows = [(k, " ".join(words[k * 10 : k * 10 + 400])) for k in range(60)]
    monkeypatch.setattr(substring_dedup, "SLICE", 500)
    monkeypatch.setattr(substring_dedup, "REMEMBERED", 100)
    import pyarrow as pa

    texts = pa.RecordBatch.from_pydict({"rid": pa.array(range(60)), "text": [t for _, t in rows]})
    found = [b for b, _, _ in substring_dedup.slices(iter([texts]))]
    assert len(found) > 20 and sum(b.num_rows for b in found) == 60
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = removed_by_hand(rows, 20)
    assert {(r.doc_id, r.text): (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(df).collect()} == want


def whitened_by_hand(vectors, k):
    x = np.array([np.floor(256 * np.asarray(v, dtype=np.float32).astype(float)) for v in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    return (x - s / n) @ v[:, :k] / np.sqrt(e[:k]), ((n * x - s) ** 2).sum(axis=1), e[:k] / e.sum(), n


@pytest.mark.parametrize("parts", [1, 40])
def test_embedding_whitening(spark, parts):
    rng = np.random.default_rng(13)
    good = (rng.normal(size=(200, 7)) * [3, 2, 1.5, 1, 0.5, 0.1, 0.01] + 5).astype(np.float32).tolist()
    good += good[:3]
    bad = [None, [], [float("nan")] * 7, [None, *[1.0] * 6], [float("inf"), *[1.0] * 6], [1.0] * 3]
    df = spark.createDataFrame([*enumerate(good + bad)], "vec_id long, embedding array<float>").withColumns({"n": F.lit("clash"), "x": F.lit(1)}).repartition(parts)
    rows = embedding_whitening.whiten(df).collect()
    w, deviation, share, n = whitened_by_hand(good, 4)
    assert sorted((r.vec_id, r.component) for r in rows) == [(i, k) for i in range(len(good)) for k in range(1, 5)]
    for k in range(4):
        own = sorted((r for r in rows if r.component == k + 1), key=lambda r: r.vec_id)
        got = np.array([r.whitened for r in own])
        assert min(np.abs(got - w[:, k]).max(), np.abs(got + w[:, k]).max()) < 1e-9
        assert [r.deviation for r in own] == deviation.astype(int).tolist()
        assert {(r.n, r.x) for r in own} == {(n, 1)} and abs(own[0].explained / share[k] - 1) < 1e-9 and own[0].identity_error < 1e-9


def test_embedding_whitening_edges(spark):
    frame = lambda rows: spark.createDataFrame([*enumerate(rows)], "vec_id long, embedding array<double>")
    assert embedding_whitening.whiten(frame([[1.0, 2.0]]).limit(0)).count() == 0
    same = embedding_whitening.whiten(frame([[1.0, 2.0]] * 3)).collect()
    assert len(same) == 6 and {r.whitened for r in same} == {None} and {r.deviation for r in same} == {0} and {r.n for r in same} == {1}
    line = embedding_whitening.whiten(frame([[1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [4.0, 8.0, 12.0]])).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True, 3: True} and line[0].identity_error < 1e-9
    huge = embedding_whitening.whiten(frame([[1e12, 0.0], [-1e12, 1.0]])).collect()
    assert {r.deviation for r in huge} == {None}


def test_jacobi_is_accurate_for_small_values():
    rng = np.random.default_rng(3)
    u, _ = np.linalg.qr(rng.normal(size=(9, 6)))
    v, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    sizes = np.array([1e6, 1e3, 1.0, 1e-3, 1e-5, 0])
    got, right = embedding_whitening.jacobi(u * sizes @ v.T)
    assert np.allclose(got[:3], sizes[:3], rtol=1e-12) and np.allclose(np.abs((right * v).sum(axis=0))[:3], 1, atol=1e-12)
    for d in (1, 2, 5, 8):
        assert sorted((int(a), int(b)) for p, q in embedding_whitening.rounds(d) for a, b in zip(p, q)) == [(a, b) for a in range(d) for b in range(a + 1, d)]
