"""The numbered operators against brute force, on small tables with nulls, empties, ties and repeated rows."""

import base64
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from worldstate.llm import best_fit_packing, byte_bpe, common, html_extraction, language_id, line_dedup, links, nearest_neighbours, ngram_jaccard, quality_rules, tokens, url_filters, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_line_dedup(spark):
    rng = random.Random(1)
    run = "\n".join(prose(rng, 12) for _ in range(6))
    short = prose(rng, 9)
    texts = [f"{prose(rng, 20)}\n{run}\n{prose(rng, 5)}", f"{short}\n{run}\n\n{short}", f"{run}", f"{short}\n{prose(rng, 60)}", None, "", f"{run}\n{run}", prose(rng, 60)]
    texts.append(texts[-1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    found = {r.doc_id: r for r in line_dedup.dedup(df).collect()}
    lines = {d: [(k, x, len(x.split())) for k, x in enumerate((t or "").split("\n")) if x.split()] for d, t in enumerate(texts)}
    places = [(d, i) for d in lines for i in range(len(lines[d]))]
    gone = {d: set() for d in lines}
    for a, b in itertools.combinations(places, 2):
        x, y = lines[a[0]][a[1] :], lines[b[0]][b[1] :]
        n = next((k for k, (p, q) in enumerate(zip(x, y)) if p[1] != q[1]), min(len(x), len(y)))
        if sum(z[2] for z in y[:n]) >= 50:
            # of a run that overlaps its own first copy, that copy stays
            m = next(k for k in range(1, n + 1) if sum(z[2] for z in y[:k]) >= 50)
            kept = min((p[1] for p in places if p[0] == b[0] and [z[1] for z in lines[b[0]][p[1] : p[1] + m]] == [z[1] for z in y[:m]]), default=0)
            gone[b[0]].update(z[0] for k, z in enumerate(y[:n]) if a[0] != b[0] or b[1] + k >= kept + m)
    for d, t in enumerate(texts):
        assert found[d].text == (t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]))
        assert (found[d].n_lines, found[d].n_deleted) == (len(lines[d]), len(gone[d]))
    assert gone[2] and found[8].text == ""
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(150, 8)).astype(np.float32)
    m[20], m[21] = m[3], m[3]
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(200, None), (220, [0.0] * 8), (240, [float("nan")] * 8), (260, [None] + [1.0] * 7), (280, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    found = {}
    for r in nearest_neighbours.search(df, F.col("vec_id") % 20 == 0, 5, block=32, query_block=3).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    score = m.astype(float) @ m.astype(float).T
    assert sorted(found) == list(range(0, 150, 20))
    for q, got in found.items():
        best = sorted((i for i in range(150) if i != q), key=lambda i: (-round(score[q, i], 9), i))[:5]
        assert [v for _, v, _ in sorted(got)] == best
        assert np.allclose([s for _, _, s in sorted(got)], score[q, best])
    assert nearest_neighbours.search(df.limit(0), F.lit(True)).count() == 0


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "a\r\n\r\nWARC/1.1\r\n\r\nb"), (6, "http://f", "long" * 9)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = f"{tmp_path}/w"
    warc.write(warc.resolve(warc.records(df)), path)
    found = {r.page_id: r for r in warc.follow(warc.read(spark, path)).collect()}
    for page, url, html in pages:
        raw = (html or "").encode()
        assert (found[page].payload_bytes, found[page].url) == (len(raw), url)
        assert found[page].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {p: (r.record_type, r.refers_to) for p, r in found.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert found[5].payload == pages[4][2] and found[1].payload is None
    assert {r.record_type for r in warc.resolve(warc.records(df), 1000).collect()} == {"response"}


def test_url_filters(spark):
    rng = random.Random(3)
    hosts = ["com", "example.com", "a.example.com", "net", "x.net", ""]
    rules = [(rng.choice(["allow", "block"]), h, p) for h in hosts for p in rng.sample(["", "/", "/a", "/a/b", "/a/", "/b/c"], 3)]
    urls = [f"http://{h}{p}{s}" for h in ["Example.COM", "b.a.example.com", "x.net", "org", "notexample.com"] for p in ["", "/", "/a", "/a/b/c", "/ab"] for s in ["", "?q=/a", "#f"]] + [None, "no url", "http://"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")

    def judge(url):
        if not url or "://" not in url:
            host = path = ""
        else:
            rest = url.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0].lower()
            path = re.split("[?#]", rest[len(host) :])[0]
        fits = [r for r in rules if (not r[1] or host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: (r[1].count(".") + bool(r[1]), len(r[2]), r[0] == "allow"), default=None)
        return (host, path, best and best[1] + best[2], best[0] if best else "allow")

    for most in (1000, 1):
        out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(df, rules, broadcast_rules=most).collect()}
        assert out == {i: judge(u) for i, u in enumerate(urls)}


def test_quality_rules(spark):
    rng = random.Random(4)
    good = " ".join(f"{w} the" for w in prose(rng, 60).split())
    texts = [None, "", "one two", good, "a b c " * 40, "same line here\n" * 30, good + " # * $", "é " * 60 + good]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit("clash"))
    for r in quality_rules.judge(df).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        assert (r.n_words, r.n_repeat_words, r.word_chars) == (len(w), len(covered), sum(map(len, w)))
        assert r.base_failed == (len(w) < 50 or 2 * len(covered) > len(w))
        assert not (r.kept and r.base_failed)
    assert quality_rules.judge(df).where("doc_id = 3").first().kept


def test_ngram_jaccard(spark):
    rng = random.Random(5)
    base = prose(rng, 120).split()
    texts = [None, "", "One two", "one TWO", "one two three", prose(rng, 80)]
    for _ in range(25):
        copy = base.copy()
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(len(copy))] = "edit" + str(rng.randrange(9))
        texts.append(" ".join(copy))
    chain = prose(rng, 200).split()
    for k in range(12):
        texts.append(" ".join(chain[k * 3 : k * 3 + 120]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {}
    for d, t in enumerate(texts):
        w = (t or "").lower().split()
        sets[d] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                label[a] = label[b] = min(label[a], label[b])
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.join(df).collect()}
    assert found == {d: (len(sets[d]), label[d]) for d in sets}
    assert ngram_jaccard.join(df.limit(0)).count() == 0


def test_ngram_jaccard_links_rows_not_ids(spark):
    a, b = prose(random.Random(1), 60), prose(random.Random(2), 60)
    data = [(1, a), (1, b), (2, b + " word"), (3, a + " word"), (None, a), (None, "alone here"), (7, a), (7, a)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"n_shingles": F.lit("x"), "component_id": F.lit("y"), "key": F.lit(1), "rep": F.lit(2)})
    found = sorted(rows(ngram_jaccard.join(df).select("doc_id", "component_id")), key=str)
    assert found == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (None, 1), (None, None), (7, 1), (7, 1)], key=str)


def test_ngram_jaccard_of_a_hot_group(spark):
    """Near copies about the threshold, from one base: components as by brute force, with lengthened prefixes too."""
    rng = random.Random(3)
    base = prose(rng, 150).split()
    texts = []
    for _ in range(120):
        copy = base.copy()
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(copy[rng.randrange(8) : len(copy) - rng.randrange(8)]))
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in map(str.split, texts)]
    label = [*range(len(texts))]
    for _ in range(9):
        for i, j in itertools.combinations(range(len(texts)), 2):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                label[i] = label[j] = min(label[i], label[j])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for cost in (2, 500):
        ngram_jaccard.PAIR_COST = cost
        assert {r.doc_id: r.component_id for r in ngram_jaccard.join(df).collect()} == dict(enumerate(label))
    ngram_jaccard.PAIR_COST = 2


def test_line_dedup_keeps_the_first_of_overlapping_copies(spark):
    line = "one two three four five six seven eight nine ten"
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big, "\n".join([line] * 10)), (None, "x " * 60), (None, None), (big + 1, line * 2000)], "doc_id long, text string")
    for most in (2_000_000, 3, 0):
        line_dedup.BROADCAST = most
        found = {r.doc_id: r for r in line_dedup.dedup(df).collect() if r.doc_id}
        assert found[big].text == "\n".join([line] * 5) and found[big].n_deleted == 5 and found[big + 1].n_deleted == 0
    line_dedup.BROADCAST = 2_000_000
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (40, 40)]
    found = dict(rows(links.components(spark.createDataFrame(edges, "a long, b long"))))
    assert found == dict.fromkeys(range(21), 0) | {30: 30, 31: 30}


def test_html_extraction(spark):
    def page(body, side):
        return f"<html><head><title>t</title><script>var x='<p>'</script></head><body><nav><a>Menu</a></nav><div class='cookie-notice'>We use</div><article><h1>A &amp; b</h1>{body}</article><aside>{side}</aside><div id=comments><p>first!</p></div><footer>(c)</footer>"

    pages = [(1, "http://h.org/1", page("<p>One <b>two</b>\n three<br>four<p>five", "x"), "A & b\nOne two three\nfour\nfive"), (2, "http://h.org/2", page("<!-- no --><div>six</div>", "y"), "A & b\nsix"), (3, None, None, ""), (4, "http://h.org/4", "", ""), (5, "http://i.org/", "plain &eacute; text", "plain é text")]
    pages += [(10 + k, f"http://t.org/{k}", f"<body><p>Welcome to T</p><p>Story {k} of its own length</p><p>All rights</p>", f"Story {k} of its own length") for k in range(5)]
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    for most in (1000, 0):
        found = {r.page_id: (r.text, r.n_chars) for r in html_extraction.extract(df, template_rows=most).collect()}
        assert {k: v for k, v in found.items() if k < 10} == {p[0]: (p[3], len(p[3])) for p in pages if p[0] < 10}
        assert {k: v for k, v in found.items() if k >= 10} == {p[0]: (p[3], len(p[3])) for p in pages if p[0] >= 10}


def test_html_classes_need_not_be_on_every_page(spark):
    """A notice on most pages, one empty page, an error page and a second layout leave the classes of the others."""
    story = lambda k: f"Story {k} of its very own and sufficient length, told at leisure"
    first = [(k, f"http://t.org/{k}", f"<body>{'<div class=info>We changed our terms</div>' * (k != 3)}<p>Welcome to T</p><p>{story(k)}</p><p>All rights</p>", story(k)) for k in range(8)]
    second = [(20 + k, f"http://t.org/s{k}", f"<body><section class=two><h2>Second wave</h2><p>{story(k + 20)}</p></section>", story(k + 20)) for k in range(4)]
    odd = [(40, "http://t.org/e", None, ""), (41, "http://t.org/f", "", ""), (42, "http://t.org/g", "<h1>Error 500</h1>", "Error 500")]
    # texts that three pages share, but no tag with them, are no template
    shared = [(50 + k, f"http://u.org/{k}", f"<body><p>{'Shared by three. ' * (k < 3)}</p><p>{story(k + 50)}</p>", ("Shared by three.\n" if k < 3 else "") + story(k + 50)) for k in range(6)]
    pages = first + second + odd + shared
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    for most in (1000, 0):
        assert {r.page_id: r.text for r in html_extraction.extract(df, template_rows=most).collect()} == {p[0]: p[3] for p in pages}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<body><div class="content has-sidebar"><article><p>Story</article><div class=sidebar>Side</div></div>', "Story"),
        ('<body><div id="no-sidebar"><main>Story</main></div>', "Story"),
        ('<body><div class="layout-with-comments"><p>The story is longer</p><div class="comments">first</div></div>', "The story is longer"),
        ("<html><head><title>t</title><meta charset=utf-8><body><nav>Menu</nav><p>Story</p>", "Story"),
        ("<head><title>t</title><p>Story</p>", "Story"),
        ("<head><title>t</title>Story", "Story"),
        ("<body><nav><a>Menu</a><article>Story</article>", "Story"),
        ("<body><header>Top<div>The story, which is longer than that</div>", "Top\nThe story, which is longer than that"),
        ("<body><form><p>The story</p><input></form><footer>A footer that is longer than the story</footer>", "The story"),
        ("<body><p>Story</p><div hidden><article>unseen</article></div><article class=comment>first</article>", "Story"),
        ("<body><p>Story, longer than the rest</p><div class=ad>Buy</div><footer>(c)</footer>", "Story, longer than the rest"),
    ],
)
def test_html_flags_do_not_reach_the_article(html, text):
    assert html_extraction.main_text(html) == text


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(6)
    texts = [None, "", "short"] + [prose(rng, rng.randrange(1, 900)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r.asDict() for r in best_fit_packing.pack_documents(df, path).collect()]
    t = Tokenizer.from_file(path)
    total = 0
    for d, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted((r for r in out if r["doc_id"] == d), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 1024 for r in own[1:])
        import zlib

        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.asarray(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
        total += len(ids)
    for _, group in itertools.groupby(sorted(out, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in group:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len({r["sequence_id"] for r in out}) <= -(-total // 1024) + 2


def test_packing_keeps_null_and_large_ids(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big, "a b"), (None, "c"), (big, "a b"), (5, None)], "doc_id long, text string").withColumn("offset", F.lit("clash"))
    out = best_fit_packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 5, big, big]
    assert best_fit_packing.pack_documents(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_packing_evolves(spark):
    """Fewer bins than best fit over descending lengths where that is not at the bound, from migrated bins too."""
    saved = 0
    for seed in range(30):
        rng = random.Random(seed)
        sizes = []
        for _ in range(40):
            a = rng.randrange(200, 500)
            b = rng.randrange(150, 1000 - a - 100)
            sizes += [a, b, 1000 - a - b]
        plain = best_fit_packing.fill(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, 1000)
        best = best_fit_packing.evolve(sizes, 1000)
        again = best_fit_packing.evolve(sizes, 1000, [best.items[k] for k in best_fit_packing.well_filled(best)])
        for bins in (best, again):
            assert sorted(i for x in bins.items for i in x) == list(range(len(sizes))) and all(sum(sizes[i] for i in x) + room == 1000 for x, room in zip(bins.items, bins.room))
        assert len(again.items) <= len(best.items) <= len(plain.items)
        saved += len(plain.items) - len(again.items)
    assert saved > 0


def test_encoder_is_the_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, t = tokens.encoder(path), Tokenizer.from_file(path)
    rng = random.Random(7)
    assert own("a<|endoftext|>b") == [64, 50256, 65]
    for _ in range(300):
        text = "".join(rng.choice(["<|endoftext|>", "<|endof", "text|>", " ", "\n", "a b", "!", "<|"]) for _ in range(rng.randrange(9)))
        assert own(text) == t.encode(text, add_special_tokens=False).ids
    for _ in range(2000):
        text = "".join(rng.choice(" \n\t\r\x85\xa0 ab'sté1٣.,!\x1c​日<|>") for _ in range(rng.randrange(14)))
        assert own(text) == t.encode(text, add_special_tokens=False).ids


def test_language_id(spark):
    rng = random.Random(8)
    kinds = {"en": "the and of to in with from this that house river".split(), "de": "der die und das mit von nicht haus fluss über".split()}
    docs = [(i, " ".join(rng.choice(kinds[x]) for _ in range(30)), x) for i in range(60) for x in [("en", "de")[i % 2]]]
    df = spark.createDataFrame([*docs, (100, None, None), (101, "123 !?", None), (102, "", "en"), (103, "und" * 50, None)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language_id.fit_and_predict(df, df.where("doc_id < 40")).collect()}
    assert all(out[i].lang_pred == x for i, _, x in docs)
    assert [out[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and 0 <= out[103].score <= 1
    assert {r.lang_pred for r in language_id.fit_and_predict(df, df.limit(0)).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    table = {"▁": [0.2], "a": [0.3], "b": [0.1], "ab": [0.25], "▁a": [0.15]}
    want = 0.2 * 0.3 * 0.1 + 0.2 * 0.25 + 0.15 * 0.1
    assert np.isclose(np.exp(language_id.Forward(table, 1)(["ab"]))[0, 0], want)
    uses = language_id.expected("ab", {k: v[0] for k, v in table.items()}, language_id.prefixes(list(table)))
    assert np.isclose(uses["ab"], 0.2 * 0.25 / want) and np.isclose(sum(len(p) * x for p, x in uses.items()), 3)


def test_forward_is_not_cut_in_long_words():
    table = {"▁": [0.2, 0.1], "a": [0.3, 0.2], "b": [0.1, 0.4], "ab": [0.25, 1e-6], "▁a": [0.15, 0.3], "bbab": [0.05, 1e-5]}
    rng = random.Random(9)
    long = "".join(rng.choice("abbc") for _ in range(2000))
    words = ["ab", long, "é", long[:41], long[1:]]
    found = language_id.Forward(table, 2)(words)
    for k, word in enumerate(words):
        for lang in range(2):
            # the plain recursion, with a number that is kept near 1
            part, sums, shift = "▁" + word, [1.0], 0.0
            for j in range(1, len(part) + 1):
                here = 0.0
                for n in range(1, 5):
                    if n <= j:
                        here += sums[-n] * table.get(part[j - n : j], [language_id.UNKNOWN if n == 1 else 0.0] * 2)[lang]
                sums = [x / here for x in sums[-4:]] + [1.0]
                shift += np.log(here)
            assert np.isclose(found[k, lang], shift)
    uses = language_id.expected(long, {p: v[0] for p, v in table.items()}, language_id.prefixes(list(table)))
    assert np.isclose(sum(len(p) * x for p, x in uses.items()), 2001 - long.count("c"))


def test_language_query_on_held_out_documents(spark):
    out = language_id.op9_language_id(spark, "/root/testdata/sf0.01")
    truth = common.table(spark, "/root/testdata/sf0.01", "documents").where("lang is not null").select("doc_id", "lang")
    right = out.where("held_out").join(truth, "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_byte_bpe(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    texts = [None, "", "It's  two\n\nlines ", "naïve 東京 ١٢٣ 😀", "x" * 3000, " " * 50, "aaaa" * 30, "東京の天気は晴れ" * 90, "a \U00031350 \u0378 b", "same", "same"]
    texts += ["".join(rng.choice(" \n\t'sabcdeé1.!日") for _ in range(rng.randrange(60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    assert byte_bpe.encode(df.limit(0), path).count() == 0
    out = byte_bpe.encode(df.repartition(40), path, known=20)
    out = out.withColumn("bytes", byte_bpe.decode(F.col("ids"), ranks))
    for r in out.collect():
        assert list(r.ids) == library.encode_ordinary(texts[r.doc_id] or ""), repr(texts[r.doc_id])
        assert bytes(r.bytes) == (texts[r.doc_id] or "").encode()


def test_empty_partitions(spark):
    """More partitions than rows, so that most tasks have no row."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.createDataFrame([(1, "a b c d e f g", "en"), (2, None, None), (3, "the house\nthe house", "en")], "doc_id long, text string, lang string").repartition(40)
    assert byte_bpe.encode(docs, path).count() == 3
    assert line_dedup.dedup(docs).count() == 3
    assert ngram_jaccard.linked_rows(docs, 4, 85).count() == 3
    assert best_fit_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 3
    assert language_id.fit_and_predict(docs, docs).count() == 3
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a/b").alias("url"), F.col("text").alias("html"))
    assert html_extraction.extract(pages).count() == 3
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.col("doc_id").cast("float"), F.lit(1.0)).alias("embedding"))
    assert nearest_neighbours.search(vectors, F.lit(True), 2).count() == 6


def test_packing_does_not_follow_arrow_batches(spark):
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"x": [*range(k, k + n)]}) for k, n in ((0, 3), (3, 10), (13, 1), (14, 6))]
    cut = [b.column("x").to_pylist() for b in best_fit_packing.islands_of(iter(batches), 5)]
    assert cut == [[*range(k, k + 5)] for k in range(0, 20, 5)]
    assert [b.num_rows for b in best_fit_packing.islands_of(iter(batches[:2]), 5)] == [5, 5, 3]


def test_ngram_jaccard_counts_tokens_before_rows_move(spark, monkeypatch):
    plans, stored = {}, common.stored
    monkeypatch.setattr(common, "stored", lambda df, name, **k: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and stored(df, name, **k))
    rows = [(k, f"a b c d e f g h i j k l m n o p q r s t u v w x y z w{k % 3}") for k in range(12)] + [(99, "alone")]
    got = ngram_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: 0 if k < 99 else k for k, _ in rows}
    # the shuffle that counts tokens is over, and its files gone, when the postings' one begins
    assert "Aggregate" not in plans["several"] and "Aggregate" in plans["tokens"]


def test_byte_bpe_takes_the_ids_of_rare_words_from_joints(spark):
    """A word that no text has twice, of ids that stand together in folded words, is not folded in its row; white space of any kind, cut in Arrow."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    frequent = [x for x in (" thestion", " stionand", " andre") for _ in range(3)]
    joints = byte_bpe.Joints((tuple(library.encode_ordinary(x)) for x in frequent), ranks)
    assert joints.find(b" thestionand") == library.encode_ordinary(" thestionand")
    assert joints.find(b" qqq") is None and byte_bpe.Joints(iter(()), ranks).find(b"a") is None
    rng = random.Random(5)
    texts = ["", " ", None, "a\0b \0 c", "a\u00a0 b \u2003 c\t d", " \x85 x\x1c y ", "".join(frequent) + " thestionand qqqzx"]
    texts += ["".join(rng.choice(["th", "e", "st", "ion", "and", "re", " ", " ", "\n", "\u3000", "\0", "é"]) for _ in range(80)) for _ in range(200)]
    out = byte_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), path, known=150)
    for r in out.collect():
        assert list(r.ids) == library.encode_ordinary(texts[r.doc_id] or ""), repr(texts[r.doc_id])


def test_ngram_jaccard_moves_sets_once_and_postings_in_slices(spark, monkeypatch):
    plans, stored = {}, common.stored
    monkeypatch.setattr(common, "stored", lambda df, name, **k: plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, name, **k))
    rows = [(k, f"a b c d e f g h i j k l m n o p q r s t u v w x y z w{k % 3}") for k in range(12)] + [(99, "alone")]
    got = ngram_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: 0 if k < 99 else k for k, _ in rows}
    assert len(plans["several"]) == ngram_jaccard.SLICES
    assert "strategy=broadcast" in plans["near-0-links"][0]
