import random

import duckdb
from pyspark.sql import functions as F

from worldstate.functions import levels, scheduling, text, urls, pages
from worldstate.operators import diffing, evidence, matching
from worldstate.plans import oracles, queries
from worldstate.streaming import stateful


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_canonical(spark):
    seen = "HTTPS://WWW.Example.com:443?utm_source=a&b=2&a=1&b=1&gclid=z#top"
    assert one(spark, seen, urls.canonical) == "https://www.example.com/?a=1&b=2&b=1"
    assert one(spark, "http://e.org:8080/p/?x=%2F", urls.canonical) == "http://e.org:8080/p/?x=%2F"
    assert one(spark, " https://e.org/p?source=a&gbraid=1&%75tm_x=2 ", urls.canonical) == "https://e.org/p?source=a"
    assert one(spark, "no url", urls.canonical) == "no url"
    assert one(spark, None, urls.canonical) is None


def test_hosts(spark):
    assert one(spark, "Example.COM.:80/a", urls.host_of) == "example.com"
    assert one(spark, "https://a.b.example.co.uk/x", urls.registrable_domain) == "example.co.uk"
    assert one(spark, "http://[2001:db8::1]:80/x", urls.host_of) == "2001:db8::1"
    assert [one(spark, x, urls.registrable_domain) for x in ("https://a.x.ne.jp", "https://y.github.io/z", "http://10.0.0.1/")] == ["x.ne.jp", "y.github.io", "10.0.0.1"]
    assert one(spark, "https://blog.example.org", lambda u: urls.domain_matches(u, ["www.example.org"])) is True
    assert one(spark, "https://badexample.org", lambda u: urls.domain_matches(u, ["example.org"])) is False


def test_text(spark):
    assert one(spark, "abcdefgh", lambda s: text.truncate(s, 5)) == "abcd…"
    assert one(spark, "costs 1,20,000 or 3.5 and 3.5", text.numbers) == ["120000", "3.5"]
    assert one(spark, "3,5 or 10.5.2", text.numbers) == ["3,5", "10.5.2"]
    assert one(spark, "It isn't so, never", text.negations) == ["never", "not"]
    assert one(spark, "What is the price's change at Acme's?", text.search_terms) == ["price", "acme"]
    masked = one(spark, "seen 2024-01-02 at 10:30, 3 days ago, id 0123456789abcdef0", text.mask_volatile)
    assert masked == "seen <DATE> at <TIME>, <RELTIME>, id <ID>"


VOLATILE = ["2026-09-28", "2026-09-28T10:15:00Z", "2026-09-28 10:15:00+05:30", "Sep 28, 2026", "Sept. 28th, 2026", "28 September 2026", "28th of September, 2026", "Mon, Sep 28", "28/09/2026", "28.09.2026", "2026/09/28", "10:15 AM", "22:04:11", "7pm", "3 minutes ago", "2 hrs ago", "an hour ago", "5m ago", "yesterday", "just now", "© 2026", "Copyright 2019-2026", "Copyright © 2019 – 2026", "(c) 2025"]
STABLE = ["Start accepting payments at just 2%", "₹2499 per month", "40,000+ businesses", "1.8% per transaction", "0%* platform fees for first 90 days", "Settlement in 2 days", "T+2 settlements", "24x7 support", "ratio 1:10", "March 2026 launch", "state-of-the-art-2026-edition", "internationalization", "Top 10 marketing tips", "Offer valid till 30 Sep 2026", "effective 1 October", "a1b2c3", "zzzzzzzzzzzz1111yyyy"]
MASKED = {"session a8Fk2LmQ9zX7pR3t end": "session <ID> end", "req 550e8400-e29b-41d4-a716-446655440000": "req <ID>", "etag deadbeefcafebabe1234": "etag <ID>", "x 1234567890123456": "x <ID>", "/static/app.js?v=123": "/static/app.js?v=<CB>", "style.css?ver=1.2.3&x=1": "style.css?ver=<CB>&x=1", "28 Sep 2026": "<DATE>", "(2026/09/28)": "(<DATE>)", "a8Fk2LmQ9zX7pR3t-": "a8Fk2LmQ9zX7pR3t-"}


def test_masks_of_the_reference(spark):
    """FIXTURES A9, with the date contexts."""
    cases = [f"Updated {x} here" for x in VOLATILE] + STABLE + list(MASKED)
    df = spark.createDataFrame([(x,) for x in cases], "x string")
    found = {r.x: r.y for r in df.select("x", text.mask_volatile(F.col("x"), None).alias("y")).collect()}
    for x in VOLATILE:
        masked = found[f"Updated {x} here"]
        assert x not in masked and masked.startswith("Updated <") and masked.endswith("> here"), masked
    assert {x: found[x] for x in STABLE} == {x: x for x in STABLE}
    assert {x: found[x] for x in MASKED} == MASKED
    pair = [one(spark, x, lambda s: text.mask_volatile(s, None)) for x in ("Last updated: Sep 28, 2026 at 10:15 AM. © 2026 Razorpay", "Last updated: Oct 1, 2026 at 9:05 PM. © 2027 Razorpay")]
    assert pair[0] == pair[1]
    assert one(spark, None, lambda s: text.mask_volatile(s, None)) is None


def test_diffs_of_the_reference(spark):
    """FIXTURES A11: notes of updates are no change; deadlines, numbers and case are."""
    cases = [("Pricing\nLast updated: Sep 28, 2026 10:15 AM\n© 2025 R", "Pricing\nLast updated: Oct 1, 2026 9:05 PM\n© 2026 R", (0, 0)), ("Offer valid till 30 Sep 2026", "Offer valid till 31 Oct 2026", (1, 1)), ("2.5%", "25%", (1, 1)), ("0%*", "0%", (1, 1)), ("-5%", "5%", (1, 1)), ("US rates", "us rates", (1, 1)), ("A\nB\nC", "A\nC\nD\nE", (2, 1))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, x string, y string")
    found = df.withColumn("h", diffing.hunks(diffing.masked_lines(F.col("x")), diffing.masked_lines(F.col("y"))))
    assert {r.i: (r.n_added, r.n_removed) for r in found.select("i", *(v.alias(k) for k, v in diffing.counts(F.col("h")).items())).collect()} == {i: c[2] for i, c in enumerate(cases)}


def test_levels(spark):
    df = spark.createDataFrame([("critical", "single_source", "high"), ("critical", "unverified", "high"), ("high", "confirmed", "low"), (None, "confirmed", "high")], "s string, e string, i string")
    assert [r[0] for r in df.select(levels.clamp_severity(F.col("s"), F.col("e"), F.col("i"))).collect()] == ["high", "medium", "medium", "medium"]


def test_gate(spark):
    df = spark.createDataFrame([(200, False, 500, 1000), (200, False, 100, 1000), (503, False, 500, 10), (404, False, 500, 10), (200, True, 500, 10)], "s int, c boolean, w int, r int")
    found = [r[0] for r in df.select(scheduling.gate(F.col("s"), F.col("c"), F.col("w"), F.col("r"))).collect()]
    assert found == ["ok", "degenerate", "blocked", "degenerate", "blocked"]


def test_evidence(spark):
    rows = [(1, "primary", "supports", True, "a"), (2, "independent", "supports", True, "a"), (2, "independent", "supports", True, "b"), (3, "independent", "supports", True, "a"), (4, "community", "supports", True, "a"), (5, "independent", "supports", True, "a"), (5, "independent", "contradicts", True, "b"), (6, "primary", "supports", False, "a")]
    df = spark.createDataFrame(rows, "claim_id int, source_class string, stance string, verified boolean, publisher string")
    assert {r.claim_id: r.status for r in evidence.assess(df).collect()} == {1: "confirmed", 2: "corroborated", 3: "single_source", 4: "unverified", 5: "conflicting", 6: "unverified"}


def test_diff(spark):
    df = spark.createDataFrame([("a\nUpdated 2024-01-01\nb", "a\nUpdated 2025-05-05\nc\nd")], "x string, y string")
    found = df.select(diffing.hunks(diffing.masked_lines(F.col("x")), diffing.masked_lines(F.col("y"))).alias("h"))
    assert found.select(*(v.alias(k) for k, v in diffing.counts(F.col("h")).items())).first() == (2, 1)
    assert len(found.select(diffing.without_noise(F.col("h"), ["^[bcd]$"]).alias("h")).first().h) == 0


def test_interval_edges(spark):
    left = spark.createDataFrame([(1, 100)], "k int, l long")
    right = spark.createDataFrame([(1, 89), (1, 90), (1, 105), (1, 106)], "k int, r long")
    assert sorted(x.r for x in matching.interval_join(left, right, ["k"], "l", "r", 10, 5).collect()) == [90, 105]


def test_limiter(spark, tmp_path):
    rows = [(1, 1, 0), (1, 2, 10), (1, 3, 20), (1, 4, 59), (1, 5, 60), (2, 6, 5)]
    df = spark.createDataFrame(rows, "key long, id long, at long")
    want = {1: (True, 0), 2: (True, 0), 3: (False, 40), 4: (False, 1), 5: (True, 0), 6: (True, 0)}
    assert {r.id: (r.allowed, r.wait) for r in stateful.limit_batch(df, 60, 2).collect()} == want
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = stateful.limit_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 60, 2)
    stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert {r.id: (r.allowed, r.wait) for r in spark.table("limited").collect()} == want


def test_limiter_forgets_keys(spark, tmp_path):
    """Keys go once the watermark is a window past them, and what passes is what passes without forgetting."""
    rows = [(k, k * 10 + n, 1000 + k * 500 + n * 7) for k in range(8) for n in range(6)]
    df = spark.createDataFrame(rows, "key long, id long, at long")
    for k in range(8):
        df.where(f"key = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = stateful.limit_stream(stream, 30, 2, "100 seconds").writeStream.format("memory").queryName("forgetful").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
    assert {r.id: r.allowed for r in spark.table("forgetful").collect()} == {r.id: r.allowed for r in stateful.limit_batch(df, 30, 2).collect()}


def test_limiter_over_many_batches(spark, tmp_path):
    """A hot key beside others, unordered, in Arrow batches of three rows: batch and stream are as one fold."""
    rng = random.Random(8)
    rows = [(1 if rng.random() < 0.7 else rng.choice([2, 3, None]), i, rng.randrange(-500, 3000)) for i in range(400)]
    want = {}
    for key in {r[0] for r in rows}:
        hits = []
        for _, id_, at in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            hits, ok, wait = stateful.allow(hits, at, 60, 3)
            want[id_] = (key, at, ok, wait)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = spark.createDataFrame(rows, "key long, id long, at long")
        out = stateful.limit_batch(df, 60, 3)
        assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
        found = [(r.id, (r.key, r.at, r.allowed, r.wait)) for r in out.collect()]
        assert len(found) == len(rows) and dict(found) == want
        df.where("key is not null").coalesce(1).write.parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        stateful.limit_stream(stream, 60, 3).writeStream.format("memory").queryName("limited_hot").outputMode("append").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
        assert {r.id: (r.key, r.at, r.allowed, r.wait) for r in spark.table("limited_hot").collect()} == {k: v for k, v in want.items() if v[0] is not None}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_quotes_of_all_lines(spark, tmp_path):
    """Later and short lines, quotes behind a tab or a quotation mark, other typography; not words that go on."""
    spark.createDataFrame([(1, "one two three four five six\nlater line"), (2, "short"), (3, "---\nit's a fee")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, "x\tone two three four five six"), (2, "he said “one two three four five six”"), (3, "a LATER\nline, and shorter"), (4, "It’s  a fee: short"), (5, "it's a feed ---"), (6, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in queries.f13_quotes(spark, str(tmp_path)).collect()} == {(1, 1), (1, 2)}
    want = {(1, 0, 1), (1, 0, 2), (1, 1, 3), (2, 0, 4), (3, 1, 4)}
    assert {tuple(r) for r in queries.f13_quote_lines(spark, str(tmp_path)).collect()} == want
    for name in ("benchmark", "documents"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert set(duckdb.sql(oracles.ORACLES["f13_quote_lines"]).fetchall()) == want


def test_pages(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    md = "# Head\n![a](b) see [the page](http://x) **now**\n|---|:--:|\n\n  two   words"
    assert one(pages.without_markdown(F.lit(md))) == "Head\nsee the page now\ntwo words"
    assert one(pages.paragraphs(F.lit("a\n \nb\nc\n\n\n" + "d" * 800 + "\n" + "e" * 800))) == ["a", "b\nc", "d" * 800, "e" * 800]
    assert one(pages.challenge(F.lit("<script src=cf-chl>"), F.lit(" Just a moment"), F.lit(10))) == "just a moment"
    assert one(pages.challenge(F.lit("a CAPTCHA"), F.lit(None).cast("string"), F.lit(79))) == "captcha"
    assert one(pages.challenge(F.lit("a captcha"), F.lit("x"), F.lit(80))) is None
    assert one(pages.rule_pattern(F.lit("/a.b/*c$"))) == r"^/a\.b/.*c$"
    assert one(pages.rule_pattern(F.lit("/$x"))) == r"^/\$x"
