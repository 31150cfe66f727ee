"""Rules that SQL does not state, and edges of those that it does."""

import itertools
import random

from pyspark.sql import functions as F

from worldstate.functions import domain, fuzzy, levels, scheduling
from worldstate.operators import feeds, policy
from worldstate.streaming import captures


def one(spark, column, *values):
    row = spark.range(1).select(column(*(F.lit(v) if v is not None else F.lit(None).cast("string") for v in values)).alias("y"))
    return row.first().y


def by_table(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        rows[i + 1][j + 1] = rows[i][j] + 1 if a[i] == b[j] else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_similarity():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(90))) for _ in range(2))
        assert fuzzy.common_length(a, b) == by_table(a, b)
    assert fuzzy.similarity("", "") == 100 and fuzzy.similarity("ab", "") == 0
    assert fuzzy.token_set("a b c", "c b a d") == 100 and fuzzy.token_set("", "x") == 0
    assert fuzzy.token_sort("b a", "a b") == 100
    assert fuzzy.token_set("razorpay partners with mastercard", "razorpay and mastercard announce partnership") >= 60


def test_similarity_of_columns(spark):
    df = spark.createDataFrame([("ab", "ac"), (None, "x"), ("", "")], "a string, b string")
    assert [r.s for r in df.select(fuzzy.ratio("a", "b").alias("s")).collect()] == [50.0, None, 100.0]


def test_slugs_and_keys(spark):
    assert one(spark, domain.slug, "Crème Brûlée & Co.") == "creme-brulee-co"
    assert one(spark, lambda s: domain.slug(s, strip_suffixes=True), "Razorpay Software Pvt Ltd") == "razorpay"
    assert one(spark, lambda s: domain.slug(s, strip_suffixes=True), "Group Holdings") == "group-holdings"
    assert one(spark, domain.slug, None) == ""
    none = F.lit(None).cast("string")
    for entity, other in itertools.product(["Razorpay", "Razorpay Software Pvt Ltd"], ["Mastercard Inc.", "Mastercard"]):
        assert one(spark, lambda e, o: domain.cluster_key(F.lit("partnership"), e, o, none, none, none, none, none), entity, other) == "partnership:razorpay:mastercard"
    assert one(spark, lambda p: domain.cluster_key(F.lit("leadership"), F.lit("Razorpay"), none, none, p, none, none, none), "Jane Doe") == "leadership:razorpay:jane-doe"
    assert one(spark, lambda e: domain.cluster_key(F.lit("funding"), e, none, none, none, none, none, none), "") == "funding:unknown:na"


def test_values(spark):
    key = lambda unit: one(spark, lambda u: domain.value_key(F.lit("x"), F.lit(2.0), u, F.lit(None).cast("string")), unit)
    assert key("%") == key("percent") != key("INR") and len(key("%")) == 32
    assert one(spark, lambda s: domain.numbers_supported(s, F.lit("pay ₹5,00,000 now")), "₹5 Lakh") is True
    assert one(spark, lambda s: domain.numbers_supported(s, F.lit("only 2% + 18% GST")), "2.36% effective") is False
    assert one(spark, domain.expanded, "1.5 crore and 2 lacs, 7 cars") == "15000000 and 200000, 7 cars"


def test_texts(spark):
    assert one(spark, domain.formatting_key, "**Fees**: 2.5% — now!") == one(spark, domain.formatting_key, "Fees 2.5% now")
    assert one(spark, domain.formatting_key, "0%*") != one(spark, domain.formatting_key, "0%")
    assert one(spark, domain.or_query, 'any "UPI fees" of Acme pricing') == '"upi fees" or acme or pricing'
    assert one(spark, domain.or_query, "what is it") is None
    assert one(spark, lambda s: domain.snippet(s, 12), "alpha beta gamma") == "alpha beta…"
    assert [one(spark, domain.is_article, u) for u in ("https://x.org/blog/a", "https://x.org/blog/", "https://x.org/pricing")] == [True, False, False]
    assert [one(spark, domain.looks_like_request, s) for s in ("Acme", "what about acme", "Acme?", "a b c d e f")] == [False, True, True, True]
    assert [one(spark, domain.valid_email, s) for s in ("a@b.org", "a@b", "a b@c.org")] == [True, False, False]
    assert one(spark, domain.original_url, "https://archive.example/web/2024id_/https://e.org/x") == "https://e.org/x"


def test_clamp_notes(spark):
    notes = lambda s, e, i: one(spark, levels.clamp_notes, s, e, i)
    assert len(notes("critical", "unverified", "low")) == 1 and len(notes("critical", "single_source", "low")) == 2 and notes("bogus", "confirmed", "high") == []


def test_intervals(spark):
    find = lambda base, current, outcome, failures: spark.range(1).select(scheduling.next_interval(F.lit(base), F.lit(current), F.lit(outcome), F.lit(failures), F.lit(True)).alias("y")).first().y
    assert [find(60, 60, "not_modified", 0), find(60, 200, "unchanged", 0), find(60, 240, "changed", 0), find(60, 60, "error", 3)] == [90, 240, 60, 480]


def test_policy(spark):
    areas = spark.createDataFrame([("pricing", "critical"), ("products", "high"), ("funding", "low"), ("odd", "bogus")], "area string, importance string")
    rules = spark.createDataFrame([("materiality_threshold", "products", "content_change", None, "high", 1, True), ("area_importance", "funding", None, "critical", None, 2, True), ("area_importance", "pricing", None, "low", None, 3, False)], "kind string, area string, event_type string, importance string, threshold string, created int, active boolean")
    found = {r.area: r.threshold for r in policy.effective_areas(areas, rules).collect()}
    assert found == {"pricing": "low", "products": "medium", "funding": "low", "odd": "medium"}
    items = spark.createDataFrame([(1, "products", "content_change", "medium"), (2, "products", "x", "medium"), (3, "unknown", "x", "medium"), (4, "pricing", "x", None), (5, "pricing", "x", "none")], "id int, area string, event_type string, materiality string")
    out = policy.with_threshold(items, policy.effective_areas(areas, rules), policy.type_thresholds(rules))
    assert {r.id: (r.threshold, r.material) for r in out.collect()} == {1: ("high", False), 2: ("medium", True), 3: ("medium", True), 4: ("low", False), 5: ("low", False)}


def test_adoption(spark):
    words = [(350, 1), (2150, 2), (300, 3), (310, 4), (310, 4), (None, 5)]
    df = spark.createDataFrame([(1, k, k, w, c) for k, (w, c) in enumerate(words)], "source long, at long, id long, words long, content long")
    assert [r.verdict for r in captures.adopted(df).orderBy("id").collect()] == ["accepted", "accepted", "rejected", "accepted", "same", "unknown"]
    assert captures.adopted(df.limit(0)).count() == 0


def test_related_and_upsert(spark):
    df = spark.createDataFrame([(1, None, 0), (2, None, 100), (3, None, 121), (4, "a", 100)], "id int, k string, d long")
    assert sorted((r.id, r.other) for r in feeds.related(df, ["k"], "id", "d", 120, 6).collect()) == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 2)]
    assert sorted((r.id, r.other, r.place) for r in feeds.related(df, ["k"], "id", "d", None, 1, F.col("id") != 3).collect()) == [(1, 2, 1), (2, 1, 1), (3, 2, 1)]
    old = spark.createDataFrame([(1, ["b"], "old"), (2, ["x"], "stay")], "id int, tags array<string>, text string")
    new = spark.createDataFrame([(1, ["a"], ""), (3, ["c"], "new")], "id int, tags array<string>, text string")
    assert {r.id: (r.tags, r.text) for r in feeds.upsert(old, new, ["id"], ["tags"], ["text"]).collect()} == {1: (["a", "b"], "old"), 2: (["x"], "stay"), 3: (["c"], "new")}
