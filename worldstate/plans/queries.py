"""The engine's queries over the driver's tables: events are observations, orders and pages are feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import levels, scheduling, text, urls
from ..operators import diffing, evidence, matching, versions
from ..streaming import stateful

HOUR = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def micros(at: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {at})")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "user_id", "event_type", "event_id", "ts", "value")
    return events.select("user_id", "event_type", "event_id", micros("ts").alias("at"), F.floor(F.col("value") / 10).cast("long").alias("key"))


FACT = ["user_id", "event_type"]


def w_fact_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.summary(observations(spark, sf_dir), FACT, "at", "event_id", "key")


def w_value_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.trail(observations(spark, sf_dir), FACT, "at", "event_id", "key")


def j11_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fact's value as of the middle of 2024-01."""
    return versions.as_of(observations(spark, sf_dir), FACT, "at", "event_id", "key", F.lit(1705276800000000))


def w5_last_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.last_n(observations(spark, sf_dir), FACT, "at", "event_id", 3).select(*FACT, "nth", "event_id", "key")


def w8_first_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    found = versions.first_per_month(orders, ["o_custkey"], "o_orderdate", "o_orderkey")
    return found.select("o_custkey", F.date_format("month", "yyyy-MM").alias("month"), "o_orderkey")


def w9_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return versions.latest(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


def w14_dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, S2, ... for the orders of each customer."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return orders.select("o_custkey", "o_orderkey", F.concat(F.lit("S"), n.cast("string")).alias("label"))


def g1_attention_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a week's checks came to; the week ends with the last event."""
    events = table(spark, sf_dir, "events", "ts", "event_type")
    last = events.agg(F.max("ts")).first()[0]  # one value, so that the bound reaches the scan
    week = events.where(F.col("ts") >= F.lit(last).cast("timestamp_ntz") - F.expr("interval 7 days"))
    n = lambda *kinds: F.count_if(F.col("event_type").isin(*kinds))
    found = week.agg(F.count("*").alias("checks"), n("click", "error", "purchase", "signup").alias("changes"), n("click").alias("filtered"), n("signup").alias("investigated"), n("purchase").alias("published"))
    return found.withColumn("material", F.col("changes") - F.col("filtered"))


def g4_entity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_orderdate")
    live = F.col("o_orderstatus").isin("F", "O")
    return orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.count_if(live).alias("n_live"), micros("max(case when o_orderstatus in ('F', 'O') then o_orderdate end)").alias("last_live"))


def g10_evidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "user_id", "event_type", "value", "props")
    items = events.select(
        F.col("user_id").alias("claim_id"),
        F.when(F.col("event_type") == "purchase", "primary").when(F.col("event_type").isin("view", "click"), "independent").otherwise("community").alias("source_class"),
        F.when(F.col("value") >= 10, "supports").when(F.col("value") < 2, "contradicts").otherwise("context").alias("stance"),
        (F.get_json_object("props", "$.k").cast("int") % 50 == 0).alias("verified"),
        F.concat(F.lit("p"), F.get_json_object("props", "$.k")).alias("publisher"),
    )
    return evidence.assess(items).select("claim_id", "status", "n_origins", "publishers")


def g18_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by severity, after the clamp by evidence and importance."""
    orders = table(spark, sf_dir, "orders", "o_orderpriority", "o_orderstatus", "o_totalprice")
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low")
    proof = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "single_source").otherwise("unverified")
    importance = F.when(F.col("o_totalprice") < 50000, "low").otherwise("high")
    return orders.groupBy(levels.clamp_severity(severity, proof, importance).alias("severity")).agg(F.count("*").alias("n"))


def j8_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that no urgent order marks, by segment."""
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return customers.join(orders, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n_unread"))


def j11_as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's latest view before or at it."""
    obs = observations(spark, sf_dir)
    left = obs.where("event_type = 'purchase'").select("user_id", "at", "event_id")
    right = obs.where("event_type = 'view'").select("user_id", "at", "key")
    return matching.as_of_join(left, right, ["user_id"], "at", ["key"]).select("user_id", "event_id", "matched_at", F.col("matched_key").alias("key"))


def j12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signup with its user's nearest purchase within 75 hours."""
    obs = observations(spark, sf_dir)
    left = obs.where("event_type = 'signup'").select("user_id", "at", "event_id")
    right = obs.where("event_type = 'purchase'").select("user_id", "at")
    return matching.nearest_join(left, right, ["user_id"], "at", 75 * HOUR).select("user_id", "event_id", "matched_at")


def j14_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with the number of its user's views from 42 hours before to 21 after."""
    obs = observations(spark, sf_dir)
    left = obs.where("event_type = 'error'").select("user_id", F.col("at").alias("ref"), "event_id")
    right = obs.where("event_type = 'view'").select("user_id", "at")
    found = matching.interval_join(left, right, ["user_id"], "ref", "at", 42 * HOUR, 21 * HOUR)
    return found.groupBy("user_id", "event_id").agg(F.count("*").alias("n_near"))


def t1_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages by how often they name the terms of a query, the 10 best."""
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    terms = F.array(*map(F.lit, ["hein", "the", "thent"]))
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    scored = items.select("item_id", F.size(F.filter(words, lambda w: F.array_contains(terms, w))).cast("long").alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "item_id").limit(10)


def t4_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 50 of the order feed before 1998, newest first."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_totalprice")
    return orders.where("o_orderdate < TIMESTAMP_NTZ'1998-01-01 00:00:00'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey", "o_totalprice")


def t8_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 newest of each kind of event, merged, the 30 newest of all."""
    obs = observations(spark, sf_dir).select("event_type", "event_id", "at")
    newest = Window.partitionBy("event_type").orderBy(F.desc("at"), F.desc("event_id"))
    top = obs.withColumn("n", F.row_number().over(newest)).where("n <= 20").drop("n")
    return top.orderBy(F.desc("at"), F.desc("event_id")).limit(30)


def u1_canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return pages.select("page_id", urls.canonical(F.col("url")).alias("canonical"), urls.host_of(F.col("url")).alias("host"), urls.registrable_domain(F.col("url")).alias("publisher"))


def e1_dedup_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each canonical URL."""
    return matching.keep_first(u1_canonical_urls(spark, sf_dir).select("canonical", "page_id"), ["canonical"], ["page_id"])


def j10_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of odd id whose canonical URL no page of even id has."""
    pages = u1_canonical_urls(spark, sf_dir).select("page_id", "canonical")
    return matching.unseen(pages.where("page_id % 2 = 1"), pages.where("page_id % 2 = 0"), ["canonical"]).select("page_id", "canonical")


def e6_routed_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted union of the teams of a customer's order priorities and statuses."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority", "o_orderstatus")
    sets = orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("a"), F.collect_set("o_orderstatus").alias("b"))
    return sets.select("o_custkey", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("teams"))


def e12_new_since_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after each user's last signup, the visit; without one all are earlier."""
    obs = observations(spark, sf_dir)
    visit = F.max(F.when(F.col("event_type") == "signup", F.col("at"))).over(Window.partitionBy("user_id"))
    marked = obs.withColumn("is_new", F.coalesce(F.col("at") > visit, F.lit(False)))
    return marked.groupBy("user_id").agg(F.count_if("is_new").alias("n_new"), F.count_if(~F.col("is_new")).alias("n_earlier"))


def p1_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by verdict; words are those of the raw page, a page id stands for its status."""
    pages = table(spark, sf_dir, "pages", "page_id", "html")
    words = F.size(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"[^ \t\n\r]+"), F.lit(0)))
    status = F.when(F.col("page_id") % 17 == 0, 503).when(F.col("page_id") % 19 == 0, 404).otherwise(200)
    return pages.select("page_id", words.cast("long").alias("n_words"), scheduling.gate(status, F.lit(False), words, F.lit(300)).alias("verdict"))


def m2_next_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    outcome = F.when(F.col("event_type") == "view", "unchanged").when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), "not_modified").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "baseline").otherwise("changed")
    minutes = scheduling.next_interval((F.col("user_id") % 90).cast("long"), (F.col("event_id") % 5000).cast("long"), outcome, F.col("event_id") % 9, F.col("user_id") % 2 == 0)
    return events.select("event_id", minutes.alias("minutes"))


def f8_masked_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of each document's masked, squeezed lines."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", text.content_hash(F.split("text", "\n")).alias("content_hash"))


def f11_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.array_join(text.numbers(F.col("text")), "|").alias("numbers"))


def f13_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the first line of a benchmark item, of five words or more, verbatim: the part of f13_quote_lines that its SQL asks for.

    The second to fourth word find them in a hash join: these are whole in a document whatever stands around the line.
    """
    items = table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", F.element_at(F.split("text", "\n"), 1).alias("quote"))
    items = items.where("size(split(quote, ' ')) >= 5").withColumn("lead", F.array_join(F.slice(F.split("quote", " "), 2, 3), " "))
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    starts = docs.withColumn("lead", F.explode(F.array_distinct(text.bound(F.split("text", "[ \n]"), lambda w: text.runs(w, 3)))))
    return starts.join(items, "lead").where("contains(text, quote)").select("item_id", "doc_id").distinct()


def f13_quote_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a line of a benchmark item: its normalised form, not begun or ended inside a word. Lines without a word are no quotes.

    A line is found by its first five words, or all of them if fewer, in a hash join on leads of each length. A text is looked through
    once for all lines that it meets, and a line that several items have is one.
    """
    words = lambda s: F.regexp_extract_all(s, F.lit(text.WORDS), F.lit(0))
    lines = table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", F.posexplode(F.split("text", "\n")).alias("line", "quote"))
    lines = lines.withColumn("quote", text.for_match(F.col("quote")))
    asked = lines.select("quote").distinct().withColumn("lead", F.array_join(F.slice(words(F.col("quote")), 1, 5), " ")).where("lead <> ''")
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("text", text.for_match(F.col("text")))
    leads = lambda w: F.array_distinct(F.flatten(F.array(*(text.runs(w, n) for n in range(1, 6)))))
    # leads move without texts, which only the documents met need
    starts = docs.select(F.col("doc_id").alias("_doc"), F.explode(text.bound(words(F.col("text")), leads)).alias("lead"))
    met = starts.join(asked, "lead").groupBy("_doc").agg(F.collect_set("quote").alias("_quotes"))
    held = lambda t: F.filter("_quotes", lambda q: F.contains(t, text.mark_words(q)))
    found = met.join(docs, F.col("_doc").eqNullSafe(F.col("doc_id"))).select("doc_id", F.explode(text.bound(text.mark_words(F.col("text")), held)).alias("quote"))
    return found.join(lines, "quote").select("item_id", F.col("line").cast("long").alias("line"), "doc_id").distinct()


def k1_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added and removed lines between a conversation's consecutive turns, where they are no more than volatile."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = turns.withColumn("before", before).where("before is not null")
    found = pairs.withColumn("hunks", diffing.hunks(diffing.masked_lines(F.col("before")), diffing.masked_lines(F.col("text"))))
    return found.select("conv_id", "turn", *(v.alias(k) for k, v in diffing.counts(F.col("hunks")).items()))


def st2_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user under a limit of 3 an hour."""
    obs = observations(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.floor(F.col("at") / 1_000_000).cast("long").alias("at"))
    return stateful.limit_batch(obs, 3600, 3)


QUERIES = {f.__name__: f for f in (w_fact_versions, w_value_trail, j11_as_of, w5_last_versions, w8_first_per_month, w9_latest_per_key, w14_dense_ids, g1_attention_funnel, g4_entity_summary, g10_evidence_status, g18_severity_counts, j8_unread, j11_as_of_join, j12_nearest, j14_interval_join, t1_ranked_search, t4_keyset_page, t8_activity, u1_canonical_urls, e1_dedup_urls, j10_unseen, e6_routed_teams, e12_new_since_visit, p1_quality_gate, m2_next_interval, f8_masked_hashes, f11_numbers, f13_quotes, f13_quote_lines, k1_diff_counts, st2_rate_limit)}
