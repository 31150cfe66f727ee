"""Queries on entities, their events, evidence and rules, each with the SQL that gives the same rows.

Customers stand for entities, orders for dated cards about them, lines for evidence, events for observations, suppliers
for sources and rules, nations for areas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domain, levels, scheduling
from ..operators import feeds, matching, policy, versions
from .queries import micros, observations, table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def day(c: str):
    return F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


OBS = "obs AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS \"at\", floor(value / 10)::BIGINT AS key FROM events)"
DAY = "(o_orderdate::DATE - DATE '1970-01-01')"


@query("SELECT c_custkey, coalesce(o.n, 0) AS n_cards, coalesce(e.n, 0) AS n_facts, epoch_us(o.last) AS last_card FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1) o ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON user_id = c_custkey")
def g2_counts_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and cards of every entity; each is aggregated before it is joined, so nothing fans out."""
    cards = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_cards"), F.max("o_orderdate").alias("last"))
    facts = table(spark, sf_dir, "events", "user_id").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n_facts"))
    met = table(spark, sf_dir, "customer", "c_custkey").join(cards, "c_custkey", "left").join(facts, "c_custkey", "left")
    return met.select("c_custkey", F.coalesce("n_cards", F.lit(0)).alias("n_cards"), F.coalesce("n_facts", F.lit(0)).alias("n_facts"), micros("last").alias("last_card"))


@query("SELECT l_orderkey, count(*) AS n_steps FROM lineitem GROUP BY 1")
def g3_steps_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n_steps"))


@query("SELECT o_custkey, count(*) AS n_cards, count(*) FILTER (o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY) AS n_recent, epoch_us(max(o_orderdate)) AS last_change, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS areas FROM orders GROUP BY 1")
def g5_subject_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_orderpriority")
    last = orders.agg(F.max("o_orderdate")).first()[0]
    recent = F.col("o_orderdate") > F.lit(last).cast("timestamp_ntz") - F.expr("interval 30 days") if last else F.lit(False)
    found = orders.groupBy("o_custkey").agg(F.count("*").alias("n_cards"), F.count_if(recent).alias("n_recent"), F.max("o_orderdate").alias("last"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("areas"))
    return found.select("o_custkey", "n_cards", "n_recent", micros("last").alias("last_change"), "areas")


@query(f"WITH {OBS}, u AS (SELECT user_id, max((\"at\", event_id)) FILTER (event_type <> 'error') AS good FROM obs GROUP BY 1), f AS (SELECT u.user_id, count(obs.event_id) AS fails FROM u LEFT JOIN obs ON obs.user_id = u.user_id AND (good IS NULL OR (\"at\", event_id) > good) GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (fails = 0) AS active, count(*) FILTER (fails >= 2) AS failing, max(fails) AS worst FROM f")
def g6_source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by how many checks failed since their last good one."""
    obs = observations(spark, sf_dir).select("user_id", "event_type", F.struct("at", "event_id").alias("place"))
    good = obs.where("event_type <> 'error'").groupBy("user_id").agg(F.max("place").alias("good"))
    fails = obs.join(good, "user_id", "left").groupBy("user_id").agg(F.count_if(F.col("good").isNull() | (F.col("place") > F.col("good"))).alias("fails"))
    return fails.agg(F.count("*").alias("total"), F.count_if(F.col("fails") == 0).alias("active"), F.count_if(F.col("fails") >= 2).alias("failing"), F.max("fails").alias("worst"))


@query("SELECT l_orderkey, string_agg(l_returnflag || l_linenumber, ' ' ORDER BY l_linenumber, l_returnflag) AS claims FROM lineitem GROUP BY 1")
def g9_claims_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    found = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    return found.select("l_orderkey", F.array_join(F.transform("x", lambda r: F.concat(r["l_returnflag"], r["l_linenumber"].cast("string"))), " ").alias("claims"))


SIGNALS = f"s AS (SELECT o_orderkey, o_custkey, o_orderpriority, {DAY} AS d FROM orders)"


@query(f"WITH {SIGNALS} SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY d RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) - 1 AS prior FROM s")
def g13_prior_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of the same entity and reason in the 60 days before each."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate").withColumn("d", day("o_orderdate"))
    return policy.prior_signals(orders, ["o_custkey", "o_orderpriority"], "d").select("o_orderkey", "prior")


@query(f"""WITH {SIGNALS}, p AS (SELECT o_orderkey, ['too_minor', 'not_our_area', 'always_urgent', 'inaccurate', 'useful'][o_orderkey % 5 + 1] AS reason, count(*) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY d RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) - 1 AS prior,
  ['none', 'low', 'medium', 'high', 'critical'] AS m, o_orderkey % 3 + 3 AS t, ['low', 'medium', 'high', 'critical'] AS imp, o_orderkey % 4 + 1 AS i, o_orderkey % 2 AS n FROM s)
SELECT o_orderkey, CASE WHEN reason = 'too_minor' AND prior + 1 >= 2 AND t < 5 THEN 'materiality_threshold:' || m[t + 1] WHEN reason = 'not_our_area' AND i > 1 THEN 'area_importance:' || imp[i - 1] WHEN reason = 'always_urgent' AND i < 4 THEN 'area_importance:critical' WHEN reason = 'inaccurate' AND n = 1 THEN 'publisher_trust:distrusted' END AS rule FROM p""")
def g14_feedback_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = g13_prior_signals(spark, sf_dir)
    pick = lambda names, n, at=0: F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % n + 1 + at).cast("int"))
    reason = pick(["too_minor", "not_our_area", "always_urgent", "inaccurate", "useful"], 5)
    return signals.select("o_orderkey", policy.feedback_rule(reason, F.col("prior"), pick(policy.MATERIALITY, 3, 2), pick(policy.IMPORTANCE, 4), F.col("o_orderkey") % 2, F.lit(0)).alias("rule"))


@query("SELECT o_orderstatus AS kind, o_orderpriority AS scope, arg_max(o_custkey, (o_orderdate, o_orderkey)) AS effect, count(*) AS evidence_count FROM orders GROUP BY ALL")
def g15_rule_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return policy.merged_rules(orders.select(F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("scope"), F.col("o_custkey").alias("effect"), F.struct("o_orderdate", "o_orderkey").alias("created")))


RULES = """a AS (SELECT n_nationkey AS area, ['low', 'medium', 'high', 'critical'][n_nationkey % 4 + 1] AS importance FROM nation),
r AS (SELECT s_suppkey AS created, s_nationkey AS area, s_acctbal > 0 AS active, CASE WHEN s_suppkey % 2 = 0 THEN 'area_importance' ELSE 'materiality_threshold' END AS kind,
  ['low', 'medium', 'high', 'critical'][s_suppkey % 4 + 1] AS importance, ['none', 'low', 'medium', 'high', 'critical'][s_suppkey % 5 + 1] AS threshold, CASE WHEN s_suppkey % 3 = 0 THEN '*' ELSE ['BUILDING', 'MACHINERY'][s_suppkey % 2 + 1] END AS event_type FROM supplier),
e AS (SELECT a.area, coalesce(arg_max(r.importance, created), any_value(a.importance)) AS effective_importance FROM a LEFT JOIN r ON r.area = a.area AND active AND kind = 'area_importance' GROUP BY 1),
et AS (SELECT *, CASE effective_importance WHEN 'critical' THEN 'low' WHEN 'low' THEN 'high' ELSE 'medium' END AS threshold FROM e),
t AS (SELECT area, event_type, arg_max(threshold, created) AS raised FROM r WHERE active AND kind = 'materiality_threshold' GROUP BY ALL)"""


def _rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pick = lambda names, c, n: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % n + 1).cast("int"))
    areas = table(spark, sf_dir, "nation", "n_nationkey").select(F.col("n_nationkey").alias("area"), pick(policy.IMPORTANCE, "n_nationkey", 4).alias("importance"))
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    kind = F.when(F.col("s_suppkey") % 2 == 0, "area_importance").otherwise("materiality_threshold")
    event = F.when(F.col("s_suppkey") % 3 == 0, "*").otherwise(pick(["BUILDING", "MACHINERY"], "s_suppkey", 2))
    return areas, s.select(F.col("s_suppkey").alias("created"), F.col("s_nationkey").alias("area"), (F.col("s_acctbal") > 0).alias("active"), kind.alias("kind"), pick(policy.IMPORTANCE, "s_suppkey", 4).alias("importance"), pick(policy.MATERIALITY, "s_suppkey", 5).alias("threshold"), event.alias("event_type"))


@query(f"WITH {RULES} SELECT area, effective_importance, threshold FROM et")
def g16_effective_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.effective_areas(*_rules(spark, sf_dir))


@query(f"""WITH {RULES}, i AS (SELECT c_custkey, c_nationkey AS area, c_mktsegment AS event_type, c_custkey % 5 AS m FROM customer),
x AS (SELECT i.*, greatest(list_position(l.l, et.threshold), coalesce(list_position(l.l, t1.raised), 0), coalesce(list_position(l.l, t2.raised), 0)) AS r FROM i CROSS JOIN (SELECT ['none', 'low', 'medium', 'high', 'critical'] AS l) l LEFT JOIN et USING (area) LEFT JOIN t t1 ON t1.area = i.area AND t1.event_type = i.event_type LEFT JOIN t t2 ON t2.area = i.area AND t2.event_type = '*')
SELECT c_custkey, ['none', 'low', 'medium', 'high', 'critical'][r] AS threshold, m > 0 AND m + 1 >= r AS material FROM x""")
def g17_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of each item's area and kind, and whether it is material."""
    areas, rules = _rules(spark, sf_dir)
    materiality = F.element_at(F.array(*map(F.lit, policy.MATERIALITY)), (F.col("c_custkey") % 5 + 1).cast("int"))
    items = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment").select("c_custkey", F.col("c_nationkey").alias("area"), F.col("c_mktsegment").alias("event_type"), materiality.alias("materiality"))
    return policy.with_threshold(items, policy.effective_areas(areas, rules), policy.type_thresholds(rules)).select("c_custkey", "threshold", "material")


@query("SELECT c_mktsegment AS team, count(DISTINCT o_orderkey) AS n_cards, string_agg(o_orderkey, ',' ORDER BY o_orderdate, o_orderkey) AS cards FROM (SELECT DISTINCT c_mktsegment, o_orderkey, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 7 DAY) GROUP BY 1")
def g19_digest_per_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last week's cards of each team, each once, by time."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    last = orders.agg(F.max("o_orderdate")).first()[0]
    week = orders.where(F.col("o_orderdate") >= F.lit(last).cast("timestamp_ntz") - F.expr("interval 7 days"))
    cards = week.join(table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("team"), "o_orderdate", "o_orderkey").distinct()
    found = cards.groupBy("team").agg(F.count("*").alias("n_cards"), F.array_sort(F.collect_set(F.struct("o_orderdate", "o_orderkey"))).alias("x"))
    return found.select("team", "n_cards", F.array_join(F.transform("x", lambda r: r["o_orderkey"].cast("string")), ",").alias("cards"))


@query("SELECT l_orderkey, count(*) AS calls, sum(l_quantity::BIGINT)::BIGINT AS tokens, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cost FROM lineitem GROUP BY 1")
def g20_usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_extendedprice")
    return lines.groupBy("l_orderkey").agg(F.count("*").alias("calls"), F.sum(F.col("l_quantity").cast("long")).alias("tokens"), F.sum(cents("l_extendedprice")).alias("cost"))


@query("SELECT l_orderkey, arg_max(l_partkey, (l_extendedprice, -l_linenumber, l_partkey)) AS lead, epoch_us(min(l_shipdate)) AS since FROM lineitem GROUP BY 1")
def g21_lead_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A story's lead is its first item of the highest rank, its date the earliest."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    found = lines.groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_extendedprice", -F.col("l_linenumber"), "l_partkey")).alias("lead"), F.min("l_shipdate").alias("first"))
    return found.select("l_orderkey", "lead", micros("first").alias("since"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def g22_status_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (o_orderstatus = 'O') AS unread, count(*) FILTER (o_orderstatus = 'P') AS in_flight, count(DISTINCT o_custkey) AS owners FROM orders")
def g23_queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_orderstatus", "o_custkey")
    return orders.agg(F.count_if(F.col("o_orderstatus") == "O").alias("unread"), F.count_if(F.col("o_orderstatus") == "P").alias("in_flight"), F.count_distinct("o_custkey").alias("owners"))


@query("SELECT l_orderkey, max(l_linenumber)::BIGINT + 1 AS next_version FROM lineitem GROUP BY 1")
def g24_next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").groupBy("l_orderkey").agg((F.max("l_linenumber").cast("long") + 1).alias("next_version"))


@query("SELECT user_id, epoch_us(max(ts)) AS heartbeat FROM events GROUP BY 1")
def g25_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("user_id").agg(F.max("at").alias("heartbeat"))


@query("SELECT o_custkey, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cost, count(*) FILTER (o_orderstatus = 'O') AS running FROM orders GROUP BY 1")
def g27_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", "o_custkey", "o_totalprice", "o_orderstatus").groupBy("o_custkey").agg(F.sum(cents("o_totalprice")).alias("cost"), F.count_if(F.col("o_orderstatus") == "O").alias("running"))


@query("SELECT user_id, count(*) AS steps, count(*) FILTER (event_type = 'click') AS tool_calls, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS seconds FROM events GROUP BY 1")
def g28_run_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    return obs.groupBy("user_id").agg(F.count("*").alias("steps"), F.count_if(F.col("event_type") == "click").alias("tool_calls"), F.floor((F.max("at") - F.min("at")) / 1_000_000).cast("long").alias("seconds"))


PLANS = "p AS (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)"


@query(f"WITH {PLANS}, l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem), x AS (SELECT o_orderkey, i, l_partkey FROM p JOIN l ON l_orderkey = o_orderkey WHERE before IS NOT NULL), y AS (SELECT o_orderkey, i, l_partkey FROM p JOIN l ON l_orderkey = before) SELECT o_orderkey, count(*) FILTER (x.l_partkey IS DISTINCT FROM y.l_partkey) AS n_edits FROM x FULL JOIN y USING (o_orderkey, i) GROUP BY 1")
def g29_plan_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in which a customer's order differs from the one before."""
    from pyspark.sql.window import Window

    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    pairs = orders.withColumn("before", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).where("before is not null").select("o_orderkey", "before")
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").withColumn("i", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")))
    side = lambda key, name: pairs.join(lines.withColumnRenamed("l_orderkey", key), key).select("o_orderkey", "i", F.col("l_partkey").alias(name))
    met = side("o_orderkey", "new").join(side("before", "old"), ["o_orderkey", "i"], "full")
    return met.groupBy("o_orderkey").agg(F.count_if(~F.col("new").eqNullSafe(F.col("old"))).alias("n_edits"))


@query("SELECT o_orderkey, c_custkey, c_name, last FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, arg_max(l_partkey, (l_shipdate, l_linenumber, l_partkey)) AS last FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def j2_fact_with_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with their entity and, if there is one, their current version."""
    orders, entity = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), table(spark, sf_dir, "customer", "c_custkey", "c_name")
    current = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_shipdate", "l_linenumber").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max_by("l_partkey", F.struct("l_shipdate", "l_linenumber", "l_partkey")).alias("last"))
    return orders.join(entity, F.col("o_custkey") == F.col("c_custkey")).join(current, "o_orderkey", "left").select("o_orderkey", "c_custkey", "c_name", "last")


@query("SELECT event_id, coalesce(c_name, 'user ' || user_id) AS title, coalesce(o_orderpriority, event_type) AS severity, o_orderkey FROM events LEFT JOIN customer ON c_custkey = user_id LEFT JOIN orders ON o_orderkey = event_id AND o_custkey = c_custkey")
def j5_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their entity and card, whose title and severity come first."""
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    met = events.join(table(spark, sf_dir, "customer", "c_custkey", "c_name"), F.col("c_custkey") == F.col("user_id"), "left")
    met = met.join(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority"), (F.col("o_orderkey") == F.col("event_id")) & (F.col("o_custkey") == F.col("c_custkey")), "left")
    return met.select("event_id", F.coalesce("c_name", F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("title"), F.coalesce("o_orderpriority", "event_type").alias("severity"), "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, o_orderpriority, s_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 WHERE l_returnflag = 'R'")
def j6_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unread notices with their card and, if it has one, the team."""
    notices = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag").where("l_returnflag = 'R'")
    teams = table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_acctbal").where("s_acctbal > 0")
    met = notices.join(table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority"), F.col("o_orderkey") == F.col("l_orderkey"))
    return met.join(teams, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("l_orderkey", "l_linenumber", "o_orderpriority", "s_name")


@query("SELECT s_name, count(DISTINCT l_orderkey) AS n_cards FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus = 'O' GROUP BY 1")
def j7_digest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'O'")
    met = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "supplier", "s_suppkey", "s_name"), F.col("s_suppkey") == F.col("l_suppkey"))
    return met.groupBy("s_name").agg(F.count_distinct("l_orderkey").alias("n_cards"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def j9_events_without_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders", "o_orderkey").join(cards, "o_orderkey", "left_anti")


@query(f"WITH {OBS} SELECT event_id, last_value(CASE WHEN event_type <> 'error' THEN key END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY \"at\", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM obs")
def j13_previous_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.previous(observations(spark, sf_dir), ["user_id"], ["at", "event_id"], "key", F.col("event_type") != "error").select("event_id", "previous")


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j19_evidence_of_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey").join(urgent, "l_orderkey", "left_semi")


@query("WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem), n AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal < 0) SELECT a AS node, b AS neighbour, 'out' AS direction FROM e JOIN n ON a = node UNION ALL SELECT b, a, 'in' FROM e JOIN n ON b = node")
def j20_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    return feeds.one_hop(edges, table(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal").where("s_acctbal < 0").select(F.col("s_suppkey").alias("node")))


CARDS = f"c AS (SELECT o_orderkey AS id, o_custkey, o_orderpriority, o_orderstatus, {DAY} AS d FROM orders)"


@query(f"WITH {CARDS}, x AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY b.d DESC, b.id DESC) AS place FROM c a JOIN c b ON a.o_custkey = b.o_custkey AND a.id <> b.id AND b.o_orderstatus IN ('F', 'O') AND b.d >= a.d - 120) SELECT * FROM x WHERE place <= 6")
def j21_related_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six newest other live cards of an entity, from 120 days before a card on."""
    cards = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").withColumn("d", day("o_orderdate"))
    return feeds.related(cards, ["o_custkey"], "o_orderkey", "d", 120, 6, F.col("o_orderstatus").isin("F", "O"))


@query(f"WITH {CARDS}, x AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY b.d DESC, b.id DESC) AS place FROM c a JOIN c b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.id <> b.id) SELECT * FROM x WHERE place <= 5")
def j22_related_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest other cards of an entity and area."""
    cards = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate").withColumn("d", day("o_orderdate"))
    return feeds.related(cards, ["o_custkey", "o_orderpriority"], "o_orderkey", "d", None, 5)


@query("SELECT s_name, n_name, list_position(['AFRICA', 'ASIA', 'EUROPE'], r_name) AS place FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name IN ('AFRICA', 'ASIA', 'EUROPE') ORDER BY place, s_name")
def j23_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with their users, by role and name."""
    roles = F.array(*map(F.lit, ["AFRICA", "ASIA", "EUROPE"]))
    met = table(spark, sf_dir, "supplier", "s_name", "s_nationkey").join(table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    found = met.select("s_name", "n_name", F.array_position(roles, F.col("r_name")).cast("int").alias("place")).where("place > 0")
    return found.orderBy("place", "s_name")


@query("WITH x AS (SELECT l_orderkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_suppkey DESC) AS place FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F') SELECT l_orderkey, l_suppkey, place FROM x WHERE place <= 2")
def j27_claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two newest pieces of evidence of each settled claim."""
    claims = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_shipdate").join(claims, "l_orderkey")
    return feeds.newest(lines, ["l_orderkey"], [F.desc("l_shipdate"), F.desc("l_linenumber"), F.desc("l_suppkey")], 2).select("l_orderkey", "l_suppkey", "place")


@query(f"WITH {OBS}, x AS (SELECT *, lag(key) OVER (PARTITION BY user_id ORDER BY \"at\", event_id) AS old FROM obs) SELECT event_id, old, key AS new FROM x WHERE old <> key")
def w6_value_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    old = F.lag("key").over(Window.partitionBy("user_id").orderBy("at", "event_id"))
    return observations(spark, sf_dir).withColumn("old", old).where("old <> key").select("event_id", "old", F.col("key").alias("new"))


@query(f"WITH {OBS}, k AS (SELECT *, coalesce(key <> lag(key) OVER (PARTITION BY user_id ORDER BY \"at\", event_id), true) AS fresh FROM obs WHERE event_type <> 'error'), s AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY \"at\", event_id) AS before FROM k WHERE fresh) SELECT * FROM s WHERE before IS NOT NULL")
def w7_snapshot_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive accepted snapshots that differ."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("user_id").orderBy("at", "event_id")
    kept = observations(spark, sf_dir).where("event_type <> 'error'").withColumn("fresh", F.coalesce(F.col("key") != F.lag("key").over(order), F.lit(True))).where("fresh")
    return kept.withColumn("before", F.lag("event_id").over(order)).where("before is not null").select("user_id", "event_id", "before")


@query("SELECT s_nationkey, max(s_suppkey) AS version FROM supplier WHERE s_acctbal > 0 GROUP BY 1")
def w10_latest_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier", "s_nationkey", "s_suppkey", "s_acctbal").where("s_acctbal > 0").groupBy("s_nationkey").agg(F.max("s_suppkey").alias("version"))


@query("SELECT l_orderkey, arg_min(l_partkey, (l_shipdate, l_linenumber, l_partkey)) AS claim FROM lineitem GROUP BY 1")
def w11_primary_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_shipdate", "l_linenumber").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_shipdate", "l_linenumber", "l_partkey")).alias("claim"))


@query("SELECT c_nationkey, CASE WHEN count(*) FILTER (c_acctbal > 9900) = 0 THEN min(c_custkey) END AS promoted, count(*) FILTER (c_acctbal > 9900) AS owners FROM customer GROUP BY 1")
def w12_promoted_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest member becomes the owner where there is none."""
    owners = F.count_if(F.col("c_acctbal") > 9900)
    return table(spark, sf_dir, "customer", "c_nationkey", "c_custkey", "c_acctbal").groupBy("c_nationkey").agg(F.when(owners == 0, F.min("c_custkey")).alias("promoted"), owners.alias("owners"))


@query(f"WITH {OBS} SELECT user_id, arg_max(event_id, (\"at\", event_id)) AS event_id, arg_max(event_type, (\"at\", event_id)) AS outcome FROM obs WHERE event_type IN ('signup', 'purchase') GROUP BY 1")
def w13_latest_investigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).where("event_type in ('signup', 'purchase')").select("user_id", "at", "event_id", "event_type")
    return versions.latest(obs, ["user_id"], ["at", "event_id"]).select("user_id", "event_id", F.col("event_type").alias("outcome"))


@query(f"WITH {OBS}, x AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY \"at\", event_id) AS old FROM obs) SELECT user_id, event_id FROM x WHERE event_type = 'error' AND coalesce(old, '') <> 'error'")
def w15_conflict_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals that turn a status into a conflict, which alone are told again."""
    from pyspark.sql.window import Window

    old = F.coalesce(F.lag("event_type").over(Window.partitionBy("user_id").orderBy("at", "event_id")), F.lit(""))
    return observations(spark, sf_dir).withColumn("old", old).where("event_type = 'error' and old <> 'error'").select("user_id", "event_id")


@query("WITH k AS (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size END AS s FROM part) SELECT p_partkey, s FROM k ORDER BY s DESC NULLS LAST, p_partkey LIMIT 40")
def t2_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated rows newest first, undated ones last: a page of 40."""
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size")).alias("s")).orderBy(F.desc_nulls_last("s"), "p_partkey").limit(40)


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 5000 ORDER BY s_acctbal, s_suppkey LIMIT 100")
def t7_due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 sources that are due longest."""
    return table(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal").where("s_acctbal < 5000").orderBy("s_acctbal", "s_suppkey").limit(100)


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 50")
def t9_severity_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 most severe cards, in the order given among equals."""
    severity = F.element_at(F.array(*map(F.lit, reversed(levels.SEVERITY))), F.left("o_orderpriority", F.lit(1)).cast("int"))
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").orderBy(levels.rank(severity).desc(), "o_orderkey").limit(50)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_orderstatus DESC, o_orderdate DESC, o_orderkey LIMIT 6")
def t10_story_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six leading stories, by materiality, status and date."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    return orders.orderBy("o_orderpriority", F.desc("o_orderstatus"), F.desc("o_orderdate"), "o_orderkey").limit(6).select("o_orderkey")


@query("WITH x AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders WHERE o_orderpriority < '4') SELECT * FROM x WHERE place <= 10")
def t14_historical_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten material cards of each entity."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority").where("o_orderpriority < '4'")
    return feeds.newest(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 10).select("o_custkey", "o_orderkey", "place")


@query("WITH u AS (SELECT l_partkey AS id, 1 AS src FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT p_partkey, 2 FROM part WHERE p_size < 10) SELECT id, min(src)::INT AS src FROM u GROUP BY 1")
def e2_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of results as one, each result once, from the first list that has it."""
    first = table(spark, sf_dir, "lineitem", "l_partkey", "l_returnflag").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"), F.lit(1).alias("src"))
    second = table(spark, sf_dir, "part", "p_partkey", "p_size").where("p_size < 10").select(F.col("p_partkey").alias("id"), F.lit(2).alias("src"))
    return first.unionByName(second).groupBy("id").agg(F.min("src").alias("src"))


@query("WITH a AS (SELECT p_partkey, 1 AS leg FROM part WHERE contains(lower(p_name), '1')), b AS (SELECT p_partkey, 2 AS leg FROM part WHERE contains(lower(p_type), 'e') AND p_partkey NOT IN (SELECT p_partkey FROM a)) SELECT p_partkey, leg FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY leg, p_partkey LIMIT 50")
def e3_two_leg_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts found by text, then by former values without those found; 50 in all."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    first = part.where(F.contains(F.lower("p_name"), F.lit("1"))).select("p_partkey", F.lit(1).alias("leg"))
    second = part.where(F.contains(F.lower("p_type"), F.lit("e"))).select("p_partkey", F.lit(2).alias("leg")).join(first, "p_partkey", "left_anti")
    return first.unionByName(second.select("p_partkey", "leg")).orderBy("leg", "p_partkey").limit(50)


@query("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def e5_not_yet_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A team's reports that it has not been sent."""
    lines = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_returnflag")
    return lines.where("l_returnflag = 'A'").select("l_suppkey", "l_partkey").distinct().join(lines.where("l_returnflag = 'R'").select("l_suppkey", "l_partkey").distinct(), ["l_suppkey", "l_partkey"], "left_anti")


@query("SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AS active FROM part")
def e7_deactivate_unwanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with whether the new plan still wants them."""
    wanted = table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("wanted", F.lit(True))
    return table(spark, sf_dir, "part", "p_partkey").join(wanted, "p_partkey", "left").select("p_partkey", F.coalesce("wanted", F.lit(False)).alias("active"))


@query("WITH f AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS l FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l, l_suppkey) AS place FROM f")
def e8_citation_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source cited once, numbered by where it comes first."""
    first = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("l"))
    return feeds.newest(first, ["l_orderkey"], [F.col("l"), F.col("l_suppkey")], 1 << 40).select("l_orderkey", "l_suppkey", "place")


@query("SELECT l_suppkey, l_partkey, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS l_orderkey FROM lineitem GROUP BY ALL")
def e9_change_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    return matching.keep_first(lines, ["l_suppkey", "l_partkey"], ["l_orderkey", "l_linenumber"]).select("l_suppkey", "l_partkey", "l_orderkey")


@query("WITH n AS (SELECT l_suppkey AS id, min(l_returnflag) AS kind, list_sort(list(DISTINCT l_linestatus)) AS tags FROM lineitem GROUP BY 1), o AS (SELECT s_suppkey AS id, s_name AS kind, ['base'] AS tags FROM supplier WHERE s_suppkey % 2 = 0) SELECT id, coalesce(n.kind, o.kind) AS kind, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.tags, []), coalesce(n.tags, [])))), '|') AS tags FROM o FULL JOIN n USING (id)")
def snk2_upsert_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities merged into a table: kinds are overwritten, tags become a sorted union."""
    old = table(spark, sf_dir, "supplier", "s_suppkey", "s_name").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("kind"), F.array(F.lit("base")).alias("tags"))
    new = table(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag", "l_linestatus").groupBy(F.col("l_suppkey").alias("id")).agg(F.min("l_returnflag").alias("kind"), F.collect_set("l_linestatus").alias("tags"))
    return feeds.upsert(old, new, ["id"], ["tags"], []).withColumn("tags", F.array_join("tags", "|"))


@query("SELECT l_suppkey AS a, l_partkey AS b, epoch_us(min(l_shipdate)) AS first_seen, epoch_us(max(l_shipdate)) AS last_seen FROM lineitem GROUP BY ALL")
def snk3_upsert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with the times of their first and last sight: an early batch, then the rest."""
    lines = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_shipdate").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), micros("l_shipdate").alias("at"))
    early = lines.where("a % 2 = 0").groupBy("a", "b").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    return feeds.touch(early, lines.where("a % 2 = 1 or b % 3 = 0").unionByName(lines.where("a % 2 = 0")), ["a", "b"], "at")


@query("SELECT l_partkey AS id, 0 AS src FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 UNION ALL SELECT p_partkey, 1 FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def snk4_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "lineitem", "l_partkey", "l_returnflag").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"), F.lit(0).alias("src")).distinct()
    return feeds.insert_absent(old, table(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").alias("id"), F.lit(1).alias("src")), ["id"])


@query(f"WITH {OBS} SELECT event_id, (CASE WHEN event_type = 'error' THEN 30 ELSE greatest(2, ceil(3 * (user_id % 5000) / 1440.0)) END)::BIGINT AS days, least(30 * pow(2, event_id % 9), 1800)::BIGINT AS retry FROM obs")
def st12_news_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that a news check looks back, and seconds to a retry."""
    obs = observations(spark, sf_dir)
    days = F.when(F.col("event_type") == "error", 30).otherwise(F.greatest(F.lit(2), F.ceil(F.col("user_id") % 5000 * 3 / 1440)))
    return obs.select("event_id", days.cast("long").alias("days"), scheduling.retry_delay(F.col("event_id") % 9 + 1).alias("retry"))


@query("SELECT c_custkey, c_custkey % 5 IN (3, 4) AND c_custkey % 4 <> 0 AS immediate FROM customer")
def p8_immediate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % n + 1).cast("int"))
    return table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", domain.is_immediate(pick(levels.SEVERITY, 5), pick(policy.IMPORTANCE, 4)).alias("immediate"))


@query("SELECT c_nationkey, CASE WHEN n = 0 THEN '–' WHEN k > 0 AND 100.0 * k / n < 1 THEN '<1%' ELSE round(k * 100.0 / n)::BIGINT || '%' END AS share FROM (SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_acctbal > 9900) AS k FROM customer GROUP BY 1)")
def m7_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "customer", "c_nationkey", "c_acctbal").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 9900).alias("k"))
    return found.select("c_nationkey", domain.percent(F.col("k"), F.col("n")).alias("share"))
