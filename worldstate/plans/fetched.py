"""Queries on fetched pages, checks and searches, each with the SQL that gives the same rows.

Users stand for sources and events for their checks; documents for plain-text captures; benchmark items for questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import addresses, pages, scheduling, text, urls
from ..operators import crawl, feeds, versions
from .queries import micros, observations, table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def sql_first(s: str, markers: list[str], test: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN {test}({s}, '{m}') THEN '{m}' END" for m in markers) + ")"


CHALLENGE = rf"""WITH p AS (SELECT page_id, lower(left(coalesce(html, ''), 200000)) AS head, lower(trim(coalesce(regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1), ''))) AS title,
  len(regexp_extract_all(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '[^ \t\r\n\f\x0B]+')) AS words FROM pages)
SELECT page_id, words::BIGINT AS n_words, CASE WHEN words < 250 THEN coalesce({sql_first("title", pages.CHALLENGE_TITLES, "starts_with")}, {sql_first("head", pages.STRONG, "contains")}, CASE WHEN words < 80 THEN {sql_first("head", pages.WEAK, "contains")} END) END AS marker FROM p"""


@query(CHALLENGE)
def p2_challenges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What makes a page a bot challenge, if anything does."""
    html = F.coalesce("html", F.lit(""))
    words = F.size(F.regexp_extract_all(F.regexp_replace(html, "<[^>]*>", " "), F.lit(r"[^ \t\r\n\f\x0B]+"), F.lit(0))).cast("long")
    title = F.regexp_extract(html, "(?is)<title[^>]*>([^<]*)", 1)
    found = table(spark, sf_dir, "pages", "page_id", "html").withColumn("n_words", words)
    return found.select("page_id", "n_words", pages.challenge(F.col("html"), title, F.col("n_words")).alias("marker"))


MARKED = f"""WITH p AS (SELECT page_id, (page_id * 37 % 300)::BIGINT AS n_words, CASE WHEN page_id % 4 = 0 THEN ({pages.CHALLENGE_TITLES})[page_id // 4 % {len(pages.CHALLENGE_TITLES)} + 1] || ' please' ELSE 'A page' END AS title,
  lower(left(CASE WHEN page_id % 4 = 1 THEN ({pages.STRONG})[page_id // 4 % {len(pages.STRONG)} + 1] WHEN page_id % 4 = 2 THEN upper(({pages.WEAK})[page_id // 4 % {len(pages.WEAK)} + 1]) ELSE '' END || coalesce(html, ''), 200000)) AS head FROM pages)
SELECT page_id, n_words, CASE WHEN n_words < 250 THEN coalesce({sql_first("title", pages.CHALLENGE_TITLES, "starts_with")}, {sql_first("head", pages.STRONG, "contains")}, CASE WHEN n_words < 80 THEN {sql_first("head", pages.WEAK, "contains")} END) END AS marker FROM p"""


@query(MARKED)
def p2_challenge_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for pages into which titles and markers of challenges of each kind are put, and for sizes about the limits."""
    found = table(spark, sf_dir, "pages", "page_id", "html")
    nth, kind = F.floor(F.col("page_id") / 4), F.col("page_id") % 4
    pick = lambda of: F.get(F.array(*map(F.lit, of)), (nth % len(of)).cast("int"))
    title = F.when(kind == 0, F.concat(F.initcap(pick(pages.CHALLENGE_TITLES)), F.lit(" please"))).otherwise("A page")
    mark = F.when(kind == 1, pick(pages.STRONG)).when(kind == 2, F.upper(pick(pages.WEAK))).otherwise("")
    words = (F.col("page_id") * 37 % 300).cast("long")
    return found.select("page_id", words.alias("n_words"), pages.challenge(F.concat(mark, F.coalesce("html", F.lit(""))), title, words).alias("marker"))


SPLIT = r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '\n[ \t\r\f]*\n[ \t\r\n\f]*')) AS x, generate_subscripts(string_split_regex(text, '\n[ \t\r\f]*\n[ \t\r\n\f]*'), 1) AS i FROM documents),
t AS (SELECT doc_id, i, regexp_replace(x, '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g') AS x FROM w),
p AS (SELECT doc_id, i, unnest(CASE WHEN length(x) > 1500 THEN string_split(x, chr(10)) ELSE [x] END) AS x, generate_subscripts(CASE WHEN length(x) > 1500 THEN string_split(x, chr(10)) ELSE [x] END, 1) AS j FROM t)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INT AS block, regexp_replace(x, '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g') AS text FROM p WHERE regexp_replace(x, '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g') <> ''"""


@query(SPLIT)
def src8_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text as blocks, in order."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.posexplode(pages.paragraphs(F.col("text"))).alias("block", "text"))


@query("""SELECT user_id, event_id, epoch_us(ts) AS captured FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'error' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-03-01') WHERE n = 1""")
def src11_captures_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good captures of a stretch of time, the first of each month."""
    events = table(spark, sf_dir, "events", "user_id", "event_id", "event_type", "ts").where("event_type <> 'error' AND ts >= TIMESTAMP_NTZ'2024-01-03' AND ts < TIMESTAMP_NTZ'2024-03-01'")
    return versions.first_per_month(events, ["user_id"], "ts", "event_id").withColumn("captured", micros("ts")).select("user_id", "event_id", "captured")


@query("SELECT page_id, 'https://web.archive.org/web/' || stamp || '/' || url AS shown, 'https://web.archive.org/web/' || stamp || 'id_/' || url AS raw FROM (SELECT page_id, url, strftime(TIMESTAMP '2024-01-01' + to_hours(page_id % 5000), '%Y%m%d%H%M%S') AS stamp FROM pages)")
def src14_archive_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("date_format(timestampadd(HOUR, CAST(page_id % 5000 AS INT), TIMESTAMP_NTZ'2024-01-01'), 'yyyyMMddHHmmss')")
    found = table(spark, sf_dir, "pages", "page_id", "url")
    return found.select("page_id", pages.archive_url(F.col("url"), at).alias("shown"), pages.archive_url(F.col("url"), at, raw=True).alias("raw"))


@query("SELECT o_orderkey, CASE WHEN d <= 1 THEN 'day' WHEN d <= 7 THEN 'week' WHEN d <= 31 THEN 'month' ELSE 'year' END AS bucket FROM (SELECT o_orderkey, (SELECT max(o_orderdate)::DATE FROM orders) - o_orderdate::DATE AS d FROM orders)")
def src16_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search bucket of each card's age on the last card's day."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    last = orders.agg(F.max(F.col("o_orderdate").cast("date"))).first()[0]
    return orders.select("o_orderkey", pages.recency(F.datediff(F.lit(last), F.col("o_orderdate").cast("date"))).alias("bucket"))


#: Hosts' rules in the query on crawl rules.
RULES = [("/", True), ("/*/1", False), ("/en/", False), ("/en/*7$", True), ("/de/8", False), ("/de/8", True)]


@query(f"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)', 1) AS t FROM pages),
r(rule, allow, pattern) AS (VALUES ('/', true, '^/'), ('/*/1', false, '^/.*/1'), ('/en/', false, '^/en/'), ('/en/*7$', true, '^/en/.*7$'), ('/de/8', false, '^/de/8'), ('/de/8', true, '^/de/8')),
m AS (SELECT page_id, arg_max(allow, length(rule) * 2 + allow::INT) AS allow FROM p JOIN r ON host <> '' AND length(host) % 3 <> 0 AND regexp_matches(CASE WHEN starts_with(t, '/') THEN t ELSE '/' || t END, pattern) GROUP BY 1)
SELECT p.page_id, CASE WHEN host <> '' AND length(host) % 7 = 0 THEN true WHEN host <> '' AND length(host) % 7 = 1 THEN false ELSE coalesce(m.allow, true) END AS allowed FROM p LEFT JOIN m ON m.page_id = p.page_id""")
def src19_crawl_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether its host's rules let a page be read: two hosts of three have rules, and some hosts' files are missing or can't be had."""
    asked = table(spark, sf_dir, "pages", "page_id", "url").select("page_id", urls.host_of(F.col("url")).alias("host"), crawl.target_of(F.col("url")).alias("target"))
    hosts = asked.where("host <> ''").select("host").distinct()
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(a).alias("allow")) for r, a in RULES))
    kind = F.length("host") % 7
    states = hosts.select("host", F.when(kind == 0, 404).when(kind == 1, 503).otherwise(200).alias("status"))
    return crawl.allowed(asked, hosts.where(F.length("host") % 3 != 0).select("host", F.inline(rules)), states)


@query("""WITH o AS (SELECT user_id, event_id, epoch_us(ts) AS "at", event_type = 'error' AS bad FROM events),
g AS (SELECT *, count(*) FILTER (NOT bad) OVER (PARTITION BY user_id ORDER BY "at", event_id ROWS UNBOUNDED PRECEDING) AS run FROM o),
f AS (SELECT *, count(*) FILTER (bad) OVER (PARTITION BY user_id, run ORDER BY "at", event_id ROWS UNBOUNDED PRECEDING) AS failures FROM g)
SELECT user_id, event_id, failures, (CASE WHEN bad THEN least(60 * 2 ** least(failures, 5), 2880) ELSE 60 END)::BIGINT AS minutes, "at" + (CASE WHEN bad THEN least(60 * 2 ** least(failures, 5), 2880) ELSE 60 END)::BIGINT * 60000000 AS next_check FROM f""")
def st5_check_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After each check: failures since the last good one, minutes to the next check and its time."""
    o = observations(spark, sf_dir).select("user_id", "event_id", "at", (F.col("event_type") == "error").alias("bad"))
    order = Window.orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = o.withColumn("run", F.count_if(~F.col("bad")).over(order.partitionBy("user_id")))
    counted = runs.withColumn("failures", F.count_if("bad").over(order.partitionBy("user_id", "run")))
    outcome = F.when(F.col("bad"), "failed").otherwise("changed")
    timed = counted.withColumn("minutes", scheduling.next_interval(F.lit(60), F.lit(60), outcome, F.col("failures"), F.lit(True)))
    return timed.select("user_id", "event_id", "failures", "minutes", (F.col("at") + F.col("minutes") * 60_000_000).alias("next_check"))


#: Documents that a task counts terms for, on average.
PER_TASK = 4000


@query("""WITH d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents),
q AS (SELECT * FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark) WHERE length(term) >= 2 AND term NOT IN (""" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + """)),
s AS (SELECT item_id, doc_id, count(*) AS n_terms FROM q JOIN d USING (term) GROUP BY 1, 2)
SELECT item_id, doc_id, n_terms, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n_terms DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def k16_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that hold most of each question's words: an inverted index met by an equi-join, counted where a document's words lie.

    A task counts for PER_TASK documents, so what it holds does not grow with the table, and passes on its ten best of each question.
    """
    terms = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    wanted = F.filter(terms(F.col("text")), lambda w: (F.length(w) >= 2) & ~w.isin(text.STOPWORDS))
    asked = table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", F.explode(wanted).alias("term"))
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    dealt = docs.select("doc_id", terms(F.col("text")).alias("terms")).repartition(-(-docs.count() // PER_TASK) or 1, "doc_id")
    index = dealt.select("doc_id", F.explode("terms").alias("term"))
    scored = asked.join(index, "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("n_terms"))
    best = feeds.newest(scored, ["item_id"], [F.desc("n_terms"), F.asc("doc_id")], 10)
    return best.select("item_id", "doc_id", "n_terms", F.col("place").alias("rank"))


@query("""SELECT * FROM (SELECT 'card' AS kind, o_orderkey AS id, epoch_us(o_orderdate) AS "at" FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 12)
UNION ALL SELECT * FROM (SELECT 'event', event_id, epoch_us(ts) FROM events WHERE event_type <> 'error' ORDER BY ts DESC, event_id DESC LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'fact', l_orderkey, max(epoch_us(l_shipdate)) FROM lineitem GROUP BY l_orderkey ORDER BY 3 DESC, 2 DESC LIMIT 10)""")
def k18_recent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest cards, events and facts; each feed is cut to its number where it is read."""

    def feed(df: DataFrame, kind: str, n: int) -> DataFrame:
        return df.orderBy(F.desc("at"), F.desc("id")).limit(n).select(F.lit(kind).alias("kind"), "id", "at")

    cards = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderstatus").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"), micros("o_orderdate").alias("at"))
    events = table(spark, sf_dir, "events", "event_id", "event_type", "ts").where("event_type <> 'error'").select(F.col("event_id").alias("id"), micros("ts").alias("at"))
    facts = table(spark, sf_dir, "lineitem", "l_orderkey", "l_shipdate").groupBy(F.col("l_orderkey").alias("id")).agg(F.max(micros("l_shipdate")).alias("at"))
    return feed(cards, "card", 12).unionByName(feed(events, "event", 10)).unionByName(feed(facts, "fact", 10))


# cards' keys as addresses in and about the reserved ranges, written in eight forms of which the last three are URLs
OCTETS = [[10, 100, 127, 169, 172, 192, 198, 203, 8, 93, 224, 0], [64, 254, 16, 168, 18, 0, 51, 31, 32, 127, 128, 19], [0, 2, 100, 113, 1]]
PUBLIC = f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 8 AS form, {OCTETS[0]}[1 + o_orderkey % 12]::BIGINT * 16777216 + {OCTETS[1]}[1 + o_orderkey // 12 % 12] * 65536 + {OCTETS[2]}[1 + o_orderkey // 144 % 5] * 256 + o_orderkey % 256 AS v FROM orders),
r AS (SELECT * FROM (VALUES ('0.0.0.0', 8), ('10.0.0.0', 8), ('100.64.0.0', 10), ('127.0.0.0', 8), ('169.254.0.0', 16), ('172.16.0.0', 12), ('192.0.0.0', 24), ('192.0.2.0', 24), ('192.168.0.0', 16), ('198.18.0.0', 15), ('198.51.100.0', 24), ('203.0.113.0', 24), ('224.0.0.0', 4), ('240.0.0.0', 4)) t(net, bits)),
n AS (SELECT list_reduce(list_transform(string_split(net, '.'), lambda x: x::BIGINT), lambda a, x: a * 256 + x) AS low, 1::BIGINT << (32 - bits) AS many FROM r),
j AS (SELECT k, form, v, v NOT IN (3221225481, 3221225482) AND EXISTS (SELECT 1 FROM n WHERE v >= low AND v < low + many) AS closed FROM o)
SELECT k AS o_orderkey, CASE WHEN form < 4 THEN NOT closed ELSE false END AS is_public, CASE WHEN form < 5 THEN 'scheme' WHEN form = 5 AND closed THEN 'address' WHEN form = 6 AND closed THEN 'address' WHEN form = 7 THEN CASE k // 8 % 3 WHEN 0 THEN 'credentials' WHEN 1 THEN 'internal' END END AS blocked FROM j"""


@query(PUBLIC)
def src20_public_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and URLs in several forms: whether they are a public host's, and why they may not be fetched from."""
    orders = table(spark, sf_dir, "orders", "o_orderkey")
    k = F.col("o_orderkey")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    parts = [pick(OCTETS[0], k % 12), pick(OCTETS[1], F.floor(k / 12) % 12), pick(OCTETS[2], F.floor(k / 144) % 5), k % 256]
    dotted = F.concat_ws(".", *(p.cast("string") for p in parts))
    digits = F.concat(*(F.lpad(F.lower(F.hex(p.cast("long"))), 2, "0") for p in parts))
    groups = F.concat(F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4))
    url = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in x))
    named = pick(["https://me@example.com/", "http://db.internal:80/x", "https://example.com/a?b"], F.floor(k / 8) % 3)
    forms = [dotted, url("::ffff:", dotted), url("[64:ff9b::", groups, "]"), url("64:ff9b:1::", groups), url("2002:", groups, "::"), url("http://0x", digits, ":8080/a"), url("https://[::ffff:", groups, "]/"), named]
    written = orders.withColumn("s", F.element_at(F.array(*forms), (k % 8 + 1).cast("int")))
    return written.select("o_orderkey", addresses.is_public_ip(F.col("s")).alias("is_public"), addresses.blocked(F.col("s")).alias("blocked"))
