"""Queries on names, values, addresses and texts, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domain, fuzzy, levels, scheduling, text, urls
from ..streaming import captures
from .queries import observations, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def sql_slug(x: str, n: int = 60) -> str:
    words = f"regexp_extract_all(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^\\x00-\\x7f]', '', 'g'), '[a-z0-9]+')"
    return f"trim(left(array_to_string({words}, '-'), {n}), '-')"


def sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


FLAT = r"trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\t-\r\x{85}\p{Z}\x1c-\x1f]+', ' ', 'g'), ' +', ' ', 'g'))"
HOST = r"regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1)"


@query(f"SELECT item_id, {sql_slug("coalesce(text, '')")} AS slug FROM benchmark")
def f3_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", domain.slug(F.col("text")).alias("slug"))


@query(r"SELECT c_custkey, CASE WHEN length(c_name) <= 9 THEN c_name ELSE rtrim(left(c_name, 8)) || '…' END AS short, left(lower(c_name), 300) AS name_key FROM customer")
def f7_short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", "c_custkey", "c_name").select("c_custkey", text.truncate(F.col("c_name"), 9).alias("short"), text.name_key(F.col("c_name")).alias("name_key"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_filter(regexp_extract_all(lower(regexp_replace(text, 'n[''’]t\\b', ' not', 'g')), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: w IN ({sql_list(text.NEGATIONS)}))), ' ') AS negations FROM documents")
def f12_negations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.array_join(text.negations(F.col("text")), " ").alias("negations"))


@query(rf"WITH w AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}][\p{{L}}\p{{M}}\p{{N}}_.''+&-]*'), lambda w: regexp_replace(regexp_replace(w, '[.''+&-]+$', ''), '''s$', '')), lambda w: length(w) >= 2 AND w NOT IN ({sql_list(text.STOPWORDS)})) AS a FROM conversations) SELECT conv_id, turn, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i)[1:12], ' ') AS terms FROM w")
def f18_search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.array_join(text.search_terms(F.col("text")), " ").alias("terms"))


@query(rf"WITH f AS (SELECT doc_id, {FLAT} AS flat FROM documents), c AS (SELECT *, left(flat, 300) AS cut, regexp_extract(left(flat, 300), '^(.*) [^ ]*$', 1) AS word FROM f) SELECT doc_id, CASE WHEN length(flat) <= 300 THEN flat ELSE regexp_replace(CASE WHEN length(word) > 180 THEN word ELSE cut END, '[ ,;:]+$', '') || '…' END AS snippet, CASE WHEN length(flat) <= 80 THEN flat ELSE left(flat, 79) || '…' END AS clip FROM c")
def f20_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", domain.snippet(F.col("text")).alias("snippet"), domain.clip(F.col("text"), 80).alias("clip"))


UNIT = ["percent", "INR", " Rs. ", "us$", "kg", "basis points"]
UNITS_SQL = "CASE lower(trim(u)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in domain.UNITS.items()) + " ELSE CASE WHEN length(trim(u)) <= 4 THEN upper(trim(u)) ELSE lower(trim(u)) END END"


@query(rf"WITH o AS (SELECT o_orderkey, o_totalprice AS x, [{sql_list(UNIT)}][o_orderkey % 6 + 1] AS u, o_orderkey % 7 = 0 AS bare, o_orderstatus AS s FROM orders), k AS (SELECT *, {UNITS_SQL} AS unit, regexp_replace(round(x, 4)::DECIMAL(38, 4)::VARCHAR, '0+$', '') AS n FROM o) SELECT o_orderkey, unit, left(sha256(CASE WHEN bare THEN 't:' || lower(s) ELSE 'n:' || CASE WHEN ends_with(n, '.') THEN n || '0' ELSE n END || '|u:' || unit || '|c:' || lower(s) END), 32) AS value_key FROM k")
def f25_value_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with a unit, or bare texts, by what makes them equal."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderstatus")
    unit = F.element_at(F.array(*map(F.lit, UNIT)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    number = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    return orders.select("o_orderkey", domain.norm_unit(unit).alias("unit"), domain.value_key(F.col("o_orderstatus"), number, unit, F.col("o_orderstatus")).alias("value_key"))


KINDS = ["partnership", "funding", "leadership", "product_launch", "regulatory", "pricing", "other"]


@query(f"""WITH e AS (SELECT o_orderkey, [{sql_list(KINDS)}][o_orderkey % 7 + 1] AS kind, c_name || ' Ltd' AS entity, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS other, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS product, strftime(o_orderdate, '%Y-%m') AS month FROM orders JOIN customer ON c_custkey = o_custkey),
s AS (SELECT *, {sql_slug("replace(entity, ' Ltd', '')")} AS n, {sql_slug('other')} AS o, {sql_slug('product')} AS p, {sql_slug("coalesce(product, other)", 50)} AS topic FROM e)
SELECT o_orderkey, CASE WHEN kind = 'partnership' AND o <> '' THEN kind || ':' || n || ':' || o WHEN kind = 'funding' THEN 'funding:' || n || ':' || month WHEN kind = 'leadership' AND other IS NOT NULL THEN kind || ':' || n || ':' || o WHEN kind = 'product_launch' AND product IS NOT NULL THEN 'launch:' || n || ':' || p WHEN kind = 'regulatory' THEN kind || ':' || n || ':' || p
  WHEN kind = 'pricing' THEN kind || ':' || n || ':' || CASE WHEN p = '' THEN 'general' ELSE p END ELSE kind || ':' || n || ':' || topic END AS cluster_key FROM s""")
def f27_cluster_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    met = orders.join(table(spark, sf_dir, "customer", "c_custkey", "c_name"), F.col("c_custkey") == F.col("o_custkey"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    other, product = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus"))
    key = domain.cluster_key(kind, F.concat("c_name", F.lit(" Ltd")), other, product, other, F.lit(None).cast("string"), F.lit(None).cast("string"), F.date_format("o_orderdate", "yyyy-MM"))
    return met.select("o_orderkey", key.alias("cluster_key"))


@query("SELECT c_custkey, regexp_matches(trim(m), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AS valid FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ' ' || replace(c_name, '#', '@') || '.org' WHEN c_custkey % 3 = 1 THEN replace(c_name, '#', '@') ELSE c_name || ' @x.org' END AS m FROM customer)")
def p23_valid_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, k = F.replace(F.col("c_name"), F.lit("#"), F.lit("@")), F.col("c_custkey") % 3
    mail = F.when(k == 0, F.concat(F.lit(" "), name, F.lit(".org"))).when(k == 1, name).otherwise(F.concat("c_name", F.lit(" @x.org")))
    return table(spark, sf_dir, "customer", "c_custkey", "c_name").select("c_custkey", domain.valid_email(mail).alias("valid"))


OWN, DISTRUSTED = ["example.com"], ["example.net"]


@query(f"WITH h AS (SELECT page_id, url, {HOST} AS host FROM pages) SELECT page_id, CASE WHEN regexp_extract(host, '([^.]+\\.[^.]+)$', 1) IN ({sql_list(DISTRUSTED)}) THEN 'community' WHEN len(list_filter([{sql_list([*OWN, *domain.REGISTRIES])}], lambda d: host = d OR ends_with(host, '.' || d))) > 0 THEN 'primary' WHEN len(list_filter([{sql_list(domain.COMMUNITY)}], lambda d: host = d OR ends_with(host, '.' || d))) > 0 THEN 'community' ELSE 'independent' END AS source_class FROM h")
def p4_source_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", domain.source_class(url, urls.registrable_domain(url), OWN, [], DISTRUSTED).alias("source_class"))


@query(r"SELECT page_id, regexp_matches(lower(regexp_extract(url, '^[a-zA-Z]+://[^/]+(/[^?#]*)?', 1)) || '/', '/(?:blog|blogs|learn|guides|resources|stories|articles)/+[^/]') AS article, regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/$', '') AS path, url AS original FROM pages")
def u5_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' paths, whether they are articles, and the address within an archive's address."""
    archived = F.concat(F.lit("https://archive.example/web/20240101000000id_/"), F.col("url"))
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", domain.is_article(F.col("url")).alias("article"), urls.path_of(F.col("url")).alias("path"), domain.original_url(archived).alias("original"))


@query(rf"WITH t AS (SELECT conv_id, turn, lower({FLAT}) AS t FROM conversations) SELECT conv_id, turn, len(string_split(t, ' ')) > 5 OR contains(t, '?') OR regexp_matches(t, '^(?:{'|'.join(domain.REQUESTS)})') AS request FROM t")
def p22_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", domain.looks_like_request(F.coalesce("text", F.lit(""))).alias("request"))


NUMBERS = r"list_distinct(list_transform(regexp_extract_all(x, '[0-9]+(?:[.,][0-9]+)*'), lambda y: CASE WHEN regexp_full_match(y, '[0-9]{1,3}(?:,[0-9]{2,3})+(?:\.[0-9]+)?') THEN replace(y, ',', '') ELSE y END))"


@query(f"WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, turn, len(list_filter({NUMBERS.replace('(x,', '(text,')}, lambda n: NOT list_contains({NUMBERS.replace('(x,', '(before,').replace('lambda y', 'lambda z').replace('(y,', '(z,').replace('ELSE y', 'ELSE z')}, n))) = 0 AS supported FROM c WHERE before IS NOT NULL AND text IS NOT NULL")
def p18_numbers_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose numbers all stand in the turn before."""
    from pyspark.sql.window import Window

    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return turns.where("before is not null and text is not null").select("conv_id", "turn", domain.numbers_supported(F.col("text"), F.col("before")).alias("supported"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, epoch_us(coalesce(CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 1 DAY END, ts)) AS effective FROM events")
def d4_effective_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of a written time, and when a thing happened or else was seen."""
    events = table(spark, sf_dir, "events", "event_id", "ts")
    day = F.try_to_date(F.left(F.col("ts").cast("string"), F.lit(10)))
    effective = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', coalesce(case when event_id % 3 = 0 then ts - interval 1 day end, ts))"
    return events.select("event_id", F.date_format(day, "yyyy-MM-dd").alias("day"), F.expr(effective).alias("effective"))


@query("SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k, coalesce((props::JSON->>'$.none')::BIGINT, 0) AS none, coalesce((props::JSON->>'$.k')::BIGINT, 0) + 1 AS merged FROM events")
def mp2_json_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at paths, with defaults, and a map of which one key is set anew."""
    kept = F.from_json("props", "map<string,string>")
    k = F.get_json_object("props", "$.k").cast("long")
    merged = F.map_concat(F.map_filter(kept, lambda a, _: a != "k"), F.create_map(F.lit("k"), (F.coalesce(k, F.lit(0)) + 1).cast("string")))
    return table(spark, sf_dir, "events", "event_id", "props").select("event_id", k.alias("k"), F.coalesce(F.get_json_object("props", "$.none").cast("long"), F.lit(0)).alias("none"), F.element_at(merged, "k").cast("long").alias("merged"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS areas, bool_or(event_type = 'error') AS failing, count(DISTINCT event_type) = 0 OR bool_or(event_type = 'signup') AS covers FROM events GROUP BY 1")
def a3_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct areas of a source, sorted; whether they hold one, or are all."""
    found = table(spark, sf_dir, "events", "user_id", "event_type").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("a"))
    return found.select("user_id", F.array_join("a", ",").alias("areas"), F.array_contains("a", "error").alias("failing"), ((F.size("a") == 0) | F.array_contains("a", "signup")).alias("covers"))


PRICES = [("PROMO", 5), ("STANDARD", 3), ("S", 2), ("", 1)]


@query(f"SELECT p_partkey, (SELECT arg_min(price, ord) FROM (VALUES {', '.join(f'({i}, {p!r}, {x})' for i, (p, x) in enumerate(PRICES))}) v(ord, prefix, price) WHERE starts_with(p_type, prefix)) * p_size AS cost FROM part")
def m4_cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units at the price of the first prefix that fits."""
    price = F.lit(None).cast("int")
    for prefix, x in reversed(PRICES):
        price = F.when(F.startswith(F.col("p_type"), F.lit(prefix)), x).otherwise(price)
    return table(spark, sf_dir, "part", "p_partkey", "p_type", "p_size").select("p_partkey", (price * F.col("p_size")).alias("cost"))


@query("SELECT event_id, event_id % 5 >= user_id % 5 AS at_least, ['none', 'low', 'medium', 'high', 'critical'][least(event_id % 5 + 1, 4) + 1] AS stepped, round((event_id % 7 + user_id % 3) / greatest(1, event_id % 11 + user_id % 13), 6) AS ratio, user_id % 40 IS NULL OR event_id % 50 >= 0.35 * (user_id % 40) AS adopted FROM events")
def p7_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered levels, the share of a page that changed, and whether a capture is long enough."""
    pick = lambda c: F.element_at(F.array(*map(F.lit, levels.SEVERITY)), (F.col(c) % 5 + 1).cast("int"))
    e, u = F.col("event_id"), F.col("user_id")
    ratio = F.round(scheduling.changed_ratio(e % 7, u % 3, e % 11, u % 13), 6)
    return table(spark, sf_dir, "events", "event_id", "user_id").select("event_id", levels.at_least(pick("event_id"), pick("user_id")).alias("at_least"), levels.step(pick("event_id"), 1).alias("stepped"), ratio.alias("ratio"), scheduling.adopt(e % 50, u % 40, F.lit(None).cast("int")).alias("adopted"))


CAPTURES = "SELECT user_id AS source, epoch_us(ts) AS \"at\", event_id AS id, (event_id * 7919) % 400 AS words, event_id % 3 AS content FROM events"


@query(f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY "at", id) AS i FROM ({CAPTURES})),
f AS (
  SELECT source, id, i, words AS ref, content AS before, NULL::BIGINT AS rejected, 'accepted' AS verdict FROM c WHERE i = 1
  UNION ALL
  SELECT source, id, i, CASE WHEN v = 'accepted' THEN words ELSE ref END, CASE WHEN v = 'accepted' THEN content ELSE before END, CASE WHEN v = 'accepted' THEN NULL WHEN v = 'rejected' THEN words ELSE rejected END, v
  FROM (SELECT c.source, c.id, c.i, c.words, c.content, f.ref, f.before, f.rejected, CASE WHEN c.content = f.before THEN 'same' WHEN c.words >= f.ref * 0.35 OR coalesce(abs(c.words - f.rejected) <= greatest(c.words, f.rejected) * 0.25, false) THEN 'accepted' ELSE 'rejected' END AS v FROM f JOIN c ON c.source = f.source AND c.i = f.i + 1)
)
SELECT source, id, verdict FROM f""")
def st3_adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of each source in order: accepted, rejected, or the same as the accepted one."""
    obs = observations(spark, sf_dir)
    found = captures.adopted(obs.select(F.col("user_id").alias("source"), "at", F.col("event_id").alias("id"), (F.col("event_id") * 7919 % 400).alias("words"), (F.col("event_id") % 3).alias("content")))
    return found.select("source", "id", "verdict")


@query()
def f4_turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike a conversation's consecutive turns are; SQL has no such measure."""
    from pyspark.sql.window import Window

    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("t", F.lower("text"))
    pairs = turns.withColumn("b", F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return pairs.select("conv_id", "turn", *(F.round(f("t", "b"), 6).alias(f"{name}_score") for name, f in (("ratio", fuzzy.ratio), ("sort", fuzzy.token_sort_ratio), ("set", fuzzy.token_set_ratio))))
