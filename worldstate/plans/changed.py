"""Queries on two versions of a page: every document's numbered lines, of which those at known places are edited.

Of nine lines one gets a dash (formatting), one a note of an update before it, re-wrapped and with another day (volatile), one
a rate (a change), and one is followed by a line that a learned rule suppresses. SQL knows the hunks by the places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import diffing
from .queries import table

QUERIES, ORACLES = {}, {}

#: A learned rule, and the characters of a rendered diff.
RULES, MOST = ["[not a pattern", "^sponsored:"], 1500


def query(sql: str):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, and both versions' lines."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    label = lambda i: F.concat(F.lit("L"), i.cast("string"))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(label(i), F.lit(" "), text.squeeze(x)))

    def old(x: Column, i: Column) -> Column:
        return F.when(i % 9 == 3, F.array(F.concat(F.lit("Updated "), label(i), F.lit(" on")), F.lit("2024-01-05"), x)).otherwise(F.array(x))

    def new(x: Column, i: Column) -> Column:
        after = lambda mark: F.regexp_replace(x, "^(L[0-9]+) ", f"$1 {mark} ")
        edited = F.when(i % 9 == 1, F.array(after("—"))).when(i % 9 == 3, F.array(F.concat(F.lit("Updated "), label(i), F.lit(" on 2025-06-07")), x))
        return edited.when(i % 9 == 5, F.array(after("rate 3%:"))).when(i % 9 == 7, F.array(x, F.concat(F.lit("Sponsored: "), label(i)))).otherwise(F.array(x))

    return docs.withColumn("_lines", lines).select("doc_id", F.flatten(F.transform("_lines", old)).alias("old"), F.flatten(F.transform("_lines", new)).alias("new"))


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = versions(spark, sf_dir)
    return found.withColumn("hunks", diffing.hunks(diffing.keyed(F.col("old")), diffing.keyed(F.col("new"))))


HUNKS = r"""WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, unnest(x) AS raw, generate_subscripts(x, 1) - 1 AS i FROM s),
t AS (SELECT doc_id, i, 'L' || i || ' ' || trim(regexp_replace(raw, '[\t-\r\x{85}\p{Z}]+', ' ', 'g')) AS t FROM l),
w AS (SELECT doc_id, i, t, i % 9 AS m, lag(t) OVER o AS p1, lag(t, 2) OVER o AS p2, lead(t) OVER o AS n1, lead(t, 2) OVER o AS n2 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (
  SELECT doc_id, i, m, (row_number() OVER (PARTITION BY doc_id ORDER BY i))::INT AS hunk, CASE m WHEN 7 THEN 'added' ELSE 'changed' END AS kind,
    CASE m WHEN 3 THEN ['Updated L' || i || ' on', '2024-01-05'] WHEN 7 THEN [] ELSE [t] END AS before,
    CASE m WHEN 1 THEN [regexp_replace(t, '^(L[0-9]+) ', '\1 — ')] WHEN 3 THEN ['Updated L' || i || ' on 2025-06-07'] WHEN 5 THEN [regexp_replace(t, '^(L[0-9]+) ', '\1 rate 3%: ')] ELSE ['Sponsored: L' || i] END AS after,
    list_filter(CASE m WHEN 3 THEN [p1] WHEN 7 THEN [p1, t] ELSE [p2, p1] END, lambda x: x IS NOT NULL) AS context_before,
    list_filter(CASE m WHEN 1 THEN [n1] WHEN 3 THEN [t, n1] ELSE [n1, n2] END, lambda x: x IS NOT NULL) AS context_after
  FROM w WHERE m IN (1, 3, 5, 7)
)"""


@query(HUNKS + " SELECT doc_id, hunk, kind, array_to_string(before, chr(10)) AS before, array_to_string(after, chr(10)) AS after, array_to_string(context_before, chr(10)) AS context_before, array_to_string(context_after, chr(10)) AS context_after FROM h")
def k1_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hunk with its lines and context."""
    found = diffs(spark, sf_dir).select("doc_id", F.posexplode("hunks").alias("_at", "h"))
    return found.select("doc_id", (F.col("_at") + 1).alias("hunk"), "h.kind", *(F.array_join(f"h.{c}", "\n").alias(c) for c in ("before", "after", "context_before", "context_after")))


@query(HUNKS + """, n AS (SELECT doc_id, count(*) AS n_new, count(*) FILTER (m = 3) AS u, count(*) FILTER (m = 7) AS s FROM w GROUP BY doc_id), c AS (SELECT doc_id, sum(len(before)) AS b, sum(len(after)) AS a FROM h GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_added, coalesce(b, 0)::BIGINT AS n_removed, floor(1000000 * (coalesce(a, 0) + coalesce(b, 0)) / (2 * n_new + 3 * u + s))::BIGINT AS ratio_ppm FROM n LEFT JOIN c USING (doc_id)""")  # fmt: skip
def k1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added and removed lines, and the share of all lines that changed, in millionths."""
    found, n = diffs(spark, sf_dir), diffing.counts(F.col("hunks"))
    ratio = F.floor((n["n_added"] + n["n_removed"]) * 1000000 / (F.size("old") + F.size("new")))
    return found.select("doc_id", *(v.alias(k) for k, v in n.items()), ratio.alias("ratio_ppm"))


SHORT = "CASE WHEN length({0}) <= 120 THEN {0} ELSE rtrim(left({0}, 119)) || '…' END"
QUOTED = r"""CASE WHEN contains({0}, '''') AND NOT contains({0}, '"') THEN '"' || replace({0}, '\', '\\') || '"' ELSE '''' || replace(replace({0}, '\', '\\'), '''', '\''') || '''' END"""


@query(HUNKS + f""", b AS (SELECT *, array_to_string(before, ' / ') AS x, array_to_string(after, ' / ') AS y FROM h), c AS (SELECT * REPLACE ({SHORT.format("x")} AS x, {SHORT.format("y")} AS y) FROM b)
SELECT doc_id, hunk, CASE m WHEN 1 THEN 'formatting' WHEN 3 THEN 'volatile' WHEN 7 THEN 'rule' END AS reason, CASE WHEN m = 7 THEN '^sponsored:' END AS rule,
  CASE m WHEN 1 THEN 'formatting-only change (whitespace/punctuation/case): ' WHEN 3 THEN 'volatile-only change (dates/times/ids): ' WHEN 7 THEN 'matched suppression rule ''^sponsored:'': + ' END || CASE WHEN m < 7 THEN {QUOTED.format("x")} || ' -> ' ELSE '' END || {QUOTED.format("y")} AS note FROM c""")  # fmt: skip
def k2_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hunk with the reason why it is noise, if it is."""
    found = diffs(spark, sf_dir).select("doc_id", F.posexplode(diffing.judged(F.col("hunks"), RULES)).alias("_at", "j"))
    return found.select("doc_id", (F.col("_at") + 1).alias("hunk"), "j.reason", "j.rule", "j.note")


@query(HUNKS + f""", b AS (
  SELECT doc_id, hunk, array_to_string(list_concat(['@@ ' || hunk || ' ' || kind], list_transform(context_before, lambda x: '  ' || x), list_transform(before, lambda x: '- ' || x), list_transform(after, lambda x: '+ ' || x), list_transform(context_after, lambda x: '  ' || x)), chr(10)) AS block FROM h
), sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, sum(length(block) + 2) OVER (PARTITION BY doc_id ORDER BY hunk) - 2 AS reach FROM b),
ended AS (SELECT *, min(CASE WHEN reach + CASE WHEN hunk < n THEN 40 ELSE 0 END > {MOST} THEN hunk END) OVER (PARTITION BY doc_id) AS stop FROM sized),
whole AS (SELECT doc_id, max(n) AS n, greatest(coalesce(max(stop) - 1, max(n)), 1) AS shown, max(stop) = 1 AS is_cut, string_agg(block, chr(10) || chr(10) ORDER BY hunk) FILTER (stop IS NULL OR hunk < stop) AS body, max(block) FILTER (hunk = 1) AS first FROM ended GROUP BY doc_id),
parts AS (SELECT doc_id, unnest(string_split(first, chr(10))) AS line, generate_subscripts(string_split(first, chr(10)), 1) AS k FROM whole WHERE is_cut),
held AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) || chr(10) || '  … (hunk truncated)' AS body FROM (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS reach FROM parts) WHERE reach <= {MOST} - 60 GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN w.doc_id IS NULL THEN '(no changes)' ELSE coalesce(held.body, w.body) || CASE WHEN n > shown THEN chr(10) || chr(10) || '… ' || (n - shown) || ' more hunk' || CASE WHEN n - shown = 1 THEN '' ELSE 's' END || ' omitted' ELSE '' END END AS rendered
FROM documents d LEFT JOIN whole w USING (doc_id) LEFT JOIN held USING (doc_id)""")  # fmt: skip
def k3_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's diff as text within a budget."""
    return diffs(spark, sf_dir).select("doc_id", diffing.rendered(F.col("hunks"), MOST).alias("rendered"))


@query(HUNKS + " SELECT d.doc_id, trim(h.after[1]) AS quote FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id AND h.hunk = 1")
def k5_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote for each document's change."""
    return diffs(spark, sf_dir).select("doc_id", diffing.quote(F.col("hunks"), F.array_join("new", "\n")).alias("quote"))
