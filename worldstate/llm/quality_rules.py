"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Measures of a whole text (null: empty), each a long:
  n_words         words, runs of characters other than ASCII white space
  word_chars      code points in words
  n_symbols       characters of `#*$%&|<>`
  n_lines         \\n-split lines with a word
  n_dup_lines     of these, lines equal to an earlier one
  n_repeat_words  words in 3-word windows that the text has twice or more, the first included
  n_stop_words    words that are a listed stop word, as listed or with a capital initial

base_failed: fewer than 50 words, or over half the words in repeated windows. The table's rules each bound
one ratio of two measures; a text is kept if neither the base nor any rule rejects it. Ratios are compared as
integers (low * denominator <= 100 * numerator <= high * denominator), so no rounding decides.

Repeated windows are found by sorting one long a window (32 bits of hash, 32 of position) and comparing the
texts of windows whose hash has a neighbour: time n log n in the text's words, exact whatever collides.

Defined cases: null and empty texts have no words and fail; a repeated row is judged as often as it occurs;
columns named as the measures are replaced, other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = """
the of and to a in is that it for was on with as be by this are at from or an not have but
de la le et les des en un du une que pour est par dans qui avec pas sur au il ne ce plus
der die und den von zu das mit sich auf für ist im nicht dem ein eine als auch es an werden
el y los se las del por con no su para al lo como más pero sus o este sí porque
""".split()

#: (rule, numerator, denominator, least per cent or None, most per cent or None)
THRESHOLDS = [
    ("length", "word_chars", "n_words", 250, 1000),
    ("symbol", "n_symbols", "n_words", None, 10),
    ("stop_word", "n_stop_words", "n_words", 2, None),
    ("line", "n_dup_lines", "n_lines", None, 40),
]


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of three that occur twice or more."""
    low = 0xFFFFFFFF
    window = lambda i: [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]

    def alike(array: Column, part) -> Column:
        """Elements whose part equals that of a neighbour in the sorted array."""
        same = lambda a, b: F.coalesce(part(a) == part(b), F.lit(False))
        return F.filter(array, lambda x, k: same(x, F.get(array, k - 1)) | same(x, F.get(array, k + 1)))

    packed = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(*window(i)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
    by_hash = common.let(packed, lambda a: alike(a, lambda x: x.bitwiseAND(F.lit(~low))))
    texts = F.sort_array(F.transform(by_hash, lambda x: common.let(x.bitwiseAND(F.lit(low)).cast("int"), lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("g"), i.alias("i")))))
    starts = F.sort_array(F.transform(common.let(texts, lambda a: alike(a, lambda x: x["g"])), lambda x: x["i"]))
    spans = common.let(starts, lambda a: F.transform(a, lambda i, k: F.least(F.lit(3), F.get(a, k + 1) - i).cast("long")))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words"]


def _measures(whole: Column, words: Column, lines: Column) -> Column:
    stop = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]
    found = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeat_words(words),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(stop))),
    }
    return F.struct(*(found[k].cast("long").alias(k) for k in MEASURES))


def compile_rules(thresholds: list[tuple], m: Column) -> Column:
    """One boolean over a struct of measures: no rule of the table rejects."""
    passed = F.lit(True)
    for _, part, whole, least, most in thresholds:
        if least is not None:
            passed &= m[part] * 100 >= m[whole] * least
        if most is not None:
            passed &= m[part] * 100 <= m[whole] * most
    return passed


def verdict(text: Column, thresholds: list[tuple] = THRESHOLDS, least_words: int = 50) -> Column:
    """A struct of the measures, base_failed and kept.

    It is one expression in which each intermediate result is bound once: a filter on it that Spark pushes
    down copies it as a whole, and never a word list into a loop over words.
    """

    def judged(m: Column) -> Column:
        failed = (m["n_words"] < least_words) | (m["n_repeat_words"] * 100 > m["n_words"] * 50)
        return F.struct(*(m[k].alias(k) for k in MEASURES), failed.alias("base_failed"), (~failed & compile_rules(thresholds, m)).alias("kept"))

    def measured(t: Column) -> Column:
        words, lines = F.filter(F.split(t, common.GAP), lambda w: w != ""), F.filter(F.split(t, "\n"), lambda x: x.rlike(common.WORD))
        return common.let(words, lambda w: common.let(lines, lambda x: common.let(_measures(t, w, x), judged)))

    return common.let(F.coalesce(text, F.lit("")), measured)


def judge(df: DataFrame, thresholds: list[tuple] = THRESHOLDS, text: str = "text", least_words: int = 50) -> DataFrame:
    """Adds the measures, base_failed and kept to df."""
    found = df.withColumn("_found", verdict(F.col(text), thresholds, least_words))
    return found.withColumns({k: F.col("_found")[k] for k in [*MEASURES, "base_failed", "kept"]}).drop("_found")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


_LIST = ", ".join(f"'{w}'" for w in [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)])
SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), places AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w
), grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS c FROM places
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM grams, (VALUES (0), (1), (2)) t(k) WHERE c > 1 GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda x: x IN ({_LIST})))::BIGINT AS n_stop_words
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id
)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND 100 * word_chars BETWEEN 250 * n_words AND 1000 * n_words AND 100 * n_symbols <= 10 * n_words
    AND 100 * n_stop_words >= 2 * n_words AND 100 * n_dup_lines <= 40 * n_lines AS kept
FROM m
"""
