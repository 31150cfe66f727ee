"""Fill-in-middle transformation by bit-parallel operations on big integers.

A text is cut into units, a run of letters A-Z, a-z or any other single character, and two ranks drawn from a hash of the
document's id end its prefix and its middle. A text's UTF-8 bytes, the last one first, are translated to 0 and 1 once a
class and read as binary numbers, so that bit i tells the class of byte i. A unit begins at a byte that ends no
character (no continuation byte) and is no letter behind a letter: one shift and three boolean operations mark them all.
bit_count gives their number. The place of the unit of a rank is found by recursive halving: the half that holds it is
told by the lower half's bit_count, so that selecting costs about as much as reading the number twice.

Forms: plain (the text as it is), psm (prefix, suffix, middle) and spm (suffix, prefix, middle), each part behind its mark.
No text moves between tasks; a task holds an Arrow batch and the numbers of one text.

Defined cases: a null text is empty, an empty one plain; a text that holds a mark stays plain, so marks are never
ambiguous; a null id draws from the seed alone; repeated rows are transformed alike; an empty table gives no rows;
columns named n, form, prefix_chars, middle_chars and output are replaced, other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are transformed; of 100 transformed ones so many have their suffix first.
RATE, SUFFIX_FIRST = 90, 20

_LETTER = bytes(48 + (65 <= b <= 90 or 97 <= b <= 122) for b in range(256))
_INSIDE = bytes(48 + (128 <= b < 192) for b in range(256))


def boundaries(text: bytes) -> tuple[int, int]:
    """Two numbers whose bit i tells if a unit, and if a character, begins at byte i of a UTF-8 text."""
    if not text:
        return 0, 0
    back = text[::-1]
    letter, inside = int(back.translate(_LETTER), 2), int(back.translate(_INSIDE), 2)
    characters = ((1 << len(text)) - 1) ^ inside
    return characters & ~(letter & (letter << 1)), characters


def select(bits: int, rank: int, width: int) -> int:
    """The place of the set bit with so many set bits below it; width if there are not so many."""
    end, at = width, 0
    if rank >= bits.bit_count():
        return end
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, width = low, half
        else:
            bits, width, at, rank = bits >> half, width - half, at + half, rank - below
    return at


def cut(text: bytes, first: int, second: int) -> tuple[int, int, int, int, int]:
    """Units of a text, the bytes where its prefix and middle end, and their characters; first and second: the numbers drawn."""
    starts, characters = boundaries(text)
    n = starts.bit_count()
    low, high = sorted((first % (n + 1), second % (n + 1)))
    p, m = select(starts, low, len(text)), select(starts, high, len(text))
    chars = lambda end: (characters & ((1 << end) - 1)).bit_count()
    return n, p, m, chars(p), chars(m) - chars(p)


def draws(id_col: Column, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits from the hash of the seed and an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(df: DataFrame, seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """df with n (units), form, prefix_chars, middle_chars (null where plain) and output, the text in its form."""
    base = df.drop("n", "form", "prefix_chars", "middle_chars", "output")
    first, second, third, fourth = draws(F.col(id_col), seed)
    whole = F.coalesce(F.col(text), F.lit(""))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(whole, F.lit(mark))
    plain = (whole == "") | marked | (third % 100 >= rate)
    form = F.when(plain, "plain").when(fourth % 100 < suffix_first, "spm").otherwise("psm")
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    @F.pandas_udf("struct<n: long, prefix_chars: long, middle_chars: long, output: string>")
    def made(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, firsts, seconds, forms in batches:
            rows = []
            for raw, x, y, kind in zip(texts, firsts, seconds, forms, strict=True):
                raw = raw.encode()
                if kind == "plain":
                    rows.append((boundaries(raw)[0].bit_count(), None, None, None))
                    continue
                n, p, m, prefix_chars, middle_chars = cut(raw, x, y)
                parts = (marks[0], raw[:p], marks[1], raw[m:]) if kind == "psm" else (marks[1], raw[m:], marks[0], raw[:p])
                rows.append((n, prefix_chars, middle_chars, b"".join((*parts, marks[2], raw[p:m])).decode()))
            out = pd.DataFrame(rows, columns=["n", "prefix_chars", "middle_chars", "output"])
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64", "output": object})

    found = base.withColumn("form", form).withColumn("_made", made(whole, first, second, F.col("form")))
    got = F.col("_made")
    return found.withColumns({"n": got["n"], "prefix_chars": got["prefix_chars"], "middle_chars": got["middle_chars"], "output": F.when(F.col("form") == "plain", whole).otherwise(got["output"])}).drop("_made")


def restore(output: Column, form: Column) -> Column:
    """The text that was transformed, by the marks of its form."""
    parts = F.split(output, "<[PSM]>")
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = transform(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    again = restore(F.col("output"), F.col("form"))
    return docs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


SQL = """
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), units AS (
    SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u,
        ('0x' || substr(h, 1, 8))::UBIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT AS h2,
        ('0x' || substr(h, 17, 8))::UBIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT AS h4 FROM drawn
), ranks AS (
    SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM units
), parts AS (
    SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM ranks
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""
