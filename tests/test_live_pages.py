"""Live pages: cases of the step, and the stream over shuffled micro-batches against the table."""

import random

from pyspark.sql import functions as F

from worldstate.functions import scheduling
from worldstate.streaming import in_order, live_pages

HOUR = 3_600_000_000
SCHEMA = ", ".join(f"{c} {t}" for c, t in live_pages.CHECK.items())


def check(k, source="s", status=200, error=None, blocked=False, quality="ok", words=100, content="a", noise=False, base=60):
    return (source, k, k * HOUR, status, error, blocked, quality, words, content, noise, base)


# what is checked, its outcome, the snapshot that it was held against, failures and interval
STORY = [
    (check(1, error="timeout"), "error", None, 1, 120),
    (check(2, quality="blocked", words=None), "blocked", None, 2, 240),
    (check(3, status=304), "not_modified", None, 0, 240),
    (check(4), "baseline", None, 0, 60),
    (check(5), "unchanged", 4, 0, 90),
    (check(6, status=304, words=None), "not_modified", 4, 0, 135),
    (check(7, words=20, content="b"), "degenerate", 4, 1, 120),
    (check(8, words=90, content="c"), "changed", 4, 0, 60),
    (check(9, words=30, content="d"), "degenerate", 8, 1, 120),
    (check(10, words=28, content="e"), "changed", 8, 0, 60),
    (check(11, words=29, content="f", noise=True), "unchanged", 10, 0, 90),
    (check(12, words=29, content="f"), "unchanged", 11, 0, 135),
    (check(13, blocked=True, error="robots"), "blocked", 11, 1, 120),
    (check(14, quality="degenerate"), "degenerate", 11, 2, 240),
    (check(15, content="g", words=29), "changed", 11, 0, 60),
]


def test_story(spark):
    df = spark.createDataFrame([c for c, *_ in reversed(STORY)], SCHEMA).withColumn("extra", F.lit(1)).repartition(5)
    got = [(r.id, r.outcome, r.before_id, r.failures, r.interval, r.next_at) for r in live_pages.outcomes(df).orderBy("at").collect()]
    assert got == [(c[1], o, b, f, i, c[2] + i * live_pages.MINUTE) for c, o, b, f, i in STORY]
    assert live_pages.outcomes(df.limit(0)).count() == 0


def test_intervals_are_those_of_the_expression(spark):
    rows = [(base, current, outcome, failures) for base in (0, 5, 60, 5000) for current in (0, 60, 200, 9000) for outcome in ("changed", "baseline", "unchanged", "not_modified", "error") for failures in (0, 1, 3, 9)]
    df = spark.createDataFrame(rows, "base long, current long, outcome string, failures long")
    found = df.withColumn("n", scheduling.next_interval(F.col("base"), F.col("current"), F.col("outcome"), F.col("failures"), F.lit(True)))
    assert all(r.n == live_pages.interval(r.base, r.current, r.outcome, r.failures) for r in found.collect())


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    rng = random.Random(5)
    rows = [check(k * 40 + s + 1, f"s{s}", rng.choice([200, 200, 200, 304]), rng.choice([None] * 5 + ["timeout"]), rng.random() < 0.05, rng.choice(["ok"] * 6 + ["degenerate", "blocked"]), rng.choice([20, 30, 90, 100, None]), rng.choice("abc"), rng.random() < 0.3) for k in range(30) for s in range(4)]
    rows += [check(rows[7][1], rows[7][0], content="z"), (None, *check(33)[1:])]
    table = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(str, live_pages.outcomes(table).collect()))
    # neighbours in time change places, over many files; the last one moves the watermark behind all others
    order = sorted(range(len(rows)), key=lambda k: rows[k][1] + rng.uniform(0, 60))
    for n, at in enumerate(range(0, len(order), 15)):
        spark.createDataFrame([rows[k] for k in order[at : at + 15]], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n:02}")
    spark.createDataFrame([check(10**6, "end")], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/99")
    before = {k: spark.conf.get(k, None) for k in in_order.STATE_STORE}
    for k, v in in_order.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = live_pages.outcomes_stream(stream, "200 hours").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None and not query.isActive
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect())) == want
