"""Clusters of items: cases, brute force, and a stream against the table."""

import random

from pyspark.sql import functions as F

from worldstate.functions import fuzzy
from worldstate.operators import clusters
from worldstate.streaming import in_order

DAY = 86_400_000_000
SCHEMA = ", ".join(f"{c} {t}" for c, t in clusters.ITEM.items())


def test_similar_titles():
    assert clusters.similar("Razorpay partners with Mastercard for tokenisation", "Mastercard and Razorpay partner on tokenisation")
    assert not clusters.similar("Razorpay raises funding", "Stripe launches new checkout")
    assert not clusters.similar(None, "x") and not clusters.similar("", "")


def items_at_random(seed, n=300):
    rng = random.Random(seed)
    words = "raises cuts fee round partner bank launch app".split()
    rows = []
    for k in range(n):
        entity, kind = rng.choice("ab"), rng.choice(["funding", "pricing"])
        key = rng.choice([None, f"{kind}:{entity}:{rng.randrange(6)}"])
        title = rng.choice([None, " ".join(rng.choice(words) for _ in range(4))])
        rows.append(("t", kind, entity, k, (rng.randrange(400) + 1) * DAY, key, title))
    return rows


def by_hand(rows):
    events, out = [], []
    for row in sorted(rows, key=lambda r: (r[4], r[3])):
        _, kind, entity, own, at, key, title = row
        near = [e for e in events if e[1:3] == (kind, entity) and e[4] >= at - 42 * DAY]
        hit = next((e for e in near if key is not None and e[5] == key), None)
        leg = "key"
        if hit is None:
            leg = "title"
            hit = next((e for e in reversed(near[-40:]) if None not in (e[6], title) and fuzzy.token_set(e[6], title) >= 82), None)
        if hit is None:
            leg, hit = "new", row
            events.append(row)
        out.append((own, hit[3], leg))
    return sorted(out)


def test_against_brute_force(spark):
    rows = items_at_random(1)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1)).repartition(20)
    got = clusters.clustered(df).collect()
    assert sorted((r.id, r.event_id, r.leg) for r in got) == by_hand(rows) and {r.leg for r in got} == {"key", "title", "new"}
    assert {r.id for r in got if r.nth == 1} == {r.event_id for r in got}
    assert clusters.clustered(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None, None, 1, None, None, None), (None, None, None, 2, None, None, None)], SCHEMA)
    assert sorted((r.id, r.event_id) for r in clusters.clustered(odd).collect()) == [(1, 1), (2, 2)]


def test_corroboration(spark):
    wire = "Razorpay on Monday announced a reduction in its standard transaction fee to 1.8 per cent for all merchants."
    said = [(1, "k", "a.com", wire), (2, "k", "b.com", wire), (3, "k", "c.com", "Merchants pay 1.8 per cent from now on, the company told us."), (4, "j", "a.com", wire)]
    rows = [("t", "pricing", "r", k, k * DAY, key, f"t{k}", "independent", "supports", p, q, True) for k, key, p, q in said]
    df = spark.createDataFrame(rows, SCHEMA + ", source_class string, stance string, publisher string, quote string, verified boolean")
    got = {r.event_id: (r.n_items, r.status, r.publishers) for r in clusters.corroborated(df).collect()}
    assert got == {1: (3, "corroborated", "a.com / b.com, c.com"), 4: (1, "single_source", "a.com")}


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    rows = items_at_random(2, 120)
    table = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(str, clusters.clustered(table).collect()))
    rng = random.Random(3)
    order = sorted(range(len(rows)), key=lambda k: rows[k][4] / DAY + rng.uniform(0, 20))
    for n, at in enumerate(range(0, len(order), 30)):
        spark.createDataFrame([rows[k] for k in order[at : at + 30]], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n:02}")
    spark.createDataFrame([("t", "x", "end", 999, 9999 * DAY, None, None)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/99")
    before = {k: spark.conf.get(k, None) for k in in_order.STATE_STORE}
    for k, v in in_order.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        clusters.clustered_stream(stream, "30 days").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination(300)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect())) == want
