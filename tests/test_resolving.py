"""Entities resolved by name, against a plain loop; JSON in noisy texts."""

import json
import random

from pyspark.sql import functions as F

from worldstate.functions import noisy_json
from worldstate.functions.quotes import normal
from worldstate.operators import resolving


def plainly(name, tenant, entities):
    """The first entity of a tenant by name or alias, else by a name that holds the other."""
    mine = sorted(((p, i, n, a) for t, i, n, a, p in entities if t == tenant and t is not None), key=lambda e: e[:2])
    if not name:
        return None, None
    key = normal(name)
    for _, i, n, a in mine:
        if key in [normal(x) for x in (n, *(a or [])) if x is not None]:
            return i, "exact"
    for _, i, n, a in mine:
        if n and normal(n) and (normal(n) in key or key in normal(n)):
            return i, "part"
    return None, None


def test_resolve(spark):
    rng = random.Random(3)
    words = ["Acme", "bank", "of", "the", "Reserve", "Pay", "Ünion", "ﬁnance", "a"]
    some = lambda: " ".join(rng.choices(words, k=rng.randint(1, 6)))
    entities = [(rng.choice(["t", "u"]), i, some(), [some() for _ in range(rng.randint(0, 2))], rng.randint(0, 9)) for i in range(60)]
    entities += [("t", 90, None, ["Nameless", None], 0), ("t", 91, "", None, 0), ("v", 92, " ", None, 1), (None, 93, "acme", None, 0)]
    asked = [(rng.choice(["t", "u", "v", None]), rng.choice([some(), some().upper(), some()[2:], "The  " + some(), "x"])) for _ in range(300)]
    asked += [("t", x) for x in ("nameless", "", None, "  ", "a", "acme")] + [("v", " "), ("v", "x"), (None, "acme")]
    found = resolving.resolve(
        spark.createDataFrame([(i, *x) for i, x in enumerate(asked)], "row int, tenant string, name string").repartition(13),
        spark.createDataFrame(entities, "tenant string, id int, name string, aliases array<string>, place int"),
        within=("tenant",),
    ).collect()
    assert len(found) == len(asked)
    wrong = [(r, plainly(r.name, r.tenant, entities)) for r in found if (r.entity_id, r.leg) != plainly(r.name, r.tenant, entities)]
    assert wrong == [] and {"exact", "part", None} == {r.leg for r in found}


def test_resolve_nothing(spark):
    asked = spark.createDataFrame([("acme",)], "name string")
    nobody = spark.createDataFrame([], "id int, name string, aliases array<string>, place int")
    assert [tuple(r) for r in resolving.resolve(asked, nobody).collect()] == [("acme", None, None)]
    assert resolving.resolve(asked.limit(0), nobody).count() == 0


def test_objects_in_noise(spark):
    good, nested = {"material": True, "score": 2}, {"quote": "use {curly} braces", "nested": {"a": [1, {"b": 2}]}}
    cases = [(x, good) for x in ('{"material": true, "score": 2}', '```json\n{"material": true, "score": 2}\n```', '```\n{"material": true, "score": 2}\n```', 'Sure:\n{"material": true, "score": 2}\nMore?', 'Result: {"material": true, "score": 2} {"second": 1}', '{x} then ```json\n[1]\n``` and {"material": true, "score": 2}')]
    cases += [(f"Answer: {json.dumps(nested)} trailing", nested), ('{"a": ' * 3000, None), ("{" * 500 + '{"é": "\\u00e9"}', {"é": "é"})]
    cases += [(x, None) for x in ("", "no json here", "[1, 2, 3]", '[{"a": 1}]', '{"unterminated": ', "{not json}", None)]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, s string").repartition(30)
    got = {r.i: r.o for r in df.select("i", noisy_json.object_text(F.col("s")).alias("o")).collect()}
    assert {i: None if o is None else json.loads(o) for i, o in got.items()} == {i: want for i, (_, want) in enumerate(cases)}


def test_names_with_a_common_beginning_meet_whole(spark, monkeypatch):
    # pairs that meet on a stretch that all names begin with would be compared one by one
    entities = spark.range(400).select("id", F.format_string("Supplier#%09d", "id").alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit(0).alias("place"))
    asked = spark.range(400).select(F.col("id").alias("row"), F.format_string("The supplier#%09d Ltd", "id").alias("name"))
    monkeypatch.setattr(resolving.F, "contains", lambda a, b: F.raise_error(F.concat(F.lit("compared: "), a, F.lit(", "), b)).cast("boolean"))
    found = resolving.resolve(asked, entities)
    assert found.where("entity_id = row and leg = 'part'").count() == 400


def test_names_longer_than_a_stretch(spark):
    long = "x" * 70
    entities = [(1, long + "one", [], 0), (2, long + "two and more", None, 1), (3, "y" * 64, None, 2)]
    asked = ["so " + long + "one ltd", long + "two", "y" * 65, "x" * 64, long + "three"]
    found = resolving.resolve(spark.createDataFrame([(x,) for x in asked], "name string"), spark.createDataFrame(entities, "id int, name string, aliases array<string>, place int")).collect()
    rows = [("t", *e) for e in entities]
    assert {(r.name, r.entity_id, r.leg) for r in found} == {(x, *plainly(x, "t", rows)) for x in asked}
