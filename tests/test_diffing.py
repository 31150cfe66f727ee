"""Hunks, noise, rendering and quotes of diffs."""

from pyspark.sql import functions as F

from worldstate.operators import diffing

OLD = ["Pricing", "Start accepting payments at just 2%", "No setup fees.", "UPI | 0%", "Last updated: Sep 28, 2026 10:15 AM", "© 2025 Razorpay"]


def diff(spark, old, new, context=2, patterns=(), most=6000):
    df = spark.createDataFrame([(old, new)], "a array<string>, b array<string>")
    df = df.withColumn("h", diffing.hunks(diffing.keyed(F.col("a")), diffing.keyed(F.col("b")), context)).withColumn("j", diffing.judged(F.col("h"), patterns))
    ratio = diffing.changed_ratio(F.col("h"), F.size("a"), F.size("b"))
    return df.select("h", diffing.kept(F.col("j")).alias("kept"), diffing.notes(F.col("j")).alias("notes"), "j", ratio.alias("ratio"), diffing.rendered(F.col("h"), most).alias("text"), diffing.quote(F.col("h"), F.array_join("b", "\n")).alias("quote")).first()


def changed(i, line):
    return [*OLD[:i], line, *OLD[i + 1 :]]


def test_no_change(spark):
    same = diff(spark, OLD, changed(4, "Last updated: Oct 1, 2026 9:05 PM"))
    assert (same.h, same.kept, same.ratio, same.text, same.quote) == ([], [], 0, "(no changes)", None)
    assert diff(spark, None, None).h == [] and diff(spark, [], []).text == "(no changes)"


def test_context(spark):
    found = diff(spark, OLD, changed(1, "Start accepting payments at just 1.8%"))
    [h] = found.h
    assert (h.kind, h.before, h.after, h.context_before, h.context_after) == ("changed", [OLD[1]], ["Start accepting payments at just 1.8%"], ["Pricing"], OLD[2:4])
    assert found.kept == found.h and found.notes == [] and found.quote == "Start accepting payments at just 1.8%"
    two = diff(spark, ["h", "a1", "same", "b1", "t"], ["h", "a2", "same", "b2", "t"]).h
    assert [(h.context_before, h.context_after) for h in two] == [(["h"], ["same"]), (["same"], ["t"])]
    assert [(h.context_before, h.context_after) for h in diff(spark, ["h", "a1", "t"], ["h", "a2", "t"], 0).h] == [([], [])]


def test_kinds_and_ratio(spark):
    found = diff(spark, ["A", "B", "C"], ["A", "C", "D", "E"])
    assert [h.kind for h in found.h] == ["removed", "added"] and found.ratio == 3 / 7
    assert diff(spark, list("abcd"), list("wxyz")).ratio == 1
    assert diff(spark, ["xx", "long line"], ["long line"]).quote == "long line"  # nothing new: what stands around it


NOISE = [
    (["© 2025 R", "rest"], ["© 2026 R rest"], ["volatile"]),
    (["Start at 2%", "per transaction"], ["Start at 2% per transaction"], ["formatting"]),
    (["Plans: Standard"], ["PLANS — standard"], ["formatting"]),
    ([""], ["   "], []),
    ([], ["  "], ["whitespace"]),
    (["Fee 2.5%"], ["Fee 25%"], [None]),
    (["Fee 0%*"], ["Fee 0%"], [None]),
    (["-5% discount"], ["5% discount"], [None]),
    (["Customer story: Acme"], ["Customer story: Globex", " "], ["rule"]),
    (["Customer story: Acme", "Fee 2%"], ["Customer story: Globex", "Fee 3%"], [None]),
]


def test_noise(spark):
    df = spark.createDataFrame([(i, ["x", *a, "y"], ["x", *b, "y"]) for i, (a, b, _) in enumerate(NOISE)], "i int, a array<string>, b array<string>").repartition(20)
    df = df.withColumn("h", diffing.hunks(diffing.keyed(F.col("a")), diffing.keyed(F.col("b")))).withColumn("j", diffing.judged(F.col("h"), ["[invalid(", "^customer story"]))
    for r in df.select("i", "j", diffing.kept(F.col("j")).alias("kept"), diffing.notes(F.col("j")).alias("notes")).collect():
        assert [x.reason for x in r.j] == NOISE[r.i][2], NOISE[r.i]
        assert len(r.kept) == sum(x.reason is None for x in r.j) and len(r.notes) == len(r.j) - len(r.kept)


def test_notes(spark):
    found = diff(spark, ["x", "Customer story: it's Acme"], ["x"], patterns=["[invalid(", "^customer story"])
    assert found.notes == ["""matched suppression rule '^customer story': - "Customer story: it's Acme\""""] and found.j[0].rule == "^customer story"
    assert diff(spark, ["Plans: A"], ["Plans - A"]).notes == ["formatting-only change (whitespace/punctuation/case): 'Plans: A' -> 'Plans - A'"]
    column = spark.createDataFrame([(["x"], ["y"], None), (["x"], ["y"], ["^[XY]$", None])], "a array<string>, b array<string>, p array<string>")
    found = column.withColumn("h", diffing.hunks(diffing.keyed(F.col("a")), diffing.keyed(F.col("b")))).select(diffing.judged(F.col("h"), F.col("p")).alias("j"))
    assert [r.j[0].reason for r in found.collect()] == [None, "rule"]


def test_rendering(spark):
    assert diff(spark, OLD, changed(1, "Start accepting payments at just 1.8%"), 1).text == "@@ 1 changed\n  Pricing\n- Start accepting payments at just 2%\n+ Start accepting payments at just 1.8%\n  No setup fees."
    old = [f"line {i} old value" for i in range(60)]
    new = [f"line {i} new value" if i % 4 == 0 else x for i, x in enumerate(old)]
    found = diff(spark, old, new, most=300)
    assert len(found.text) <= 300 and found.text.startswith("@@ 1 changed") and found.text.endswith("more hunks omitted")
    assert found.text.count("@@") + int(found.text.split("… ")[-1].split(" ")[0]) == len(found.h) == 15
    long = diff(spark, ["x"], [f"added line number {i}" for i in range(200)], most=200).text
    assert len(long) <= 200 and long.split("\n")[:3] == ["@@ 1 changed", "- x", "+ added line number 0"] and long.endswith("\n  … (hunk truncated)")
    assert diff(spark, ["x"], ["y"], most=20).text == "@@ 1 changed\n- x\n+ y"


def test_versions_are_aligned_once_by_keys_alone(spark, tmp_path):
    """Alignment in Python stands once in a plan, although hunks are exploded, and Python gets keys and no lines."""
    rows = [(i, ["same", f"Updated on 2025-01-{i:02} x", "y", "z"], None if i == 3 else ["same", "Updated on 2026-02-01 x", f"new {i}", "z"]) for i in range(1, 9)]
    spark.createDataFrame(rows, "i int, a array<string>, b array<string>").repartition(1).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    found = df.select("i", F.explode(diffing.hunks(diffing.keyed(F.col("a")), diffing.keyed(F.col("b")))).alias("h"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "AS line" not in plan
    for r in found.collect():
        expected = ("removed", rows[2][1], [], [], []) if r.i == 3 else ("changed", ["y"], [f"new {r.i}"], ["same", "Updated on 2026-02-01 x"], ["z"])
        assert tuple(r.h) == expected
