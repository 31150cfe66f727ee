"""Statuses carried on, and registrable domains by a table of suffixes."""

from worldstate.operators import propagation, suffixes


def test_conflicts_are_told_once(spark):
    assessed = spark.createDataFrame(
        [(1, 10, 1, "single_source"), (1, 10, 2, "conflicting"), (2, 10, 3, "conflicting"), (1, 10, 4, "confirmed"), (2, 10, 5, "conflicting"), (3, 11, 1, "conflicting"), (4, 12, 1, "conflicting"), (5, 13, 1, "conflicting"), (6, 14, 1, "conflicting"), (7, 14, 1, "confirmed"), (8, 15, 1, None)],
        "claim_id int, event_id int, at int, status string",
    ).selectExpr("*", "concat(status, '.') as summary")
    reports = spark.createDataFrame(
        [(100, 10, "confirmed", False, ["a", "b", "a"]), (110, 11, "conflicting", False, ["a"]), (120, 12, "unverified", True, ["a"]), (140, 14, None, None, ["c", None]), (150, 15, "confirmed", False, None)],
        "report_id int, event_id int, evidence_status string, is_historical boolean, teams array<string>",
    )
    steps = propagation.refreshed(assessed.repartition(9), reports)
    assert sorted(tuple(r) for r in propagation.notices(steps).collect()) == [(100, 2, 2, "a"), (100, 2, 2, "b"), (100, 5, 5, "a"), (100, 5, 5, "b"), (140, 1, 1, "c")]
    assert {r.event_id: r.status for r in propagation.statuses(steps, "event_id").collect()} == {10: "conflicting", 11: "conflicting", 12: "conflicting", 13: "conflicting", 14: "confirmed", 15: None}
    assert {r.report_id: r.summary for r in propagation.statuses(steps, "report_id").collect()} == {100: "conflicting.", 110: "conflicting.", 120: "conflicting.", 140: "confirmed.", 150: None}
    assert {r.claim_id: r.status for r in propagation.statuses(steps, "claim_id").collect()}[1] == "confirmed"
    assert propagation.refreshed(assessed.limit(0), reports).count() == 0


def test_suffixes(spark, tmp_path):
    (tmp_path / "rules.dat").write_text("// comment\ncom\nin\norg.in  // more\nuk\nco.uk\n\n*.ck\n!www.ck\ngithub.io\nio\n")
    cases = {
        "www.example.com": "example.com",
        "example.com": "example.com",
        "com": "com",
        "www.rbi.org.in": "rbi.org.in",
        "org.in": "org.in",
        "a.b.co.uk": "b.co.uk",
        "alice.github.io": "alice.github.io",
        "x.alice.github.io": "alice.github.io",
        "a.b.c.ck": "b.c.ck",
        "c.ck": "c.ck",
        "ck": "ck",
        "a.www.ck": "www.ck",
        "www.ck": "www.ck",
        "localhost": "localhost",
        "10.0.0.1": "10.0.0.1",
        "WWW.Example.COM.": "example.com",
        "": "",
    }
    df = spark.createDataFrame([(h, i) for i, h in enumerate([*cases, "example.com", None])], "host string, _k int").withColumnRenamed("_k", "k").repartition(30)
    found = suffixes.registrable(df, suffixes.read_rules(spark, str(tmp_path / "rules.dat"))).collect()
    assert len(found) == len(cases) + 2 and [(r.host, r.registrable_domain) for r in found if r.registrable_domain != cases.get(r.host)] == []
