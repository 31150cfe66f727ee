"""The full-text query on documents that several rows share, dealt to many tasks, against its SQL."""

import re
import shutil

import duckdb

from worldstate.plans import fetched, registry

SF = "/root/testdata/sf0.001"


def test_pairs_stay_where_a_document_lies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fetched, "PER_TASK", 20)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.unionByName(docs.withColumn("doc_id", docs["doc_id"] % 7)).write.parquet(f"{tmp_path}/documents.parquet")
    shutil.copy(f"{SF}/benchmark.parquet", tmp_path)
    found = fetched.k16_full_text(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet'")
    want = con.execute(registry.oracle_sql()["k16_full_text"]).fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want) and want
    # pairs of a question and a document, of which there are more than words, are not dealt out again
    assert not re.search(r"hashpartitioning\(item_id#\d+L?, doc_id", found._jdf.queryExecution().executedPlan().toString())
