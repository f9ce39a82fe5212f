"""License notices, each planted in prose."""

import __spark_entry__ as E
from driftline.llm.licenses import MORE, TEMPLATES

#: Notices that another one's text holds.
WITHIN = {"apache-2.0-header": {"apache-2.0"}}


def test_every_notice_is_found(spark, tmp_path):
    every = TEMPLATES | MORE
    prose = " ".join(f"w{i}" for i in range(60))
    rows = [(n, f"{prose}\n{t}\n{prose}") for n, t in every.items()] + [("none", prose), ("null", None)]
    spark.createDataFrame(rows, "doc_id string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in E.queries()["op10_license_scan_all"](spark, str(tmp_path)).collect()}
    assert got == {n: {n} | WITHIN.get(n, set()) for n in every} | {"none": set(), "null": set()}


def test_planted_line_of_the_data(spark):
    sf = "/root/testdata/sf0.001"
    planted = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").where("text like '%Licensed under CC BY-NC 4.0.%'").collect()}
    found = {r.doc_id for r in E.queries()["op10_license_scan_all"](spark, sf).where("licenses like '%cc-by-nc-4.0-short%'").collect()}
    assert planted and found == planted
