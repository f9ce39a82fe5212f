"""Micro-batches of streaming queries and executors' metrics as tables."""

from driftline.streaming import progress as P


def test_batches_are_recorded_over_two_runs(spark, tmp_path):
    source = str(tmp_path / "source")
    sizes = [5, 9, 2]

    def go(name):
        q = spark.readStream.schema("x long").option("maxFilesPerTrigger", 1).parquet(source).groupBy("x").count()
        return q.writeStream.queryName(name).outputMode("update").format("noop").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()

    with P.Recorder(spark, f"file://{tmp_path}/progress") as seen:
        assert seen.table().count() == 0
        for n in sizes[:2]:
            spark.range(n).selectExpr("id AS x").coalesce(1).write.mode("append").parquet(source)
        one = go("counts")
        one.awaitTermination()
        spark.range(sizes[2]).selectExpr("id AS x").coalesce(1).write.mode("append").parquet(source)
        two = go("counts")
        two.awaitTermination()
        assert seen.ended(one) and seen.ended(two)
        rows = seen.table().where("query = 'counts' AND input_rows > 0").cache()
    assert sorted(r["input_rows"] for r in rows.collect()) == sorted(sizes)
    assert rows.select("run").distinct().count() == 2 and rows.where("state_rows = 9").count() >= 1
    total = P.totals(rows, 0.0).first()
    assert (total["batches"], total["rows"], total["max_pending"], total["backpressure_count"]) == (3, 16, 9, 3)
    assert total["maintenance_ms_total"] == sum(r["batch_ms"] for r in rows.collect()) > 0
    assert total["backpressure_ms_total"] == sum(r["trigger_ms"] for r in rows.collect())
    assert P.totals(rows, 1e9).first()["backpressure_ms_total"] == 0.0
    steps = P.running(rows, 0.0).orderBy("batch").collect()
    assert [r["max_pending"] for r in steps] == [5, 9, 2]
    assert [r["backpressure_count"] for r in steps] == [1, 2, 1]


def test_executors_report(spark):
    spark.range(10).count()
    rows = P.executors(spark).collect()
    assert rows and sum(r["tasks"] for r in rows) > 0
    assert all(r["heap_bytes"] is None or r["heap_bytes"] >= 0 for r in rows)
