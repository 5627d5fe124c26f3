from __future__ import annotations

import math

from flowbalance.operators.watch import Limit, batch_reports, invariant_limits, judged, watched, watched_stream


def reported(spark, rows, limits):
    df, watch = watched(spark.createDataFrame(rows, "site int, volume double"), limits)
    assert len(df.collect()) == len(rows)
    return {r.metric: (r.value, r.ok) for r in watch.report(spark).collect()}


def test_limits_are_judged_in_the_pass_that_makes_the_rows(spark):
    sound = reported(spark, [(1, 0.0), (2, 5.0)], invariant_limits("volume", high=9.0))
    assert sound == {"n_rows": (2, True), "n_nan": (0, True), "n_missing": (0, True), "least": (0, True), "most": (5, True)}
    bad = reported(spark, [(1, -1.0), (2, math.nan), (3, None), (3, 50.0)], invariant_limits("volume", high=9.0))
    assert bad == {"n_rows": (4, True), "n_nan": (1, False), "n_missing": (1, False), "least": (-1, False), "most": (50, False)}


def test_no_rows(spark):
    empty = reported(spark, [], invariant_limits("volume"))
    assert empty["n_rows"] == (0, False) and empty["least"] == (None, True) and empty["most"] == (None, True)


def test_nan_breaks_every_bound():
    limits = {"a": Limit("x", 0.0), "b": Limit("x", high=1.0), "c": Limit("x")}
    assert [ok for *_, ok in judged(dict.fromkeys("abc", math.nan), limits)] == [False, False, True]


def test_one_scan(spark, tmp_path):
    spark.range(1000).selectExpr("CAST(id AS INT) AS site", "id * 1D AS volume").write.parquet(str(tmp_path / "in"))
    df, watch = watched(spark.read.parquet(str(tmp_path / "in")).where("site % 2 = 0"), invariant_limits("volume"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "CollectMetrics" in plan
    df.write.parquet(str(tmp_path / "out"))
    assert {r.metric: r.value for r in watch.report(spark).collect()}["n_rows"] == 500


def test_stream_batches_carry_their_metrics(spark, tmp_path):
    folder, limits = str(tmp_path / "in"), invariant_limits("volume")
    schema = "site int, volume double"
    for k, rows in enumerate(([(1, 2.0)], [(1, -3.0), (2, 1.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        feed = watched_stream(spark.readStream.schema(schema).parquet(folder), limits)
        query = (feed.writeStream.format("parquet").option("path", str(tmp_path / "out"))
                 .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
        query.awaitTermination()
        found = {(b, m): ok for b, m, _, _, _, ok in batch_reports(query, limits)}
        assert found[(k, "least")] is (k == 0) and found[(k, "n_rows")] is True
    assert spark.read.schema(schema).parquet(str(tmp_path / "out")).count() == 3
