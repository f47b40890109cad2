from tracewright.operators import reports as R


def test_only_ok_rows_feed_means(spark):
    rows = [("a", "ok", True, 2.0, 4), ("a", "ok", False, None, 2), ("a", "error", True, 100.0, 100), (" ", None, True, 5.0, 1), (None, "ok", None, 1.0, None)]
    df = spark.createDataFrame(rows, "kind string, status string, correct boolean, reward double, n int")
    got = {r["value"]: r.asDict() for r in R.eval_breakdown(df, ["kind"], ["reward", "n"]).collect()}
    assert got["a"] == {"field": "kind", "value": "a", "num_samples": 3, "num_success": 2, "num_error": 1, "success_rate": 2 / 3, "accuracy": 0.5, "avg_reward": 1.0, "avg_n": 3.0}
    assert got["UNKNOWN"] == {"field": "kind", "value": "UNKNOWN", "num_samples": 2, "num_success": 1, "num_error": 1, "success_rate": 0.5, "accuracy": 0.0, "avg_reward": 1.0, "avg_n": 0.0}
    assert R.eval_breakdown(df.where("false"), ["kind"], ["n"]).count() == 0
    failed = R.eval_breakdown(df.where("status = 'error'"), ["kind"], ["n"]).first()
    assert (failed["success_rate"], failed["accuracy"], failed["avg_n"]) == (0.0, 0.0, 0.0)
