from tessera.operators import context


def test_rows_of_odd_tasks(spark):
    rows = [(1, "do", '{"status":"pending","scope":"user","priority":"high","due":"2024-02-01"}'), (2, "do", '{"status":7,"due":""}'), (3, None, None), (4, "a)b", "no json"), (None, "x", "{}")]
    got = {r["id"]: r["text"] for r in context.task_rows(spark.createDataFrame(rows, "id long, content string, metadata string")).collect()}
    assert got == {1: "[id=1] [pending] do (scope=user, priority=high, due=2024-02-01)\n", 2: "[id=2] [] do (scope=, priority=)\n", 3: "[id=3] []  (scope=, priority=)\n", 4: "[id=4] [] a)b (scope=, priority=)\n", None: None}
