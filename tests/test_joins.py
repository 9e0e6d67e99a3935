from grove.operators.joins import join_one


def test_join_with_frequent_keys(spark):
    rows = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(3000)] + [(1, None)], "id long, k long")
    table = spark.createDataFrame([(1, 2000, "hot"), (9, 1, "cold")], "k long, n long, name string")
    found = join_one(rows, table, ["k"], "n", 3000, ["id"])
    assert found.columns == ["id", "k", "name"] and found.count() == 3001
    assert {r["name"]: r["count"] for r in found.groupBy("name").count().collect()} == {"hot": 2000, "cold": 1, None: 1000}
