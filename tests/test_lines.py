import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from grove.operators.refgroups import shown
from grove.plans.scan import scan_repository
from grove.sources.lines import LinesSink, newest_parts, read_lines, report_lines


@pytest.fixture(scope="module", autouse=True)
def sink(spark):
    spark.dataSource.register(LinesSink)


def save(df, path, mode="overwrite"):
    df.write.format("lines").mode(mode).save(path)


def test_reports_written_whole(spark, git_repo, tmp_path):
    oid = git_repo.put("blob", b"x\n")
    git_repo.ref("refs/heads/main", git_repo.commit(git_repo.tree(("100644", "é<&>", oid))))
    report, _ = scan_repository(spark, git_repo.path)
    for i, text in enumerate((report.table(0), report.json_fields(), report.json_metrics())):
        path = str(tmp_path / f"report{i}")
        save(report_lines(spark, text), path)
        assert "\n".join(read_lines(path)) == text.rstrip("\n")
    assert json.loads("\n".join(read_lines(path)))["uniqueBlobCount"]["value"] == 1


def test_listings_in_order(spark, git_repo, tmp_path):
    oid = git_repo.commit(git_repo.tree())
    git_repo.git("update-ref", "--stdin", data="".join(f"create refs/heads/b{i:04d} {oid}\n" for i in range(500)).encode())
    _, refs = scan_repository(spark, git_repo.path, [("exclude-regexp", "refs/heads/b01.*")])
    path = str(tmp_path / "listing")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        save(shown(refs.orderBy("ord")), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(newest_parts(path)[1]) > 1
    assert list(read_lines(path)) == [f"{'  ' if 100 <= i < 200 else '+ '}refs/heads/b{i:04d}" for i in range(500)]


def test_failed_writes_leave_the_report(spark, tmp_path):
    path = str(tmp_path / "report")
    with pytest.raises(FileNotFoundError):
        list(read_lines(path))
    rows = spark.range(0, 100, 1, 4).select(F.col("id").cast("string").alias("line"), "id")
    save(rows, path)
    before, parts = list(read_lines(path)), newest_parts(path)[1]
    assert before == [str(i) for i in range(100)]
    late = rows.withColumn("line", F.when(F.col("id") == 99, F.raise_error(F.lit("late"))).otherwise("new"))
    broken = rows.withColumn("line", F.when(F.col("id") == 60, F.lit(None)).otherwise(F.col("line")))
    split = rows.withColumn("line", F.when(F.col("id") == 60, F.lit("a\nb")).otherwise(F.col("line")))
    for bad in (late, broken, split):
        with pytest.raises(PySparkException):
            save(bad, path)
        assert list(read_lines(path)) == before and newest_parts(path)[1] == parts
    for text in "ab":
        save(report_lines(spark, text), path)
    assert list(read_lines(path)) == ["b"] and len(os.listdir(path)) == 2


def test_versions_and_modes(spark, tmp_path):
    path = str(tmp_path / "report")
    for i in range(4):
        save(report_lines(spark, f"report {i}\n\nend"), path)
        assert list(read_lines(path)) == [f"report {i}", "", "end"]
    assert len(os.listdir(path)) == 2
    os.makedirs(f"{path}/0000000009-unfinished")
    assert list(read_lines(path)) == ["report 3", "", "end"]
    with pytest.raises(PySparkException):
        save(report_lines(spark, "more"), path, "append")
    save(spark.createDataFrame([], "line string"), path)
    assert list(read_lines(path)) == []
    with pytest.raises(PySparkException):
        save(spark.range(1), path)
