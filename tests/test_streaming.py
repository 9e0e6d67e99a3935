import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from grove.functions.counters import CAP32, CAP64
from grove.operators.refgroups import Groups
from grove.operators.treefold import SIZES, fold_trees
from grove.streaming.totals import arriving, current, kept_current, object_totals, reference_totals, versions
from grove.streaming.treefold import arrivals, combined, fold_arrived, part_of


def test_totals_grow_with_files(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "type string, size long"

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        stream = arriving(spark, source, spark.createDataFrame([], schema).schema)
        kept_current(object_totals(stream), target, state).awaitTermination()
        return {r["type"]: (r["n"], int(r["total"]), r["largest"]) for r in current(spark, target).collect()}

    assert arrive(("blob", 3), ("blob", 4), ("tree", 1)) == {"blob": (2, 7, 4), "tree": (1, 1, 1)}
    assert arrive(("blob", 10)) == {"blob": (3, 17, 10), "tree": (1, 1, 1)}
    assert arrive(("tree", 5)) == {"blob": (3, 17, 10), "tree": (2, 6, 5)} and versions(spark, target) == [1, 2]


def test_failed_batches_leave_the_totals(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    with pytest.raises(FileNotFoundError):
        current(spark, target)
    spark.createDataFrame([("blob", 3)], "type string, size long").write.parquet(source)
    stream = arriving(spark, source, StructType.fromDDL("type string, size long"))
    checked = stream.withColumn("size", F.when(F.col("size") < 0, F.raise_error(F.lit("negative"))).otherwise(F.col("size")))
    kept_current(object_totals(checked), target, state).awaitTermination()
    before = current(spark, target).collect()
    spark.createDataFrame([("blob", -3)], "type string, size long").write.mode("append").parquet(source)
    with pytest.raises(StreamingQueryException, match="negative"):
        kept_current(object_totals(checked), target, state).awaitTermination()
    assert current(spark, target).collect() == before and versions(spark, target) == [0]


def test_reference_totals(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("refs/heads/a",), ("refs/tags/b",), ("refs/x",)], "refname string").write.parquet(source)
    stream = arriving(spark, source, spark.read.parquet(source).schema)
    kept_current(reference_totals(stream, Groups().finish()), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {r["symbol"]: r["n"] for r in current(spark, str(tmp_path / "out")).collect()} == {"": 3, "branches": 1, "tags": 1, "other": 1}


def test_trees_in_any_order(spark, tmp_path):
    """Trees, entries and blobs that arrive in shuffled files settle as the batch fold says, whatever the order."""
    draw = random.Random(3)
    blobs = {i: draw.randrange(90) for i in range(100, 108)}
    entries = []
    for t in range(25):
        for _ in range(draw.randint(0, 5)):
            kind = draw.choice(["tree", "tree", "blob", "link", "submodule"] if t else ["blob"])
            entries.append((t, draw.randint(1, 9), draw.randrange(-(-t // 3)) if kind == "tree" else draw.choice(list(blobs)), kind))
    schema = "tree long, name_length long, child long, kind string"
    frames = (spark.createDataFrame([(t, t) for t in range(25)], "oid long, ord long"), spark.createDataFrame(entries, schema), spark.createDataFrame(list(blobs.items()), "oid long, size long"))
    wanted = {(r["oid"], *(int(r[c]) for c in SIZES), r["entries"]) for r in fold_trees(*frames).collect()}
    rows = {"trees": [(t, sum(e[0] == t for e in entries)) for t in range(25)], "entries": entries, "blobs": list(blobs.items())}
    schemas = {"trees": "oid long, entries long", "entries": schema, "blobs": "oid long, size long"}
    for seed in range(5):
        own, mix = tmp_path / str(seed), random.Random(seed)
        waves = [(name, k) for name in rows for k in range(2)]
        mix.shuffle(waves)
        for name in rows:
            mix.shuffle(rows[name])
            (own / name).mkdir(parents=True)
        streams = [arriving(spark, str(own / name), StructType.fromDDL(schemas[name])) for name in ("trees", "entries", "blobs")]
        for half in (waves[:3], waves[3:]) if seed == 0 else (waves,):
            for name, k in half:
                spark.createDataFrame(rows[name][k::2], schemas[name]).coalesce(1).write.mode("append").parquet(str(own / name))
            found = fold_arrived(spark, arrivals(*streams), str(own / "out"), str(own / "checkpoint"))
            got = {(int(r["oid"]), *(int(r[c]) for c in SIZES), r["entries"]) for r in found.collect()}
            assert got <= wanted and found.count() == len(got)
        assert got == wanted


def test_sizes_stop_at_their_caps():
    far = (1, 2, CAP32 - 1, 5, CAP64 - 1, 0, 0)
    assert combined(far, far) == (1, 2, CAP32, 10, CAP64, 0, 0)
    assert part_of(far, True, 3) == (2, 6, *far[2:]) and part_of((1, 0, 1, 0, 0, 0, 0), True, 3)[1] == 3 and part_of((0, 0, 0, 1, 9, 0, 0), False, 4) == (1, 4, 0, 1, 9, 0, 0)
