import numpy as np
import pytest
from pyspark.sql import functions as F

from vecpress.sources import datasets, fvecs, vectorfile


def rows_of(df):
    return [(r["vec_id"], r["embedding"]) for r in df.orderBy("vec_id").collect()]


@pytest.fixture
def rows():
    return np.random.default_rng(0).standard_normal((1000, 7)).astype(np.float32)


def test_a_file_is_read_by_many_tasks(spark, tmp_path, rows, monkeypatch):
    (tmp_path / "a.fvecs").write_bytes(fvecs.dump(rows))
    reader = vectorfile.VectorReader(str(tmp_path / "a.fvecs"), "f", True)
    assert len(reader.partitions()) == 1
    monkeypatch.setattr(vectorfile, "RANGE_BYTES", 3000)
    monkeypatch.setattr(vectorfile, "CHUNK_BYTES", 500)
    ranges = reader.partitions()
    assert len(ranges) > 10 and sum(r.rows for r in ranges) == 1000
    got = [b for r in ranges for b in reader.read(r)]
    assert np.array_equal(np.concatenate([np.array(b.column(1).to_pylist(), np.float32) for b in got]), rows)
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(1000))


def test_a_folder_there_and_back(spark, tmp_path, rows):
    x = datasets.from_matrix(spark, rows).withColumn("vec_id", F.col("vec_id") * 3).withColumnRenamed("v", "embedding").repartition(6)
    path = str(tmp_path / "out")
    vectorfile.write(x, path, parts=4)
    assert len(list((tmp_path / "out").glob("part-*.fvecs"))) > 1 and not list((tmp_path / "out").glob("_*"))
    got = rows_of(vectorfile.read(spark, path))
    assert [i for i, _ in got] == list(range(1000)) and np.array_equal(np.array([v for _, v in got], np.float32), rows)
    assert vectorfile.read(spark, path).rdd.getNumPartitions() > 1
    vectorfile.write(x.limit(5), path)  # overwrites
    assert vectorfile.read(spark, path).count() == 5
    vectorfile.write(x.limit(4), path, mode="append")
    assert vectorfile.read(spark, path).count() == 9


def test_one_file_of_many_parts(spark, tmp_path, rows):
    x = datasets.from_matrix(spark, rows).withColumnRenamed("v", "embedding").repartition(5)
    fvecs.write(x, f"file://{tmp_path}/one.fvecs")
    assert (tmp_path / "one.fvecs").read_bytes() == fvecs.dump(rows) and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["one.fvecs"]
    vectorfile.write(x, str(tmp_path / "parts"), parts=4)
    vectorfile.join_files(spark, str(tmp_path / "parts"), str(tmp_path / "joined.fvecs"))
    assert len(list((tmp_path / "parts").iterdir())) == 4 and (tmp_path / "joined.fvecs").read_bytes() == fvecs.dump(rows)
    ints = np.arange(60).reshape(20, 3)
    fvecs.write(datasets.from_matrix(spark, ints).withColumnRenamed("v", "embedding"), str(tmp_path / "one.ivecs"), kind="i")
    assert (tmp_path / "one.ivecs").read_bytes() == fvecs.dump(ints, "<i4")


def test_bad_files_and_vectors(spark, tmp_path, rows):
    good = fvecs.dump(rows)
    cases = {"short": good[:-3], "zero": b"\0\0\0\0" + good[4:], "other": good[:32] + b"\5\0\0\0" + good[36:]}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="record"):
            vectorfile.read(spark, str(tmp_path / name)).collect()
    assert vectorfile.read(spark, str(tmp_path / "other"), strict=False).count() == 1000
    (tmp_path / "empty").write_bytes(b"")
    assert vectorfile.read(spark, str(tmp_path / "empty")).count() == 0
    ragged = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="one length"):
        vectorfile.write(ragged.coalesce(1), str(tmp_path / "ragged"))
    assert not (tmp_path / "ragged").exists() or not list((tmp_path / "ragged").iterdir())
    vectorfile.write(ragged.limit(0), str(tmp_path / "none"))
    assert vectorfile.read(spark, str(tmp_path / "none")).count() == 0


def test_stores_that_only_spark_opens():
    assert not vectorfile.reachable("viewfs://store/in") and vectorfile.reachable("/tmp") and vectorfile.reachable("file:///tmp")
