import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.sources import matrices


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(7).normal(size=(1003, 12)).astype(np.float32)


def test_one_file_is_many_tasks(spark, x, tmp_path):
    np.save(tmp_path / "m.npy", x)
    df = matrices.read_matrix(spark, f"{tmp_path}/m.npy", range_bytes=100 * 12 * 4)
    assert df.rdd.getNumPartitions() == 11
    rows = df.orderBy("row").collect()
    assert [r["row"] for r in rows] == list(range(1003)) and np.array_equal(np.array([r.embedding for r in rows], np.float32), x)
    np.save(tmp_path / "d.npy", x.astype(np.float64)[:5])
    assert np.allclose([r.v for r in matrices.read_matrix(spark, f"file://{tmp_path}/d.npy", "v").orderBy("row").collect()], x[:5])


def test_rows_go_to_their_own_places(spark, x, tmp_path):
    df = spark.createDataFrame([(int(i) * 3, v.tolist()) for i, v in enumerate(x)], "place long, v array<float>").repartition(7)
    assert matrices.write_matrix(df, f"file://{tmp_path}/with space.npy".replace(" ", "%20"), "place", "v") == 1003
    assert np.array_equal(np.load(tmp_path / "with space.npy"), x)
    assert matrices.write_matrix_parts(df, f"{tmp_path}/parts", "place", "v") == 1003
    back = matrices.read_matrix(spark, f"{tmp_path}/parts", range_bytes=1 << 12).orderBy("row").collect()
    assert np.array_equal(np.array([r.embedding for r in back], np.float32), x)
    with pytest.raises(ValueError, match="already"):
        matrices.write_matrix_parts(df, f"{tmp_path}/parts", "place", "v")
    assert matrices.write_matrix(df.limit(0), f"{tmp_path}/none.npy", "place", "v") == 0 and np.load(tmp_path / "none.npy").shape == (0, 0)


def test_files_that_are_no_matrix(spark, x, tmp_path):
    for name, bad in (("one", x[0]), ("columns", np.asfortranarray(x)), ("text", np.array([["a"]]))):
        np.save(tmp_path / f"{name}.npy", bad)
        with pytest.raises(Exception, match="two dimensions"):
            matrices.read_matrix(spark, f"{tmp_path}/{name}.npy").count()
    np.save(tmp_path / "cut.npy", x)
    with open(tmp_path / "cut.npy", "r+b") as f:
        f.truncate(5000)
    with pytest.raises(Exception, match="ends before"):
        matrices.read_matrix(spark, f"{tmp_path}/cut.npy").agg(F.sum("row")).collect()
    with pytest.raises(ValueError, match="no places"):
        matrices.write_matrix(spark.range(1).withColumn("embedding", F.array(F.lit(1.0))), "s3://bucket/x.npy", "id")
