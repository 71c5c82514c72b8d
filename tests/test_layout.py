from pyspark.sql import functions as F

from foliant.operators import layout


def files_read(df):
    """Rows, and how many files the scans of the plan read."""
    execution = df._jdf.queryExecution()
    rows = execution.toRdd().count()
    leaves = execution.executedPlan().collectLeaves()
    return rows, sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_slices_read_their_own_files(spark, tmp_path):
    members = spark.range(3000).select(F.col("id").cast("string").alias("book_id"), (F.col("id") % 6).cast("int").alias("cluster_id"), (F.floor(F.col("id") / 6) + 1).cast("int").alias("cluster_rank")).repartition(5)
    layout.write_members(members, f"{tmp_path}/m", rows_a_file=100)
    assert len(list((tmp_path / "m").glob("cluster_id=*/*.parquet"))) == 30
    raw = spark.read.parquet(f"{tmp_path}/m").where("cluster_id = 2 and cluster_rank <= 10")
    assert files_read(raw) == (10, 5)  # of 30; row groups beyond the ranks are passed over
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(cluster_rank,10)" in plan and "cluster_id" in plan.split("PartitionFilters")[1].split("]")[0]
    assert [r.cluster_rank for r in layout.member_slice(spark, f"{tmp_path}/m", 2).collect()] == list(range(1, 11))
    assert layout.member_slice(spark, f"{tmp_path}/m", 2, None).count() == 500

    details = spark.range(3000).select(F.col("id").cast("string").alias("book_id"), F.concat(F.lit("t"), "id").alias("title"))
    layout.write_details(details, f"{tmp_path}/d", 16)
    some = layout.details_of(spark, f"{tmp_path}/d", ["5", "77", "no"])
    rows, files = files_read(some)
    assert rows == 2 and files <= 3 and {r.title for r in some.collect()} == {"t5", "t77"}
    shown = layout.member_slice(spark, f"{tmp_path}/m", 3, 4, f"{tmp_path}/d").collect()
    assert [(r.book_id, r.title) for r in shown] == [(b, f"t{b}") for b in ("3", "9", "15", "21")]
    whole = layout.with_details(spark, members.where("cluster_id = 1"), f"{tmp_path}/d", page=50)
    assert whole.count() == 500 and whole.where("title is null").count() == 0
