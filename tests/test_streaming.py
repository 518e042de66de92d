from rastertables.streaming.ingest import index_counts, ingest_incremental, read_index

SCHEMA = "observation_id string, row int, col int, invalid_fraction double"


def test_redelivery_changes_nothing(spark, tmp_path):
    arrivals, root, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    first = [("A", 0, 0, 0.0), ("A", 0, 1, 0.5), ("B", 0, 0, 0.01)]
    second = [("A", 0, 0, 0.0), ("C", 1, 1, 0.0)]
    for rows in (first, second):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(arrivals)
        ingest_incremental(spark.readStream.schema(SCHEMA).parquet(arrivals), root, checkpoint, least=1)
    kept = sorted(tuple(r)[:3] for r in spark.read.parquet(f"{root}/crops").collect())
    assert kept == [("A", 0, 0), ("B", 0, 0), ("C", 1, 1)]
    splits = read_index(spark, root).collect()
    assert tuple(index_counts(spark, root).first()) == (3, 3)
    assert sorted(r.observation_id for r in splits) == ["A", "B", "C"] and sum(r.split == "val" for r in splits) == 1


def test_a_batch_reads_its_own_rows_only(spark, tmp_path):
    """What was ingested before is moved away: the state alone knows it."""
    arrivals, root, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    for number, rows in enumerate(([("A", i, j, 0.0) for i in range(20) for j in range(5)], [("A", 3, 3, 0.0), ("A", 30, 0, 0.0), ("B", 0, 0, 0.0), ("B", 0, 1, 0.9)])):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(arrivals)
        ingest_incremental(spark.readStream.schema(SCHEMA).parquet(arrivals), root, checkpoint, least=1)
        if number == 0:
            (tmp_path / "out" / "crops" / "batch=0").rename(tmp_path / "away")
    kept = sorted(tuple(r)[:3] for r in spark.read.parquet(f"{root}/crops").collect())
    assert kept == [("A", 30, 0), ("B", 0, 0)]
    assert tuple(index_counts(spark, root).first()) == (102, 2)
