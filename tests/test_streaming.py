from locusflow.streaming.summary import ROW_SCHEMA, haplotype_counts

ROWS = [
    ("a", [(2, 1, 1), (1, 0, 0)]),
    ("b", [(1, 0, 0), (2, 1, 1)]),
    ("c", [(1, 0, 1), (2, 1, 1)]),
    ("d", [(1, None, None), (2, 1, 1)]),
    ("e", []),
]


def test_stream_equals_batch(spark, tmp_path):
    for i, part in enumerate((ROWS[:2], ROWS[2:])):
        spark.createDataFrame(part, ROW_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ROW_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = haplotype_counts(stream, True).writeStream.outputMode("complete").format("memory").queryName("haps").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.hap, r["count"]) for r in spark.table("haps").collect()}
    assert got == {(r.hap, r["count"]) for r in haplotype_counts(spark.createDataFrame(ROWS, ROW_SCHEMA), True).collect()} == {("0/0|1/1", 3)}
