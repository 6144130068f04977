from geoskein.sources.csv_records import failed_records, loaded_records
from geoskein.streaming.ingest import split_stream


def test_stream_gives_what_the_batch_gives(spark, small, tmp_path):
    lines = spark.read.parquet(f"{small}/listing_lines.parquet")
    source = tmp_path / "source"
    lines.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = split_stream(stream, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert query.exception() is None
    good, bad = spark.read.parquet(str(tmp_path / "good")), spark.read.parquet(str(tmp_path / "bad"))
    assert good.select("batch_id").distinct().count() == 3
    assert sorted(r.line_id for r in good.collect()) == sorted(r.line_id for r in loaded_records(lines).collect())
    assert sorted(map(tuple, bad.select("line_id", "reason").collect())) == sorted(map(tuple, failed_records(lines).select("line_id", "reason").collect()))
