"""A stream's predictions are those of the same rows at rest."""

from gradloom.dataset import Dataset
from gradloom.queries import fixed_model
from gradloom.streaming.score import score_stream


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(40).selectExpr("id row_id", "cast(id as float) f0", "cast(id / 400 as float) f1", "cast(nullif(id % 3, 0) / 30 as float) f2")
    rows.write.parquet(str(tmp_path / "in"))
    stream = score_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), fixed_model(), ["f0", "f1", "f2"], "row_id")
    q = stream.writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = fixed_model().predict(Dataset(rows, ("f0", "f1", "f2"), "row_id")).orderBy("row_id").collect()
    assert spark.sql("select * from scored order by row_id").collect() == want
