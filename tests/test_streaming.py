import numpy as np

from loomwork.operators.cluster import Bfr
from loomwork.streaming.rounds import bfr_stream, file_rounds, windowed_counts


def test_bfr_stream(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rng = np.random.default_rng(1)
    rows = [(i, (np.array([30.0 * (i % 2), 0.0]) + rng.normal(0, 1, 2)).tolist()) for i in range(60)]
    for i in range(2):
        spark.createDataFrame(rows[30 * i : 30 * i + 30], "id int, v array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    bfr = Bfr(2)
    bfr_stream(file_rounds(spark, str(tmp_path / "in"), "id int, v array<double>"), bfr, str(tmp_path / "c")).awaitTermination(60)
    got = {r.id: r.cluster for r in bfr.result().collect()}
    assert len(bfr.rounds) == 2 and set(got) == set(range(60))


def test_windowed_counts(spark):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(source.schema).parquet("/root/testdata/sf0.001/events*.parquet")
    query = windowed_counts(stream, width="1 day").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == source.count()
