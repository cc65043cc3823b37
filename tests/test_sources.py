from pyspark.sql import functions as F

from folioscope.operators import figures, logs
from folioscope.sources import readers, sinks
from folioscope.sources.tables import hash_sample, most_frequent, one_per_key, release, stored
from folioscope.streaming import logs as stream
from tests.conftest import rows

LINES = ['{"level": "info", "event": "op.failed", "msg": "m", "retryable": true, "attempt": 2, "time": "2026-01-01T00:00:00Z"}', "plain {", '{"level": 30, "message": "n"}', "[1]", ""]


def test_log_import(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(LINES) + "\n")
    x = logs.imported(readers.log_files(spark, str(tmp_path)))
    assert rows(x, "line_no", "parsed", "level", "message", "retryable", "attempt") == [(1, True, "info", "m", "true", "2"), (2, False, None, "plain {", None, None), (3, True, None, "n", None, None), (4, False, None, "[1]", None, None), (5, False, None, "", None, None)]
    assert rows(logs.level_counts(x)) == [("info", 1), ("none", 4)]
    assert rows(logs.counts(x)) == [(5, 2, 0, 0, 1)]
    assert rows(logs.events(x)) == [("op.failed", 1, 1)]


def test_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(LINES))
    q = stream.to_table(stream.log_lines(spark, str(tmp_path / "in")).select("log_file", "parsed", "level", "message"), str(tmp_path / "out"), tmp_path.name)
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).where("parsed").count() == 2
    rates = stream.level_rates(stream.log_lines(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    rates.processAllAvailable()
    rates.stop()
    assert rows(spark.sql("SELECT level, n FROM rates")) == [("info", 1)]


def test_images_and_files(spark, tmp_path):
    import numpy as np

    (tmp_path / "page_003.png").write_bytes(figures.png(np.zeros((10, 12), np.uint8)))
    (tmp_path / "x.md").write_text("a\nb")
    f = readers.image_files(spark, str(tmp_path)).collect()
    assert len(f) == 1 and len(f[0].sha256) == 64
    p = readers.image_pixels(spark, str(tmp_path / "page_003.png")).collect()[0]
    assert (p.width, p.height, len(p.data)) == (12, 10, 120)
    assert rows(readers.markdown_files(spark, str(tmp_path)), "text") == [("a\nb",)]


def test_trial_files(spark, tmp_path):
    d = tmp_path / "trials" / "trial-0001"
    d.mkdir(parents=True)
    (d / "trial.json").write_text('{"id": "t"}')
    (d / "response.txt").write_text("x\ny")
    assert rows(readers.trial_files(spark, str(tmp_path)), "id", "raw_response") == [("t", "x\ny")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, "x"), ("b", 0, "w")], "book_id string, part long, markdown string")
    for _ in range(2):
        sinks.write_table(df, str(tmp_path / "t"))
        sinks.append_states(df, str(tmp_path / "s"))
    sinks.write_documents(df, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 and spark.read.parquet(str(tmp_path / "s")).count() == 4
    assert (tmp_path / "d" / "book=b" / "part=0").is_dir()
    assert sinks.json_report(df).count() == 2


def test_one_per_key_and_stored(spark):
    df = spark.createDataFrame([(1, 2), (1, 1), (None, 3), (None, 4)], "k int, v int")
    assert rows(one_per_key(df, ["k"], [F.col("v")])) == [(1, 1), (None, 3)]
    assert rows(stored(df.where("false"), "none")) == []


def test_samples_are_bounded_and_the_same_on_every_run(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    got = [r.k for r in hash_sample(df, 500, "k")]
    assert len(got) == 500 and got == [r.k for r in hash_sample(df.repartition(7), 500, "k")]
    assert len(hash_sample(df.limit(30), 500, "k")) == 30 and hash_sample(df.where("false"), 5, "k") == []


def test_most_frequent_rows(spark):
    df = spark.range(1, 1001).select(F.col("id").alias("n"), F.lit("x").alias("clash"))
    got = [r.n for r in most_frequent(df, 100, "n").collect()]
    assert 80 <= len(got) <= 100 and sorted(got) == list(range(1001 - len(got), 1001))
    assert most_frequent(df.where("false"), 5, "n").count() == 0 and most_frequent(df, 5000, "n").count() == 1000
    assert most_frequent(df.where("n < 3").unionByName(df.where("n < 3")), 3, "n").count() == 2


def test_stored_tables_go_on_release(spark):
    from pathlib import Path

    stored(spark.range(3), "gone")
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "folioscope" / spark.sparkContext.applicationId
    assert list(folder.glob("gone-*"))
    release(spark)
    assert not folder.exists() and stored(spark.range(3), "again").count() == 3
