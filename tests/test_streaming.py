import numpy as np

from signalframe import streaming
from signalframe.operators import fourier


def test_a_stream_ends_with_the_batch_spectrum(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((12, 8))
    for part in range(3):
        rows = [(i, x[i].tolist()) for i in range(4 * part, 4 * part + 4)]
        spark.createDataFrame(rows, "row_id long, x array<double>").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("row_id long, x array<double>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = streaming.running_power(stream).writeStream.outputMode("complete").format("memory").queryName("running_power").start()
    query.processAllAvailable()
    query.stop()
    got = streaming.spectrum_of(spark.table("running_power"), 8.0).orderBy("k").collect()
    batch = fourier.eigenspectrum(spark.read.parquet(f"{tmp_path}/in"), 8.0).orderBy("k").collect()
    assert np.allclose([r["power"] for r in got], [r["power"] for r in batch]) and [r["freq"] for r in got] == [r["freq"] for r in batch]


def test_windows_close_when_the_watermark_passes(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal((6, 4))
    for part, minutes in enumerate(([0, 3, 12], [14, 1, 40])):  # the late one, minute 1, is within the watermark
        rows = [(f"2024-01-01 00:{m:02d}:00", x[3 * part + n].tolist()) for n, m in enumerate(minutes)]
        spark.createDataFrame(rows, "at string, x array<double>").selectExpr("CAST(at AS TIMESTAMP) AS at", "x").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("at timestamp, x array<double>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = streaming.windowed_power(stream, "at", "10 minutes", "15 minutes")
    query = found.writeStream.outputMode("append").format("memory").queryName("windowed_power").start()
    query.processAllAvailable()
    query.stop()
    got = {(r["window"]["start"].minute, r["k"]): (r["n"], r["total"]) for r in spark.table("windowed_power").collect()}
    for start, rows in ((0, [0, 1, 4]), (10, [2, 3])):
        power = (np.abs(np.fft.fft(x[rows], axis=1)) ** 2 / 4).sum(axis=0)
        assert [got[start, k][0] for k in range(4)] == [len(rows)] * 4 and np.allclose([got[start, k][1] for k in range(4)], power)
    assert {start for start, _ in got} == {0, 10}


def test_running_power_of_ragged_signals(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],), ([1.0, 0.0, 0.0],)], "x array<double>")
    got = {(r["m"], r["k"]): (r["n"], r["total"]) for r in streaming.running_power(rows).collect()}
    assert got[2, 0][0] == 2 and np.isclose(got[2, 0][1], (9 + 49) / 2) and np.isclose(got[3, 2][1], 1 / 3) and len(got) == 5
