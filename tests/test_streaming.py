"""The streaming extension over files that land one by one."""

from datetime import datetime, timedelta

from tarnwatch.streaming import bursts as B

T0 = datetime(2024, 1, 1)


def drain(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
        return df.sparkSession.sql(f"SELECT * FROM {name}").collect()
    finally:
        q.stop()


def test_bursts_and_repeats(spark, tmp_path):
    for k, minutes in enumerate(([0, 5], [9, 9], [400])):
        rows = [("p", T0 + timedelta(minutes=m), m) for m in minutes]
        spark.createDataFrame(rows, "package string, ts timestamp, version int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = lambda: B.landed(spark, str(tmp_path / "in"), schema)
    assert len(drain(B.once(stream(), ["package", "version"], "ts"), "once", "append")) == 4
    found = drain(B.bursts(stream(), "package", "ts"), "bursts", "update")
    assert found and all(r["package"] == "p" and r["versions"] >= 3 for r in found)
