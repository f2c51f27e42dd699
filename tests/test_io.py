"""Sources and sinks round trip."""

import tempfile

from churnlab.sources import io


def test_parquet_and_csv_round_trip(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", None)], "id long, s string, v double")
    base = tempfile.mkdtemp(prefix="churnlab-io-")
    io.write_table(df, f"{base}/t")
    back = io.read_table(spark, f"{base}/t")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    io.write_csv(df, f"{base}/c")
    csv = io.read_csv(spark, f"{base}/c", "id long, s string, v double")
    assert sorted(map(tuple, csv.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert [r["id"] for r in io.preview(df, ["id"], offset=1, n=1).collect()] == [2]
