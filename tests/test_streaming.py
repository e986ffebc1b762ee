"""Streaming operators over files of rows, run to the end."""

import datetime

import pytest

from tessera.streaming import operators as S


def run(spark, tmp_path, rows, schema, build, name, mode="append"):
    """Rows go in as one file per batch; a last batch far in the future moves the watermark."""
    folder = tmp_path / "in"
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(folder))
    query = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name).collect()


def at(seconds):
    return datetime.datetime(2025, 1, 1) + datetime.timedelta(seconds=seconds)


EVENTS = "path string, type string, ts timestamp, seq long"


def test_debounce_keeps_the_last_action(spark, tmp_path):
    rows = [[("a.ts", "create", at(0), 1), ("a.ts", "update", at(0.3), 2), ("b.ts", "update", at(0.1), 3), ("a.ts", "delete", at(0.6), 4)], [("x.ts", "create", at(100), 9)], [("y.ts", "create", at(200), 10)]]
    got = run(spark, tmp_path, rows, EVENTS, lambda s: S.debounced(S.file_events(s), "path", "action", "ts", "seq"), "debounced")
    assert {(r["path"], r["n"], r["action"]) for r in got} >= {("a.ts", 3, "unlink"), ("b.ts", 1, "change")}


def test_events_outside_are_dropped(spark, tmp_path):
    rows = [[("../a.ts", "create", at(0), 1), ("/b.ts", "create", at(0), 2), ("node_modules/c.js", "create", at(0), 3), ("d.ts", "rename", at(0), 4), ("e.ts", "create", at(0), 5), (None, "create", at(0), 6)]]
    got = run(spark, tmp_path, rows, EVENTS, S.file_events, "outside")
    assert [r["path"] for r in got] == ["e.ts"]


def test_bucket_pays_and_refills(spark, tmp_path):
    rows = [[("r", at(0), 990), ("r", at(0), 1000)], [("r", at(20), 1000)]]
    got = run(spark, tmp_path, rows, "k string, t timestamp, c int", lambda s: S.token_bucket(s, "k", "t", "c"), "bucket", "append")
    assert sorted((r["ok"], r["retry_ms"]) for r in got) == [(False, 19800), (True, 0), (True, 0)]


def test_sweep_counts_overlapping_windows(spark, tmp_path):
    rows = [[("error", at(60 * k)) for k in range(5)], [("error", at(86400))], [("error", at(2 * 86400))]]
    got = run(spark, tmp_path, rows, "kind string, t timestamp", lambda s: S.swept(s, "kind", "t", 5), "sweep")
    assert got and all(r["n"] == 5 for r in got) and len(got) == 12


def test_unchanged_content_is_skipped(spark, tmp_path):
    index = spark.createDataFrame([("a.ts", "1"), ("b.ts", "2")], "file_path string, sha256 string")
    rows = [[("a.ts", "1"), ("b.ts", "9"), ("c.ts", None)]]
    got = run(spark, tmp_path, rows, "path string, sha string", lambda s: S.unchanged_skipped(s, index, "path", "sha"), "skip")
    assert sorted(r["path"] for r in got) == ["b.ts", "c.ts"]



def test_upserts_keep_the_latest_version(spark, tmp_path):
    from tessera.streaming import sinks

    schema = "k string, v int, t string"
    for n, part in enumerate(([("a", 1, "x"), ("b", 2, "y")], [("a", 3, "z"), ("b", 1, "old"), (None, 1, "n")])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        sinks.upserts(stream, str(tmp_path / "out"), ["k"], "v", str(tmp_path / "cp")).awaitTermination()
    assert sinks.current(spark, str(tmp_path / "none")) is None
    got = {(r["k"], r["v"], r["t"]) for r in sinks.current(spark, str(tmp_path / "out")).collect()}
    assert got == {("a", 3, "z"), ("b", 2, "y"), (None, 1, "n")}


if __name__ == "__main__":
    pytest.main([__file__])
