"""The source with offsets of its own: bounded micro-batches, files that come late, a restart, changed and empty files."""

import json

import pytest
from pyspark.errors import StreamingQueryException

from pairwave.sources import feed
from pairwave.streaming import live

KIND = "id long, name string"


def put(spark, folder, lo, hi, part=1):
    spark.range(lo, hi).selectExpr("id", "if(id % 3 = 0, null, concat('n', id)) AS name").coalesce(part).write.mode("append").parquet(folder)


def stream(spark, tmp_path, rows, split=1 << 20):
    return feed.feed(spark, str(tmp_path / "in"), spark.createDataFrame([], KIND).schema, f"file://{tmp_path}/feed-log", rows, split)


def run(made, tmp_path):
    q = made.writeStream.option("checkpointLocation", str(tmp_path / "log")).format("parquet").option("path", str(tmp_path / "out")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_bounded_and_restarted(spark, tmp_path):
    put(spark, str(tmp_path / "in"), 0, 10)
    put(spark, str(tmp_path / "in"), 10, 10)  # an empty file
    run(stream(spark, tmp_path, 4, split=3), tmp_path)
    found = lambda: sorted(map(tuple, feed.admissions(spark, f"file://{tmp_path}/feed-log").select("start", "end", "waiting_rows").collect()))
    assert found() == [(0, 4, 6), (4, 8, 2), (8, 10, 0)]
    put(spark, str(tmp_path / "in"), 10, 15)
    run(stream(spark, tmp_path, 4, split=3), tmp_path)
    assert found()[3:] == [(10, 14, 1), (14, 15, 0)]
    run(stream(spark, tmp_path, 4, split=3), tmp_path)  # nothing new
    got = sorted(map(tuple, spark.read.schema("id long, name string, offset long").parquet(str(tmp_path / "out")).collect()))
    assert got == [(i, None if i % 3 == 0 else f"n{i}", i) for i in range(15)]


def test_unopened_files_wait(spark, tmp_path):
    for i in range(3):
        put(spark, str(tmp_path / "in"), 5 * i, 5 * i + 5)
    reader = feed.FeedReader({"path": str(tmp_path / "in"), "log": str(tmp_path / "feed-log"), "rows": "4"}, spark.createDataFrame([], KIND).schema)
    assert reader.initialOffset() == {"row": 0} and reader.latestOffset() == {"row": 4}
    assert [reader.admitted.entries[-1][k] for k in ("waiting_rows", "waiting_files")] == [1, 2]
    assert reader.latestOffset() == {"row": 8} and reader.latestOffset() == {"row": 12} and reader.latestOffset() == {"row": 15}
    assert [(p.lo, p.hi) for p in reader.partitions({"row": 3}, {"row": 12})] == [(3, 5), (0, 5), (0, 2)] and reader.partitions({"row": 4}, {"row": 4}) == []
    assert reader.latestOffset() == {"row": 15} and len(reader.admitted.entries) == 4
    again = feed.FeedReader({"path": str(tmp_path / "in"), "log": str(tmp_path / "feed-log"), "rows": "4"}, reader.schema)
    assert again.latestOffset() == {"row": 15} and again.partitions({"row": 3}, {"row": 12}) == reader.partitions({"row": 3}, {"row": 12})


def test_a_backlog_is_worked_off_in_fewer_micro_batches(spark, tmp_path):
    """Each admission is logged with its own backlog; a micro-batch takes as many as it may. Started again, it goes on."""
    put(spark, str(tmp_path / "in"), 0, 15)
    put(spark, str(tmp_path / "in"), 15, 27)
    made = lambda: feed.feed(spark, str(tmp_path / "in"), spark.createDataFrame([], KIND).schema, f"file://{tmp_path}/feed-log", 2, admissions=5)
    run(made(), tmp_path)
    found = lambda: sorted(map(tuple, feed.admissions(spark, f"file://{tmp_path}/feed-log").select("start", "end", "waiting_rows", "waiting_files").collect()))
    first = [(a, min(a + 2, 27), (15 if a < 10 else 27) - min(a + 2, 27), int(a < 10)) for a in range(0, 27, 2)]
    assert found() == first and len(list((tmp_path / "log" / "commits").glob("[0-9]*"))) == 3
    put(spark, str(tmp_path / "in"), 27, 30)
    run(made(), tmp_path)
    assert found() == [*first, (27, 29, 1, 0), (29, 30, 0, 0)]
    got = sorted(map(tuple, spark.read.schema("id long, name string, offset long").parquet(str(tmp_path / "out")).collect()))
    assert [r[2] for r in got] == list(range(30)) and sorted(r[0] for r in got) == list(range(30))


def test_no_files_and_wrong_options(spark, tmp_path):
    reader = feed.FeedReader({"path": str(tmp_path / "none"), "log": str(tmp_path / "feed-log"), "rows": "4"}, spark.createDataFrame([], KIND).schema)
    assert reader.latestOffset() == {"row": 0} and reader.partitions({"row": 0}, {"row": 0}) == []
    with pytest.raises(ValueError, match="at least 1"):
        feed.FeedReader({"path": "x", "log": str(tmp_path / "feed-log"), "rows": "0"}, reader.schema)


def test_a_changed_file_is_an_error(spark, tmp_path):
    put(spark, str(tmp_path / "in"), 0, 10)
    made = stream(spark, tmp_path, 4)
    run(made, tmp_path)
    entry = next((tmp_path / "feed-log" / "files").glob("0*.json"))
    entry.write_text(json.dumps({**json.loads(entry.read_text()), "size": 1}))
    for f in (tmp_path / "feed-log" / "admitted").glob("*2.json"):
        f.unlink()
    q = stream(spark, tmp_path, 4).writeStream.option("checkpointLocation", str(tmp_path / "log2")).format("noop").start()
    with pytest.raises(StreamingQueryException, match="has changed"):
        q.processAllAvailable()
    q.stop()


def test_drained(spark, tmp_path):
    put(spark, str(tmp_path / "in"), 0, 9, part=1)
    out = live.drained(stream(spark, tmp_path, 2), str(tmp_path / "log3"))
    assert spark.read.schema(KIND).parquet(out).count() == 9
