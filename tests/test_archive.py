"""The page archive as a data source."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from bandwise.sources import archive, snapshots

AT = dt.datetime(2025, 1, 1, 12)
COLUMNS = "page_id bigint, source string, url string, fetched_at timestamp, content string, content_type string, status_code int"


def pages(spark, ids, parts=3):
    rows = [(i, [None, "bat", "ebay", "bat"][i % 4], f"u{i}", None if i % 11 == 5 else AT + dt.timedelta(days=i // 4 % 6), "" if i % 7 == 3 else f"<p>{i}</p>",
             "html", 200) for i in ids]
    return spark.createDataFrame(rows, COLUMNS).repartition(parts)


def ids(df):
    return sorted(r.page_id for r in df.collect())


@pytest.fixture
def folder(spark, tmp_path):
    archive.write_pages(pages(spark, range(60)), str(tmp_path / "a"))
    archive.write_pages(pages(spark, range(60, 100)), str(tmp_path / "a"))
    return str(tmp_path / "a")


def test_round_trip_and_filters(spark, folder):
    got = archive.read_pages(spark, folder)
    want = pages(spark, range(100)).where("content <> ''").withColumn("fetch_date", F.col("fetched_at").cast("date"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    for condition in ("source = 'bat'", "source is null", "fetch_date is null", "source = 'bat' and fetch_date >= date'2025-01-04'",
                      "source in ('ebay', 'none') and fetch_date < date'2025-01-03'", "fetch_date = date'2025-01-02' and page_id > 50"):
        assert ids(got.where(condition)) == ids(want.where(condition)), condition
    assert archive.read_pages(spark, f"{folder}-none").count() == 0


def test_only_the_days_asked_for_are_planned(folder):
    day = dt.date(2025, 1, 4)

    def planned(*filters):
        reader = archive.ArchiveReader(folder)
        assert list(reader.pushFilters(list(filters))) == list(filters)  # the engine checks the rows again
        return [p for task in reader.partitions() for p in task.pieces]

    every = planned()
    assert len({(p.source, p.day) for p in every}) > 15
    some = planned(EqualTo(("source",), "bat"), GreaterThanOrEqual(("fetch_date",), day))
    assert {(p.source, p.day) for p in some} == {("bat", f"2025-01-0{k}") for k in (4, 5, 6)}
    assert planned(EqualTo(("source",), "bat"), LessThan(("fetch_date",), dt.date(2024, 1, 1))) == []
    assert {p.source for p in planned(In(("source",), ("ebay",)))} == {"ebay"}
    assert len(planned(EqualTo(("url",), "u1"))) == len(every)


def test_days_share_files_and_reads_are_grouped(folder, monkeypatch):
    pieces = archive._pieces(folder, archive._writes(folder))
    assert len(os.listdir(f"{folder}/packs")) == len({p.file for p in pieces}) < len(pieces) / 2
    assert len(archive._grouped(pieces)) == 1
    monkeypatch.setattr(archive, "TASK_BYTES", 1)
    assert len(archive._grouped(pieces)) == len(pieces)


def test_large_days_are_several_batches(spark, tmp_path, monkeypatch):
    writer = archive.ArchiveWriter(str(tmp_path))
    monkeypatch.setattr(archive, "BATCH_BYTES", 2_000)
    rows = pages(spark, [1] * 300, 1).withColumn("fetch_date", F.col("fetched_at").cast("date")).toArrow()
    message = writer.write(iter(rows.to_batches(max_chunksize=10)))
    assert len(message.pieces) > 5 and len({(p.source, p.day) for p in message.pieces}) == 1
    writer.abort([message, None])
    assert os.listdir(f"{tmp_path}/packs") == [] and archive._writes(str(tmp_path)) == []


def test_a_failed_write_leaves_nothing(spark, folder):
    before = ids(archive.read_pages(spark, folder))
    broken = pages(spark, range(200, 260)).withColumn("status_code", F.when(F.col("page_id") == 230, F.raise_error(F.lit("lost"))).otherwise(F.col("status_code")))
    with pytest.raises(Exception, match="lost"):
        archive.write_pages(broken, folder)
    assert ids(archive.read_pages(spark, folder)) == before


def test_the_stream_follows_the_writes(spark, folder, tmp_path):
    seen = []

    def drain():
        archive.follow_pages(spark, folder).writeStream.foreachBatch(lambda rows, _: seen.append(ids(rows))).option(
            "checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
        return sorted(i for batch in seen for i in batch)

    assert drain() == ids(archive.read_pages(spark, folder))
    archive.write_pages(pages(spark, range(300, 310)), folder)
    assert drain() == ids(archive.read_pages(spark, folder))
    assert seen[-1] == [i for i in range(300, 310) if i % 7 != 3]


def test_a_replay_sends_pages_once_to_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "SNAPSHOTS_PER_TASK", 10)
    rows = [("s", f"u{n % 150}", n // 150 * 86_400, n, f"<p>{n}</p>") for n in range(450)]
    pages = spark.createDataFrame(rows, "source string, url string, at long, page_id long, content string").select(
        "source", "url", F.timestamp_seconds("at").alias("fetched_at"), "page_id", "content")
    newest = snapshots.latest_snapshots(pages)
    assert sorted((r.url, r.page_id, r.content) for r in newest.collect()) == sorted(
        (url, n, html) for _, url, _, n, html in rows if n >= 300)
    assert newest.rdd.getNumPartitions() == 45
    plan = newest._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.rindex("SortAggregate") < plan.index("Exchange hashpartitioning")
