"""Streams with state, paged sources and watched files: late rows, restarts, rewritten files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark import on_workers, registry
from tidemark.plans import streams
from tidemark.sources import files, paged
from tidemark.streaming import episodes, windows

from .compare import connect, duck_rows, spark_rows

HOUR = 3_600_000_000


def batches(spark, tmp_path, parts, schema):
    """Each part as a file that arrives after the one before."""
    inbox = f"file://{tmp_path}/inbox"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
    return on_workers(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)


def plain_episodes(rows, gap, until):
    out, by = [], {}
    for key, us, member in rows:
        by.setdefault(key, []).append((us, member))
    for key, own in by.items():
        own.sort(key=lambda r: (r[0], r[1] or 0))
        spans = []
        for us, member in own:
            if spans and us - spans[-1][1] <= gap:
                spans[-1][1], spans[-1][2] = us, spans[-1][2] + 1
            else:
                spans.append([us, us, 1, set()])
            spans[-1][3].update({member} - {None})
        pool, known = set(), False
        for start, end, n, mine in spans:
            if end + gap < until:
                out.append((key, start, end, n, len(mine), len(mine - pool), len(pool - mine), len(pool & mine), known))
            pool, known = mine, True
    return sorted(out, key=repr)


def test_a_late_row_joins_two_open_episodes(spark, tmp_path):
    day = 24 * HOUR
    parts = [
        [(1, 0, 5), (1, 30 * HOUR, 6), (2, HOUR, 9), (None, 2 * HOUR, None)],
        [(1, 15 * HOUR, 7), (2, 26 * HOUR, 8), (1, 31 * HOUR, 5)],  # 15 h joins the first two; 26 h is two spans' border
        [(1, 100 * HOUR, 5), (1, 100 * HOUR, 5), (2, 100 * HOUR + 1, None)],
        [(3, 400 * HOUR, 1)],
        [(1, 380 * HOUR, 4), (3, 600 * HOUR, 1)],
    ]
    # An hour from the watermark's own start, which is zero.
    parts = [[(k, us + HOUR, m) for k, us, m in part] for part in parts]
    schema = "key long, us long, member long"
    stream = batches(spark, tmp_path, parts, schema).withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", "40 hours")
    out = windows.finished(episodes.episodes(stream, "key", "ts", "member", day), "episodes")
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want = plain_episodes([r for p in parts for r in p], day, 561 * HOUR)
    assert got == want
    assert (1, HOUR, 32 * HOUR, 4, 3, 3, 0, 0, False) in got


def pages_of(folder, pages):
    for token, records, after in pages:
        (folder / f"token={token}").mkdir(parents=True)
        (folder / f"token={token}" / "part-0.json").write_text(json.dumps({"records": records, **({"next": after} if after else {})}))
    return f"file://{folder}"


@pytest.mark.parametrize("dies_in", [0, 1, 3])
def test_a_run_that_dies_before_the_commit_repeats_its_batch(spark, tmp_path, dies_in):
    n = 9
    path = pages_of(tmp_path / "pages", [(f"t{k}", [{"id": 10 * k + i} for i in range(3)] if k != 4 else [], f"t{k + 1}" if k < n - 1 else None) for k in range(n)])
    table, log, died = f"file://{tmp_path}/table", f"file://{tmp_path}/log", []

    def dies(number):
        if number == dies_in and not died:
            died.append(number)
            raise RuntimeError("stored, not committed")

    with pytest.raises(Exception, match="stored, not committed"):
        paged.drained(paged.stream(spark, path, "t0", 2), table, log, dies)
    half = spark.read.parquet(table)
    assert not half.agg(F.bool_or("last")).first()[0]
    paged.drained(paged.stream(spark, path, "t0", 2), table, log, dies)
    rows = spark.read.parquet(table)
    ids = [json.loads(r["record"])["id"] for r in rows.where("record is not null").collect()]
    assert sorted(ids) == [10 * k + i for k in range(n) if k != 4 for i in range(3)]
    assert paged.coverage(rows).collect()[0].asDict() == {"search": "", "pages": n, "records": 24, "complete": True}
    # Nothing new: a further run stores nothing.
    paged.drained(paged.stream(spark, path, "t0", 2), table, log)
    assert spark.read.parquet(table).count() == rows.count()


def test_searches_stop_at_their_bound(spark, tmp_path):
    path = pages_of(tmp_path / "pages", [("a1", [1, 2], "a2"), ("a2", [3], "a3"), ("a3", [], "a4"), ("a4", [9], None), ("b1", [5], None), ("c1", [], None)])
    got = {r["search"]: (r["pages"], r["records"], r["complete"]) for r in paged.coverage(paged.searches(spark, path, {"a": "a1", "b": "b1", "c": "c1"}, 3)).collect()}
    assert got == {"a": (3, 3, False), "b": (1, 1, True), "c": (1, 0, True)}


def test_a_rewritten_file_is_read_again_and_a_touched_one_is_not(spark, tmp_path):
    folder, out, ledger = (f"file://{tmp_path}/{n}" for n in ("in", "out", "ledger"))
    (tmp_path / "in").mkdir()

    def put(name, ids):
        (tmp_path / "in" / name).write_text("".join(json.dumps({"id": i, "v": f"{name}{i}"}) + "\n" for i in ids) + "\n no json\n")

    def poll(k):
        files.poll(spark, folder, out, ledger, k, "id long, v string", "id")
        return sorted((r["id"], r["v"], r["poll"]) for r in spark.read.parquet(out).collect()), spark.read.parquet(ledger).where(f"poll = {k}").count()

    put("a", [1, 2])
    put("b", [2, 3])
    rows, read = poll(1)
    assert (rows, read) == ([(1, "a1", 1), (2, "a2", 1), (3, "b3", 1)], 2)
    put("b", [3, 4])  # the same length, other content
    (tmp_path / "in" / "a").touch()
    rows, read = poll(2)
    assert (rows[3:], read) == ([(4, "b4", 2)], 1)
    put("b", [2, 3])  # as it once was: known; an empty file is none
    (tmp_path / "in" / "c").write_text("")
    assert poll(3) == (rows, 0)


def test_every_batch_is_reported(spark, data):
    from tidemark.plans import desk

    got = desk.reported(spark, data, 110).collect()
    assert len(got) == 110 and sum(r["rows"] for r in got) == spark.read.parquet(f"{data}/events.parquet").count()
    assert all(r["seconds"] > 0 for r in got)


def test_batches_of_many_files(spark, data, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 60)
    stream = streams.arriving(spark, data, 4)
    got = []
    stream.select("event_id", "ts").writeStream.foreachBatch(lambda b, k: got.append([r["event_id"] for r in b.orderBy("ts", "event_id").collect()])).trigger(availableNow=True).start().awaitTermination()
    events = spark.read.parquet(f"{data}/events.parquet")
    assert len(got) == 4 and [i for part in got for i in part] == [r["event_id"] for r in events.orderBy("ts", "event_id").collect()]
    assert spark_rows(streams.stream_episodes(spark, data)) == duck_rows(connect(data), registry.oracle_sql()["stream_episodes"])
