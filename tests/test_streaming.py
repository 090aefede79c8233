import random
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidex.operators import ingest as op
from evidex.plans.streams import QUERIES
from evidex.streaming import ingest, limiter, work

START = datetime(2024, 1, 1)
HITS = "key string, event_id bigint, ts timestamp_ntz"


def hits(rows, n=400, seed=1):
    rng = random.Random(seed)
    at, data = 0.0, []
    for i in range(n):
        at += rng.choice([0.5, 1, 3, 10, 30, 70, 200])
        # One key holds a third of the hits.
        key = "hot" if rng.random() < 0.34 else f"k{rng.randrange(4)}"
        data.append((key, i, START + timedelta(seconds=at)))
    return rows(data, HITS), data


def walk(data, limit, window):
    kept, out = {}, {}
    for key, event, ts in sorted(data, key=lambda x: (x[2], x[1])):
        times = [t for t in kept.get(key, []) if t >= ts - timedelta(seconds=window)]
        out[event] = len(times) < limit
        kept[key] = times + [ts] if out[event] else times
    return out


def test_three_hits_two_allowed(rows):
    df = rows([("a", i, START + timedelta(seconds=i)) for i in range(3)], HITS)
    got = {x["event_id"]: x["allowed"] for x in limiter.limit_hits(df, 2).collect()}
    assert got == {0: True, 1: True, 2: False}


def test_batch_limiter_agrees_with_a_walk(rows):
    for limit, window in ((1, 60), (2, 60), (5, 90)):
        df, data = hits(rows)
        got = {x["event_id"]: x["allowed"] for x in limiter.limit_hits(df, limit, window).collect()}
        assert got == walk(data, limit, window)


def test_stream_limiter_agrees_with_batch(spark, rows, tmp_path):
    df, data = hits(rows)
    source = str(tmp_path / "hits")
    for part in range(4):
        df.filter(F.floor(F.col("event_id") / 100) == part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    decided = work.run_to_files(limiter.limit_stream(stream, 2, 60), str(tmp_path / "out"), timers=True)
    got = {x["event_id"]: x["decision"] for x in decided.collect()}
    want = walk(data, 2, 60)
    assert len(got) == len(want)
    assert all((d == "allow") == want[e] for e, d in got.items() if d != "late")


def test_file_stream_ingest(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("word " * 500)
    (folder / "b.md").write_text("short text")
    (folder / "c.exe").write_bytes(b"MZ")
    files = ingest.file_stream(spark, str(folder)).select(
        F.col("name").alias("document_id"), F.col("name").alias("filename"), F.col("mime").alias("mime_type"), F.col("bytes").alias("byte_size"), "text")
    rows = work.run_to_files(ingest.chunk_stream(files), str(tmp_path / "out")).collect()
    assert sorted({r["document_id"] for r in rows}) == ["a.txt", "b.md"]
    assert sum(r["document_id"] == "a.txt" for r in rows) == 3


def test_index_batches_are_idempotent(spark, rows, tmp_path):
    path = str(tmp_path / "index")
    schema = "document_id string, user_id string, version bigint, text string"
    first = rows([("d1", "u", 1, "one " * 400), ("d1", "u", 2, "two"), ("d2", "u", 1, "keep me")], schema)
    second = rows([("d1", "u", 3, "three " * 300), ("d2", "u", 2, "  ")], schema)
    for batch_id, batch in ((0, first), (1, second), (1, second), (0, first)):
        ingest.write_batch(path, batch, batch_id)
    got = sorted((r["document_id"], r["version"], r["chunk_index"]) for r in ingest.current_index(spark, path).collect())
    assert got == [("d1", 3, 0), ("d1", 3, 1)]
    assert got == [("d1", 3, r["chunk_index"]) for r in op.chunk_documents(second.filter("document_id = 'd1'")).orderBy("chunk_index").collect()]


def test_an_older_version_that_comes_later_does_not_win(spark, rows, tmp_path):
    path = str(tmp_path / "index")
    schema = "document_id string, user_id string, version bigint, text string"
    ingest.write_batch(path, rows([("d1", "u", 3, "third"), ("d2", "u", 2, " ")], schema), 0)
    ingest.write_batch(path, rows([("d1", "u", 1, "first"), ("d2", "u", 1, "old")], schema), 1)
    assert [(r["document_id"], r["version"], r["text"]) for r in ingest.current_index(spark, path).collect()] == [("d1", 3, "third")]


def index_files(path, folder):
    """The bytes of one batch's folder, by bucket."""
    return sorted((f.parent.name, f.read_bytes()) for f in (path / "rows" / f"folder={folder}").rglob("*.parquet"))


SCHEMA = "document_id string, user_id string, version bigint, text string"


def test_index_agrees_with_a_dictionary_and_reads_no_superseded_folder(spark, rows, tmp_path):
    rng = random.Random(3)
    newest = {}
    for batch_id in range(9):
        # Null users, versions out of order, versions that come twice, blank and null texts, an empty batch.
        batch = {}
        for _ in range(0 if batch_id == 4 else rng.choice([2, 5, 30])):
            key = (f"d{rng.randrange(25)}", rng.choice(["u", "w", None]))
            batch[key] = (rng.randrange(6), rng.choice(["", "  ", None, f"text {batch_id} of {key}", f"long {batch_id} " * 300]))
        ingest.write_batch(str(tmp_path), rows([(*k, *v) for k, v in batch.items()], SCHEMA), batch_id, buckets=3)
        for key, (version, text) in batch.items():
            newest[key] = max(newest.get(key, (-1, -1, None)), (version, batch_id, text), key=lambda x: x[:2])
        want = rows([(*k, v, t) for k, (v, _, t) in newest.items()], SCHEMA)
        got = ingest.current_index(spark, str(tmp_path))
        key = ["document_id", "user_id", "version", "chunk_index", "text", "start_offset"]
        assert sorted(map(str, got.select(*key).collect())) == sorted(map(str, op.chunk_documents(want).select(*key).collect()))
        live = ingest.live_folders(spark, str(tmp_path), batch_id)
        for bucket in {r["bucket"] for r in live}:
            sizes = [r["documents"] for r in live if r["bucket"] == bucket]
            assert all(size > sum(sizes[i + 1:]) for i, size in enumerate(sizes))
        named = {f"folder={r['folder']}/bucket={r['bucket']}" for r in live}
        assert {"/".join(f.split("/")[-3:-1]) for f in got.inputFiles()} == named


def test_a_replayed_batch_writes_the_same_bytes(spark, rows, tmp_path):
    for batch_id in range(3):
        data = [(f"d{i}", "u", batch_id, f"text {batch_id} {i} " * 200) for i in range(batch_id, 12)]
        ingest.write_batch(str(tmp_path), rows(data, SCHEMA), batch_id, buckets=4)
    want = index_files(tmp_path, 2), ingest.live_folders(spark, str(tmp_path), 2)
    ingest.write_batch(str(tmp_path), rows(data, SCHEMA), 2, buckets=4)
    assert want[0] and (index_files(tmp_path, 2), ingest.live_folders(spark, str(tmp_path), 2)) == want


def test_a_batch_without_a_complete_manifest_is_not_seen(spark, rows, tmp_path):
    assert ingest.current_index(spark, str(tmp_path)).collect() == []
    ingest.write_batch(str(tmp_path), rows([("d", "u", 1, "first")], SCHEMA), 0)
    ingest.write_batch(str(tmp_path), rows([("d", "u", 2, "second")], SCHEMA), 1)
    (tmp_path / "manifest" / "batch_id=1" / "_SUCCESS").unlink()
    assert [r["text"] for r in ingest.current_index(spark, str(tmp_path)).collect()] == ["first"]


def test_superseded_folders_go(spark, rows, tmp_path):
    for batch_id in range(5):
        ingest.write_batch(str(tmp_path), rows([(f"d{i}", "u", batch_id, f"text {batch_id}") for i in range(20)], SCHEMA), batch_id, buckets=2)
    (tmp_path / "rows" / "folder=7").mkdir()  # of a batch not yet committed
    ingest.drop_superseded(spark, str(tmp_path), 2)
    assert sorted(f.name for f in (tmp_path / "rows").iterdir()) == ["folder=3", "folder=4", "folder=7"]
    assert sorted(f.name for f in (tmp_path / "manifest").iterdir()) == ["batch_id=3", "batch_id=4"]
    assert {r["text"] for r in ingest.current_index(spark, str(tmp_path)).collect()} == {"text 4"}


def test_a_bucket_with_one_folder_is_read_without_a_shuffle(spark, rows, tmp_path):
    for batch_id in range(3):
        ingest.write_batch(str(tmp_path), rows([(f"d{i}", "u", batch_id, "text") for i in range(20)], SCHEMA), batch_id)
    plan = ingest.current_index(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The smallest tables rewritten as folders of part files, beside the given single files."""
    folder = tmp_path_factory.mktemp("parts")
    for name in ("documents", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["stream_ingest", "stream_index", "stream_event_log"])
def test_streams_read_tables_of_part_files(spark, parts, name):
    want = sorted(map(str, QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
    assert want and sorted(map(str, QUERIES[name](spark, parts).collect())) == want


def test_every_hit_of_a_stream_is_answered(spark, rows, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    first = [("a", i, at(1000 + i)) for i in range(3)] + [("b", 9, at(100_000))]
    second = [("a", 10, at(10)), ("a", 11, at(1001)), ("c", 12, at(5))]
    source = str(tmp_path / "hits")
    for batch in (first, second):
        rows(batch, HITS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(HITS).option("maxFilesPerTrigger", 1).parquet(source)
    decided = work.run_to_files(limiter.limit_stream(stream, 2, 60), str(tmp_path / "out"), timers=True)
    got = {r["event_id"]: r["decision"] for r in decided.collect()}
    assert got == {0: "allow", 1: "allow", 2: "deny", 9: "allow", 10: "late", 11: "deny", 12: "allow"}
    assert [r["event_id"] for r in limiter.late_hits(decided).collect()] == [10]


def test_stream_limiter_reads_part_files(spark, parts):
    assert QUERIES["stream_limit_hits"](spark, parts).count() == 1000


def test_a_key_never_silent_spreads_over_runs(rows):
    """One hit a second for eleven hours; bursts above the limit now and then."""
    rng = random.Random(5)
    data = [("busy", i, START + timedelta(seconds=i)) for i in range(40_000)]
    bursts = [rng.randrange(40_000) for _ in range(6)]
    data += [("busy", 50_000 + 100 * b + j, START + timedelta(seconds=at, milliseconds=3 * j)) for b, at in enumerate(bursts) for j in range(40)]
    df = rows(data, HITS)
    got = {x["event_id"]: x["allowed"] for x in limiter.limit_hits(df, 70).collect()}
    assert got == walk(data, 70, 60) and not all(got.values())
    us = df.select("key", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    runs = limiter.limiter_runs(us, 70, 60_000_000).groupBy("run_start").count().collect()
    assert len(runs) >= 10 and max(r["count"] for r in runs) < 3 * 3600 + 300


@pytest.mark.parametrize("limit", [0, 1, 3, 6])
def test_runs_cut_by_free_hits_agree_with_a_walk(rows, monkeypatch, limit):
    """Short slices, equal times, stretches below, at and above the limit."""
    monkeypatch.setattr(limiter, "SLICE_WINDOWS", 4)
    rng = random.Random(limit)
    at, data = 0, []
    for i in range(1500):
        at += rng.choice((0, 1, 2) if (i // 150) % 2 else (2, 4, 5, 9))
        data.append((rng.choice(["hot", "hot", "b"]), i, START + timedelta(seconds=at)))
    got = {x["event_id"]: x["allowed"] for x in limiter.limit_hits(rows(data, HITS), limit, 10).collect()}
    assert got == walk(data, limit, 10)


class Kept:
    """The state and timers of one key, without a cluster."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, now, due=None):
        self.now, self.due = now, due

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.due


def test_an_idle_key_is_forgotten_but_not_after_a_standstill():
    kept, limiting = Kept(), limiter.Limiter(1, 60_000_000, 60_000_000, 1000)
    limiting.init(kept)
    hit = lambda us, now: list(limiting.handleInputRows(("a",), iter([pd.DataFrame({"us": [us], "event_id": [us]})]), Clock(now)))[0]["decision"][0]
    tick = lambda now: list(limiting.handleExpiredTimer(("a",), Clock(now), Clock(now, kept.timers[-1])))
    assert hit(0, 0) == "allow" and kept.timers == [1000]
    assert hit(5, 600) == "deny" and kept.timers == [1000]
    tick(1000)  # seen since: looked at again when its period is over
    assert kept.value and kept.timers == [1000, 1600]
    tick(9000)  # the query stood still
    assert kept.value and kept.timers[-1] == 10_000 and hit(9, 9100) == "deny"
    tick(10_000)
    assert kept.timers[-1] == 10_100
    tick(10_200)
    assert kept.value is None and hit(10, 10_300) == "allow"


def test_the_state_of_an_idle_key_leaves_the_store(spark, rows, tmp_path):
    source, out = str(tmp_path / "hits"), str(tmp_path / "out")
    rows([("a", 1, START), ("b", 2, START)], HITS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(HITS).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        limiter.limit_stream(stream, 2, 1, idle_seconds=3).writeStream.format("parquet")
        .option("checkpointLocation", f"{out}/_stream").trigger(processingTime="500 milliseconds").start(f"{out}/rows")
    )
    try:
        state = lambda: query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress and query.lastProgress["stateOperators"] else None
        seen, end = set(), time.time() + 60
        while time.time() < end and not (0 in seen and max(seen) > 0):
            if (n := state()) is not None:
                seen.add(n)
            time.sleep(0.3)
        assert 0 in seen and max(seen) > 0
        assert query.exception() is None
    finally:
        query.stop()


def test_scanned_files_lie_in_few_folders(spark, tmp_path):
    """One file per row, rows of one id too; no folder of its own for each."""
    from evidex.plans import streams

    data = [(i, f"text {i}\nof é") for i in range(300)] + [(7, "again")]
    spark.createDataFrame(data, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = streams.scanned_files(spark, str(tmp_path))
    got = sorted((x["name"], x["characters"], x["bytes"]) for x in found.collect())
    assert got == sorted((f"d{i}", len(t) + 1, len(t.encode()) + 1) for i, t in data)
    assert len({f.rsplit("/", 1)[0] for f in found.inputFiles()}) <= streams.FILE_FOLDERS


def test_files_are_listed_some_folders_at_a_time(spark, tmp_path, monkeypatch):
    """No listing holds all files, and none is missed; rows without id or text, none at all."""
    from evidex.plans import streams

    data = [(i, f"text {i}\nof é") for i in range(300)] + [(7, "again"), (None, "no id"), (9999, None)]
    spark.createDataFrame(data, "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    read, listed = streams.read_documents, []
    monkeypatch.setattr(streams, "FILES_AT_ONCE", 100)
    monkeypatch.setattr(streams.work, "FOLDER", 10)
    monkeypatch.setattr(streams, "read_documents", lambda s, p: listed.append(read(s, p)) or listed[-1])
    got = sorted((x["name"] or "", x["characters"], x["bytes"]) for x in streams.scanned_files(spark, str(tmp_path)).collect())
    assert got == sorted((f"d{i}" if i is not None else "", len(t or "") + 1, len((t or "").encode()) + 1) for i, t in data)
    assert len(listed) == 4 and max(len(set(f.inputFiles())) for f in listed) < 200
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert streams.scanned_files(spark, f"{tmp_path}/none").count() == 0
