from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pulseframe.schema import StreamError
from pulseframe.sources import file_commits as fc

SCHEMA = "k string, window long, filename string, chunk long, data binary, extra int"


def files_in(folder):
    """Contents by path, the writer's own folders left out."""
    return {str(p.relative_to(folder)): p.read_bytes() for p in Path(folder).rglob("*") if p.is_file() and not p.relative_to(folder).parts[0].startswith("_") and not p.name.startswith(".")}


def chunks(spark):
    rows = [(k, w, f"f{f}.bin", c, f"{k}{w}{f}{c};".encode(), 1) for k in ("a", None, "x/../y") for w in (0, 1) for f in range(5) for c in range(3)]
    want = {}
    for k, _, name, _, data, _ in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1], r[3])):
        path = f"{ {'a': 'a', None: '%null'}.get(k, 'x%2F%2E%2E%2Fy') }/{name}"
        want[path] = want.get(path, b"") + data
    return spark.createDataFrame(rows[::-1], SCHEMA).repartition(7), want


def test_files_and_index(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows, want = chunks(spark)
    fc.write_committed(rows, folder, ["k"])
    assert files_in(folder) == want
    assert {r["path"]: (r["bytes"], r["chunks"]) for r in fc.committed_files(spark, folder).collect()} == {p: (len(d), 6) for p, d in want.items()}
    assert not list((tmp_path / "out" / "_tasks").iterdir())
    fc.write_committed(rows.limit(0), folder, ["k"])
    assert files_in(folder) == want


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows, _ = chunks(spark)
    # the task of one file fails after others have been written
    bad = rows.withColumn("data", F.when((F.col("filename") == "f3.bin") & (F.col("chunk") == 2) & (F.col("window") == 1), F.raise_error("broken").cast("binary")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="broken"):
        fc.write_committed(bad, folder, ["k"])
    assert files_in(folder) == {} and not (tmp_path / "out" / "_index").exists()
    for name in ("../up", "a//b", ""):
        with pytest.raises(Exception, match="can't be the name"):
            fc.write_committed(rows.withColumn("filename", F.lit(name)), folder, ["k"])
    assert files_in(folder) == {} and not (tmp_path / "up").exists()


def test_a_job_counts_once(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows, want = chunks(spark)
    fc.write_committed(rows, folder, ["k"], job="batch-0")
    fc.write_committed(rows.withColumn("data", F.lit(b"other")), folder, ["k"], job="batch-0")
    assert files_in(folder) == want and fc.committed_files(spark, folder).count() == len(want)
    with pytest.raises(StreamError):
        fc.write_committed(rows, folder, ["k"], job="a/b")


def test_attempts_that_do_not_count_are_left_out(tmp_path):
    """A task that ran twice, and a commit that was cut off after some files were moved."""
    folder = tmp_path / "out"
    for attempt, text in ((1, b"lost"), (2, b"kept")):
        for name in ("a/x", "a/y", "b/z"):
            at = folder / "_tasks" / "job-own" / str(attempt) / name
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_bytes(text)
    (folder / "_commits").mkdir()
    (folder / "_commits" / "job.pending").write_text(json.dumps(["job-own", ["_tasks/job-own/2"]]))
    (folder / "a").mkdir()
    (folder / "_tasks/job-own/2/a/x").rename(folder / "a/x")
    assert fc.recover(str(folder)) == 1
    assert files_in(folder) == {"a/x": b"kept", "a/y": b"kept", "b/z": b"kept"}
    assert fc.recover(str(folder)) == 0 and not (folder / "_tasks" / "job-own").exists()


def test_as_the_sink_of_a_stream(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "out")
    rows, want = chunks(spark)
    rows.coalesce(1).write.parquet(str(source))
    for _ in range(2):
        # the second run has no checkpoint and sends batch 0 again
        query = spark.readStream.schema(SCHEMA).parquet(str(source)).writeStream.foreachBatch(lambda df, n: fc.write_committed(df, folder, ["k"], job=f"batch-{n}"))
        run = query.option("checkpointLocation", str(tmp_path / f"state-{_}")).trigger(availableNow=True).start()
        assert run.awaitTermination(120) and run.exception() is None
    assert files_in(folder) == want and fc.committed_files(spark, folder).count() == len(want)


def test_folders_of_keys_are_moved_whole(spark, tmp_path, monkeypatch):
    """The driver moves a folder for each key and not each of its files, unless the folder is there already."""
    from concurrent.futures import ThreadPoolExecutor

    folder = tmp_path / "out"
    for attempt, keys in ((1, range(5)), (2, range(4, 8))):
        for k in keys:
            at = folder / "_tasks" / "job-own" / str(attempt) / str(k)
            at.mkdir(parents=True)
            for i in range(20):
                (at / f"{attempt}-{i}").write_text(f"{k} {i}")
    (folder / "_commits").mkdir()
    (folder / "_commits" / "job.pending").write_text(json.dumps(["job-own", ["_tasks/job-own/1", "_tasks/job-own/2"]]))
    moved = 0

    class Counted(ThreadPoolExecutor):
        def map(self, f, todo, **more):
            nonlocal moved
            todo = list(todo)
            moved += len(todo)
            return super().map(f, todo, **more)

    monkeypatch.setattr(fc, "ThreadPoolExecutor", Counted)
    fc.finish_commit(str(folder), "job")
    assert sum(x.is_file() for x in folder.glob("[0-9]/*")) == 9 * 20 and (folder / "4" / "2-3").read_text() == "4 3"
    # both places, nine folders, and the files of the one that was there
    assert moved == 2 + 9 + 20 and not (folder / "_tasks" / "job-own").exists()


def test_the_driver_holds_few_files_at_a_time(spark, tmp_path, monkeypatch):
    """Files lie in places of few folders and files, and the commit lists one place and moves a few at a time, over new folders and over those that are there."""
    import pyarrow as pa
    import pyspark
    from pyarrow import fs

    folder, longest = str(tmp_path / "out"), 0

    class Store:
        def __getattr__(self, name):
            return getattr(fs.LocalFileSystem(), name)

        def get_file_info(self, x):
            nonlocal longest
            found = fs.LocalFileSystem().get_file_info(x)
            longest = max(longest, len(found)) if isinstance(x, fs.FileSelector) else longest
            return found

    class Task:
        def taskAttemptId(self):  # noqa: N802
            return 7

    monkeypatch.setattr(fc, "PLACE_ENTRIES", 5)
    monkeypatch.setattr(fc, "PLACE_FILES", 8)
    monkeypatch.setattr(fc, "MOVED_AT_ONCE", 3)
    monkeypatch.setattr(fc, "_opened", lambda folder: (Store(), folder))
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: Task()))
    # key 0 has more files than a place, the others one each
    files = [(0, f"f{i:02}") for i in range(30)] + [(k, "f") for k in range(1, 40)]
    want = {f"{k}/{name}": name.encode() * 2 for k, name in files}
    for job, times in (("one", 1), ("two", 2)):
        writer = fc.FileWriter({"path": folder, "job": job}, 1)
        rows = [[k, 0, name, c, name.encode()] for k, name in files for c in range(2)]
        batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["k", "window", "filename", "chunk", "data"])
        found = writer.write(iter([batch.slice(0, 25), batch.slice(25)]))
        # four places for key 0, the last with two keys more, and eight for 37 keys
        assert found.parts == 4 + 8
        writer.commit([found, None])
        # a place has its index beside eight files or five folders
        assert longest == 8 and files_in(folder) == want and not (tmp_path / "out" / "_tasks" / writer.own).exists()
        index = fc.committed_files(spark, folder)
        assert index.count() == times * len(want) and {r["path"]: (r["bytes"], r["chunks"]) for r in index.collect()} == {p: (len(d), 2) for p, d in want.items()}
        assert len(list((tmp_path / "out" / "_index").glob("*.parquet"))) == times * 12


def test_contents_are_read_by_the_index(spark, tmp_path, monkeypatch):
    """The query of committed files reads them in tasks; the driver lists no folder but the index. Each file counts once, with its last content."""
    from pulseframe.plans import file_queries as q

    folder = str(tmp_path / "out")
    rows, want = chunks(spark)
    fc.write_committed(rows, folder, ["k"])
    fc.write_committed(rows.withColumn("data", F.lit(b"new")), folder, ["k"])
    found = fc.committed_contents(spark, folder)
    assert {r["path"]: bytes(r["content"]) for r in found.collect()} == dict.fromkeys(want, b"new" * 6) and found.count() == len(want)
    seen = q.k1_committed_files(spark, "/root/testdata/sf0.001")
    listed = seen.inputFiles()
    assert listed and all("/_index/" in x for x in listed) and seen.count() > 100


def test_nothing_written_is_nothing_read(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows, _ = chunks(spark)
    fc.write_committed(rows.limit(0), folder, ["k"])
    assert fc.committed_files(spark, folder).count() == 0 and fc.committed_contents(spark, folder).count() == 0
