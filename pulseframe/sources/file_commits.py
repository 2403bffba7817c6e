"""Files written as one transaction by a Python data source: after a job all of its files are there, or none.

``write_committed`` takes the chunks of ``sinks.file_chunks``. Tasks write below ``_tasks`` in the folder, each attempt to its own places of at most PLACE_ENTRIES folders, and tell the
driver how many these are and no more. The commit notes the places of the attempts that count in ``_commits/<job>.pending``, moves their folders (whole where the folder is new, else file by file) and then
takes the note away for ``_commits/<job>.done``; :func:`recover` does the rest of a commit that was cut off. A job that was done before changes nothing, so a stream's
``foreachBatch`` can name a job by its batch number. ``_index`` has a Parquet file for each place: path, bytes, chunks of each file. By it tasks read the files back
(``committed_contents``), so that the driver never lists them: its memory grows with the number of places, not of files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice
from typing import Any
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from ..schema import StreamError

NAME = "pulse_files"
TASKS, COMMITS, INDEX = "_tasks", "_commits", "_index"
FOUND = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("chunks", pa.int64())])
MOVERS = 16
#: Folders (without keys: files) of a place, and files; moves that the driver holds at a time.
PLACE_ENTRIES, PLACE_FILES, MOVED_AT_ONCE = 1000, 50_000, 1024
#: Bytes and files of a batch that is read back.
READ_BYTES, READ_FILES = 8_000_000, 1000


@dataclass
class Attempt(ds.WriterCommitMessage):
    """Where a task's attempt wrote, relative to the folder: so many numbered places; none if it had no rows."""

    place: str
    parts: int


def file_path(keys: Sequence[Any], filename: str) -> str:
    """A file's place in the folder: a level for each key, quoted, ``%null`` for null; names that leave the folder or are the folder's own are errors."""
    parts = filename.split("/")
    if any(p in ("", ".", "..") for p in parts) or (not keys and parts[0] in (TASKS, COMMITS, INDEX)):
        raise StreamError(f"{filename!r} can't be the name of a file")
    levels = ["%null" if k is None else quote(str(k), safe="").replace(".", "%2E") for k in keys]
    # a key that is empty or like a folder of the writer is still a level of its own
    levels = [f"%{x}" if x in ("", TASKS, COMMITS, INDEX) else x for x in levels]
    return "/".join([*levels, *parts])


def _opened(folder: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _text(store: Any, path: str, text: str) -> None:
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(text.encode())


def _files(store: Any, path: str) -> list[str]:
    from pyarrow import fs

    return [x.path for x in store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if x.type == fs.FileType.File]


def _exists(store: Any, path: str) -> bool:
    from pyarrow import fs

    return store.get_file_info(path).type != fs.FileType.NotFound


def _drop(store: Any, path: str) -> None:
    if _exists(store, path):
        store.delete_dir(path)


def finish_commit(folder: str, job: str) -> None:
    """Move what the note of a job names, then mark the job as done; can be repeated after any interruption."""
    from pyarrow import fs

    store, base = _opened(folder)
    note = f"{base}/{COMMITS}/{job}.pending"
    with store.open_input_stream(note) as held:
        own, places = json.loads(held.read())

    def move(source: str, target: str, is_file: bool) -> tuple[str, str] | None:
        """Move a file, or a folder whole if there is none at its target; else what is in it has to be moved."""
        there = store.get_file_info(target).type
        if not is_file and there != fs.FileType.NotFound:
            return source, target
        if there != fs.FileType.NotFound:
            store.delete_file(target)
        store.move(source, target)
        return None

    def listed(source: str, target: str) -> Iterator[tuple[str, str, bool]]:
        for x in store.get_file_info(fs.FileSelector(source)):
            yield x.path, f"{target}/{x.base_name}", x.type == fs.FileType.File

    with ThreadPoolExecutor(MOVERS) as pool:
        for place in places:
            # what is gone from here was moved before; folders are listed one at a time
            levels = [iter([(f"{base}/{place}", base, False)])] if _exists(store, f"{base}/{place}") else []
            while levels:
                todo = list(islice(levels[-1], MOVED_AT_ONCE))
                if not todo:
                    levels.pop()
                levels += [listed(*x) for x in pool.map(lambda x: move(*x), todo) if x is not None]
    _text(store, f"{base}/{COMMITS}/{job}.done", "")
    store.delete_file(note)
    _drop(store, f"{base}/{TASKS}/{own}")


def recover(folder: str) -> int:
    """Finish commits of a folder that were cut off; how many there were. Not while jobs write to it."""
    store, base = _opened(folder)
    pending = [x.rsplit("/", 1)[1].removesuffix(".pending") for x in _files(store, f"{base}/{COMMITS}") if x.endswith(".pending")]
    for job in pending:
        finish_commit(folder, job)
    return len(pending)


class FileWriter(ds.DataSourceArrowWriter):
    """Writes rows (keys, window, filename, chunk, data) that are sorted by file in each task."""

    def __init__(self, options: dict[str, str], keys: int):
        self.folder, self.keys = options["path"], keys
        self.job = options.get("job") or uuid.uuid4().hex
        # a job that runs again, or twice at once, has another place each time
        self.own = f"{self.job}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        store, base = _opened(self.folder)
        attempt = TaskContext.get().taskAttemptId()
        place = f"{TASKS}/{self.own}/{attempt}"
        out, name, top, size, chunks, parts, entries = None, None, None, 0, 0, 0, 0
        found: list[tuple] = []

        def indexed() -> None:
            table = pa.table([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), FOUND, strict=True)], schema=FOUND)
            store.create_dir(f"{base}/{place}/{parts}/{INDEX}", recursive=True)
            with store.open_output_stream(f"{base}/{place}/{parts}/{INDEX}/{self.own}-{attempt}-{parts}.parquet") as held:
                pq.write_table(table, held)

        try:
            for batch in iterator:
                ids = [batch.column(i).to_pylist() for i in range(self.keys)]
                for i, (filename, data) in enumerate(zip(batch.column(self.keys + 1).to_pylist(), batch.column(self.keys + 3), strict=True)):
                    own = file_path([x[i] for x in ids], filename)
                    if own != name:
                        if out is not None:
                            out.close()
                            found.append((name, size, chunks))
                        entry = own.split("/", 1)[0]
                        if entries + (entry != top) > PLACE_ENTRIES or len(found) >= PLACE_FILES:
                            indexed()
                            found, top, parts, entries = [], None, parts + 1, 0
                        entries, top = entries + (entry != top), entry
                        at = f"{base}/{place}/{parts}/{own}"
                        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                        out, name, size, chunks = store.open_output_stream(at), own, 0, 0
                    out.write(data.as_buffer())
                    size, chunks = size + len(data.as_buffer()), chunks + 1
        finally:
            if out is not None:
                out.close()
        if name is None:
            return Attempt(place, 0)
        found.append((name, size, chunks))
        indexed()
        return Attempt(place, parts + 1)

    def commit(self, messages: list[Attempt | None]) -> None:
        store, base = _opened(self.folder)
        if _exists(store, f"{base}/{COMMITS}/{self.job}.done"):
            return _drop(store, f"{base}/{TASKS}/{self.own}")
        if _exists(store, f"{base}/{COMMITS}/{self.job}.pending"):
            # an earlier run of the job was cut off within its commit: its files count
            _drop(store, f"{base}/{TASKS}/{self.own}")
        else:
            _text(store, f"{base}/{COMMITS}/{self.job}.pending", json.dumps([self.own, [f"{m.place}/{i}" for m in messages if m is not None for i in range(m.parts)]]))
        finish_commit(self.folder, self.job)

    def abort(self, messages: list[Attempt | None]) -> None:
        store, base = _opened(self.folder)
        _drop(store, f"{base}/{TASKS}/{self.own}")


class FilesSource(ds.DataSource):
    """Chunks of files, written to ``path`` as one transaction."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "window long, filename string, chunk long, data binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> FileWriter:
        if overwrite or "path" not in self.options:
            raise StreamError("files are appended, to a path")
        if schema.names[-4:] != ["window", "filename", "chunk", "data"]:
            raise StreamError("chunks of files are keys, window, filename, chunk, data")
        return FileWriter(dict(self.options), len(schema.names) - 4)


def write_committed(chunks: DataFrame, folder: str, keys: Sequence[str] = (), job: str | None = None) -> None:
    """Write ``chunks`` (keys, window, filename, chunk, data) to files below a folder that all executors share, all or none.

    A file is written by one task, its windows one after the other. A file that is there already is replaced. ``job`` names the transaction: one
    that was done before is left as it is.
    """
    if job is not None and (not job or "/" in job or job.startswith(".")):
        raise StreamError(f"{job!r} can't be the name of a job")
    chunks.sparkSession.dataSource.register(FilesSource)
    rows = chunks.select(*keys, "window", "filename", "chunk", "data")
    # by range, so that the folder of a key lies in one task, or in a few if it is large, and is moved as a whole
    rows = (rows.repartitionByRange(*keys, "filename") if keys else rows.repartition("filename")).sortWithinPartitions(*keys, "filename", "window", "chunk")
    options = {"path": folder} | ({"job": job} if job is not None else {})
    rows.write.format(NAME).mode("append").options(**options).save()


def committed_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes, chunks of the files of all done jobs; of a file that was written again a row for each time."""
    store, base = _opened(folder)
    kinds = "path string, bytes long, chunks long"
    return spark.read.schema(kinds).parquet(f"{folder}/{INDEX}") if _exists(store, f"{base}/{INDEX}") else spark.createDataFrame([], kinds)


def committed_contents(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of the files of all done jobs, each once; tasks read them, dealt out by the index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _opened(folder)
        paths: list[str] = []
        data: list[bytes] = []
        size = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{path}") as held:
                    data.append(held.read())
                paths.append(path)
                size += len(data[-1])
                if size >= READ_BYTES or len(paths) >= READ_FILES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(data, pa.binary())], names=["path", "content"])
                    paths, data, size = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(data, pa.binary())], names=["path", "content"])

    return committed_files(spark, folder).select("path").distinct().mapInArrow(read, "path string, content binary")
