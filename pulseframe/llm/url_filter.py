"""URL rules in a sorted digest array.

Rules (action, host, path) are kept as 64-bit xxhash keys of host + path in one sorted array, beside the rule
strings. Both are written to the shared folder, sent to each executor as Spark files, and memory-mapped by its
Python workers. A url's candidates, its host and each parent domain with each rule path length, are hashed and
found by one vectorised binary search; the stored full string decides, so that colliding digests do no harm.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder

Rule = tuple[str, str, str]

#: Most rules of one pair of files.
FILE_RULES = 5_000_000

RESULT = "page_id long, host string, path string, rule string, verdict string"


def digest_file(rules: Sequence[Rule]) -> tuple[bytes, bytes]:
    """The sorted digests as .npy bytes, and the rule strings with their offsets as an Arrow file, in that order.

    A later rule for the same host and path replaces an earlier one.
    """
    actions = {host.lower() + path: action for action, host, path in rules}
    texts = sorted(actions, key=xxhash.xxh64_intdigest)
    held = io.BytesIO()
    np.save(held, np.array([xxhash.xxh64_intdigest(x) for x in texts], np.uint64))
    sink = pa.BufferOutputStream()
    rows = pa.table({"rule": pa.array(texts, pa.large_string()), "action": pa.array([actions[x] for x in texts], pa.large_string())})
    with pa.ipc.new_file(sink, rows.schema) as out:
        out.write_table(rows)
    return held.getvalue(), sink.getvalue().to_pybytes()


class DigestArray:
    """Memory-mapped view of a pair of files."""

    def __init__(self, digests: str, strings: str):
        self.digests = np.load(digests, mmap_mode="r")
        held = pa.ipc.open_file(pa.memory_map(strings)).read_all().combine_chunks()
        self.rules, self.actions = held.column("rule"), held.column("action")

    def find(self, keys: list[str]) -> np.ndarray:
        """Position of each string in the array, -1 where it is absent."""
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, wanted)
        out = np.full(len(keys), -1, np.int64)
        inside = np.flatnonzero(at < len(self.digests))
        for i in inside[self.digests[at[inside]] == wanted[inside]]:
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == wanted[i]:
                if self.rules[k].as_py() == keys[i]:
                    out[i] = k
                    break
                k += 1
        return out


@cache
def opened(digests: str, strings: str) -> DigestArray:
    return DigestArray(digests, strings)


#: A-Z only; other letters stay as they are.
LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    scheme, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:end].translate(LOWER), tail[:stop]


def candidates(host: str, path: str, lengths: Sequence[int], labels: int, longest: int) -> Iterator[str]:
    """The host and its parent domains of at most ``labels`` labels and ``longest`` characters with each prefix of the path that has a rule's length.

    No rule has more, so the number and size of candidates depend on the rules and not on the url.
    """
    own = host[-longest - 1 :].rsplit(".", labels)[-labels:] if labels else []
    names = [".".join(own[i:]) for i in range(len(own))]
    for name in names:
        if len(name) <= longest and (len(name) == len(host) or host[-len(name) - 1] == "."):
            for n in lengths:
                if n <= len(path):
                    yield name + path[:n]


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages(page_id, url, ...)``.

    A rule fits its host and all subdomains if the url's path starts with the rule's; of those that fit the
    longest string host + path decides, else ``default``. Of rules for one host and path the last counts. A null or
    empty url, or one without ``://``, has an empty host and path and no rule. Hosts and paths of any length are judged in time and memory that grow with their length alone. Rows that repeat are each judged; other
    columns are not looked at. An empty table gives an empty result. The rules go to every executor as files of at
    most FILE_RULES rules each; they are mapped and not loaded.
    """
    spark = pages.sparkSession
    actions = {(host.lower() + path): (action, host, path) for action, host, path in rules}
    rules = sorted(actions.values())
    lengths = sorted({len(path) for _, _, path in rules})
    labels, longest = max((host.count(".") + 1 for _, host, _ in rules), default=0), max((len(host) for _, host, _ in rules), default=0)
    names: list[list[str]] = []
    for begin in range(0, max(len(rules), 1), FILE_RULES):
        names.append([])
        for content in digest_file(rules[begin : begin + FILE_RULES]):
            path = shared_folder(spark, "url-rules")
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
            out.write(bytearray(content))
            out.close()
            spark.sparkContext.addFile(path)
            names[-1].append(path.rsplit("/", 1)[1])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [opened(*map(SparkFiles.get, pair)) for pair in names]
        for batch in batches:
            parts = [split_url(x) for x in batch.column(1).to_pylist()]
            keys, owner = [], []
            for i, (host, path) in enumerate(parts):
                own = list(candidates(host, path, lengths, labels, longest)) if host else []
                keys += own
                owner += [i] * len(own)
            best: list[tuple[str, str] | None] = [None] * len(parts)
            for array in arrays:
                found = array.find(keys)
                for j in np.flatnonzero(found >= 0):
                    k, i = int(found[j]), owner[j]
                    if best[i] is None or len(keys[j]) > len(best[i][0]):
                        best[i] = keys[j], array.actions[k].as_py()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array([x[k] for x in parts], pa.string()) for k in (0, 1)),
                    pa.array([x and x[0] for x in best], pa.string()),
                    pa.array([x[1] if x else default for x in best], pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(judge, RESULT)
