"""JSON logs in many tasks: a Python data source that cuts a file's records out
of byte ranges (S1, S2).

A JSON array on many lines is one record to Spark's reader, so a file is one
task.  Here a file is cut into ranges, and where records begin is found in two
passes:

1. Every range is scanned once without knowing what came before, for both
   cases -- it begins inside a string, or outside.  What is left of a range is
   small: whether it ends inside a string, how the nesting changes, and its
   lowest nesting, for either case.
2. The driver folds these in order, one row a range, which gives each range its
   true case and nesting; the ranges that reach the top level name the keys there.
3. A range's task then reads the records that begin in it, each to its end,
   and a record's number is its place after the records of earlier ranges.

Records are the objects directly in the top array, or in the array under ``key`` of
the top object (``{"logs": [...]}``).  Other things there (numbers, strings) are no
records.  Files must be plain JSON in UTF-8, not compressed; a file that is no
such array gives no rows.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 16 << 20
BATCH_RECORDS = 4096
QUOTE, BACKSLASH = 0x22, 0x5C
OPEN, CLOSE = (0x7B, 0x5B), (0x7D, 0x5D)


# ------------------------------------------------------------------ files
def _files(path: str):
    from pyarrow import fs
    where, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") \
        else (fs.LocalFileSystem(), os.path.abspath(path))
    return where, inside


def list_files(path: str) -> list[tuple[str, int]]:
    """(file, size) under a path, in order; hidden ones left out."""
    from pyarrow import fs
    where, inside = _files(path)
    info = where.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        return []
    infos = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(inside, recursive=True))
    return sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File
                  and not os.path.basename(i.path).startswith(("_", ".")))


def read_range(path: str, inside: str, start: int, size: int) -> bytes:
    where, _ = _files(path)
    with where.open_input_file(inside) as f:
        return f.read_at(size, start)


# -------------------------------------------------------------- one range
def quotes_of(data: np.ndarray, before: bytes) -> np.ndarray:
    """Places of quotes that are not escaped; ``before`` is what precedes."""
    at = np.flatnonzero(data == QUOTE)
    if not len(at):
        return at
    slash = data == BACKSLASH
    idx = np.arange(len(data))
    last_other = np.maximum.accumulate(np.where(slash, -1, idx))  # last place that is no backslash
    run = np.where(at > 0, at - 1 - last_other[np.maximum(at - 1, 0)], 0)
    carry = len(before) - len(before.rstrip(b"\\"))
    run = run + np.where(at - run == 0, carry, 0)  # the run goes on before the range
    return at[run % 2 == 0]


def nesting(data: np.ndarray, quotes: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """(places of brackets outside strings, nesting after each, from 0)."""
    kind = np.zeros(256, np.int8)
    kind[list(OPEN)], kind[list(CLOSE)] = 1, -1
    step = kind[data]
    at = np.flatnonzero(step)
    in_string = (np.searchsorted(quotes, at) + inside) % 2 == 1
    at = at[~in_string]
    return at, np.cumsum(step[at], dtype=np.int64)


@dataclass
class Summary:
    """What a range does, by the case it begins in: ends inside a string,
    change of nesting, lowest nesting on the way."""

    ends: tuple[bool, bool]
    change: tuple[int, int]
    lowest: tuple[int, int]


def summarize(data: bytes, before: bytes) -> Summary:
    raw = np.frombuffer(data, np.uint8)
    quotes = quotes_of(raw, before)
    ends, change, lowest = [], [], []
    for inside in (False, True):
        _, level = nesting(raw, quotes, inside)
        ends.append((len(quotes) + inside) % 2 == 1)
        change.append(int(level[-1]) if len(level) else 0)
        lowest.append(min(0, int(level.min())) if len(level) else 0)
    return Summary(tuple(ends), tuple(change), tuple(lowest))


def record_starts(data: bytes, before: bytes, inside: bool, level: int, depth: int) -> np.ndarray:
    """Places of the objects that open at nesting ``depth`` (before them)."""
    raw = np.frombuffer(data, np.uint8)
    at, after = nesting(raw, quotes_of(raw, before), inside)
    return at[(raw[at] == OPEN[0]) & (after + level == depth + 1)]


def top_arrays(data: bytes, before: bytes, inside: bool, level: int) -> list[tuple[int, bool, str | None]]:
    """(place, opens, key) of the arrays directly under the top object."""
    raw = np.frombuffer(data, np.uint8)
    quotes = quotes_of(raw, before)
    at, after = nesting(raw, quotes, inside)
    after = after + level
    out = []
    for i, a in zip(at.tolist(), after.tolist()):
        if raw[i] == OPEN[1] and a == 2:
            head = (before + data[:i]).rstrip()
            out.append((i, True, _key_before(head)))
        elif raw[i] == CLOSE[1] and a == 1:
            out.append((i, False, None))
    return out


def _key_before(head: bytes) -> str | None:
    """The key whose value is about to begin after ``head``, if it is there."""
    if not head.endswith(b":"):
        return None
    head = head[:-1].rstrip()
    start = len(head) - 1
    while start > 0:
        start = head.rfind(b'"', 0, start)
        if start < 0:
            return None
        slashes = len(head[:start]) - len(head[:start].rstrip(b"\\"))
        if slashes % 2 == 0:
            try:
                return json.loads(head[start:])
            except ValueError:
                return None
    return None


LOOK_BACK = 4096           # bytes before a range that a key or a run of backslashes may take


# ---------------------------------------------------------- the data source
@dataclass
class RecordRange(InputPartition):
    path: str
    file: str
    start: int
    end: int
    size: int
    inside: bool
    level: int
    depth: int
    windows: list          # [from, to) places of the file whose objects are records
    first: int             # number of the range's first record


class RangeReader(DataSourceReader):
    def __init__(self, ranges: list[RecordRange]):
        self.ranges = ranges

    def partitions(self):
        return self.ranges

    def read(self, part: RecordRange):
        rows = []
        for pos, raw in records_of(part):
            rows.append((part.file, pos, raw))
            if len(rows) >= BATCH_RECORDS:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list) -> pa.RecordBatch:
    f, p, j = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(p, pa.int64()), pa.array(j, pa.string())],
                                      ["file", "file_pos", "json"])


def _in_windows(at: np.ndarray, windows: list) -> np.ndarray:
    ok = np.zeros(len(at), bool)
    for a, b in windows:
        ok |= (at >= a) & (at < b)
    return at[ok]


def records_of(part: RecordRange):
    """(number, text) of the records that begin in a range."""
    back = min(part.start, LOOK_BACK)
    data = read_range(part.path, part.file, part.start - back, part.end - part.start + back)
    before, data = data[:back], data[back:]
    starts = record_starts(data, before, part.inside, part.level, part.depth)
    starts = _in_windows(starts + part.start, part.windows) - part.start
    if not len(starts):
        return
    raw = np.frombuffer(data, np.uint8)
    at, after = nesting(raw, quotes_of(raw, before), part.inside)
    closes = at[(after + part.level == part.depth) & (raw[at] == CLOSE[0])]
    for i, s in enumerate(starts.tolist()):
        j = np.searchsorted(closes, s)
        if j < len(closes):
            text = data[s:int(closes[j]) + 1]
        else:  # it ends in a later range
            text = _to_end(part, data[s:])
            if text is None:
                return
        yield part.first + i, text.decode("utf-8", "replace")


def _to_end(part: RecordRange, text: bytes) -> bytes | None:
    """A record from its begin on, read on until it closes."""
    at, step = part.end, 1 << 16
    while True:
        raw = np.frombuffer(text, np.uint8)
        close, after = nesting(raw, quotes_of(raw, b""), False)
        done = np.flatnonzero(after == 0)
        if len(done):
            return text[:int(close[done[0]]) + 1]
        if at >= part.size:
            return None
        text += read_range(part.path, part.file, at, min(step, part.size - at))
        at += step
        step = min(step * 2, RANGE_BYTES)


def plan_ranges(spark: SparkSession, path: str, key: str | None, range_bytes: int) -> list[RecordRange]:
    """The ranges of all files under a path with their true beginnings."""
    files = list_files(path)
    jobs = [(f, s, min(s + range_bytes, n), n) for f, n in files for s in range(0, max(n, 1), range_bytes)]
    if not jobs:
        return []
    table = spark.createDataFrame([(i, *j) for i, j in enumerate(jobs)], "i long, file string, a long, b long, n long") \
        .repartition(min(len(jobs), 4 * spark.sparkContext.defaultParallelism), "i")

    def look(r) -> tuple[bytes, bytes]:
        back = min(r["a"], LOOK_BACK)
        data = read_range(path, r["file"], r["a"] - back, r["b"] - r["a"] + back)
        return data[:back], data[back:]

    def scan(batches):
        for b in batches:
            for r in b.to_pylist():
                before, data = look(r)
                s = summarize(data, before)
                yield pa.RecordBatch.from_pylist([{"i": r["i"], "e0": s.ends[0], "e1": s.ends[1], "c0": s.change[0],
                                                   "c1": s.change[1], "l0": s.lowest[0], "l1": s.lowest[1]}])

    got = {r["i"]: r for r in table.mapInArrow(
        scan, "i long, e0 boolean, e1 boolean, c0 long, c1 long, l0 long, l1 long").collect()}
    begins, inside, level = [], False, 0
    for i, (f, a, _, _) in enumerate(jobs):
        if a == 0:
            inside, level = False, 0
        r = got[i]
        begins.append((inside, level, level + r["l1" if inside else "l0"]))
        inside, level = r["e1" if inside else "e0"], level + r["c1" if inside else "c0"]

    depth = 1 if key is None else 2
    windows: dict[str, list] = {f: [(0, n)] for f, n in files} if key is None else {f: [] for f, _ in files}
    state = spark.createDataFrame([(i, *begins[i][:2]) for i in range(len(jobs))], "i long, inside boolean, level long")
    if key is not None:  # the ranges that touch the top object name its arrays
        touch = [i for i, (_, _, low) in enumerate(begins) if low <= 1]

        def tops(batches):
            for b in batches:
                for r in b.to_pylist():
                    before, data = look(r)
                    for at, opens, name in top_arrays(data, before, r["inside"], r["level"]):
                        yield pa.RecordBatch.from_pylist(
                            [{"i": r["i"], "at": r["a"] + at, "opens": opens, "name": name}],
                            pa.schema([("i", pa.int64()), ("at", pa.int64()), ("opens", pa.bool_()),
                                       ("name", pa.string())]))

        found = table.where(F.col("i").isin(touch)).join(state, "i").mapInArrow(
            tops, "i long, at long, opens boolean, name string").collect()
        open_at: dict[str, int] = {}
        for r in sorted(found, key=lambda r: (jobs[r["i"]][0], r["at"])):
            f = jobs[r["i"]][0]
            if r["opens"] and r["name"] == key:
                open_at[f] = r["at"]
            elif not r["opens"] and f in open_at:
                windows[f].append((open_at.pop(f), r["at"]))
        for f, n in files:
            if f in open_at:  # the file breaks off
                windows[f].append((open_at[f], n))

    def count(batches):
        for b in batches:
            for r in b.to_pylist():
                before, data = look(r)
                starts = record_starts(data, before, r["inside"], r["level"], depth) + r["a"]
                yield pa.RecordBatch.from_pylist([{"i": r["i"], "n": len(_in_windows(starts, windows[r["file"]]))}])

    many = {r["i"]: r["n"] for r in table.join(state, "i").mapInArrow(count, "i long, n long").collect()}
    out, first = [], 0
    for i, (f, a, b, n) in enumerate(jobs):
        first = 0 if a == 0 else first
        if many[i]:
            out.append(RecordRange(path, f, a, b, n, begins[i][0], begins[i][1], depth, windows[f], first))
        first += many[i]
    return out


class JsonRanges(DataSource):
    """``spark.read.format("json_ranges")`` of ranges planned before."""

    ranges: list[RecordRange] = []

    @classmethod
    def name(cls):
        return "json_ranges"

    def schema(self):
        return "file string, file_pos long, json string"

    def reader(self, schema):
        return RangeReader(self.ranges)


def read_json_records(spark: SparkSession, path: str, record: T.StructType, key: str | None = None,
                      range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, file_pos, the record's fields) of every object in the top array, or
    in the array under ``key``; a range is a task.  A record that does not parse
    has null fields."""
    ranges = plan_ranges(spark, path, key, range_bytes)
    if not ranges:
        return spark.createDataFrame([], T.StructType([T.StructField("file", T.StringType()),
                                                       T.StructField("file_pos", T.LongType()), *record.fields]))
    source = type("JsonRangesOfPath", (JsonRanges,), {"ranges": ranges})
    spark.dataSource.register(source)
    rows = spark.read.format("json_ranges").load()
    return rows.select("file", "file_pos", F.from_json("json", record, {"mode": "PERMISSIVE"}).alias("r")) \
        .select("file", "file_pos", "r.*")
