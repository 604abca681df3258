"""Best-fit packing by sums of squares.

A bin's state is how full it is, ``level`` = window - gap; N(l) counts the open
bins of level l.  A piece of length a goes where the sum of N(l)^2 becomes
smallest: moving a bin from l to l + a changes it by 2 (N(l + a) - N(l) + 1), a
new bin by 2 N(a) + 1, and a bin that becomes full by 1 - 2 N(l).  No kind of gap
then grows common, so pieces that close bins exactly stay easy to find.

1. Every document is tokenised once; only pieces longer than a window are cut.
   Full windows are sequences of their own.
2. The other pieces are dealt by a hash to buckets of about ``rows_per_bucket``
   and each bucket is packed by itself, the longest piece first; bins left with
   a gap are dissolved and their pieces packed again while that saves bins.
3. The pieces of bins that still have a gap go to the next round, where buckets
   hold what many left over, until one bucket is enough or most of a round's
   pieces stay in open bins (their lengths do not combine, more company does
   not help).  No task sees more than a bucket and the driver only counts.

A white-space-delimited chunk of text has the same ids wherever it stands (the
tokenizer drops white space, no token spans it), so ids are kept per part of one.

Defined results: a null or empty text is one piece holding the end id; repeated
rows are packed one by one; an empty table gives an empty result; other columns
are ignored whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvigil.llm.textkit import durable, parts, worker_cache

WINDOW = 2048
END_ID = 0
ROWS_PER_BUCKET = 1 << 15
LOCAL_BITS = 22          # sequence numbers of one bucket
PARTS_KEPT, PART_CHARS = 1 << 18, 64
STAY_OPEN = 0.5


#: characters whose lower case, composition and class need no tables: printable
#: ASCII and Latin letters without combining marks or special casing
PLAIN = re.compile("[\t-\r -~\u00a1-\u012f\u0131-\u017f]*")


class WordIds(dict):
    """Ids (little-endian uint32 bytes) of UTF-8 texts by the tokenizer file's own
    library.

    A plain text is lower-cased and split here by the file's own pattern; its
    parts go to the library's merges alone, and their ids are kept here, a
    bounded number in two generations so that common parts survive.  Any other
    text is taken chunk by chunk: plain chunks in the same way, the rest, and what
    may hold a special token, through the whole library.  Both ways must agree on
    a probe, or all goes through the library."""

    PROBE = "Don't they'LL über-Ĳsel, 12½²x «ñandú»!! ªº µ's''re Straße _a_ ſ ŉ ĸ ­ ¿Qué? ~|` ÷× ŸŽ&#x27;"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.merges = self.own.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.split = regex.compile(splits[0]).findall
        self.special = tuple(t["content"][:2] for t in spec.get("added_tokens", []))
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(256 + i) for i, b in enumerate(hidden)}  # byte-level names
        self.old: dict[str, bytes] = {}
        self.other: dict[str, bytes] = {}
        self.plain = len(splits) == 1
        self.plain = self.plain and self.ids(self.PROBE) == self._whole(self.PROBE)

    def _whole(self, chunk: str) -> bytes:
        return array("I", self.own.encode(chunk, add_special_tokens=False).ids).tobytes()

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            named = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.merges.tokenize(named)]).tobytes()
        if len(part) <= PART_CHARS:
            if len(self) >= PARTS_KEPT:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids

    def _is_plain(self, text: str) -> bool:
        return self.plain and PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def _chunk(self, chunk: str) -> bytes:
        if self._is_plain(chunk):
            return b"".join(map(self.__getitem__, self.split(chunk.lower())))
        ids = self.other.get(chunk)
        if ids is None:
            ids = self._whole(chunk)
            if len(chunk) <= PART_CHARS:
                if len(self.other) >= PARTS_KEPT:
                    self.other.clear()
                self.other[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if self._is_plain(text):
            return b"".join(map(self.__getitem__, self.split(text.lower())))
        return b"".join(self._chunk(c.decode()) for c in text.encode().split())  # ASCII white space


def cut_pieces(df: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID,
               key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32[, ids])."""
    src = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("text"))
    end, step = np.array([end_id], "<u4").tobytes(), 4 * window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        if ("words", tokenizer_path) not in cache:
            cache["words", tokenizer_path] = WordIds(tokenizer_path)
        tok = cache["words", tokenizer_path]
        for b in parts(batches):
            rows, ids = [], []
            for k, t in zip(b.column("k").to_pylist(), b.column("text").to_pylist()):
                raw = tok.ids(t or "") + end
                for s in range(0, len(raw), step):
                    part = raw[s:s + step]
                    rows.append((k, s // step, s // 4, len(part) // 4, zlib.crc32(part)))
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
            names = ["k", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            if rows:
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "k long, piece long, start long, length long, ids_crc32 long"
    return src.mapInArrow(cut, schema + (", ids array<int>" if keep_ids else "")) \
        .withColumnRenamed("k", key)


# ----------------------------------------------------------------- one bucket
def sum_of_squares(lengths, window: int) -> list[list[int]]:
    """Pack lengths (all from 1 to ``window``) in the given order: bins, each a
    list of indices.  Ties go to the fullest bin."""
    count = np.zeros(window + 1)
    count[0], count[window] = 0.5, -0.5  # makes a new and a full bin fit the common formula
    open_: list[list[list[int]]] = [[] for _ in range(window + 1)]
    bins: list[list[int]] = []
    for i, a in enumerate(lengths):
        have = count[:window + 1 - a]
        change = np.where(have > 0, count[a:] - have, np.inf)
        level = len(change) - 1 - int(change[::-1].argmin())
        if level:
            count[level] -= 1
            b = open_[level].pop()
        else:
            b = []
            bins.append(b)
        b.append(i)
        if level + a < window:
            count[level + a] += 1
            open_[level + a].append(b)
    return bins


def pack_lengths(lengths: np.ndarray, window: int) -> tuple[list[list[int]], int]:
    """Bins of indices, the full ones first, and the number of full ones: longest
    first, then bins with a gap are dissolved and packed again while that saves
    bins."""
    todo = np.argsort(-lengths, kind="stable")
    full: list[list[int]] = []
    best: list[list[int]] | None = None
    while len(todo):
        bins = [[int(todo[i]) for i in b] for b in sum_of_squares(lengths[todo].tolist(), window)]
        if best is not None and len(bins) >= len(best):
            break
        filled = [b for b in bins if lengths[b].sum() == window]
        full += filled
        best = [b for b in bins if lengths[b].sum() < window]
        left = np.array(sorted((i for b in best for i in b), key=lambda i: (-lengths[i], i)), np.int64)
        if not filled:
            break
        todo = left
    return full + (best or []), len(full)


def pack(pieces: DataFrame, window: int = WINDOW, key: str = "doc_id",
         rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add sequence_id and offset to pieces (key, piece, length, ids_crc32, ...),
    which should be durable: they are read several times."""
    if window >= 1 << LOCAL_BITS or rows_per_bucket >= 1 << (LOCAL_BITS - 2):
        raise ValueError("window or rows_per_bucket too large")
    names = pieces.columns
    done = [pieces.where(F.col("length") == window).withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})]
    left = pieces.where(F.col("length") < window)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields]
                       + ["sequence_id long", "offset long", "_settled boolean"])

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), *((c, "ascending") for c in
                                                           (key, "piece", "ids_crc32"))])
        lengths = table.column("length").to_numpy()
        bins, n_full = pack_lengths(lengths, window)
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for j, b in enumerate(bins):
            seq[b] = j
            off[b] = np.cumsum(lengths[b]) - lengths[b]
        base = table.column("_base").to_numpy()
        return pa.table({**{c: table.column(c) for c in names}, "sequence_id": base + seq, "offset": off,
                         "_settled": seq < n_full})

    n, number = left.count(), 0
    while n:
        buckets = -(-n // rows_per_bucket)
        if (number + buckets) >> (62 - LOCAL_BITS):
            raise ValueError("too many buckets")
        bucket = F.pmod(F.xxhash64(key, "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(buckets))
        base = (F.lit(number) + bucket) * F.lit(1 << LOCAL_BITS)
        placed = durable(left.withColumn("_base", base).groupBy("_base").applyInArrow(place, schema))
        number += buckets
        open_ = placed.where("not _settled").count()
        if buckets == 1 or open_ > STAY_OPEN * n:
            done.append(placed.drop("_settled"))
            break
        done.append(placed.where("_settled").drop("_settled"))
        left, n = placed.where("not _settled").select(*names), open_
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def pack_documents(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text",
                   rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Tokenise, cut and pack every document: the contract's columns."""
    pieces = durable(cut_pieces(df, tokenizer_path, key=key, text=text))
    return pack(pieces, key=key, rows_per_bucket=rows_per_bucket).select(
        key, F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id",
        "offset")
