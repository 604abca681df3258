"""Exact repeated-substring removal by a depth-limited radix sort of suffixes.

A byte is removed when it lies in a string of ``threshold`` bytes that also
starts in a document with a smaller key.  Suffixes are ordered only through
their first ``threshold`` bytes, most significant digit first; the groups that
are still equal at that depth are exactly the repeated windows.

The passes:

1. First digit: the window's least-hash gram of ``gram`` bytes (a function of
   the window alone, so equal windows share it).  Consecutive windows with one
   gram form a run.  Only the grams' hashes are shuffled, once per cell of
   documents; grams that a single document holds leave the sort here.
2. Runs of the remaining grams (their bytes, once per cell and content) go to
   the gram's bucket.  There runs with the same content are one, and their
   windows are refined digit by digit (8 bytes each) to the full depth;
   windows alone in their group leave at every pass.
3. Each group's smallest key comes back to the runs' cells as byte ranges.

Rows equal in key and text are one row with a count in all passes: each task
sends a text once and its further copies as a number, a cell adds them up, and
the result rows are repeated at the end.

A gram that more than ``hot_cells`` cells hold is not sent to one bucket: its
runs are cut into single windows, dealt by the windows' own bytes.  Cells and
buckets are sized by the text's bytes, so tasks stay bounded as tables grow.

Defined results: a null text is empty; a null key counts as larger than every
key; rows with one key never remove each other's bytes; repeated rows get the
same result each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvigil.llm.textkit import mix, parts, ranges, span_hashes, text_buffer

THRESHOLD = 50
GRAM = 20
CELL_BYTES = 4 << 20
HOT_CELLS = 4096
CHUNK = 1 << 20
COMBINE_ROWS = 200_000     # distinct rows that a task remembers at once
REPEAT_ROWS = 4096
SINGLE = 0xFFFF  # in place of a gram's offset: a window dealt by its own bytes
NO_KEY = np.iinfo(np.int64).max


def gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position, by doubling lengths."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    power = buf.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    size, done, acc = 1, 0, None
    while True:
        if k & size:
            if acc is None:
                acc = power
            else:
                n = len(buf) - done - size + 1
                acc = (acc[:n] ^ (acc[:n] >> np.uint64(31))) * odd + power[done:done + n]
            done += size
        if 2 * size > k:
            return mix(acc.copy())
        n = len(power) - size
        power = (power[:n] ^ (power[:n] >> np.uint64(29))) * odd + power[size:size + n]
        size *= 2


def window_runs(buf: np.ndarray, off: np.ndarray, threshold: int, gram: int):
    """Runs of consecutive windows with one least gram: (first window, number
    of windows, gram position, gram hash); windows never cross documents."""
    outs = []
    span = threshold - gram + 1
    ends = off[1:]
    for a in range(0, max(len(buf) - threshold + 1, 0), CHUNK):
        part = buf[a:a + CHUNK + threshold - 1]
        n = len(part) - threshold + 1
        g = gram_hashes(part, gram)
        low = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
        step = 1
        while 2 * step <= span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < span:
            low = np.minimum(low[:len(low) - (span - step)], low[span - step:])
        pos = (low[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = np.arange(n) + a
        doc = np.searchsorted(ends, at, "right")
        whole = at + threshold <= ends[np.minimum(doc, len(ends) - 1)]
        new = np.ones(n, bool)
        new[1:] = (pos[1:] != pos[:-1]) | (whole[1:] != whole[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, n))
        ok = whole[first]
        first, count = first[ok], count[ok]
        outs.append((first + a, count, pos[first] + a, g[pos[first]]))
    if not outs:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*outs))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _combine(src: DataFrame) -> DataFrame:
    """src (k, text, without null texts) plus th, digest and n: the first of a
    task's equal rows with n = 1, the others as one row with n of them and a
    null text."""
    src = src.select("k", "text", F.xxhash64("k", "text").alias("th"),
                     F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))

    def rows(k, text, th, digest, n):
        return pa.RecordBatch.from_pydict({"k": k, "text": text, "th": th, "digest": digest, "n": n})

    def extra(seen: dict) -> pa.RecordBatch:
        more = [(*at, n) for at, n in seen.items() if n]
        k, th, digest, n = zip(*more) if more else ((), (), (), ())
        return rows(pa.array(k, pa.int64()), pa.nulls(len(more), pa.string()), pa.array(th, pa.int64()),
                    pa.array(digest, pa.binary()), pa.array(n, pa.int64()))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for b in parts(batches):
            first = []
            for i, at in enumerate(zip(*(b.column(c).to_pylist() for c in ("k", "th", "digest")))):
                if at in seen:
                    seen[at] += 1
                else:
                    seen[at] = 0
                    first.append(i)
            if len(first) < b.num_rows:
                b = b.take(pa.array(first, pa.int64()))
            yield rows(*(b.column(c) for c in ("k", "text", "th", "digest")),
                       pa.array(np.ones(b.num_rows, np.int64)))
            if len(seen) > COMBINE_ROWS:
                yield extra(seen)
                seen.clear()
        yield extra(seen)

    return src.mapInArrow(combine, "k long, text string, th long, digest binary, n long")


def _cell_rows(t: pa.Table):
    """A cell's distinct rows, with the number of each, in an order that
    depends on their content only: keys, bytes and offsets."""
    t = t.append_column("_more", t.column("text").is_null())
    t = t.take(pc.sort_indices(t.select(["th", "k", "digest", "_more"]), sort_keys=[
        (c, "ascending") for c in ("th", "k", "digest", "_more")]))
    keys = t.column("k").fill_null(int(NO_KEY)).to_numpy()
    th, digest = t.column("th").to_numpy(), t.column("digest").to_pylist()
    new = np.ones(len(keys), bool)
    new[1:] = (th[1:] != th[:-1]) | (keys[1:] != keys[:-1])
    new[1:] |= np.array([x != y for x, y in zip(digest[1:], digest)], bool)
    first = np.flatnonzero(new)
    n = np.add.reduceat(t.column("n").to_numpy(), first)
    if len(first) < len(keys):
        t, keys = t.take(pa.array(first)), keys[first]
    t = t.select(["k", "text"]).append_column("n", pa.array(n))
    buf, off = text_buffer(t.column("text"))
    return t, keys, buf, off


def _by_bucket(bucket: np.ndarray, buckets: int):
    """(bucket, order slice) for each bucket that has entries."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
    for i, j in zip(cut, np.append(cut[1:], len(b))):
        yield int(b[i]), order[i:j]


def remove_repeats(df: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM,
                   key: str = "doc_id", text: str = "text", cell_bytes: int = CELL_BYTES,
                   hot_cells: int = HOT_CELLS, keep_text: bool = False) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept_sha256, and
    with ``keep_text`` kept (binary: what is left) and spans (byte ranges)."""
    spark = df.sparkSession
    src = df.select(F.col(key).cast("long").alias("k"),
                    F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // cell_bytes + 1)
    x = _combine(src).withColumn("cell", F.pmod("th", F.lit(cells)).cast("int"))

    # 1. the grams of each cell, and those that more than one document holds
    def grams(t: pa.Table) -> pa.Table:
        cell = t.column("cell")[0].as_py()
        _, keys, buf, off = _cell_rows(t)
        first, _, _, g = window_runs(buf, off, threshold, gram)
        k = keys[np.searchsorted(off, first, "right") - 1]
        order = np.lexsort((k, g))
        g, k = g[order], k[order]
        new = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
        stop = np.append(new[1:], len(g)) - 1
        several = (k[new] != k[stop]).astype(np.uint8) if len(g) else np.zeros(0, np.uint8)
        g = g[new]
        out = [(cell, b, _blob(g[i]), _blob(several[i])) for b, i in
               _by_bucket(bucket_of(g, cells), cells)]
        return _table(out, GRAM_COLS)

    def shared(t: pa.Table) -> pa.Table:
        own = [np.frombuffer(v, np.uint64) for v in t.column("grams").to_pylist()]
        cell = np.repeat(t.column("cell").to_numpy(), [len(v) for v in own])
        several = np.frombuffer(b"".join(t.column("several").to_pylist()), np.uint8)
        g = np.concatenate(own)
        _, inv, n = np.unique(g, return_inverse=True, return_counts=True)
        many = np.bincount(inv, weights=several) > 0
        keep = ((n > 1) | many)[inv]
        hot = (n > hot_cells)[inv].astype(np.uint8)
        g, cell, hot = g[keep], cell[keep], hot[keep]
        out = [(c, _blob(g[i]), _blob(hot[i])) for c, i in _by_bucket(cell, cells)]
        return _table(out, SHARED_COLS)

    found = x.groupBy("cell").applyInArrow(grams, _schema(GRAM_COLS)) \
        .groupBy("bucket").applyInArrow(shared, _schema(SHARED_COLS))

    # 2. the runs of those grams, refined in their buckets
    def runs(t: pa.Table, s: pa.Table) -> pa.Table:
        if not t.num_rows or not s.num_rows:
            return _table([], RUN_COLS)
        cell = t.column("cell")[0].as_py()
        _, keys, buf, off = _cell_rows(t)
        want = np.frombuffer(b"".join(s.column("grams").to_pylist()), np.uint64)
        hot = np.frombuffer(b"".join(s.column("hot").to_pylist()), np.uint8)
        order = np.argsort(want)
        want, hot = want[order], hot[order]
        first, count, pos, g = window_runs(buf, off, threshold, gram)
        i = np.minimum(np.searchsorted(want, g), len(want) - 1)
        keep = want[i] == g
        first, count, pos, g, h = first[keep], count[keep], pos[keep], g[keep], hot[i[keep]] > 0
        if h.any():  # single windows, dealt by their own bytes
            one = ranges(first[h], count[h])
            first = np.concatenate([first[~h], one])
            count = np.concatenate([count[~h], np.ones(len(one), np.int64)])
            pos = np.concatenate([pos[~h], one + SINGLE])
            g = np.concatenate([g[~h], np.zeros(len(one), np.uint64)])
        order = np.argsort(first, kind="stable")
        first, count, pos, g = first[order], count[order], pos[order], g[order]
        content = span_hashes(buf, first, first + count + (threshold - 1))
        g = np.where(pos - first == SINGLE, content, g)
        row = np.searchsorted(off, first, "right") - 1
        k = keys[row]
        # runs with the same content are one entry with several places
        order = np.lexsort((k, content, g))
        g, content, k = g[order], content[order], k[order]
        first, count, pos, row = first[order], count[order], pos[order], row[order]
        new = np.append(True, (g[1:] != g[:-1]) | (content[1:] != content[:-1]))
        e = np.flatnonzero(new)
        places = np.diff(np.append(e, len(g)))
        least = k[e]
        is_least = k == np.repeat(least, places)
        out = []
        for b, i in _by_bucket(bucket_of(g[e], cells), cells):
            ei = e[i]
            p = ranges(ei, places[i])
            size = count[ei] + (threshold - 1)
            out.append((cell, b, _blob(least[i]),
                        _blob(count[ei].astype(np.uint16)),
                        _blob((pos[ei] - first[ei]).astype(np.uint16)),
                        pa.compress(_blob(buf[ranges(first[ei], size)]), "zstd", asbytes=True),
                        _blob(places[i].astype(np.uint32)),
                        _blob(row[p].astype(np.uint32)),
                        _blob((first[p] - off[row[p]]).astype(np.uint32)),
                        _blob(is_least[p])))
        return _table(out, RUN_COLS)

    def refine(t: pa.Table) -> pa.Table:
        return _table(_refine_bucket(t, threshold, gram, cells), CUT_COLS)

    cuts = x.groupBy("cell").cogroup(found.groupBy("cell")).applyInArrow(runs, _schema(RUN_COLS)) \
        .groupBy("bucket").applyInArrow(refine, _schema(CUT_COLS))

    # 3. the ranges, applied to the texts
    def apply(t: pa.Table, c: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _table([], OUT_COLS)
        t, _, buf, off = _cell_rows(t)
        col = [np.frombuffer(b"".join(c.column(n).to_pylist()), np.uint32).astype(np.int64)
               if c.num_rows else np.zeros(0, np.int64) for n in ("rows", "starts", "ends")]
        edge = np.zeros(len(buf) + 1, np.int32)
        np.add.at(edge, off[col[0]] + col[1], 1)
        np.add.at(edge, off[col[0]] + col[2], -1)
        gone = np.cumsum(edge[:-1]) > 0
        touched = set(col[0].tolist())
        out = []
        for r, (k, n) in enumerate(zip(t.column("k").to_pylist(), t.column("n").to_pylist())):
            i, j = int(off[r]), int(off[r + 1])
            raw, spans = buf[i:j], []
            if r in touched:
                m = gone[i:j]
                turn = np.flatnonzero(np.diff(np.concatenate([[0], m.view(np.int8), [0]])))
                spans, raw = turn.tolist(), raw[~m]
            kept = raw.tobytes()
            out.append((k, j - i, j - i - len(kept), len(spans) // 2,
                        hashlib.sha256(kept).hexdigest(), n,
                        *((kept, spans) if keep_text else (None, None))))
        return _table(out, OUT_COLS)

    done = x.groupBy("cell").cogroup(cuts.groupBy("cell")).applyInArrow(apply, _schema(OUT_COLS))
    # each row as often as it was there, in two steps so that no array is long
    names = [c for c, _ in OUT_COLS if c != "n" and (keep_text or c not in ("kept", "spans"))]
    last = F.floor((F.col("n") - 1) / REPEAT_ROWS)
    done = done.select(*names, "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_part"))
    times = F.least(F.lit(REPEAT_ROWS).cast("long"), F.col("n") - F.col("_part") * REPEAT_ROWS)
    return done.select(*names, F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("_one")) \
        .drop("_one").withColumnRenamed("k", key)


GRAM_COLS = [("cell", "int"), ("bucket", "int"), ("grams", "binary"), ("several", "binary")]
SHARED_COLS = [("cell", "int"), ("grams", "binary"), ("hot", "binary")]
RUN_COLS = [("cell", "int"), ("bucket", "int"), *[(n, "binary") for n in (
    "least", "count", "anchor", "bytes", "places", "rows", "starts", "is_least")]]
CUT_COLS = [("cell", "int"), ("rows", "binary"), ("starts", "binary"), ("ends", "binary")]
OUT_COLS = [("k", "long"), ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"),
            ("kept_sha256", "string"), ("n", "long"), ("kept", "binary"), ("spans", "array<long>")]


def _schema(cols) -> str:
    return ", ".join(f"{n} {t}" for n, t in cols)


def _table(rows: list[tuple], cols) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(),
             "array<long>": pa.list_(pa.int64())}
    data = zip(*rows) if rows else [[] for _ in cols]
    return pa.table({n: pa.array(list(v), kinds[t]) for (n, t), v in zip(cols, data)})


def radix_groups(blob: np.ndarray, start: np.ndarray, group: np.ndarray,
                 depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Refine groups of the strings blob[start:start + depth] by 8-byte digits,
    most significant first; strings alone in a group leave.  Returns (indices
    of the strings that stay, their final groups), ordered by group."""
    padded = np.concatenate([blob, np.zeros(8, np.uint8)])
    digits = np.ndarray((len(blob),), ">u8", buffer=padded.data, strides=(1,)) \
        if len(blob) else np.zeros(0, np.uint64)
    idx = np.arange(len(start))
    at = 0
    while True:
        new = np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, bool)
        cut = np.flatnonzero(new)
        size = np.diff(np.append(cut, len(group)))
        stay = np.repeat(size > 1, size)
        idx, group = idx[stay], group[stay]
        if at >= depth or not len(idx):
            return idx, group
        here = min(at, depth - 8) if depth >= 8 else at
        d = digits[start[idx] + here].astype(np.uint64)
        if depth < 8:
            d >>= np.uint64(8 * (8 - depth))
        order = np.lexsort((d, group))
        idx, d, group = idx[order], d[order], group[order]
        change = np.append(True, (group[1:] != group[:-1]) | (d[1:] != d[:-1]))
        group = np.cumsum(change)
        at = here + 8


def _refine_bucket(t: pa.Table, threshold: int, gram_size: int, cells: int) -> list[tuple]:
    def col(name, kind):
        return np.frombuffer(b"".join(t.column(name).to_pylist()), kind)

    least, places = col("least", np.int64), col("places", np.uint32).astype(np.int64)
    count, anchor = col("count", np.uint16).astype(np.int64), col("anchor", np.uint16).astype(np.int64)
    if not len(least):
        return []
    size = count + threshold - 1
    begin = np.cumsum(size) - size
    entries = np.array([len(v) // 8 for v in t.column("least").to_pylist()])
    last = np.cumsum(entries)
    blob = np.frombuffer(b"".join(
        pa.decompress(v, int(size[j - n:j].sum()), "zstd", asbytes=True)
        for v, n, j in zip(t.column("bytes").to_pylist(), entries, last)), np.uint8)
    # the grams and contents are not shuffled but hashed anew
    content = span_hashes(blob, begin, begin + size)
    single = anchor == SINGLE
    anchor[single] = 0
    gram = np.where(single, content, gram_hashes(blob, gram_size)[begin + anchor])
    # one representative per content
    order = np.lexsort((least, content, gram))
    new = np.append(True, (gram[order][1:] != gram[order][:-1])
                    | (content[order][1:] != content[order][:-1]))
    rep_no = np.empty(len(order), np.int64)
    rep_no[order] = np.cumsum(new) - 1
    rep = order[new]
    rep_least = least[rep]
    # windows of grams with several contents; their first group is (gram, offset)
    g = gram[rep]
    gnew = np.append(True, g[1:] != g[:-1])
    gno = np.cumsum(gnew) - 1
    many = np.bincount(gno)[gno] > 1
    m = np.flatnonzero(many)
    who = np.repeat(m, count[rep[m]])
    inner = ranges(np.zeros(len(m), np.int64), count[rep[m]])
    start = begin[rep[who]] + inner
    group = gno[who] * (threshold + 1) + (anchor[rep[who]] - inner)
    order = np.argsort(group, kind="stable")
    who, inner, start, group = who[order], inner[order], start[order], group[order]
    idx, group = radix_groups(blob, start, group, threshold)
    # windows whose group has a smaller key than their own content's smallest
    low_rep, low_inner = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(idx):
        cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        best = np.repeat(np.minimum.reduceat(rep_least[who[idx]], cut),
                         np.diff(np.append(cut, len(idx))))
        lower = best < rep_least[who[idx]]
        low_rep, low_inner = who[idx[lower]], inner[idx[lower]]
        order = np.lexsort((low_inner, low_rep))
        low_rep, low_inner = low_rep[order], low_inner[order]
    # join neighbouring windows of a content into ranges
    step = np.append(True, (low_rep[1:] != low_rep[:-1]) | (low_inner[1:] != low_inner[:-1] + 1)) \
        if len(low_rep) else np.zeros(0, bool)
    r0 = np.flatnonzero(step)
    r1 = (np.append(r0[1:], len(low_rep)) - 1)[:len(r0)]
    part_rep = low_rep[r0]
    part_a, part_b = low_inner[r0], low_inner[r1] + threshold
    part_first = np.searchsorted(part_rep, np.arange(len(rep)))
    part_count = np.bincount(part_rep, minlength=len(rep))
    # every place: all of it, unless it is its content's smallest key
    entry = np.repeat(np.arange(len(gram)), places)
    rows, starts = col("rows", np.uint32).astype(np.int64), col("starts", np.uint32).astype(np.int64)
    mine = col("is_least", np.uint8).astype(bool) & (least[entry] == rep_least[rep_no[entry]])
    cell_of_entry = np.repeat(t.column("cell").to_numpy(), entries)
    full = np.flatnonzero(~mine)
    some = np.flatnonzero(mine & (part_count[rep_no[entry]] > 0))
    n = part_count[rep_no[entry[some]]]
    pi = ranges(part_first[rep_no[entry[some]]], n)
    some = np.repeat(some, n)
    place = np.concatenate([full, some])
    a = np.concatenate([starts[full], starts[some] + part_a[pi]])
    b = np.concatenate([starts[full] + size[entry[full]], starts[some] + part_b[pi]])
    cell = cell_of_entry[entry[place]]
    return [(c, _blob(rows[place[i]].astype(np.uint32)), _blob(a[i].astype(np.uint32)),
             _blob(b[i].astype(np.uint32))) for c, i in _by_bucket(cell.astype(np.int64), cells)]


def brute_force(docs: list[tuple], threshold: int = THRESHOLD) -> list[tuple]:
    """Contract rows by a dictionary of all windows (for tests)."""
    least: dict[bytes, int] = {}
    raws = [(k, (t or "").encode()) for k, t in docs]
    order = lambda k: NO_KEY if k is None else k
    for k, raw in raws:
        for i in range(len(raw) - threshold + 1):
            w = raw[i:i + threshold]
            least[w] = min(least.get(w, NO_KEY), order(k))
    out = []
    for k, raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - threshold + 1):
            if least[raw[i:i + threshold]] < order(k):
                gone[i:i + threshold] = True
        kept = bytes(b for b, x in zip(raw, gone) if not x)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((k, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out
