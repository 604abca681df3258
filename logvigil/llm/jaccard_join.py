"""N-gram Jaccard self-join by grouped prefixes.

Two documents link when their sets of distinct ``width``-word shingles overlap
by ``percent`` of the union.  The result is each document's set size and the
smallest key reachable by links.

* Documents with one set are one class; only classes are joined.
* A set's elements are ordered by a count sketch of the whole corpus (a table
  of fixed size), the rare ones first; only the order depends on it, never the
  result.  Sets of a and b elements that overlap in at least o share at least
  ``COMMON`` (or o, if less) of the first a - o + COMMON and b - o + COMMON
  elements; these prefixes are what is joined.
* Classes with identical prefixes and size are one group.  Elements are kept if
  two groups hold them at places and sizes that allow a link (and, within a
  group, if it has two classes); then the groups are expanded to their members.
* Members are verified exactly.  First each element's members are compared with
  its most central member only; the links found are contracted.  Then all
  remaining pairs of different components are compared.  Pairs inside a
  component need no comparison, so no group of near copies is expanded into
  all its pairs.

Bitmaps of fixed size (``FILTER_BITS``) tell the scans which elements,
documents and rows may matter; the joins decide.  Prefix elements are shuffled
packed by bucket, a class's set is read from one document, and the texts of
rows that surely stay are not shuffled.

Defined results: a null, empty or blank text has an empty set and is linked
with nothing; fewer words than ``width`` are one shingle; a null key is never
a component's smallest (null if nothing else is there); repeated rows are one
class; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logvigil.llm.graph import components
from logvigil.llm.textkit import (SPACE_WORDS, durable, mix, slices, span_hashes, windows,
                                  word_spans)

WIDTH = 4
PERCENT = 85
COMMON = 2
FLUSH = 256  # documents of an Arrow batch that are worked on at a time
SKETCH = 1 << 20
SKETCH_SLICES = 16
FILTER_BITS = 1 << 26
WORD_BITS = 32768  # of a Spark bitmap
PACK_ROWS = 1 << 18  # prefix elements that a task packs at a time
BUCKET_ROWS = 1 << 20  # prefix elements that a group compares, about


def shingle_sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row of a batch."""
    for a, b, buf, off in slices(batch):
        s, e, firsts = word_spans(buf, off, SPACE_WORDS)
        h = span_hashes(buf, s, e, fold=True)
        grams, at = windows(h, firsts, width)
        cut = np.searchsorted(at, firsts)
        for d in range(b - a):
            n = int(firsts[d + 1] - firsts[d])
            if n >= width:
                yield a + d, np.unique(grams[cut[d]:cut[d + 1]])
            elif n:
                short = np.uint64(width - n) * np.uint64(0x9E3779B97F4A7C15)
                x = xxhash.xxh3_64_intdigest(h[firsts[d]:firsts[d + 1]].tobytes())
                yield a + d, mix(np.array([x], np.uint64) ^ short)
            else:
                yield a + d, np.zeros(0, np.uint64)


def _some(items: Iterator) -> Iterator[list]:
    """Lists of up to FLUSH items."""
    while some := list(itertools.islice(items, FLUSH)):
        yield some


def class_of(u: np.ndarray) -> int:
    return np.uint64(xxhash.xxh3_64_intdigest(u.tobytes())).astype(np.int64).item()


def prefix_size(n: int, percent: int) -> int:
    """The longest prefix that any partner asks for (the smallest one does)."""
    return min(n, n - -(-percent * n // 100) + COMMON)


def _needed(a, b, percent: int):
    """Least overlap of linked sets of sizes a and b (whole-number columns)."""
    return F.floor(((a + b) * percent + (99 + percent)) / (100 + percent))


def _ordered(u: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, float]:
    """Set elements by (sketched count, hash); the set's mean count."""
    count = sketch[u & np.uint64(SKETCH - 1)].astype(np.uint64)
    key = (np.minimum(count, np.uint64((1 << 24) - 1)) << np.uint64(40)) | (u >> np.uint64(24))
    return u[np.argsort(key, kind="stable")], float(count.mean())


def _narrow(counts: np.ndarray) -> bytes:
    """Whole numbers from 0 (beyond 2^32: cut off there), in as few bytes each as the
    largest needs."""
    top = int(counts.max(initial=0))
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32
    return np.minimum(counts, 0xFFFFFFFF).astype(kind).tobytes()


def _wide(packed: pa.BinaryScalar, n: int) -> np.ndarray:
    """The n numbers that _narrow() packed (read in place)."""
    raw = packed.as_buffer()
    return np.frombuffer(raw, f"u{raw.size // n}")


# ------------------------------------------------------------ classes, sketch
def _signatures(src: DataFrame, width: int) -> DataFrame:
    """Rows (k, th, n, c) of documents and, from each task, its part of the sketch
    (slice, part, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.int64)
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            c = np.zeros(batch.num_rows, np.int64)
            for some in _some(shingle_sets(batch, width)):
                for r, u in some:
                    n[r], c[r] = len(u), class_of(u)
                low = np.concatenate([u for _, u in some]) & np.uint64(SKETCH - 1)
                at, counts = np.unique(low.astype(np.int64), return_counts=True)
                sketch[at] += counts
            yield _sig_batch(batch.num_rows, k=batch.column("k"), th=batch.column("th"),
                             n=pa.array(n), c=pa.array(c))
        rows = [(s, _narrow(part)) for s, part in enumerate(np.split(sketch, SKETCH_SLICES)) if part.any()]
        if rows:
            yield _sig_batch(len(rows), slice=pa.array([r[0] for r in rows], pa.int32()),
                             part=pa.array([TaskContext.get().partitionId()] * len(rows), pa.int64()),
                             counts=pa.array([r[1] for r in rows], pa.binary()))

    return src.select("k", "th", "text").mapInArrow(
        run, "k long, th long, n long, c long, slice int, part long, counts binary")


_SIG_KINDS = {"k": pa.int64(), "th": pa.int64(), "n": pa.int64(), "c": pa.int64(), "slice": pa.int32(),
              "part": pa.int64(), "counts": pa.binary()}


def _sig_batch(rows: int, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: cols.get(n, pa.nulls(rows, t))
                                       for n, t in _SIG_KINDS.items()})


def _sum_sketch(parts: DataFrame) -> np.ndarray:
    """Sum the tasks' sketches: in two steps, with as many groups in the first as
    a group has parts, so that both stay small; what comes to the driver has a
    fixed size."""
    step = SKETCH // SKETCH_SLICES
    salts = int((parts.count() / SKETCH_SLICES) ** 0.5) + 1

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(step, np.int64)
        for counts in t.column("counts"):
            total += _wide(counts, step)
        return pa.table({"slice": pa.array([t.column("slice")[0].as_py()], pa.int32()),
                         "counts": pa.array([_narrow(total)], pa.binary())})

    schema = "slice int, counts binary"
    first = parts.withColumn("salt", F.pmod(F.xxhash64("part"), F.lit(salts))) \
        .groupBy("slice", "salt").applyInArrow(add, schema)
    out = np.zeros(SKETCH, np.uint32)
    for r in first.groupBy("slice").applyInArrow(add, schema).collect():
        out[r["slice"] * step:(r["slice"] + 1) * step] = np.frombuffer(
            r["counts"], f"u{len(r['counts']) // step}")
    return out


# -------------------------------------------------------------------- filters
def _bitmap(df: DataFrame, column: str) -> bytes:
    """A bitmap of fixed size with a bit for each value's hash slot."""
    slot = F.pmod(F.col(column), F.lit(FILTER_BITS))
    rows = df.select(F.floor(slot / WORD_BITS).alias("w"), (slot % WORD_BITS).alias("p")) \
        .groupBy("w").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    out = bytearray(FILTER_BITS // 8)
    for r in rows:  # at most FILTER_BITS / WORD_BITS rows
        out[r["w"] * (WORD_BITS // 8):(r["w"] + 1) * (WORD_BITS // 8)] = r["bits"]
    return bytes(out)


def _maybe(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the bitmap may hold each value (int64)."""
    slot = (values.astype(np.int64).view(np.uint64) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


# ----------------------------------------------------------------------- scans
def _three_each(token: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Rows of each token's smallest, second and largest member: all that it
    takes to tell whether one, two or more members hold it, so that a token
    that many hold is small before it is shuffled."""
    order = np.lexsort((member, token))
    t, m = token[order], member[order]
    once = np.append(True, (t[1:] != t[:-1]) | (m[1:] != m[:-1]))
    order, t = order[once], t[once]
    first = np.append(True, t[1:] != t[:-1])
    last = np.append(t[1:] != t[:-1], True)
    second = np.append(False, first[:-1]) & ~first
    return order[first | second | last]


def _elements(some: list, percent: int, counts: np.ndarray):
    """(token, class, group, n, position, mean count, last row of each class) of the
    prefix elements of a list of sets, once a class, each class's followed by its
    group's own number at position -1; None if there are no elements."""
    toks, size, meta, seen = [], [], [], set()
    for _, u in some:
        n = len(u)
        c = class_of(u)
        if not n or c in seen:
            continue
        seen.add(c)
        order, mid = _ordered(u, counts)
        p = order[:prefix_size(n, percent)].view(np.int64)
        g = xxhash.xxh3_64_intdigest(p.tobytes() + n.to_bytes(8, "little"))
        g = np.uint64(g).astype(np.int64).item()
        toks.append(np.append(p, g))
        size.append(len(p) + 1)
        meta.append((c, g, n, mid))
    if not toks:
        return None
    token, size = np.concatenate(toks), np.array(size)
    c, g, n = (np.repeat(np.array([m[i] for m in meta], np.int64), size) for i in (0, 1, 2))
    last = np.cumsum(size) - 1
    pos = np.arange(len(token)) - np.repeat(last + 1 - size, size)
    pos[last] = -1
    return token, c, g, n, pos, np.repeat(np.array([m[3] for m in meta]), size), last


def _packed_members(have: list, buckets: int) -> pa.RecordBatch:
    """One row per bucket of tokens: the tokens, and for each the place in the
    bucket's list of members (with their sizes) and the position."""
    token, member, n, pos = (np.concatenate(x) for x in zip(*have))
    i = _three_each(token, member)
    token, member, n, pos = token[i], member[i], n[i], pos[i]
    bucket = ((token.view(np.uint64) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
    rows = []
    for a, b in itertools.pairwise(cuts):
        i = order[a:b]
        who, first, at = np.unique(member[i], return_index=True, return_inverse=True)
        rows.append((int(bucket[i[0]]), token[i].tobytes(), _narrow(at), _narrow(pos[i] + 1),
                     who.tobytes(), _narrow(n[i][first])))
    return pa.RecordBatch.from_pydict({
        name: pa.array([r[j] for r in rows], pa.binary() if j else pa.int64())
        for j, name in enumerate(("bucket", "token", "at", "pos", "who", "size"))})


def _held_tokens(src: DataFrame, width: int, percent: int, sketch, buckets: int) -> DataFrame:
    """The prefix elements that two groups hold, and the numbers of groups that two
    classes hold; of just two holders, at places that allow a link.

    Elements are shuffled by bucket, packed; a bucket has about BUCKET_ROWS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(sketch.value, np.uint32)
        have, rows = [], 0
        for batch in batches:
            for some in _some(shingle_sets(batch, width)):
                if (found := _elements(some, percent, counts)) is None:
                    continue
                token, c, member, n, pos, _, last = found
                member[last] = c[last]
                have.append((token, member, n, pos))
                rows += len(token)
                if rows >= PACK_ROWS:
                    yield _packed_members(have, buckets)
                    have, rows = [], 0
        if have:
            yield _packed_members(have, buckets)

    def held(t: pa.Table) -> pa.Table:
        parts = []
        for token, at, pos, who, size in zip(*(t.column(c) for c in ("token", "at", "pos", "who", "size"))):
            token, who = (np.frombuffer(x.as_buffer(), np.int64) for x in (token, who))
            at = _wide(at, len(token)).astype(np.int64)
            parts.append((token, who[at], _wide(size, len(who)).astype(np.int64)[at],
                          _wide(pos, len(token)).astype(np.int64) - 1))
        token, member, n, pos = (np.concatenate(x) for x in zip(*parts))
        i = np.lexsort((member, token))
        token, member, n, pos = token[i], member[i], n[i], pos[i]
        once = np.append(True, (token[1:] != token[:-1]) | (member[1:] != member[:-1]))
        token, n, pos = token[once], n[once], pos[once]
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        rows = np.diff(np.append(first, len(token)))
        first, rows = first[rows > 1], rows[rows > 1]
        a, b = n[first], n[first + 1]
        need = ((a + b) * percent + (99 + percent)) // (100 + percent)
        fits = (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent) \
            & (pos[first] < a - need + COMMON) & (pos[first + 1] < b - need + COMMON)
        return pa.table({"token": pa.array(token[first[(rows > 2) | fits]], pa.int64())})

    return src.select("text").mapInArrow(
        run, "bucket long, token binary, at binary, pos binary, who binary, size binary") \
        .groupBy("bucket").applyInArrow(held, "token long")


def _members(src: DataFrame, width: int, percent: int, sketch, wanted) -> DataFrame:
    """The members' rows (token, c, n, pos, mid) of the wanted elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(sketch.value, np.uint32)
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            for some in _some(shingle_sets(batch, width)):
                if (found := _elements(some, percent, counts)) is None:
                    continue
                token, c, _, n, pos, mid, _ = found
                keep = np.flatnonzero(_maybe(bits, token))
                yield pa.RecordBatch.from_pydict({
                    "token": pa.array(token[keep]), "c": pa.array(c[keep]), "n": pa.array(n[keep]),
                    "pos": pa.array(pos[keep]), "mid": pa.array(mid[keep])})

    return src.select("text").mapInArrow(run, "token long, c long, n long, pos long, mid double")


def _sets(src: DataFrame, width: int, wanted) -> DataFrame:
    """(c, toks) of the documents whose id the bitmap may hold, once a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            batch = batch.filter(pa.array(_maybe(bits, batch.column("id").to_numpy())))
            for some in _some(shingle_sets(batch, width)):
                found = {class_of(u): u.view(np.int64) for _, u in some if len(u)}
                if found:
                    cut = pa.array(np.cumsum([0, *map(len, found.values())]).astype(np.int32))
                    yield pa.RecordBatch.from_pydict({
                        "c": pa.array(list(found), pa.int64()),
                        "toks": pa.ListArray.from_arrays(cut, pa.array(np.concatenate(list(found.values()))))})

    return src.select("id", "text").mapInArrow(run, "c long, toks array<long>").dropDuplicates(["c"])


def _verify(src: DataFrame, docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link.  Of each class one document is read."""
    spark = src.sparkSession
    ends = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c")))
    carriers = docs.join(ends.distinct(), "c", "left_semi").groupBy("c").agg(F.min("id").alias("id"))
    sets = _sets(src, width, spark.sparkContext.broadcast(_bitmap(carriers, "id")))
    sets = sets.join(ends.distinct(), "c", "left_semi")
    both = pairs.join(sets.select(F.col("c").alias("a"), F.col("toks").alias("ta")), "a") \
        .join(sets.select(F.col("c").alias("b"), F.col("toks").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.withColumn("i", common).where(
        F.col("i") * 100 >= (F.size("ta") + F.size("tb") - F.col("i")) * percent).select("a", "b")


def _fits(n1, p1, n2, p2, percent: int):
    """Sizes and places in the two orders still allow the needed overlap."""
    need = _needed(n1, n2, percent)
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) \
        & (p1 < n1 - need + COMMON) & (p2 < n2 - need + COMMON)


def _enough(shared: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) from rows (a, na, b, nb, pos) of a shared element each, that
    share enough of them; a group's own number stands for all of its prefix."""
    need = F.least(F.lit(COMMON), _needed(F.col("na"), F.col("nb"), percent))
    return shared.groupBy("a", "b", "na", "nb").agg(F.sum(
        F.when(F.col("pos") < 0, COMMON).otherwise(1)).alias("common")) \
        .where(F.col("common") >= need).select("a", "b")


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
                       percent: int = PERCENT) -> DataFrame:
    """One row per document: key, n_shingles, component_id, and class_id and
    text_hash (of the set and of the text)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    src = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("text")) \
        .withColumn("th", F.xxhash64("text"))
    sig = durable(_signatures(src, width))
    docs = sig.where("n is not null").select("k", "th", "n", "c")
    sketch = sc.broadcast(_sum_sketch(sig.where("slice is not null")).tobytes())
    texts = src.withColumn("id", F.xxhash64("k", "th"))
    ids = docs.where("n > 0").select(F.xxhash64("k", "th").alias("id"), "c")

    # elements that two groups hold, or two classes of one group, and of just
    # two, at places that fit
    words = docs.agg(F.sum(F.col("n") * (100 - percent) / 100 + COMMON + 1)).first()[0] or 0
    held = durable(_held_tokens(src, width, percent, sketch, 1 + int(words) // BUCKET_ROWS))
    wanted = sc.broadcast(_bitmap(held, "token"))
    rows = durable(_members(src, width, percent, sketch, wanted)
                   .join(held, "token").dropDuplicates(["token", "c"]))

    # each element's most central member against the others
    hubs = rows.groupBy("token").agg(F.max_by(
        F.struct("c", "n", "pos"), F.struct("mid", "c")).alias("hub"))
    star = rows.join(hubs, "token").where(F.col("c") != F.col("hub.c")) \
        .where(_fits(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), percent)) \
        .select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("hub.c").alias("b"),
                F.col("hub.n").alias("nb"), "pos")
    first = durable(_verify(texts, ids, durable(_enough(star, percent)), width, percent))

    # what is left: all pairs of different components
    comp = components(first)
    part = durable(rows.drop("mid").join(comp.withColumnRenamed("node", "c"), "c", "left")
                   .withColumn("comp", F.coalesce("comp", "c")))
    mixed = part.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")) \
        .where("x != y").select("token")
    part = durable(part.join(mixed, "token", "left_semi"))
    l, r = part.alias("l"), part.alias("r")
    rest = l.join(r, (F.col("l.token") == F.col("r.token")) & (F.col("l.c") < F.col("r.c"))
                  & (F.col("l.comp") != F.col("r.comp"))
                  & _fits(F.col("l.n"), F.col("l.pos"), F.col("r.n"), F.col("r.pos"), percent)) \
        .select(F.col("l.c").alias("a"), F.col("l.n").alias("na"), F.col("r.c").alias("b"),
                F.col("r.n").alias("nb"), F.col("l.pos").alias("pos"))
    rest = _enough(rest, percent)
    second = _verify(texts, ids, durable(rest), width, percent)

    comp = components(durable(first.union(second)))
    cls = docs.where("n > 0").groupBy("c").agg(F.min("k").alias("low")) \
        .join(comp.withColumnRenamed("node", "c"), "c", "left") \
        .withColumn("comp", F.coalesce("comp", "c"))
    low = cls.groupBy("comp").agg(F.min("low").alias("component_id"))
    cls = cls.join(low, "comp").select(F.col("c").alias("class"), "comp", "component_id")
    return docs.join(cls, (docs.c == cls["class"]) & (docs.n > 0), "left").select(
        F.col("k").alias(key), F.col("n").alias("n_shingles"), F.col("c").alias("class_id"),
        F.col("th").alias("text_hash"), F.col("comp"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("k")).alias("component_id"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
             percent: int = PERCENT) -> DataFrame:
    """The rows of df (all columns) without near copies: of each component one
    row of the smallest key (of the least text hash, if that is repeated)
    stays; rows without shingles all stay."""
    found = jaccard_components(df, key, text, width, percent)
    # plain equality on three columns that are never null
    at = ["none", "k", "th"]

    def id_of(k, th):
        return [k.isNull().alias("none"), F.coalesce(k.cast("long"), F.lit(0)).alias("k"), th.alias("th")]

    ids = durable(found.where("n_shingles > 0").select("comp", *id_of(F.col(key), F.col("text_hash")))
                  .groupBy("comp", *at).agg(F.count(F.lit(1)).alias("rows")))
    first = ids.groupBy("comp").agg(F.min(F.struct(*at)).alias("w")).select("w.*")
    # rows that may go are those that are not first or come again; only they, and
    # what shares their bits, are shuffled with their texts and judged
    doubt = ids.join(first.withColumn("won", F.lit(True)), at, "left").where("won is null or rows > 1")
    bits = df.sparkSession.sparkContext.broadcast(_bitmap(doubt.select(F.xxhash64(*at).alias("id")), "id"))

    @F.pandas_udf("boolean")
    def doubted(id: pd.Series) -> pd.Series:
        return pd.Series(_maybe(np.frombuffer(bits.value, np.uint8), id.to_numpy()))

    names = df.columns
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                     *id_of(F.col(key), F.xxhash64(F.col(text).cast("string"))),
                     F.coalesce(F.col(text), F.lit("")).rlike("[^\\x20\\x09-\\x0D]").alias("worded")) \
        .withColumn("doubted", doubted(F.xxhash64(*at)))
    mine = rows.where("doubted and worded").join(first, at, "left_semi")
    once = mine.withColumn("n", F.row_number().over(Window.partitionBy(*at).orderBy("th"))).where("n <= 1")
    return once.select("row.*").unionByName(rows.where("not doubted or not worded").select("row.*"))


def brute_force(docs: list[tuple], width: int = WIDTH, percent: int = PERCENT) -> list[tuple]:
    """(key, n_shingles, component_id) by comparing all pairs (for tests)."""
    import re
    sets = []
    for _, t in docs:
        raw = (t or "").encode().lower()
        w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        sets.append({tuple(w[i:i + width]) for i in range(max(len(w) - width, 0) + 1)} if w else set())
    up = list(range(len(docs)))

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                up[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return [(k, len(s), low.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(docs, sets))]
