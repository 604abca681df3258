"""Secret scans: fixed patterns plus a randomness test battery.

Base spans come from three patterns (``assign``, ``access``, ``hex``).  The
method adds ``random`` spans: runs of at least ``MIN_RUN`` key characters that
look drawn at random.

Battery, per run: the encoding is the smallest of ``ALPHABETS`` that holds all of
its characters; four tests ask whether the run is a uniform draw from it -- a
chi-squared test of alphabet uniformity, a runs test about the alphabet's middle,
a lag-1 serial-correlation test, and a test of how well the run follows the
corpus's letter pairs (a draw does as well as draws do; text does far better).
Fisher's method combines the four p-values, on equal footing, into the score
(high: random).  A run below ``LEAST_RANDOM`` is refused outright.

Null law, per (alphabet, length class): the same battery's scores of strings that
are text for certain -- cut out of the corpus's own consecutive words, joined by
nothing and by a sign, one of each kind and length from every document, at a
place told by its text.  Cells the corpus has few strings for lean on
``PRIOR_STRINGS`` strings written by the law of the text (``STEP`` for kinds of
characters, the letter pairs for letters).  A run's p-value is the share of null
strings that score as high.

False-discovery control, by alphabet and length: the Benjamini-Hochberg step-up at
level ``fdr`` on the counted p-values sets each cell's threshold.  Candidates are
all runs that do not overlap a base span, letters of one case among them.

Defined results: a null text is empty; spans are in code points; repeated rows
are scanned each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvigil.llm.textkit import byte_class, durable, parts, slices, word_spans, worker_cache

# ---- fixed values: the base patterns and their shortest lengths
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN_VALUE = "[A-Za-z0-9+/_.=-]+"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")
# ----

MIN_RUN = 16               # shorter random runs are not told from text often enough
FDR = 0.01
LEAST_RANDOM = 0.001       # a draw scores less once in a thousand times
SCORE_BINS = 128           # in equal steps of the score's logarithm from LEAST_RANDOM to 1
PRIOR_STRINGS = 1000       # of each cell that has candidates
LENGTHS = (16, 20, 24, 28, 32, 40, 48, 64, 96, 160)
RUN_BYTES = byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN_RE = re.compile("(?:%s)[\"']?\x20*[:=]\x20*[\"']?(%s)" % (
    "|".join(map(_either_case, ASSIGN_WORDS)), ASSIGN_VALUE))
ACCESS_RE = re.compile(ACCESS)
HEX_RE = re.compile("[0-9a-f]{%d,}" % MIN_HEX)
RUN_RE = re.compile("[A-Za-z0-9+/_=-]{%d,}+" % MIN_RUN)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), by start, then kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN_RE.finditer(text)
                if m.end(1) - m.start(1) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS_RE.finditer(text)
                if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX_RE.finditer(text)]
    return sorted(out)


def span_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# --------------------------------------------------------------- the battery
def _alphabets() -> list[str]:
    digit, low, up = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return [digit, digit + low[:6], digit + up[:6], low, up, digit + low, digit + up, up + low,
            up + low + digit, up + low + digit + "+/-_="]


ALPHABETS = _alphabets()


RANKS = np.array([[a.find(chr(c)) for c in range(256)] for a in ALPHABETS])


def alphabet_of(run: str) -> str:
    chars = set(run)
    return next(a for a in ALPHABETS if chars <= set(a))


def alphabets_of(rows: np.ndarray) -> np.ndarray:
    """Number of the smallest alphabet of each row of a bytes matrix (one that
    fits is sure)."""
    fits = np.stack([(RANKS[a][rows] >= 0).all(axis=1) for a in range(len(ALPHABETS))])
    return fits.argmax(axis=0)


def _tail(z: np.ndarray) -> np.ndarray:
    """Upper tail of the normal law."""
    return 0.5 * np.array([math.erfc(x) for x in (z / math.sqrt(2)).tolist()], float)


def chi2_upper(x, k: int) -> np.ndarray:
    """Upper tail of chi-squared with k degrees, by the cube-root normal."""
    x = np.asarray(x, float)
    if k <= 0:
        return np.ones_like(x)
    z = ((np.maximum(x, 0) / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return np.where(x > 0, _tail(z), 1.0)


def three_tests(ranks: np.ndarray, k: int) -> list[np.ndarray]:
    """p-values of uniformity, runs and serial correlation for rows of ranks in
    an alphabet of k characters."""
    m, n = ranks.shape
    seen = np.bincount((np.arange(m)[:, None] * k + ranks).ravel(), minlength=m * k).reshape(m, k)
    uniform = chi2_upper(((seen - n / k) ** 2).sum(axis=1) * k / n, k - 1)
    high = ranks >= k / 2
    n1 = high.sum(axis=1).astype(float)
    n0 = n - n1
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    mean = 1 + 2 * n1 * n0 / n
    var = (mean - 1) * (mean - 2) / max(n - 1, 1)
    z = (runs - mean) / np.sqrt(np.where(var > 0, var, 1.0))
    p_runs = np.where((n1 > 0) & (n0 > 0), np.where(var > 0, 2 * _tail(np.abs(z)), 1.0), 2.0 ** max(1 - n, -1000))
    d = ranks - ranks.mean(axis=1, keepdims=True)
    ss = (d * d).sum(axis=1)
    r = (d[:, 1:] * d[:, :-1]).sum(axis=1) / np.where(ss > 0, ss, 1.0) + 1 / n
    return [uniform, p_runs, np.where(ss > 0, 2 * _tail(np.abs(r * math.sqrt(n))), 0.0)]


def fisher(ps: list[np.ndarray]) -> np.ndarray:
    """Fisher's combination of independent p-values."""
    f = -sum(np.log(np.maximum(p, 1e-300)) for p in ps)
    return np.exp(-f) * sum(f ** i / math.factorial(i) for i in range(len(ps)))


def randomness(run: str, law: np.ndarray | None = None) -> float:
    """Combined p-value of 'a random draw from its alphabet' (0 to 1); without a
    law of text the pair test is left out."""
    rows = np.frombuffer(run.encode(), np.uint8)[None, :]
    if law is not None:
        return float(battery(rows, law)[1][0])
    a = ALPHABETS.index(alphabet_of(run))
    return float(fisher(three_tests(RANKS[a][rows], len(ALPHABETS[a])))[0])


# ---- the law of written text
#: kinds of characters: lower case, capital, digit, sign, further capital; a
#: last row for a run's begin
STEP = np.array([[.86, .05, .04, .05, 0], [.60, 0, .07, .08, .25], [.08, .07, .70, .15, 0],
                 [.45, .15, .20, .20, 0], [.05, 0, .05, .05, .85], [.50, .25, .15, .10, 0]])
#: a to z in Latin-script text, in thousandths
LETTERS = np.array([85, 15, 35, 40, 130, 16, 18, 35, 75, 2, 8, 45, 27, 75, 70, 25, 3, 67, 70, 85, 35,
                    12, 12, 2, 12, 1], float)
LETTERS_WEIGHT, PAIR_WEIGHT = 1000, 50  # letters' worth of LETTERS, and of single letters in a pair
APART = 0.15               # share of letters that follow no pair
OTHER = 26                 # in place of a letter


def _fold() -> np.ndarray:
    table = np.full(256, OTHER, np.int64)
    for first in b"aA":
        table[first:first + 26] = np.arange(26)
    return table


def _kinds() -> np.ndarray:
    table = np.full(256, 3, np.int64)
    for i, chars in enumerate((b"az", b"AZ", b"09")):
        table[chars[0]:chars[1] + 1] = i
    return table


FOLD, KIND_OF = _fold(), _kinds()


def letter_pairs(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of (byte before, letter), folded, of the texts in buf; characters
    of long runs count as OTHER."""
    x = FOLD[buf]
    s, e, _ = word_spans(buf, off, RUN_BYTES)
    long_run = e - s >= MIN_RUN
    for i, j in zip(s[long_run].tolist(), e[long_run].tolist()):
        x[i:j] = OTHER
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[off[:-1][off[1:] > off[:-1]]] = OTHER
    return np.bincount(before * 27 + x, minlength=27 * 27)


def text_law(pairs: np.ndarray) -> np.ndarray:
    """log P(letter | letter before, or OTHER) from letter_pairs' counts."""
    n = np.asarray(pairs).reshape(27, 27)[:, :26].astype(float)
    single = n.sum(0) + LETTERS_WEIGHT * LETTERS / LETTERS.sum()
    single /= single.sum()
    pair = (n + PAIR_WEIGHT * single) / (n.sum(1, keepdims=True) + PAIR_WEIGHT)
    return np.log((1 - APART) * pair + APART * single)


def depths(rows: np.ndarray, law: np.ndarray, k: int) -> np.ndarray:
    """log of each row's probability as a draw from k characters over its
    probability as written text."""
    kind, x = KIND_OF[rows].copy(), FOLD[rows]
    kind[:, 1:][(kind[:, 1:] == 1) & (KIND_OF[rows[:, :-1]] == 1)] = 4
    before, last = np.full(x.shape, OTHER), np.full(x.shape, 5)
    last[:, 1:] = kind[:, :-1]
    before[:, 1:] = np.where(kind[:, 1:] != 1, x[:, :-1], OTHER)
    letter = x < OTHER
    text = np.log(np.maximum(STEP[last, kind], 1e-3)) - math.log(10) * (kind == 2) - math.log(5) * (kind == 3)
    text = text + np.where(letter, law[before, np.where(letter, x, 0)], 0.0)
    return -rows.shape[1] * math.log(k) - text.sum(axis=1)


DRAWS, DRAW_LENGTH = 400, 32


def draw_moments(law: np.ndarray) -> np.ndarray:
    """Per alphabet, mean and variance a character of the depth of uniform draws
    (the same draws everywhere; kept per worker)."""
    cache = worker_cache()
    name = ("depths of draws", hashlib.sha256(law.tobytes()).digest())
    if name not in cache:
        rng, out = np.random.default_rng(17), []
        for a in ALPHABETS:
            rows = np.frombuffer(a.encode(), np.uint8)[rng.integers(0, len(a), (DRAWS, DRAW_LENGTH))]
            d = depths(rows, law, len(a))
            out.append((d.mean() / DRAW_LENGTH, max(d.var(), 1e-6) / DRAW_LENGTH))
        cache[name] = np.array(out)
    return cache[name]


def pair_test(rows: np.ndarray, law: np.ndarray, a: int) -> np.ndarray:
    """p-values of 'no more like text than draws from the alphabet are'."""
    mean, var = draw_moments(law)[a]
    n = rows.shape[1]
    return _tail(-(depths(rows, law, len(ALPHABETS[a])) - n * mean) / math.sqrt(n * var))


def battery(rows: np.ndarray, law: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alphabet, combined p-value of all four tests) of each row of a bytes
    matrix."""
    which, out = alphabets_of(rows), np.zeros(len(rows))
    for a in np.unique(which):
        at = np.flatnonzero(which == a)
        ranks = RANKS[a][rows[at]]
        out[at] = fisher([*three_tests(ranks, len(ALPHABETS[a])), pair_test(rows[at], law, int(a))])
    return which, out


def score_bins(p: np.ndarray) -> np.ndarray:
    """0 (text) .. SCORE_BINS - 1, even steps of the score's logarithm."""
    low = math.log(LEAST_RANDOM)
    share = (np.log(np.maximum(p, 1e-300)) - low) / -low
    return np.where(p < LEAST_RANDOM, 0, 1 + np.minimum(np.floor(share * (SCORE_BINS - 1)), SCORE_BINS - 2)).astype(int)


def score_bin(run: str, law: np.ndarray) -> int:
    return run_code(run, law) % SCORE_BINS


def run_code(run: str, law: np.ndarray) -> int:
    """Cell (length class, alphabet) times SCORE_BINS plus the score's bin."""
    which, p = battery(np.frombuffer(run.encode(), np.uint8)[None, :], law)
    return (length_class(len(run)) * len(ALPHABETS) + int(which[0])) * SCORE_BINS + int(score_bins(p)[0])


CELLS = len(LENGTHS) * 10  # length classes x ALPHABETS


def null_codes(buf: np.ndarray, off: np.ndarray, law: np.ndarray) -> list[list[int]]:
    """Per document, the codes of the strings cut from its consecutive words: of
    each length class one joined by nothing and one by '_', where it has enough.
    Long runs are left out, they are under test."""
    s, e, firsts = word_spans(buf, off, RUN_BYTES)
    keep = e - s < MIN_RUN
    docs: list[bytes] = []
    plain: list[bytes] = []
    raw = buf.tobytes()
    for d in range(len(off) - 1):
        at = range(int(firsts[d]), int(firsts[d + 1]))
        words = [raw[s[i]:e[i]] for i in at if keep[i]]
        docs.append(b"".join(words))
        plain.append(b"_".join(words))
    out: list[list[int]] = [[] for _ in docs]
    for c, n in enumerate(LENGTHS):
        rows, who = [], []
        for d, both in enumerate(zip(docs, plain)):
            for t in both:
                if len(t) >= n:
                    i = zlib.crc32(t, n) % (len(t) - n + 1)
                    rows.append(t[i:i + n])
                    who.append(d)
        if rows:
            m = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, n)
            which, p = battery(m, law)
            codes = (c * len(ALPHABETS) + which) * SCORE_BINS + score_bins(p)
            for d, code in zip(who, codes.tolist()):
                out[d].append(code)
    return out


def written_strings(cell: int, law: np.ndarray, most: int = PRIOR_STRINGS) -> np.ndarray:
    """Up to ``most`` strings of a cell's length and alphabet, written by the law of
    the text (the same ones everywhere), as a bytes matrix."""
    c, a = divmod(cell, len(ALPHABETS))
    n, alphabet = LENGTHS[c], ALPHABETS[a]
    rng = np.random.default_rng(cell + 1)
    by_kind = [np.array([ord(ch) for ch in alphabet if KIND_OF[ord(ch)] == k], np.uint8) for k in range(4)]
    able = np.array([len(by_kind[0]) > 0, len(by_kind[1]) > 0, len(by_kind[2]) > 0, len(by_kind[3]) > 0,
                     len(by_kind[1]) > 0], float)
    step = STEP * able
    step = np.where(step.sum(axis=1, keepdims=True) > 0, step, able)
    step = np.cumsum(step / step.sum(axis=1, keepdims=True), axis=1)
    rows = np.zeros((2 * most, n), np.uint8)
    kind, before = np.full(len(rows), 5), np.full(len(rows), OTHER)
    for i in range(n):
        kind = np.minimum((rng.random(len(rows))[:, None] > step[kind]).sum(axis=1), 4)
        follows = np.where((kind == 1) | (i == 0), OTHER, before)
        u = rng.random(len(rows))
        for k in range(5):
            at = np.flatnonzero(kind == k)
            chars = by_kind[1 if k == 4 else k]
            if not len(at):
                continue
            if k in (0, 1, 4):
                p = np.exp(law[follows[at]][:, FOLD[chars]])
                p = np.cumsum(p / p.sum(axis=1, keepdims=True), axis=1)
                rows[at, i] = chars[np.minimum((u[at, None] > p).sum(axis=1), len(chars) - 1)]
            else:
                rows[at, i] = chars[(u[at] * len(chars)).astype(int)]
        before = FOLD[rows[:, i]]
    return rows[alphabets_of(rows) == a][:most]


def length_class(n: int) -> int:
    return max(i for i, low in enumerate(LENGTHS) if n >= low)


# ------------------------------------------------------------------ the scan
def learn(df: DataFrame, text: str = "text") -> np.ndarray:
    """The law of the corpus's text; 27 x 27 counts reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(27 * 27, np.int64)
        for batch in batches:
            for _, _, buf, off in slices(batch):
                n += letter_pairs(buf, off)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    rows = df.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "at int, n long") \
        .groupBy("at").agg(F.sum("n").alias("n")).collect()
    pairs = np.zeros(27 * 27, np.int64)
    for r in rows:
        pairs[r["at"]] = r["n"]
    return text_law(pairs)


def _scan(df: DataFrame, key: str, text: str, law: np.ndarray) -> DataFrame:
    """Per document: base spans (start, kind, end triples), candidate runs
    (start, end, code triples) and the codes of its null strings; a code is the
    cell (length class, alphabet) times SCORE_BINS plus score bin."""
    src = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in slices(batch):
                s, e, firsts = word_spans(buf, off, RUN_BYTES)
                long_run = e - s >= MIN_RUN
                doc = np.searchsorted(firsts, np.flatnonzero(long_run), "right") - 1
                runs: list[list] = [[] for _ in range(b - a)]
                for d, i, j in zip(doc.tolist(), s[long_run].tolist(), e[long_run].tolist()):
                    runs[d].append((i, j))
                raw = buf.tobytes()
                base, cand = [], []
                for d in range(b - a):
                    lo, hi = int(off[d]), int(off[d + 1])
                    t = raw[lo:hi].decode()
                    spans = base_spans(t)
                    base.append([x for sp in spans for x in sp])
                    mine = []
                    for i, j in runs[d]:
                        run = raw[i:j].decode()
                        at = len(raw[lo:i].decode())
                        if not any(x < at + len(run) and at < z for x, _, z in spans):
                            mine += [at, at + len(run), run_code(run, law)]
                    cand.append(mine)
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_pydict({
                    "k": batch.column("k").slice(a, b - a), "fixed": pa.array(base, kind),
                    "cand": pa.array(cand, kind), "null": pa.array(null_codes(buf, off, law), kind)})

    return src.mapInArrow(scan, "k long, fixed array<int>, cand array<int>, null array<int>")


def thresholds(cand: dict[int, int], null: dict[int, int], fdr: float = FDR) -> list[int]:
    """Per cell, the lowest score bin that is accepted (SCORE_BINS: none), from
    the candidates' and the null strings' counts by code."""
    out = []
    for c in range(CELLS):
        mine = [cand.get(c * SCORE_BINS + i, 0) for i in range(SCORE_BINS)]
        text = [null.get(c * SCORE_BINS + i, 0) for i in range(SCORE_BINS)]
        best, total, among, taken, above = SCORE_BINS, sum(mine), sum(text), 0, 0
        for i in range(SCORE_BINS - 1, 0, -1):
            taken += mine[i]
            above += text[i]
            if mine[i] and (1 + above) / (1 + among) <= fdr * taken / total:
                best = i
        out.append(best)
    return out


def _counts(found: DataFrame, codes) -> dict[int, int]:
    """Counts by code: at most a row for each cell and score bin."""
    return {r[0]: r[1] for r in found.select(F.explode(codes)).groupBy("col").count().collect()}


def _limits(found: DataFrame, law: np.ndarray, fdr: float) -> list[int]:
    """Thresholds from a (durable) scan's codes."""
    codes = F.filter(F.transform("cand", lambda x, i: F.when(i % 3 == 2, x)), lambda x: x.isNotNull())
    cand, null = _counts(found, codes), _counts(found, F.col("null"))
    for cell in sorted({c // SCORE_BINS for c in cand}):
        which, p = battery(written_strings(cell, law), law)
        for b in score_bins(p[which == cell % len(ALPHABETS)]).tolist():
            null[cell * SCORE_BINS + b] = null.get(cell * SCORE_BINS + b, 0) + 1
    return thresholds(cand, null, fdr)


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text",
                 fdr: float = FDR) -> DataFrame:
    """Per document: key, base (array of struct start, kind, end) and spans
    (the same with the accepted random runs), both by start, then kind.  The
    scan's small result is checkpointed; texts are read for the law and once more."""
    law = learn(df, text)
    found = durable(_scan(df, key, text, law))
    limit = _limits(found, law, fdr)
    least = F.array(*[F.lit(c * SCORE_BINS + x) for c, x in enumerate(limit)])

    def triples(column, kind=None):
        n = F.size(column) / 3
        at = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(
            F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(
            column[i * 3].alias("start"),
            (column[i * 3 + 1] if kind is None else F.lit(kind)).alias("kind"),
            column[i * 3 + (2 if kind is None else 1)].alias("end"),
            (F.lit(0) if kind is None else column[i * 3 + 2]).alias("code")))

    def spans(x):
        return F.transform(x, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"),
                                                 s["end"].alias("end")))

    base = spans(triples(F.col("fixed")))
    extra = F.filter(triples(F.col("cand"), KINDS.index("random")), lambda s: s["code"] >= F.element_at(
        least, (F.floor(s["code"] / SCORE_BINS) + 1).cast("int")))
    return found.select(F.col("k").alias(key), base.alias("base"),
                        F.array_sort(F.concat(base, spans(extra))).alias("spans"))


def joined(spans):
    """kind:start:end, comma-joined (a column of span structs)."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"),
        s["end"].cast("string"))), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns."""
    def n(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")

    return found.select(key, n("assign").alias("n_assign"), n("access").alias("n_access"),
                        n("hex").alias("n_hex"),
                        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]",
           fdr: float = FDR) -> DataFrame:
    """The rows of df (all columns) with every span replaced by the mark: a
    first pass learns the law of the text, a second one sets the thresholds, a
    third one writes; nothing is shuffled.  A null text stays null."""
    law = learn(df, text)
    limit = _limits(durable(_scan(df, key, text, law).select("cand", "null")), law, fdr)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            texts = []
            for t in b.column(text).to_pylist():
                if t:
                    spans = base_spans(t)
                    where = [(s, e) for s, _, e in spans] + [
                        (s, e) for s, e, code in random_runs(t, spans, law)
                        if code % SCORE_BINS >= limit[code // SCORE_BINS]]
                    t = redact_text(t, where, mark) if where else t
                texts.append(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if n == text else b.column(n) for n in b.schema.names],
                names=b.schema.names)

    return df.mapInArrow(write, schema)


def random_runs(text: str, spans, law: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, code) of the candidate runs of one text."""
    out = []
    for m in RUN_RE.finditer(text):
        run = m[0]
        if not any(x < m.end() and m.start() < z for x, _, z in spans):
            out.append((m.start(), m.end(), run_code(run, law)))
    return out


def redact_text(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """The text with the (united) spans replaced by the mark."""
    out, at = [], 0
    for s, e in sorted(spans):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def brute_force(text: str | None) -> tuple:
    """(n_assign, n_access, n_hex, base_sha256) by walking the patterns' own
    wording, one character at a time (for tests)."""
    t, out = text or "", []
    value = re.compile(ASSIGN_VALUE)
    i = 0
    while i < len(t):
        hit = None
        for w in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if t[i:i + len(w)].translate(_LOWER) == w:
                j = i + len(w)
                tail = re.compile("[\"']?\x20*[:=]\x20*[\"']?").match(t, j)
                v = tail and value.match(t, tail.end())
                if v:
                    hit = v
                    break
        if hit:
            if hit.end() - hit.start() >= MIN_ASSIGN:
                out.append((i, 0, hit.end()))
            i = hit.end()
        else:
            i += 1
    for kind, pat, least in ((1, ACCESS, MIN_ACCESS), (2, HEX, MIN_HEX)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pat, t) if m.end() - m.start() >= least]
    out.sort()
    return (*(sum(k == x for _, k, _ in out) for x in range(3)),
            hashlib.sha256(span_text(out).encode()).hexdigest())


_LOWER = {i: i + 32 for i in range(65, 91)}
