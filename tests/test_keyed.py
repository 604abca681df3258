"""Chunked per-key running windows equal plain whole-partition windows,
including across chunk boundaries and for one hot key holding most rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from logvigil.operators import keyed


def _data(spark, n=500):
    # key "hot" holds ~2/3 of the rows, NULL key included
    rows = [(i, "hot" if i % 3 else ("cold" if i % 2 else None), i * 1000 + (i % 7), i % 5 == 0)
            for i in range(n)]
    return spark.createDataFrame(rows, "seq long, k string, t long, f boolean")


def test_running_sums_match_window(spark):
    df = _data(spark)
    got = keyed.running_sums(df, "k", {"c": F.lit(1).cast("long"),
                                       "s": F.col("f").cast("long")}, chunk_rows=37)
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("c", F.count(F.lit(1)).over(w)).withColumn("s", F.sum(F.col("f").cast("long")).over(w))
    a = sorted(got.select("seq", "c", "s").collect())
    b = sorted(exp.select("seq", "c", "s").collect())
    assert a == b


def test_previous_value_and_running_max(spark):
    df = _data(spark)
    got = keyed.previous_value(df, "k", "prev", F.col("t"), chunk_rows=11)
    got = keyed.running_max(got, "k", "mx", F.when(F.col("f"), F.col("t")), chunk_rows=11)
    w = Window.partitionBy("k").orderBy("seq")
    wr = w.rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("prev", F.lag("t").over(w)).withColumn(
        "mx", F.max(F.when(F.col("f"), F.col("t"))).over(wr))
    assert sorted(got.select("seq", "prev", "mx").collect()) == sorted(
        exp.select("seq", "prev", "mx").collect())


def test_key_totals(spark):
    df = _data(spark)
    got = keyed.key_totals(df, "k", {"n": F.lit(1).cast("long")}, chunk_rows=17)
    exp = df.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k")))
    assert sorted(got.select("seq", "n").collect()) == sorted(exp.select("seq", "n").collect())


def test_running_sums_firsts_and_maxes_in_one_table(spark):
    df = _data(spark)
    hit = F.when(F.col("f"), F.col("t"))
    got = keyed.running_sums(df, "k", {"n": F.lit(1).cast("long")}, chunk_rows=13,
                             firsts={"first_t": F.col("t")}, maxes={"mx": hit})
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumns({"n": F.count(F.lit(1)).over(w), "first_t": F.first("t").over(w),
                          "mx": F.max(hit).over(w)})
    cols = ["seq", "n", "first_t", "mx"]
    assert sorted(got.select(*cols).collect()) == sorted(exp.select(*cols).collect())


def test_idle_sessions_chunked_equals_session_window(spark):
    from logvigil.operators import response
    from conftest import SF0001
    ev = spark.read.parquet(f"{SF0001}/events.parquet")
    a = response.idle_sessions(ev, "user_id", order="event_id", chunk_rows=97)
    b = response.idle_sessions_window(ev, "user_id")
    assert sorted(a.collect()) == sorted(b.collect())


from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(keys=st.lists(st.sampled_from(["a", "a", "a", "b", "c", None]), min_size=1, max_size=60),
       gaps=st.lists(st.integers(min_value=1, max_value=4), min_size=60, max_size=60),
       chunk=st.integers(min_value=1, max_value=25))
def test_chunked_windows_property(spark, keys, gaps, chunk):
    seqs, s = [], 0
    for g in gaps[:len(keys)]:
        s += g
        seqs.append(s)
    df = spark.createDataFrame([(q, k, q * 3 % 11) for q, k in zip(seqs, keys)],
                               "seq long, k string, v long")
    got = keyed.running_sums(df, "k", {"c": F.col("v")}, chunk_rows=chunk)
    got = keyed.previous_value(got, "k", "p", F.col("v"), chunk_rows=chunk)
    w = Window.partitionBy("k").orderBy("seq")
    exp = df.withColumn("c", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))) \
            .withColumn("p", F.lag("v").over(w))
    assert sorted(got.select("seq", "c", "p").collect()) == sorted(exp.select("seq", "c", "p").collect())


def test_running_sums_firsts(spark):
    df = _data(spark)
    got = keyed.running_sums(df, "k", {"c": F.lit(1).cast("long")}, chunk_rows=13,
                             firsts={"ft": F.col("t")})
    w = Window.partitionBy("k").orderBy("seq")
    exp = df.withColumn("ft", F.first("t").over(w))
    assert sorted(got.select("seq", "ft").collect()) == sorted(exp.select("seq", "ft").collect())


def test_only_hot_keys_are_chunked(spark):
    """One key with most rows among a hundred thousand cold ones: the table of
    offsets holds the hot key's chunks and nothing else."""
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, F.lit("hot")).when(
        F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"))
    heavy = {r["_hk"] for r in keyed.heavy_hitters(df, "k", chunk_rows=10_000).collect()}
    assert heavy == {"=hot", ""}  # the NULL key holds a fourteenth of the rows
    d = keyed._with_chunk(df, "k", "seq", 10_000)
    chunks = d.groupBy("_hot", "_key").agg(F.countDistinct("_chunk").alias("c"), F.max("_chunk").alias("m"))
    per = {r["_key"]: r["c"] for r in chunks.where("_hot").collect()}
    assert set(per) == heavy and 8 <= per["=hot"] <= 25
    assert chunks.where("NOT _hot AND (c <> 1 OR m <> -1)").count() == 0
    got = keyed.running_sums(df, "k", {"c": F.lit(1).cast("long")}, chunk_rows=10_000, firsts={"f": F.col("seq")})
    w = Window.partitionBy("k").orderBy("seq")
    exp = df.withColumns({"c": F.count(F.lit(1)).over(w), "f": F.first("seq").over(w)})
    assert got.exceptAll(exp.select(got.columns)).count() == 0 and got.count() == n


def test_empty_log(spark):
    df = _data(spark).limit(0)
    assert keyed.running_sums(df, "k", {"c": F.lit(1).cast("long")}).count() == 0
    assert keyed.previous_value(df, "k", "p", F.col("t")).count() == 0
