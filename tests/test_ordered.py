"""Ordered helpers against plain windows, with a group that holds most of all rows, rows without a group and chunks of a few rows."""
from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.operators import ordered
from pagewright.operators.states import activity_sessions
from pagewright.session import stored


def hot(spark, n: int = 3000):
    rng = random.Random(7)
    data = [(None if i % 29 == 0 else "hot" if i % 3 else f"g{i % 50}", i, rng.choice([None, rng.randint(0, 9)]), "x" * rng.randint(0, 5)) for i in range(n)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "g string, i bigint, v bigint, t string")


def same(a, b) -> bool:
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_running_sum_and_numbers(spark) -> None:
    df, w = hot(spark), Window.partitionBy("g").orderBy("i")
    chunk = ordered.chunk_of(F.col("i"), 37)
    got = ordered.numbered(ordered.running_sum(df, ["g"], ["i"], F.col("v"), "s", chunk), ["g"], ["i"], "n", chunk)
    want = df.withColumn("s", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).withColumn(
        "n", (F.row_number().over(w) - 1).cast("long"))
    assert same(got.select("g", "i", "s", "n"), want.select("g", "i", "s", "n"))


def test_last_before(spark) -> None:
    df, w = hot(spark), Window.partitionBy("g").orderBy("i")
    for including, end in ((False, -1), (True, 0)):
        got = ordered.last_before(df, ["g"], ["i"], {"l": F.col("v")}, ordered.chunk_of(F.col("i"), 37), including)
        want = df.withColumn("l", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, end)))
        key = lambda d: d.select("g", "i", F.coalesce("l", F.lit(-1)))
        assert same(key(got), key(want))


def test_ranges_cut_a_group_that_lies_in_one_second(spark, monkeypatch) -> None:
    """Groups of very different spreads, a null group, values that repeat, whichever way bounds reach the rows."""
    rng = random.Random(2)
    data = [("hot", rng.randint(0, 900) if i % 3 else 5, i) for i in range(4000)] + [(None, rng.randint(0, 10 ** 12), i) for i in range(900)]
    data += [(f"g{i % 40}", rng.choice([None, i]), i) for i in range(400)]
    df = spark.createDataFrame(data, "g string, at bigint, i bigint")
    order = ["at", "i"]
    w = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("l", F.last("i", ignorenulls=True).over(w))
    for most in (2000, 0):
        monkeypatch.setattr(ordered, "MOST_HOT", most)
        ranged = ordered.by_range(df, ["g"], "at", 500)
        rows = ranged.collect()
        assert len(rows) == len(data) and {r._range for r in rows if r.g not in ("hot", None)} == {0}
        sizes = {}
        for r in rows:
            sizes.setdefault(r.g, {}).setdefault(r._range, []).append(r.at)
        assert len(sizes["hot"]) > 300 and len(sizes[None]) > 500
        assert max(len(v) for k, v in sizes["hot"].items() if 5 not in v) < 60 and max(map(len, sizes[None].values())) < 10
        for held in sizes.values():
            bounds = [(min(v), max(v)) for _, v in sorted(held.items()) if None not in v]
            assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))
        assert same(ordered.last_before(ranged, ["g"], order, {"l": F.col("i")}, F.col("_range")).select("g", "i", "l"), want.select("g", "i", "l"))


def test_bursts_of_a_user_with_one_day_equal_plain_windows(spark) -> None:
    rng = random.Random(3)
    rows = [("busy", rng.randint(0, 60_000), i) for i in range(3000)] + [(f"u{i % 9}", rng.randint(0, 10 ** 9), i) for i in range(200)]
    got = {(r.user_id, r.start_ts, r.end_ts, r.n) for r in activity_sessions(spark.createDataFrame(rows, "user_id string, ts bigint, event_id bigint"), 90, hot_rows=200).collect()}
    want = set()
    for user in {r[0] for r in rows}:
        times = sorted(r[1] for r in rows if r[0] == user)
        start, n = times[0], 0
        for at, after in zip(times, [*times[1:], None]):
            n += 1
            if after is None or after - at >= 90:
                want.add((user, start, at, n))
                start, n = after, 0
    assert got == want and sum(w[0] == "busy" for w in want) > 20


def test_first_n(spark) -> None:
    df, w = hot(spark), Window.partitionBy("g").orderBy("i")
    want = df.withColumn("_rank", F.row_number().over(w)).filter("_rank <= 7")
    assert same(ordered.first_n(df, ["g"], ["i"], 7).select("g", "i", "_rank"), want.select("g", "i", "_rank"))


def test_salted_join(spark) -> None:
    df = hot(spark)
    small = spark.createDataFrame([("hot", 1), ("g1", 2), ("none", 3)], "g string, k int")
    for how in ("inner", "left", "left_anti"):
        got, want = ordered.salted_join(df, small, ["g"], F.col("i"), how), df.join(small, "g", how)
        order = [c for c in ("g", "i", "k") if c in want.columns]
        fill = lambda d: d.select(*(F.coalesce(F.col(c), F.lit(-1)) if c == "k" else F.col(c) for c in order))
        assert same(fill(got), fill(want))


def test_copies_count_as_many_before_they_are_sent(spark, sent) -> None:
    """A salted small side is sixteen times the table it is made of, and is sized so: one that is small enough to be sent may not be sixteen times over."""
    df, small = stored(hot(spark), "big"), stored(spark.range(2000).select(F.concat(F.lit("g"), "id").alias("g"), F.col("id").alias("k")), "small")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 1 << 17)
        files = lambda joined: [part for part in sent(joined) if "FileScan" in part]
        assert files(df.join(small, "g", "left"))
        assert not files(ordered.salted_join(df, small, ["g"], F.col("i"), "left"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = df.join(small, "g", "left")
    assert same(ordered.salted_join(df, small, ["g"], F.col("i"), "left").select(want.columns), want)
    assert sorted((r.k, r._salt) for r in ordered.copies(small.filter("k < 2"), 3).collect()) == [(k, s) for k in range(2) for s in range(3)]


def test_pages_of_text_put_end_to_end_are_the_whole(spark) -> None:
    df = hot(spark)
    pages = ordered.pages_of_text(df, ["g"], ["i"], F.col("t"), "text", ordered.chunk_of(F.col("i"), 37), page_chars=100)
    got: dict = {}
    for r in sorted(pages.collect(), key=lambda r: (str(r.g), r.page)):
        assert len(r.text) <= 100 + 5
        got[r.g] = got.get(r.g, "") + r.text
    want: dict = {}
    for r in sorted(df.collect(), key=lambda r: (str(r.g), r.i)):
        want[r.g] = want.get(r.g, "") + r.t
    assert got == want


def test_a_wide_row_is_sent_as_often_as_its_key_asks(spark) -> None:
    """Narrow rows of a hot key, of ordinary ones and of none meet the wide row of their key as in a plain join; a hot key's wide row in each of its tasks."""
    big = spark.range(900).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") < 30, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id").cast("string"))).alias("g"), "id")
    small = spark.createDataFrame([(f"g{i}", i, "x") for i in range(0, 1200, 3)] + [("hot", 0, "h"), (None, 0, "n")], "g string, k int, t string")
    got = ordered.copied_join(big, small, ["g"], F.col("id"), 100)
    assert same(got.select("g", "id", "k", "t"), big.join(small, "g").select("g", "id", "k", "t"))
