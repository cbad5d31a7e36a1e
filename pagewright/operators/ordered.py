"""Order inside groups that may be huge.

A plain window partitioned by a group's key puts the whole group into one task. Here a group is cut along its order into
chunks; the windows run over one chunk of one group each, and what the earlier chunks hold is carried in from a table
with one row per chunk, made by partial aggregation. The results equal the plain window's.

``chunk`` is a monotone function of the order, for example ``index div 4096``: rows of a later chunk come later, a null chunk's first. Null keys
are one group.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import stored

#: Rows of one group that share a chunk where the order is a dense position.
CHUNK_ROWS = 4096


def chunk_of(position: Column, rows: int = CHUNK_ROWS) -> Column:
    return F.floor(position / F.lit(rows))


#: Rows of a group from which on its order is cut into ranges, and ranges of the larger and the smaller kind.
HOT_ROWS, RANGES = 1 << 17, 32
#: Hot groups whose bounds are sent to every worker, some 8 KB each; those of more are joined.
MOST_HOT = 2000


def by_range(df: DataFrame, keys: list[str], at: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with ``_range``, a chunk for orders that begin with the number ``at``: 0 in a group of at most ``hot_rows`` rows, else one of some thousand ranges of about equal size.

    Where the values lie does not matter: a group that has all its rows in one second is cut inside it. Rows of one value share a range. Bounds are approximate quantiles of
    the hot groups alone, made by partial aggregation; a row finds its range by two comparisons with 32 bounds each, in generated code.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).select(*keys)
    hot = stored(sizes, "hot")
    n = hot.count()
    if not n:
        return df.withColumn("_range", F.lit(0))
    named = hot.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (df[k].eqNullSafe(named[f"_of_{k}"]) for k in keys))
    shares = [i / (RANGES * RANGES) for i in range(1, RANGES * RANGES)]
    few = n <= MOST_HOT
    rows = df.join(F.broadcast(named) if few else named, same, "left_semi")
    bounds = stored(rows.groupBy(*keys).agg(F.percentile_approx(at, shares, 20_000).alias("_bounds")), "bounds").withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (df[k].eqNullSafe(bounds[f"_of_{k}"]) for k in keys))
    if few:
        placed = df.join(F.broadcast(bounds), same, "left")
    else:
        salted = copies(bounds, 16)
        left = df.withColumn("_salt", F.pmod(F.xxhash64(at), F.lit(16)).cast("int"))
        placed = left.join(salted, reduce(lambda a, b: a & b, (left[k].eqNullSafe(salted[f"_of_{k}"]) for k in keys)) & (left["_salt"] == salted["_salt"]), "left").drop("_salt")
    above = lambda step, first: sum((F.when(F.col(at) >= F.element_at("_bounds", first + i * step), 1).otherwise(0) for i in range(1, RANGES)), F.lit(0))
    large = placed.withColumn("_large", F.when(F.col("_bounds").isNotNull(), above(RANGES, F.lit(0))).otherwise(0))
    small = F.when(F.col("_bounds").isNotNull(), F.col("_large") * RANGES + above(1, F.col("_large") * RANGES)).otherwise(0)
    return large.withColumn("_range", small).drop("_large", "_bounds", *(f"_of_{k}" for k in keys))


def _carried(df: DataFrame, keys: list[str], totals: list[Column], carries: list[Column]) -> DataFrame:
    """``df`` with each chunk's carry columns. ``df`` holds ``_chunk``."""
    per_chunk = df.groupBy(*keys, "_chunk").agg(*totals)
    parts = [*keys, "_chunk"]
    carry = per_chunk.select(*parts, *carries).withColumnsRenamed({k: f"_of_{k}" for k in parts})
    # a null key is a group and a null chunk a chunk, as in a plain window
    same = reduce(lambda a, b: a & b, (df[k].eqNullSafe(carry[f"_of_{k}"]) for k in parts))
    # neither side is bounded, and Spark sizes what is read of files by their compressed bytes, a tenth of the rows' and less: merged, else the driver may be sent either
    return df.hint("merge").join(carry, same).drop(*(f"_of_{k}" for k in parts))


def _before(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def running_sums(df: DataFrame, keys: list[str], order: list, values: dict[str, Column], chunk: Column) -> DataFrame:
    """For each ``out: value``, the sum of ``value`` over the rows of the group up to and including this one."""
    marked = reduce(lambda d, c: d.withColumn(f"_v_{c[0]}", c[1]), values.items(), df.withColumn("_chunk", chunk))
    joined = _carried(marked, keys, [F.sum(f"_v_{out}").alias(f"_total_{out}") for out in values],
                      [F.coalesce(F.sum(f"_total_{out}").over(_before(keys)), F.lit(0)).alias(f"_carry_{out}") for out in values])
    here = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = joined.withColumns({out: F.coalesce(F.sum(f"_v_{out}").over(here), F.lit(0)) + F.col(f"_carry_{out}") for out in values})
    return summed.drop("_chunk", *(f"_v_{o}" for o in values), *(f"_carry_{o}" for o in values))


def running_sum(df: DataFrame, keys: list[str], order: list, value: Column, out: str, chunk: Column) -> DataFrame:
    return running_sums(df, keys, order, {out: value}, chunk)


def numbered(df: DataFrame, keys: list[str], order: list, out: str, chunk: Column) -> DataFrame:
    """``out`` = the row's place in its group's order, from 0."""
    return (running_sum(df, keys, order, F.lit(1).cast("long"), "_place", chunk)
            .withColumn(out, (F.col("_place") - 1).cast("long")).drop("_place"))


def last_before(df: DataFrame, keys: list[str], order: list, columns: dict[str, Column], chunk: Column,
                including: bool = False) -> DataFrame:
    """For each ``out: value`` of ``columns``, the last value that is not null before this row (or at it).

    ``order`` must be total inside the group.
    """
    marked = reduce(lambda d, c: d.withColumn(f"_v_{c[0]}", c[1]), columns.items(), df.withColumn("_chunk", chunk))
    place = F.struct(*order)
    joined = _carried(
        marked, keys,
        [F.max_by(f"_v_{out}", F.when(F.col(f"_v_{out}").isNotNull(), place)).alias(f"_last_{out}") for out in columns],
        [F.last(f"_last_{out}", ignorenulls=True).over(_before(keys)).alias(f"_carry_{out}") for out in columns])
    here = (Window.partitionBy(*keys, "_chunk").orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, 0 if including else -1))
    for out in columns:
        joined = joined.withColumn(out, F.coalesce(F.last(f"_v_{out}", ignorenulls=True).over(here), F.col(f"_carry_{out}")))
    return joined.drop("_chunk", *(f"_v_{o}" for o in columns), *(f"_carry_{o}" for o in columns))


def first_n(df: DataFrame, keys: list[str], order: list, n: int, salts: int = 64) -> DataFrame:
    """The first ``n`` rows of each group, with their place (from 1) as ``_rank``.

    ``order`` names ascending columns. Two rounds: each salt of a group keeps its own first ``n`` before they meet, so the last task of a group sees at most
    ``salts * n`` rows however large the group is. Spark also cuts each round's rows to ``n`` before its shuffle.
    """
    salted = df.withColumn("_salt", F.pmod(F.hash(*order), F.lit(salts)))
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    kept = salted.withColumn("_rank", F.row_number().over(local)).filter(F.col("_rank") <= n).drop("_rank", "_salt")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return kept.withColumn("_rank", F.row_number().over(whole)).filter(F.col("_rank") <= n)


def copies(df: DataFrame, n: int, out: str = "_salt") -> DataFrame:
    """``df`` with ``out``: each row once for each number from 0 below ``n``.

    A product, which Spark sizes as one; an exploded table counts for as large as it was before, so the driver would be sent all copies of one that is not small at all.
    """
    return df.crossJoin(F.broadcast(df.sparkSession.range(0, n, 1, 1).select(F.col("id").cast("int").alias(out))))


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner",
                salts: int = 16) -> DataFrame:
    """An equi-join whose hot keys are spread over ``salts`` tasks: the small side, a few rows a key, is repeated."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return left.join(copies(small, salts), [*keys, "_salt"], how).drop("_salt")


def copied_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, rows: int = CHUNK_ROWS) -> DataFrame:
    """An equi-join of narrow rows with wide ones, one a key: a wide row is sent once for each ``rows`` narrow rows of its key, and not at all where there is none."""
    counts = big.groupBy(*keys).agg(F.ceil(F.count("*") / rows).cast("int").alias("_copies"))
    left = salted_join(big, counts, keys, spread).withColumn("_salt", F.pmod(F.xxhash64(spread), F.col("_copies")).cast("int")).drop("_copies")
    right = small.join(counts, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def pages_of_text(df: DataFrame, keys: list[str], order: list, text: Column, out: str, chunk: Column,
                  page_chars: int = 64 * 1024 * 1024) -> DataFrame:
    """The texts of a group joined in order, in pages: ``(keys, page, out)``.

    A page starts in a text of its own and gathers at most ``page_chars`` characters of starts, so no row and no task
    grows with the group; the pages put end to end are the whole. An ordinary group is one page, 0.
    """
    measured = df.withColumn("_text", text)
    placed = running_sum(measured, keys, order, F.length("_text").cast("long"), "_end", chunk)
    paged = placed.withColumn("page", F.floor((F.col("_end") - F.length("_text")) / page_chars))
    gathered = paged.groupBy(*keys, "page").agg(F.collect_list(F.struct(F.struct(*order).alias("o"), F.col("_text").alias("t"))).alias("_all"))
    return gathered.select(*keys, "page", F.array_join(F.transform(F.array_sort("_all"), lambda r: r["t"]), "").alias(out))
