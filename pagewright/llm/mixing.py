"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source are dealt by a hash of their id into blocks of about ``BLOCK_ROWS``. A source's target gives the exact number of
blocks it is drawn for: whole passes over its blocks, then a part of one more, whose last block is filled document by document; what that
leaves is filled from the blocks after it, smallest documents first, until none fits. A binary
tree over the output shards splits these quotas: at each node the left half's slots are drawn without replacement from all blocks of the
node, source by source, each count hypergeometric given those before it. The counts at the leaves cut each source's blocks into disjoint
runs, one for each shard, and a shard's documents are ordered by a hash. All of it is DataFrame and SQL functions; all draws come from
hashes of ``seed``, so a rerun gives the same mix.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import numbered, text_of, unused
from pagewright.operators.ordered import chunk_of, numbered as placed_in_order, running_sum, salted_join
from pagewright.session import stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK_ROWS = 64
SHARD_WORDS = 1 << 21
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``(source, source_size, ...)`` with ``idx`` and ``target``: the weighted share of all sizes, none above twice its source's.

    Sources count by code point, null last. What a source at its limit leaves is shared again by weight: sources in the order of limit
    over weight are full up to a point, and past it all get the same amount for each unit of weight. A window over the sources alone.
    """
    placed = sizes.withColumn("idx", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = (placed.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), F.pmod("idx", F.lit(len(weights))) + 1).cast("double"))
               .withColumn("_most", F.col("source_size") * float(MOST_REPEATS)).withColumn("_ratio", F.col("_most") / F.col("_w")))
    all_ = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy("_ratio", "idx").rowsBetween(Window.unboundedPreceding, -1)
    level = weighed.withColumn("_level", (share * F.sum("source_size").over(all_) - F.coalesce(F.sum("_most").over(before), F.lit(0.0)))
                               / (F.sum("_w").over(all_) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    unit = F.min_by("_level", F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "idx"))).over(all_)
    return level.withColumn("target", F.coalesce(F.least("_most", unit * F.col("_w")), F.col("_most"))).drop("_w", "_most", "_ratio", "_level")


def _uniform(*parts: str) -> str:
    return f"((pmod(xxhash64({', '.join(parts)}), 9007199254740992L) + 0.5D) / 9007199254740992D)"


def _let(fields: dict[str, str], name: str, body: str) -> str:
    inner = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    return f"transform(array(named_struct({inner})), {name} -> {body})[0]"


def hypergeometric(good: str, bad: str, draws: str, u: str) -> str:
    """SQL for the number of good ones among ``draws`` of ``good + bad`` without replacement, at the quantile ``u``.

    Weights start at 1 on the likeliest count and follow the ratio of neighbours, upward and then downward, 12 deviations and 60 more to
    each side, beyond which nothing is left in double precision. Outcomes are taken in that order until ``u`` of the weight is used.
    """
    rise = lambda k: f"((p.k - {k}) * (p.n - {k})) / (({k} + 1) * (p.m - p.n + {k} + 1))"  # noqa: E731  from k to k + 1
    fall = lambda k: f"({k} * (p.m - p.n + {k})) / ((p.k - {k} + 1) * (p.n - {k} + 1))"  # noqa: E731  from k to k - 1
    up = lambda seed, extra: f"aggregate(sequence(0L, r.top - q.mode), {seed}, (a, j) -> named_struct('w', a.w * {rise('(q.mode + j)')}, 'c', a.c + a.w{extra}))"
    w = fall("(q.mode - j + 1)")
    down = lambda seed, extra: f"aggregate(sequence(0L, q.mode - r.low), {seed}, (a, j) -> named_struct('w', if(j = 0, a.w, a.w * {w}), 'c', a.c + if(j = 0, 0D, a.w * {w}){extra}))"
    pick_up = ", 'x', coalesce(a.x, if(t.t <= a.c + a.w, q.mode + j, null))"
    pick_down = f", 'x', coalesce(a.x, if(j > 0 and t.t <= a.c + a.w * {w}, q.mode - j, null))"
    zero = "named_struct('w', 1D, 'c', 0D)"
    picked = f"coalesce({down(f'''named_struct('w', 1D, 'c', g.c, 'x', {up("named_struct('w', 1D, 'c', 0D, 'x', cast(null as bigint))", pick_up)}.x)''', pick_down)}.x, q.mode)"
    body = _let({"t": "p.u * (g.c + h.c)"}, "t", picked)
    body = _let({"c": f"{down(zero, '')}.c"}, "h", body)
    body = _let({"c": f"{up(zero, '')}.c"}, "g", body)
    body = _let({"top": "cast(least(p.k, p.n, q.mode + q.reach) as bigint)", "low": "cast(greatest(0D, p.n - p.m, q.mode - q.reach) as bigint)"}, "r", body)
    body = _let({"mode": "cast(least(greatest(floor((p.n + 1) * (p.k + 1) / (p.k + p.m + 2)), 0D, p.n - p.m), p.k, p.n) as bigint)",
                 "reach": "cast(60 + 12 * ceil(sqrt(coalesce(p.n * p.k * p.m * (p.k + p.m - p.n) / nullif((p.k + p.m) * (p.k + p.m) * (p.k + p.m - 1), 0), 0))) as bigint)"}, "q", body)
    return _let({"k": f"cast({good} as double)", "m": f"cast({bad} as double)", "n": f"cast({draws} as double)", "u": u}, "p", body)


def split(nodes: DataFrame, total: int, shards: int, seed: int) -> DataFrame:
    """One level of the tree: nodes ``(lo, hi, q)`` of more than one shard become two. ``q`` holds the quota of each source, in order."""
    slots = lambda a, b: f"(({b}) * {total}L div {shards}L - ({a}) * {total}L div {shards}L)"
    one = hypergeometric("q[i]", "a.n_all - q[i]", "a.n_left", _uniform(f"{seed}L", "lo", "hi", "i"))
    step = _let({"x": one}, "d", "named_struct('n_all', a.n_all - q[i], 'n_left', a.n_left - d.x, 'out', concat(a.out, array(d.x)))")
    left = (f"aggregate(sequence(0, size(q) - 1), named_struct('n_all', aggregate(q, 0L, (x, y) -> x + y), 'n_left', {slots('lo', 'mid')}, "
            f"'out', cast(array() as array<bigint>)), (a, i) -> {step}).out")
    halved = nodes.withColumn("mid", F.expr("(lo + hi) div 2")).withColumn("_left", F.when(F.col("hi") - F.col("lo") > 1, F.expr(left)))
    both = F.expr("if(hi - lo > 1, array(named_struct('lo', lo, 'hi', mid, 'q', _left), named_struct('lo', mid, 'hi', hi, 'q', transform(q, (x, i) -> x - _left[i]))), "
                  "array(named_struct('lo', lo, 'hi', hi, 'q', q)))")
    return halved.select(F.explode(both).alias("n")).select("n.lo", "n.hi", "n.q")


def _filled(blocks: DataFrame) -> DataFrame:
    """The rows taken of a source's last, partly drawn block: largest first, each that still fits. A block is a hash bucket of some ``BLOCK_ROWS`` rows."""
    gathered = blocks.groupBy("idx", "block").agg(F.sort_array(F.collect_list(F.struct("size", "_key", "_row")), asc=False).alias("_all"), F.first("left").alias("left"))
    taken = F.expr("aggregate(_all, named_struct('left', left, 'out', cast(array() as array<struct<_row: bigint, _key: bigint, size: bigint>>)), (a, x) -> "
                   "if(x.size <= a.left, named_struct('left', a.left - x.size, 'out', concat(a.out, array(named_struct('_row', x._row, '_key', x._key, 'size', x.size)))), a)).out")
    return gathered.select("idx", "block", F.explode(taken).alias("t")).select("idx", "block", "t.*")


def _after(later: DataFrame, seed: int) -> DataFrame:
    """``(_row, _key, idx)`` of what is taken of a source's rows ``(_row, _key, size, idx, left)`` after its last block: the smallest, as many as fit in ``left``.

    A window runs over a source's different sizes, not its rows: below one size all rows are taken, of that size as many as fit, by a hash.
    """
    sizes = later.groupBy("idx", "size").agg(F.count("*").alias("_n"), F.first("left").alias("left"))
    before = F.coalesce(F.sum(F.col("_n") * F.col("size")).over(Window.partitionBy("idx").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = sizes.withColumn("_fit", F.least(F.col("_n"), F.floor((F.col("left") - before) / F.col("size")))).filter("_fit > 0").select("idx", "size", "_n", "_fit")
    open_ = stored(salted_join(later, fits, ["idx", "size"], F.col("_row")), "later")
    hashed = open_.filter("_fit < _n").withColumn("_hash", F.xxhash64(F.lit(seed), "_key"))
    # the rows of each size are ordered apart from those of another
    some = placed_in_order(hashed, ["idx", "size"], ["_hash", "_key", "_row"], "_at", F.shiftright("_hash", 44)).filter("_at < _fit")
    return open_.filter("_fit = _n").select("_row", "_key", "idx").unionByName(some.select("_row", "_key", "idx"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, block_rows: int = BLOCK_ROWS, shard_words: int = SHARD_WORDS,
         seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(placed, mix)``: every row with its size, source size and target, and a row ``(_row, idx, shard, turn, place)`` for each time one is taken.

    A null text has size 0; rows of a null source are a source of their own; rows repeated are rows like others; an empty table gives an empty
    mix. ``place`` orders a shard. The mix is the same whatever files and splits the rows come in; of equal rows it may be another that is taken.
    ``_row`` is a number for each row, given as ``docs`` is read, which is once.
    """
    return _plan(docs.select("doc_id", "text", "source").withColumn("_row", F.monotonically_increasing_id()), weights, share, block_rows, shard_words, seed)


def _plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, block_rows: int = BLOCK_ROWS, shard_words: int = SHARD_WORDS,
          seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """``plan`` of rows ``(_row, doc_id, text, source)``."""
    sized = stored(rows.select("_row", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text_of()).alias("_said"),
                               F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), F.col("source").cast("string").alias("source")), "sizes")
    named = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n")), weights, share)
    named = named.withColumn("nb", F.ceil(F.col("_n") / block_rows)).drop("_n")
    turns = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    named = stored(named.withColumn("turns", turns).withColumn("rest", F.col("target") - F.col("turns") * F.col("source_size"))
                   .withColumn("_key", F.coalesce("source", F.lit(""))).withColumn("_null", F.col("source").isNull()).drop("source"), "sources")
    keyed = sized.withColumn("_key", F.coalesce("source", F.lit(""))).withColumn("_null", F.col("source").isNull())
    # an id that says which row it is places it; rows of none or of one id are told apart by their texts, and equal ones counted, so they share no block. Nothing that
    # decides hangs on a row's number, which is that of its place in a file, but for which of two equal rows it is
    twice = stored(keyed.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit(True).alias("_twice")), "twice")
    keyed = stored(salted_join(keyed, twice, ["doc_id"], F.col("_row"), "left").withColumn("_odd", F.col("doc_id").isNull() | F.coalesce("_twice", F.lit(False))).drop("_twice"), "keyed")
    odd = placed_in_order(keyed.filter("_odd"), ["_said", "_key", "_null"], ["_row"], "_nth", chunk_of(F.col("_row")))
    keyed = keyed.filter("not _odd").withColumn("_nth", F.lit(0).cast("long")).unionByName(odd).withColumnRenamed("_key", "_source")
    keyed = keyed.withColumn("_key", F.xxhash64("doc_id", "_said", "_nth"))
    named = named.withColumnRenamed("_key", "_source")
    block = F.expr(f"cast(floor({_uniform(f'{seed}L', 'doc_id', 'if(_odd, _key, null)')} * nb) as bigint)")
    placed = stored(salted_join(keyed, named, ["_source", "_null"], F.col("_row")).withColumn("block", block).drop("_source", "_null", "_odd", "_nth", "_said"), "placed")

    blocks = placed.groupBy("idx", "block").agg(F.sum("size").alias("words"), *(F.first(c).alias(c) for c in ("nb", "turns", "rest")))
    summed = stored(running_sum(blocks, ["idx"], ["block"], F.col("words"), "upto", chunk_of(F.col("block"))), "blocks")
    ends = (summed.filter("upto > rest").groupBy("idx").agg(F.min(F.struct("block", (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))).alias("e"))
            .select("idx", F.col("e.block").alias("last"), F.col("e.left").alias("left")))
    quotas = stored(named.join(ends, "idx", "left").select("idx", "nb", "turns", "last", "left", "rest", (
        F.col("nb") * F.col("turns") + F.when(F.col("rest") > 0, F.coalesce(F.col("last") + 1, F.col("nb"))).otherwise(F.lit(0))).alias("quota")), "quotas")

    total, words = quotas.agg(F.sum("quota")).first()[0] or 0, named.agg(F.sum("target")).first()[0] or 0
    shards = max(1, math.ceil(words / shard_words))
    nodes = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "quota"))), lambda x: x["quota"]).alias("q")).filter("size(q) > 0").select(
        F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "q")
    for level in range(math.ceil(math.log2(shards))):
        nodes = split(nodes if level < 5 else nodes.repartition("lo"), total, shards, seed)
    nodes = stored(nodes, "leaves")
    leaves = nodes.select(F.col("lo").alias("shard"), F.posexplode("q").alias("idx", "k"))
    first = F.coalesce(F.sum("k").over(Window.partitionBy("idx").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = leaves.withColumn("first", first).filter("k > 0").join(quotas, "idx")
    draws = (runs.select("shard", "idx", "nb", "turns", "last", F.explode(F.expr("sequence(first, first + k - 1)")).alias("draw"))
             .select("shard", "idx", F.expr("draw div nb").alias("turn"), F.expr("draw % nb").alias("block"),
                     F.expr("draw div nb = turns and draw % nb = last").alias("part")))
    draws = stored(draws.withColumn("part", F.coalesce("part", F.lit(False))), "draws")
    rows = placed.select("_row", "_key", "idx", "block").join(draws.filter("not part").drop("part"), ["idx", "block"])
    lasts = quotas.filter("last is not null and left > 0").select("idx", F.col("last").alias("block"), "left")
    filled = stored(_filled(placed.select("_row", "_key", "size", "idx", "block").join(lasts, ["idx", "block"])), "filled")
    some = filled.drop("size").join(draws.filter("part").drop("part"), ["idx", "block"])
    spent = filled.groupBy("idx").agg(F.sum("size").alias("_spent"))
    rests = stored(quotas.filter("last is not null and rest > 0").join(spent, "idx", "left").select("idx", "turns", "last", (F.col("left") - F.coalesce("_spent", F.lit(0))).alias("left")), "rests")
    sought = placed.filter("size > 0").select("_row", "_key", "size", "idx", "block")
    later = salted_join(sought, rests.drop("turns"), ["idx"], F.col("_row")).filter("block > last and size <= left").select("_row", "_key", "size", "idx", "left")
    more = _after(later, seed).join(rests.select("idx", F.col("turns").alias("turn")), "idx").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "_key"), F.lit(shards)))
    taken_rows = ["_row", "_key", "idx", "shard", "turn"]
    mix = rows.select(taken_rows).unionByName(some.select(taken_rows)).unionByName(more.select(taken_rows)).select("_row", "idx", "shard", "turn", F.xxhash64(F.lit(seed), "shard", "turn", "_key").alias("place"))
    return placed, mix


def taken(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every row: the words the mix takes of it, repeats counted."""
    placed, mix = plan(docs, **options)
    times = mix.groupBy("_row").agg(F.count("*").alias("_times"))
    return placed.join(times, "_row", "left").select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("_times", F.lit(0))).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, all their columns, rows taken twice coming twice; each partition in the order of its shards.

    ``docs`` is read once.
    """
    row, shard, place = (unused(docs, c) for c in ("_row", "_shard", "_place"))
    rows = numbered(docs, row)
    _, mix = _plan(rows.select(F.col(row).alias("_row"), "doc_id", "text", "source"), **options)
    drawn = mix.select(F.col("_row").alias(row), F.col("shard").alias(shard), F.col("place").alias(place))
    return rows.join(drawn, row).repartition(shard).sortWithinPartitions(shard, place).drop(row, shard, place)
