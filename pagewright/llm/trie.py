"""A prefix trie of conversations by fixed-length block hashing.

A conversation's turns are cut into blocks of ``BLOCK_TURNS``. A block's digest is that of its turns; the sum of the digests so far, each hashed with its place,
names everything up to a block's end, and such sums run over chunks of a conversation, however long it is. Conversations are grouped by these names, block after block:
where all conversations that agree so far go on with one block, its turns are nodes as they stand. Only where they go on with different blocks
(siblings) are the turns inside looked at, and the different blocks grouped by each of their beginnings.

A node's members have a smallest id, the node's own. The nodes one conversation is the smallest member of are the end of its way. So a sum over a subtree is the
sum, over all members, of what their own nodes hold, less what the node's own conversation holds above it: no walk over levels.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import ship_package
from pagewright.operators.ordered import chunk_of, numbered, running_sum, running_sums, salted_join
from pagewright.session import stored

BLOCK_TURNS = 4
#: Conversations of one leader, and how many first turns of it they may take over.
TOGETHER, MOST_TURNS = 20, 3
#: A node's ends whose ids agree but for so many bits are put together before they meet.
IDS_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"


def marked(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, mark, words)`` of every turn ``(conv_id, turn, role, text)``: its place from 0, 128 bits that name role and text, and the words of its text.

    Turns go by number, null first; those of one number by ``mark``. A null role or text is empty. Rows without a ``conv_id`` belong to no
    conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    narrow = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), mark.alias("mark"),
                                                               F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    narrow = stored(narrow, "turns")
    return numbered(narrow, ["conv_id"], [F.col("turn").asc_nulls_first(), "mark"], "pos", chunk_of(F.col("turn"))).select("conv_id", "pos", "mark", "words")


def taken_over(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_TURNS + 1)).cast("long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(convs, turns)`` of conversations that begin as their leader does: ``(conv_id)``, and ``(conv_id, pos, mark, words)``.

    Conversation ``c`` takes the first ``crc32(c) % 4`` turns of ``c - c % 20`` in place of as many of its own (all if there are fewer, none if
    there is no such conversation).
    """
    lead = F.col("conv_id") - F.col("conv_id") % TOGETHER
    convs = stored(turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", lead.alias("lead"), taken_over(F.col("conv_id")).alias("h")), "convs")
    leaders = convs.filter("conv_id = lead").select("lead", F.col("n").alias("_n"))
    heads = convs.join(leaders, "lead", "left").select("conv_id", "lead", "h", F.least("h", F.coalesce("_n", F.lit(0))).alias("head"))
    heads = stored(heads, "heads")
    first = turns.filter((F.col("pos") < MOST_TURNS) & (F.col("conv_id") % TOGETHER == 0)).select(F.col("conv_id").alias("lead"), "pos", "mark", "words")
    taken = (heads.filter("head > 0").select("conv_id", "lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("head") - 1)).alias("pos"))
             .join(first, ["lead", "pos"]).select("conv_id", "pos", "mark", "words"))
    # only turns behind a leader with fewer turns than are taken over move
    fewer = heads.filter("head < h").select("conv_id", (F.col("h") - F.col("head")).alias("_less"))
    later = salted_join(turns.filter(F.col("pos") >= taken_over(F.col("conv_id"))), fewer, ["conv_id"], F.col("pos"), "left")
    own = later.select("conv_id", (F.col("pos") - F.coalesce("_less", F.lit(0))).alias("pos"), "mark", "words")
    return convs.select("conv_id"), taken.unionByName(own)


def _name(*parts) -> Column:
    return F.md5(F.concat_ws(",", *parts).cast("binary"))


def _beginning(turns: Column) -> Column:
    """The name of the node behind the first ``turns`` turns of a block ``(from, at, marks)``: a whole block's is that the next one goes on from."""
    return F.when(turns == F.lit(BLOCK_TURNS), F.col("at")).otherwise(_name("from", F.array_join(F.slice("marks", F.lit(1), turns), ",")))


def blocks(turns: DataFrame) -> DataFrame:
    """``(conv_id, blk, from, at, marks, words)``: each conversation's blocks, with the names of what lies before and up to them."""
    block = F.floor(F.col("pos") / BLOCK_TURNS)
    held = turns.groupBy("conv_id", block.alias("blk")).agg(F.array_sort(F.collect_list(F.struct("pos", "mark", "words"))).alias("t"))
    digested = held.select("conv_id", "blk", F.transform("t", lambda t: t["mark"]).alias("marks"), F.transform("t", lambda t: t["words"]).alias("words"))
    told = F.array_join("marks", ",")
    for i in (0, 1):
        digested = digested.withColumn(f"_d{i}", F.xxhash64(F.lit(i), "blk", told).cast("decimal(20,0)"))
    summed = running_sums(digested, ["conv_id"], ["blk"], {f"_s{i}": F.col(f"_d{i}") for i in (0, 1)}, chunk_of(F.col("blk")))
    return summed.select("conv_id", "blk", _name(F.col("blk") - 1, F.col("_s0") - F.col("_d0"), F.col("_s1") - F.col("_d1")).alias("from"),
                         _name("blk", "_s0", "_s1").alias("at"), "marks", "words")


def _root() -> Column:
    zero = F.lit(0).cast("decimal(20,0)")
    return _name(F.lit(-1).cast("long"), zero, zero)


def _turns_of(grouped: DataFrame, sums: list[Column]) -> DataFrame:
    """The nodes ``(id, parent, depth, words, sums)`` of blocks ``(from, at, blk, marks, words, split)``: as they stand, or grouped by their beginnings where siblings differ."""
    one = grouped.select("*", F.explode(F.sequence(F.lit(1), F.size("marks"))).alias("j"))
    return one.select("split", _beginning(F.col("j")).alias("id"), F.when(F.col("j") == 1, F.col("from")).otherwise(_beginning(F.col("j") - 1)).alias("parent"),
                      (F.col("blk") * BLOCK_TURNS + F.col("j")).alias("depth"), F.element_at("words", F.col("j")).alias("words"), *sums)


def ends_of(ends: DataFrame) -> DataFrame:
    """``(id, ends_sha256)`` of nodes' ends ``(id, conv_id)``: ids put together piece by piece, and a node's pieces, in order, one after the other through the digest."""
    piece = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("id", F.shiftright("conv_id", IDS_BITS).alias("no")).agg(piece.alias("ids"))
    dealt = pieces.repartition("id").sortWithinPartitions("id", "no")

    def digested(batches):
        now, sha = None, None
        for batch in batches:
            done = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node == now:
                    sha.update(b",")
                else:
                    if now is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = node, hashlib.sha256()
                sha.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["id", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (now, sha.hexdigest())], ["id", "ends_sha256"])
    return dealt.select("id", "ids").mapInArrow(digested, "id string, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of ``convs`` ``(conv_id)``, each once, with ``turns`` ``(conv_id, pos, mark, words)``; a conversation may have none.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``: a node is named by its smallest member and its
    depth. No conversation gives no node, not even a root. Equal conversations, and turns repeated within one, are what they are: members and turns.
    """
    ship_package(convs.sparkSession)
    walks = stored(blocks(turns), "walks")
    grouped = walks.groupBy("from", "at", "blk").agg(F.count("*").alias("n"), F.min("conv_id").alias("m"), F.first("marks").alias("marks"), F.first("words").alias("words"))
    grouped = stored(grouped, "blocks")
    siblings = grouped.groupBy("from").agg(F.count("*").alias("_k")).filter("_k > 1").select("from", F.lit(True).alias("_split"))
    grouped = stored(salted_join(grouped, siblings, ["from"], F.col("at"), "left").withColumn("split", F.coalesce("_split", F.lit(False))).drop("_split"), "blocks")

    every = _turns_of(grouped, [F.col("n"), F.col("m")])
    met = every.filter("split").groupBy("id", "parent", "depth").agg(F.first("words").alias("words"), F.sum("n").alias("n"), F.min("m").alias("m"))
    root = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("m")).filter("n > 0").select(
        _root().alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "n", "m")
    columns = ["id", "parent", "depth", "words", "n", "m"]
    nodes = stored(every.filter("not split").select(columns).unionByName(met.select(columns)).unionByName(root.select(columns)), "nodes")

    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("_saved", (F.col("n") - 1) * F.col("words")).withColumn("_leaf", (F.col("n_children") == 0).cast("long"))
    above = running_sum(nodes, ["m"], ["depth"], F.col("_saved"), "_upto", chunk_of(F.col("depth")))
    nodes = stored(above.withColumn("_above", F.col("_upto") - F.col("_saved")).drop("_upto"), "nodes")

    # what each conversation's own nodes hold goes to all the nodes it is a member of
    own = nodes.groupBy(F.col("m").alias("conv_id")).agg(F.sum("_saved").alias("_t"), F.sum("_leaf").alias("_l")).filter("_t > 0 or _l > 0")
    own = stored(own, "own")
    through = salted_join(walks.select("conv_id", "at"), own, ["conv_id"], F.col("at")).groupBy("at").agg(F.sum("_t").alias("_t"), F.sum("_l").alias("_l"))
    through = grouped.drop("n", "m").join(through, "at")
    sums = _turns_of(through, [F.col("_t"), F.col("_l")])
    sums = (sums.filter("not split").select("id", "_t", "_l")
            .unionByName(sums.filter("split").groupBy("id").agg(F.sum("_t").alias("_t"), F.sum("_l").alias("_l")))
            .unionByName(own.agg(F.sum("_t").alias("_t"), F.sum("_l").alias("_l")).filter("_l is not null").select(_root().alias("id"), "_t", "_l")))

    last = walks.groupBy("conv_id").agg(F.max_by(_beginning(F.size("marks")), "blk").alias("id"))
    ends = ends_of(convs.join(last, "conv_id", "left").select(F.coalesce("id", _root()).alias("id"), "conv_id"))
    parents = nodes.filter("n_children > 0").select(F.col("id").alias("parent"), F.col("m").alias("parent_conv_id"))
    named = salted_join(nodes, parents, ["parent"], F.col("id"), "left")
    return (named.join(sums, "id", "left").join(ends, "id", "left")
            .select(F.col("m").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
                    F.coalesce("_l", F.lit(0)).alias("n_leaves"), (F.coalesce("_t", F.lit(0)) - F.col("_above")).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))


def led_trie(conversations: DataFrame) -> DataFrame:
    """``trie`` of all conversations, each beginning as its leader does. An empty table gives no nodes; columns beside ``conv_id, turn, role, text`` are not looked at."""
    convs, turns = rebuilt(stored(marked(conversations), "marked"))
    return trie(convs, stored(turns, "rebuilt"))
