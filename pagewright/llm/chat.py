r"""Chat formatting as a prefix tree.

A conversation becomes a text by a template of marks; control strings inside its texts are escaped. Conversations that begin with the same turns share
those turns' nodes: a tree of turns whose nodes are written once, depth first. A node carries its tokens (ids of a public byte-level vocabulary), the
position of its first token in its tree's sequence, the position id that token has in its conversations, which of its tokens are learned from, and the
ancestors' intervals of the sequence it attends to besides itself. A conversation is the path to one node.

Template: a turn of role ``assistant`` is ``<s>text</s>``, any other ``[INST]role`` newline ``text[/INST]``. In texts and roles a backslash is put
before the name in every ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, and one more where backslashes stand there already; a line break in a role is written ``\n``,
a backslash in it ``\\``.
"""
from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import ship_package
from pagewright.operators.ordered import last_before, running_sum
from pagewright.session import stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text before merging: contractions, words, numbers, other marks, white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNKS = 4096
#: Characters a tokenizer call gets at once.
CALL_CHARS = 1 << 16
_CONTROL = re.compile(r"(<\/?|\[\/?)(\\*)(s>|INST\])")
_ESCAPED = re.compile(r"(<\/?|\[\/?)\\(\\*)(s>|INST\])")
_TURN = re.compile(r"<s>(?P<said>.*?)</s>|\[INST\](?P<role>[^\n]*)\n(?P<text>.*?)\[/INST\]", re.DOTALL)


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[1]}\\{m[2]}{m[3]}" if (m[1][0] == "<") == (m[3] == "s>") else m[0], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"{m[1]}{m[2]}{m[3]}" if (m[1][0] == "<") == (m[3] == "s>") else m[0], text)


def formatted(role: str, text: str) -> tuple[str, str, str]:
    """A turn's text in three parts, the middle one learned from."""
    if role == "assistant":
        return "<s>", escaped(text), "</s>"
    name = escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))
    return f"[INST]{name}\n{escaped(text)}[/INST]", "", ""


def parsed(text: str) -> list[tuple[str, str]]:
    """The ``(role, text)`` turns of a formatted conversation."""
    out = []
    for m in _TURN.finditer(text):
        if m["said"] is not None:
            out.append(("assistant", unescaped(m["said"])))
        else:
            role = re.sub(r"\\(.)", lambda e: "\n" if e[1] == "n" else e[1], unescaped(m["role"]))
            out.append((role, unescaped(m["text"])))
    return out


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("turns", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encode(path: str, text: str) -> list[int]:
    encode = _encoding(path).encode_ordinary
    return [t for at in range(0, len(text), CALL_CHARS) for t in encode(text[at:at + CALL_CHARS])]


def _tokens(path: str):
    def tokens(batches):
        for batch in batches:
            ids, low, high = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = [_encode(path, p) for p in formatted(role, text)]
                ids.append([t for p in parts for t in p])
                low.append(len(parts[0]))
                high.append(len(parts[0]) + len(parts[1]))
            kept = [batch.column(c) for c in ("node", "tree", "way", "depth")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.list_(pa.int32())), pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                                             ["node", "tree", "way", "depth", "tokens", "loss_from", "loss_to"])
    return tokens


def paths(conversations: DataFrame) -> DataFrame:
    """``(conv_id, way, turns)``: each conversation with its turns in order and its way down, a hash of all turns so far for each turn.

    Null roles and texts are empty. Turns of equal number go by role and text; a null number comes first; rows repeated are turns of their own. A
    conversation is one row: its size is its own. Rows without a ``conv_id`` are one conversation. An empty table gives no rows; columns beside ``conv_id, turn, role,
    text`` are not looked at.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    key = lambda a, t: F.substring(F.sha2(F.concat(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")), F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]), 256), 1, 32)
    way = F.aggregate("turns", F.array().cast("array<string>"), lambda a, t: F.concat(a, F.array(key(a, t))))
    return gathered.select("conv_id", "turns", way.alias("way"))


def tree(walked: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The nodes of ``paths``: ``(node, tree, depth, tokens, loss_from, loss_to, at, head_at, position, attends)``.

    ``node`` names a way down; ``at`` is its first token's place in its tree's depth-first sequence, ``position`` its position id, ``attends`` the
    intervals ``[from, to)`` of its ancestors in the sequence, the root's first. Nodes without a branch between them lie end to end and make one
    interval, so a long conversation has few; ``head_at`` is where a node's own stretch begins. Token ``i`` of the node is learned from if
    ``loss_from <= i < loss_to``.
    """
    ship_package(walked.sparkSession)
    steps = walked.select("way", F.posexplode("turns").alias("i", "t"))
    node = steps.select(F.element_at("way", F.col("i") + 1).alias("node"), F.element_at("way", 1).alias("tree"), F.slice("way", F.lit(1), F.col("i") + 1).alias("way"),
                        (F.col("i") + 1).cast("long").alias("depth"), F.col("t.role").alias("role"), F.col("t.text").alias("text"))
    once = node.groupBy("node").agg(*(F.first(c).alias(c) for c in ("tree", "way", "depth", "role", "text")))
    spelled = stored(once.mapInArrow(_tokens(vocabulary), "node string, tree string, way array<string>, depth long, tokens array<int>, loss_from long, loss_to long"), "nodes")
    sized = spelled.select("node", "tree", "way", "depth", F.size("tokens").cast("long").alias("n"), F.try_element_at("way", F.lit(-2)).alias("parent"))
    # the sequence: nodes of a tree in the order of their ways, in chunks by the first turn below the root, so that no tree is one task
    below = F.substring(F.coalesce(F.try_element_at("way", F.lit(2)), F.lit("")), 1, 4)
    placed = stored(running_sum(sized, ["tree"], ["way"], F.col("n"), "end", below).withColumn("at", F.col("end") - F.col("n")), "placed")
    # a stretch begins at a root and below every branch; it goes on while each node is its parent's only child
    branches = placed.groupBy("parent").agg(F.count("*").alias("_n")).filter("_n > 1 and parent is not null").select("parent", F.lit(True).alias("_branch"))
    begun = placed.join(branches, "parent", "left").withColumn("_head", F.col("parent").isNull() | F.coalesce("_branch", F.lit(False)))
    stretched = stored(last_before(begun, ["tree"], ["way"], {"head": F.when(F.col("_head"), F.col("node")), "head_at": F.when(F.col("_head"), F.col("at"))}, below, including=True)
                       .select("node", "tree", "parent", "at", "end", "head", "head_at"), "stretches")
    # each stretch's way up, one more branch a round
    above = stretched.select(F.col("node").alias("parent"), F.col("head").alias("up"), F.struct(F.col("head_at").alias("from"), F.col("end").alias("to")).alias("piece"))
    waiting = stored(stretched.filter("node = head and parent is not null").select("head", "parent").join(above, "parent").select("head", "up", "piece"), "branches")
    known = stored(stretched.filter("node = head and parent is null").select("head", F.array().cast("array<struct<from: bigint, to: bigint>>").alias("ups")), "ways-up")
    whole = known
    while not known.isEmpty():
        known = stored(waiting.join(known.withColumnRenamed("head", "up"), "up").select("head", F.concat("ups", F.array("piece")).alias("ups")), "ways-up")
        whole = whole.unionByName(known)
    own = F.when(F.col("at") > F.col("head_at"), F.array(F.struct(F.col("head_at").alias("from"), F.col("at").alias("to")))).otherwise(F.array().cast("array<struct<from: bigint, to: bigint>>"))
    lines = stretched.join(whole, "head").select("node", "at", "head_at", F.concat("ups", own).alias("attends"))
    return spelled.drop("way").join(lines, "node").withColumn("position", F.aggregate("attends", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"]))


def _read(vocabulary: str):
    def read(batches):
        decode = _encoding(vocabulary).decode_bytes
        for batch in batches:
            out = []
            for conv_id, pieces in zip(batch.column("conv_id").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                text = b"".join(decode(p["tokens"]) for p in pieces).decode()
                learned = [unescaped(decode(p["tokens"][p["loss_from"]:p["loss_to"]]).decode()) for p in pieces if p["loss_to"] > p["loss_from"]]
                turns, loss = parsed(text), "".join(learned)
                out.append((conv_id, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return read


def read_back(walked: DataFrame, nodes: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Digests of every conversation as its path through the tree's output says it: its last node's ancestors are those of the intervals it attends to."""
    ends = walked.select("conv_id", F.element_at("way", -1).alias("node")).join(nodes.select("node", "tree", "at", "head_at", "attends"), "node")
    other = F.filter("attends", lambda x: x["from"] != F.col("head_at"))
    mine = F.array(F.struct(F.col("head_at").alias("from"), (F.col("at") + 1).alias("to")))
    spans = ends.select("conv_id", "tree", F.explode(F.concat(other, mine)).alias("s")).select("conv_id", "tree", F.col("s.from").alias("head_at"), F.col("s.to").alias("_to"))
    here = nodes.select("tree", "head_at", "at", "depth", "tokens", "loss_from", "loss_to")
    found = spans.join(here, ["tree", "head_at"]).filter(F.col("at") < F.col("_to"))
    whole = found.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "tokens", "loss_from", "loss_to"))).alias("pieces"))
    return whole.mapInArrow(_read(vocabulary), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
