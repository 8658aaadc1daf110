"""Conversation prefix trie by whole-sequence collapse.

Conversations are sequences of turns (role, text). A node of the trie is a distinct sequence of
first d turns, and the root (d = 0) has no turn. How it runs:

1. Turns get a hash of role, text and place, and a prefix is known by the exclusive or of its turns'
   hashes (128 bits, and its depth), which is summed up in blocks of places, so that a conversation
   of any length is spread over tasks.
2. Identical conversations collapse to one sequence with a weight and the list of its members, kept
   in chunks of neighbouring ids, whatever the number of members.
3. Sequences that are proper prefixes of others go by an anti-join; what stays are the leaves.
4. The prefixes of each sequence are aggregated once, with the sequence's weight.
   Sums over subtrees need no ancestors: each node's own value is given to the sequence of its smallest
   member, summed from the end of that sequence to each of its prefixes, and the sums of all sequences
   meet at the prefixes. Work is in proportion to the turns of distinct sequences.

Defined: null roles and texts are empty; rows with a null conversation id are left out; a null turn
comes first, and ties are ordered by role and by the SHA-256 of the text; repeated rows are turns of
their own; texts of any length are read once and hashed; other columns are ignored; without
conversations there are no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import stored

#: Places (and ids of members) that share their higher bits make a block (a chunk).
BLOCK_BITS, CHUNK_BITS = 10, 12
KEY = ("depth", "a", "b")


def _before(rows: DataFrame, by: str, block: str, total: Column, so_far) -> DataFrame:
    """(by, block, before): what the blocks of ``by`` before each block have in all."""
    blocks = rows.groupBy(by, block).agg(total.alias("total"))
    earlier = Window.partitionBy(by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(by, block, so_far("total", earlier).alias("before"))


def _added(x: str, over) -> Column:
    return F.coalesce(F.sum(x).over(over), F.lit(0).cast("long"))


def _mixed(x: str, over) -> Column:
    return F.coalesce(F.bit_xor(x).over(over), F.lit(0).cast("long"))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, role, digest, chars) of each turn of a table (conv_id, turn, role, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.sha2(text.cast("binary"), 256).alias("digest"),
        F.char_length(text).cast("long").alias("chars"),
    )
    rows = rows.withColumn("block", F.coalesce(F.shiftright("turn", BLOCK_BITS), F.lit(-(1 << 62))))
    order = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    own = rows.withColumn("own", F.row_number().over(order))
    before = _before(rows, "conv_id", "block", F.count("*"), _added)
    return own.join(before, ["conv_id", "block"]).select("conv_id", (F.col("own") + F.col("before")).alias("place"), "role", "digest", "chars")


def with_openings(turns: DataFrame, group: int = 100, folds: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings: (turns of the same columns, ids of all conversations).

    Conversation c takes the place of its own first h turns by the first h of conversation c - c % ``group``
    (all if it has fewer, none if it does not exist); h is the crc32 of the id as text modulo ``folds``.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = F.crc32(F.col("conv_id").cast("string")) % folds
    ids = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), heads.alias("h"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    ids = stored(ids.join(base, "base", "left").withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0)))), "openings")
    # at most folds - 1 turns of one conversation go to at most 2 * group - 1 others
    first = turns.where(F.col("place") < folds).withColumnRenamed("conv_id", "base")
    opening = ids.select("conv_id", "base", "head").join(first, "base").where("place <= head").select(*turns.columns)
    rest = turns.join(ids.select("conv_id", "h", "head"), "conv_id").where("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("head"))
    return opening.union(rest.select(*turns.columns)), ids.select("conv_id")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, parent_a, parent_b, chars): the prefix that ends with each turn, and the one before it."""
    own = [F.xxhash64(F.lit(seed), "role", "digest", "place").alias(x) for seed, x in ((1, "x"), (2, "y"))]
    rows = turns.select("conv_id", F.col("place").alias("depth"), F.shiftright("place", BLOCK_BITS).alias("block"), *own, "chars")
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select("*", F.bit_xor("x").over(within).alias("in_x"), F.bit_xor("y").over(within).alias("in_y"))
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("all_x"), F.bit_xor("y").alias("all_y"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("conv_id", "block", _mixed("all_x", earlier).alias("to_x"), _mixed("all_y", earlier).alias("to_y"))
    a, b = F.col("in_x").bitwiseXOR(F.col("to_x")), F.col("in_y").bitwiseXOR(F.col("to_y"))
    return inside.join(before, ["conv_id", "block"]).select("conv_id", "depth", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x")).alias("parent_a"), b.bitwiseXOR(F.col("y")).alias("parent_b"), "chars")


def collapse(every: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole sequences: (depth, a, b, conv_id of the smallest member, weight), and their members in chunks.

    Chunks are (depth, a, b, chunk, ids): ascending ids, of at most 2 ** CHUNK_BITS neighbouring values.
    ``every``: the prefixes; ``ids``: all conversations, those without turns too.
    """
    last = every.groupBy("conv_id").agg(F.max(F.struct("depth", "a", "b")).alias("last"))
    zero = F.lit(0).cast("long")
    whole = ids.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(F.col(f"last.{c}"), zero).alias(c) for c in KEY])
    whole = stored(whole, "whole")
    sequences = whole.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"))
    chunks = whole.groupBy(*KEY, F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    return stored(sequences, "sequences"), chunks


def prefix_trie(turns: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie of ``turns`` (conv_id, place, role, digest, chars) of the conversations ``ids``: (nodes, members).

    nodes: depth, a, b (the node's key), conv_id (its smallest member; turn ``depth`` of it is the node's), parent_conv_id,
    n_convs, n_children, n_leaves, saved (summed over the subtree: members but one, times characters
    of the last text). members: the conversations that end at each node, in chunks.
    """
    every = stored(prefixes(turns), "prefixes")
    sequences, chunks = collapse(every, ids)
    zero = F.lit(0).cast("long")
    own = sequences.select("conv_id", F.col("depth").alias("length"), "weight")
    roots = own.select("conv_id", "length", "weight", *[zero.alias(c) for c in (*KEY, "parent_a", "parent_b", "chars")])
    held = stored(every.join(own, "conv_id").unionByName(roots), "collapsed")

    leaves = sequences.join(held.where("depth < length").select(*KEY).distinct(), list(KEY), "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    weighted = held.join(leaves, "conv_id", "left").groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("weight").alias("n_convs"),
        F.sum(F.coalesce("leaf", zero)).alias("n_leaves"),
        F.max("chars").alias("chars"),
        F.max("parent_a").alias("parent_a"),
        F.max("parent_b").alias("parent_b"),
    )
    nodes = stored(weighted, "nodes")

    up = [(F.col("depth") - 1).alias("depth"), F.col("parent_a").alias("a"), F.col("parent_b").alias("b")]
    children = nodes.where("depth > 0").select(*up).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id"))
    saved = _summed_below(held, nodes)
    found = nodes.join(parents, ["depth", "parent_a", "parent_b"], "left").join(children, list(KEY), "left").join(saved, list(KEY))
    return found.select(*KEY, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved"), chunks


def _summed_below(held: DataFrame, nodes: DataFrame) -> DataFrame:
    """(depth, a, b, saved): each node's own value, summed over its subtree."""
    own = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"))
    rows = held.select("conv_id", *KEY, F.shiftright("depth", BLOCK_BITS).alias("block")).join(own, ["conv_id", "depth"], "left").withColumn("own", F.coalesce("own", F.lit(0).cast("long")))
    behind = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    later = _before(rows.withColumn("block", -F.col("block")), "conv_id", "block", F.sum("own"), _added).withColumn("block", -F.col("block"))
    summed = rows.withColumn("inside", F.sum("own").over(behind)).join(later, ["conv_id", "block"])
    return summed.groupBy(*KEY).agg(F.sum(F.col("inside") + F.col("before")).alias("saved"))


def member_digests(chunks: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): SHA-256 of the ascending decimal member ids, comma-joined.

    The digest of a list is taken in one task, chunk by chunk, with memory for some chunks only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for *now, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = ",".join(map(str, ids)).encode()
                if now == key:
                    digest.update(b"," + text)
                else:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = now, hashlib.sha256(text)
            if done:
                yield _digest_batch(done)
        if key is not None:
            yield _digest_batch([(*key, digest.hexdigest())])

    dealt = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").select(*KEY, "ids")
    return dealt.mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:3]), pa.array([r[3] for r in rows])], [*KEY, "ends_sha256"])
