"""Prefix trie of conversations by vertical bitmaps (operator 13).

Conversations are dealt in ranges of their id and then in shards of bounded size. A shard indexes (position, turn) to the bit set of its
conversations that have this turn there, with bits in the order of ids, and walks its trie depth first: the members of a node that go
on, intersected with the posting of the next turn of their first one, are a child, so a node costs one intersection. Bit counts are
members, the lowest bit the smallest id, and members without a further turn the shard's end list of the node.

Nodes are named by the chained hash of their turns. The same node of several shards is counted together by name, and belongs to the
first shard that has it, the one of its smallest member. What is summed over subtrees is then summed inside each shard over the nodes
that belong to it: every node below another one is in some shard below the same other one, so the sums of the shards add up, whatever
the depth. A node that all conversations share is one row per shard.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import WORD_PATTERN, Tables, grown


@dataclass(frozen=True)
class Trie:
    """Conversations and turns in a shard; a conversation is never cut."""

    conversations: int = 8_192
    turns: int = 65_536


#: Name of the root (a fixed value).
ROOT = bytes(16)
LOCAL = "shard bigint, no int, parent int, depth int, key binary, n bigint, conv_id bigint, goes_on boolean, words bigint, ends string"


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, words): turns of each conversation from 0, in the order of `turn` (null first, ties by the turn's MD5).

    turn is the MD5 of role and text, of which null is empty. Rows without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("at"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("turn"), F.regexp_count(text, F.lit(WORD_PATTERN)).cast("bigint").alias("words"))
    return named.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("at"), "turn")) - 1).alias("pos"), F.unhex("turn").alias("turn"), "words")


def with_heads(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Conversations rebuilt with a shared head: of c, the first h turns are those of conversation c - c % group, h = crc32(c) % most.

    All of that conversation's turns if it has fewer, none if it is absent; c's own turns follow from its h-th on. Each conversation
    also gets a row at position -1 without a turn, so that one left without turns is still there.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    convs = convs.join(grown(sizes), "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"))
    heads = turns.where((F.col("pos") < most - 1) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    head = convs.where("taken > 0").join(grown(heads), "base").where("pos < taken").select("conv_id", "pos", "turn", "words")
    own = turns.join(grown(convs), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn", "words")
    return head.unionByName(own).unionByName(convs.select("conv_id", F.lit(-1).alias("pos"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("bigint").alias("words")))


def shard_nodes(ids: list[int], turns: list[list[bytes]], words: list[list[int]]) -> dict[str, list]:
    """Nodes of a shard's trie in the order of the walk; ids ascend."""
    postings: list[dict[bytes, int]] = []
    ending: dict[int, int] = {}
    for i, own in enumerate(turns):
        ending[len(own)] = ending.get(len(own), 0) | 1 << i
        while len(postings) < len(own):
            postings.append({})
        for posting, turn in zip(postings, own, strict=False):
            posting[turn] = posting.get(turn, 0) | 1 << i
    out: dict[str, list] = {c: [] for c in ("no", "parent", "depth", "key", "n", "conv_id", "goes_on", "words", "ends")}
    todo = [(-1, 0, ROOT, (1 << len(ids)) - 1)] if ids else []
    while todo:
        parent, depth, key, members = todo.pop()
        no = len(out["no"])
        first = (members & -members).bit_length() - 1
        done = members & ending.get(depth, 0)
        rest, below = members ^ done, []
        while rest:
            turn = turns[(rest & -rest).bit_length() - 1][depth]
            child = members & postings[depth][turn]
            below.append((no, depth + 1, hashlib.md5(key + turn).digest(), child))
            rest ^= child
        todo += reversed(below)
        ends = []
        while done:
            low = done & -done
            ends.append(str(ids[low.bit_length() - 1]))
            done ^= low
        for c, x in zip(out, (no, parent, depth, key, members.bit_count(), ids[first], bool(below), words[first][depth - 1] if depth else 0, ",".join(ends)), strict=True):
            out[c].append(x)
    return out


def _walked(config: Trie):
    """Rows (conv_id, pos, turn, words) in order -> nodes of each shard, shards numbered in the order of ids."""

    def run(batches):
        shard = TaskContext.get().partitionId() << 32
        ids, turns, words, held = [], [], [], 0

        def rows():
            nodes = shard_nodes(ids, turns, words)
            n = len(nodes["no"])
            kinds = {"parent": pa.int32(), "no": pa.int32(), "depth": pa.int32()}
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard] * n, pa.int64())} | {c: pa.array(x, kinds.get(c)) for c, x in nodes.items()})

        for batch in batches:
            for conv, pos, turn, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pos < 0:  # a conversation begins
                    if len(ids) >= config.conversations or held >= config.turns:
                        yield rows()
                        shard, held = shard + 1, 0
                        ids, turns, words = [], [], []
                    ids.append(conv)
                    turns.append([])
                    words.append([])
                else:
                    turns[-1].append(turn)
                    words[-1].append(n)
                    held += 1
        if ids:
            yield rows()

    return run


def _summed(nodes: pa.Table) -> pa.Table:
    """A shard's nodes with the sums over their subtrees of what belongs to this shard."""
    nodes = nodes.sort_by("no")
    parent, owned = nodes.column("parent").to_numpy(), nodes.column("owned").to_numpy(zero_copy_only=False)
    size = np.ones(len(parent), np.int64)
    for k in range(len(parent) - 1, 0, -1):
        size[parent[k]] += size[k]
    end = np.arange(len(parent)) + size
    upto = lambda x: np.concatenate([[0], np.cumsum(x)])
    below = lambda x: pa.array(upto(x)[end] - upto(x)[:-1], pa.int64())
    saved = np.where(owned, (nodes.column("n_convs").to_numpy() - 1) * nodes.column("words").to_numpy(), 0)
    leaves = owned & ~nodes.column("inner").to_numpy(zero_copy_only=False)
    children = np.bincount(parent[1:], owned[1:], len(parent)).astype(np.int64)
    conv = nodes.column("conv_id").combine_chunks()
    up = conv.take(pa.array(parent, mask=parent < 0))
    return pa.table({"key": nodes.column("key"), "conv_id": conv, "depth": nodes.column("depth").cast(pa.int64()), "parent_conv_id": up, "n_convs": nodes.column("n_convs"), "n_children": pa.array(children), "n_leaves": below(leaves.astype(np.int64)), "saved_tokens": below(saved)})


def _hashed(batches):
    """Rows (key, shard, ends) in order -> SHA-256 of each key's ends, joined by commas; only one hash is held."""
    key, state = None, None
    for batch in batches:
        keys, hashes = [], []
        for k, ends in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    keys.append(key)
                    hashes.append(state.hexdigest())
                key, state = k, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def prefix_trie(turns: DataFrame, config: Trie = Trie()) -> DataFrame:
    """(key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row per node.

    turns(conv_id, pos, turn, words) has positions from 0 without gaps, and a row at -1 for each conversation. A node is a distinct
    sequence of first turns; its members are the conversations that begin with it, conv_id the smallest. A leaf has no children, a
    subtree includes its top. saved_tokens sums (n_convs - 1) * words of a node's last turn over its subtree, and ends_sha256 hashes the
    ids of the members that end there, ascending. Without conversations there is no node, not even the root. A conversation's turns
    meet in one task.
    """
    tables = Tables(turns.sparkSession)
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.select("conv_id", "pos", "turn", "words").repartitionByRange(parts, "conv_id").sortWithinPartitions("conv_id", "pos")
    local = tables.stored(ordered.mapInArrow(_walked(config), LOCAL), "nodes")
    named = local.groupBy("key").agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("shard").alias("owner"), F.max("goes_on").alias("inner"))
    told = local.drop("n", "conv_id", "goes_on", "ends").join(grown(named), "key").withColumn("owned", F.expr("shard = owner")).drop("owner")
    sums = told.groupBy("shard").applyInArrow(_summed, "key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint")
    alike, added = ("conv_id", "depth", "parent_conv_id", "n_convs"), ("n_children", "n_leaves", "saved_tokens")
    nodes = sums.groupBy("key").agg(*(F.max(c).alias(c) for c in alike), *(F.sum(c).alias(c) for c in added))
    ends = local.where("ends <> ''").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
    hashes = ends.mapInArrow(_hashed, "key binary, ends_sha256 string")
    return nodes.join(grown(hashes), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def rebuilt_trie(conversations: DataFrame, config: Trie = Trie()) -> DataFrame:
    """The trie of conversations(conv_id, turn, role, text) rebuilt with shared heads; see `numbered` for nulls and ties."""
    turns = Tables(conversations.sparkSession).stored(numbered(conversations), "turns")
    return prefix_trie(with_heads(turns), config)
