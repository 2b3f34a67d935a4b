"""Tries of conversation prefixes: which beginnings conversations share, and what sharing them saves.

A prefix is known by four sums of hashed turns, so that the node of each turn follows from running sums, and the
members of a node from a grouped count. What lies below a node is rolled up shard by shard. Where only one
conversation is left, the trie is a chain whose figures are known. The other nodes are of a level, by their number of
members: up to SHARD, up to its square, and so on. A shard is a topmost node of a level with all of this level below it, so
that it has at most SHARD nodes of a depth. It is laid out in level order as a LOUDS bitvector and an array of
labels, and summed up in reverse order. Each level starts from the sums of those below, already added up by parent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.heavy import looked_up
from meterlake.llm.running import running_sums
from meterlake.llm.scratch import table

#: Members of a node of the lowest level; each level above has this many times as many.
SHARD = 64
#: Nodes that are laid out together, if one shard has no more.
FOREST_NODES = 1 << 16
#: Turns of a base conversation that another may take over, and how far base conversations lie apart.
HEAD_TURNS, APART = 8, 5
LANES = 4


class Louds:
    """A forest in level order: for each node, after one for all roots, a 1 for each child and a 0; ``labels`` by node.

    ``nodes`` are the rows given, in level order; ``depths`` the first node of each depth, and the number of nodes.
    """

    def __init__(self, ids: list[bytes], parents: list[bytes], depth: np.ndarray, labels: np.ndarray):
        """``depth`` is 0 for roots; ``labels`` has a row of numbers for each node, by which siblings stand in order."""
        row = {k: i for i, k in enumerate(ids)}
        above = np.array([row.get(p, -1) if d else -1 for p, d in zip(parents, depth.tolist(), strict=True)], np.int64)
        by_depth = np.argsort(depth, kind="stable")
        starts = np.searchsorted(depth[by_depth], np.arange(depth.max(initial=-1) + 2))
        rank = np.full(len(ids) + 1, -1, np.int64)
        for a, b in zip(starts, starts[1:], strict=False):
            level = by_depth[a:b]
            level = level[np.lexsort((*labels[level].T[::-1], rank[above[level]]))]
            by_depth[a:b] = level
            rank[level] = np.arange(a, b)
        self.nodes, self.depths, self.labels = by_depth, starts, labels[by_depth]
        degree = np.bincount(rank[above] + 1, minlength=len(ids) + 1)
        self.bits = np.ones(len(ids) + len(degree), bool)
        self.bits[np.cumsum(degree + 1) - 1] = False

    def parents(self) -> np.ndarray:
        """The node above each node, or -1: as many zeros stand before a node's 1 as nodes, from the one for all roots, are done."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    def children(self) -> np.ndarray:
        zeros = np.flatnonzero(~self.bits)
        return np.diff(np.concatenate([[-1], zeros]))[1:] - 1

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """Sums over each node and all below it, by node."""
        total, above = values[self.nodes].copy(), self.parents()
        for a, b in zip(self.depths[-2:0:-1], self.depths[:1:-1], strict=True):
            np.add.at(total, above[a:b], total[a:b])
        return total


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole shards, together of FOREST_NODES or, if one alone is larger, of one; rows come shard by shard."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        shards = batch.column("shard")
        last = shards[batch.num_rows - 1]
        cut = int(np.searchsorted(np.array(shards.to_pylist(), object) == last.as_py(), True))
        if n + cut >= FOREST_NODES and (cut or held[-1].column("shard")[-1].as_py() != last.as_py()):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held)
            held, n, batch = [], 0, batch.slice(cut)
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _roll_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for forest in _forests(batches):
        ids, parents, codes, shards = (forest.column(c).to_pylist() for c in ("id", "parent", "code", "shard"))
        below, depth = (forest.column(c).to_numpy() for c in ("below", "depth"))
        top = {k: d for k, s, d in zip(ids, shards, depth.tolist(), strict=True) if k == s}
        labels = np.frombuffer(b"".join(c.ljust(16, b"\0") for c in codes), ">u8").reshape(-1, 2)
        trie = Louds(ids, parents, depth - np.array([top[s] for s in shards]), labels)
        inside = np.zeros(len(ids), np.int64)
        inside[trie.nodes] = trie.children()
        leaf = (inside == 0) & (below == 0)
        leaves, saved = (trie.rolled_up(v) for v in (forest.column("leaves").to_numpy() + leaf, forest.column("saved").to_numpy()))
        rows = forest.select(["id", "parent", "shard"]).take(pa.array(trie.nodes)).combine_chunks()
        children = (inside + below)[trie.nodes]
        columns = [rows.column(i).combine_chunks() for i in range(3)] + [pa.array(x) for x in (children, leaves, saved)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "parent", "shard", "n_children", "n_leaves", "saved_tokens"])


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The conversations of each node as one text, as far as a batch has them in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, convs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
        spans = list(zip(cuts, cuts[1:], strict=False))
        columns = [pa.array([ids[a] for a, _ in spans], pa.binary()), pa.array([convs[a] for a, _ in spans], pa.int64()), pa.array([",".join(map(str, convs[a:b])) for a, b in spans])]
        yield pa.RecordBatch.from_arrays(columns, ["id", "first", "joined"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's texts, comma-joined, as they stream by."""
    node, digest = None, None

    def done(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found])], ["id", "ends_sha256"])

    for batch in batches:
        found = []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k == node:
                digest.update(b",")
            else:
                if digest:
                    found.append((node, digest.hexdigest()))
                node, digest = k, hashlib.sha256()
            digest.update(text.encode())
        if found:
            yield done(found)
    if digest:
        yield done([(node, digest.hexdigest())])


def in_order(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, code, n_bytes): the turns of each conversation from 1, by turn (null first), then role and text.

    ``code`` is a digest of role and text, null ones as empty. Rows without a conversation are left out; a repeated row is a turn of its own.
    """
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    code = F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, 16)
    rows = rows.select("*", code.alias("code"), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("_one"))
    return running_sums(rows, "conv_id", [F.asc_nulls_first("turn"), "role", "text"], {"pos": "_one"}, ["code", "n_bytes"])


def regrafted(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, pos, code, n_bytes) with each conversation's first h turns taken from its base conversation.

    h is the CRC-32 of the id modulo HEAD_TURNS + 1; the base is the last multiple of APART towards zero. A base that is shorter
    gives all it has, and one that doesn't exist nothing; the conversation's own turns after its first h follow.
    """
    taken = F.crc32(F.col("conv_id").cast("string")) % (HEAD_TURNS + 1)
    convs = table(turns.groupBy("conv_id").agg(F.max("pos").alias("_n")), "conversations")
    heads = turns.where(F.col("pos") <= HEAD_TURNS).withColumnRenamed("conv_id", "base")
    wanted = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % APART).alias("base"), taken.alias("h"))
    grafted = wanted.join(heads, "base").where(F.col("pos") <= F.col("h"))
    lengths = wanted.join(convs.select(F.col("conv_id").alias("base"), F.col("_n").alias("had")), "base", "left")
    moved = lengths.select("conv_id", F.greatest(F.lit(0), F.col("h") - F.coalesce("had", F.lit(0))).alias("back"))
    own = looked_up(turns.where(F.col("pos") > taken), table(convs.join(moved, "conv_id"), "moved"), "conv_id")
    return grafted.select("conv_id", "pos", "code", "n_bytes").unionByName(own.select("conv_id", (F.col("pos") - F.col("back")).alias("pos"), "code", "n_bytes"))


def _node(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *(s.cast("string") for s in sums))))


def prefix_trie(turns: DataFrame, convs: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row for each distinct beginning of the conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, pos (gapless from 1), code, n_bytes; ``convs``: conv_id of all conversations, each once, turnless ones too. A
    node is named by its smallest member and its depth. The root has depth 0, no parent and all conversations. saved_tokens: over the node and all below,
    members but one times the bytes of the node's last text. ends_sha256: of the ids of the members that end there. No
    conversations give no rows. A conversation's turns lie in as many tasks as they need; only the digest of one
    node's ends is one task's work, as SHA-256 can't be split: it reads joined texts and holds one of them.
    """
    digest = F.sha2(F.concat(F.col("pos").cast("string").cast("binary"), F.lit(b":"), F.col("code")), 256)
    lanes = [f"_h{j}" for j in range(LANES)]
    hashed = turns.select("conv_id", "pos", "code", "n_bytes", digest.alias("_digest")).select(
        "conv_id", "pos", "code", "n_bytes", *(F.conv(F.substring("_digest", 8 * j + 1, 8), 16, 10).cast("long").alias(h) for j, h in enumerate(lanes))
    )
    summed = running_sums(hashed, "conv_id", ["pos"], {f"_s{h}": h for h in lanes}, ["pos", "code", "n_bytes", *lanes])
    sums = [F.col(f"_s{h}") for h in lanes]
    top = F.lit(0).cast("long")
    root = _node(top, [top] * LANES)
    below = summed.select("conv_id", F.col("pos").alias("depth"), _node(F.col("pos"), sums).alias("id"), _node(F.col("pos") - 1, [s - F.col(h) for s, h in zip(sums, lanes, strict=True)]).alias("parent"), "code", "n_bytes")
    above = convs.select("conv_id", top.alias("depth"), root.alias("id"), F.lit(None).cast("binary").alias("parent"), F.lit(b"").alias("code"), top.alias("n_bytes"))
    paths = table(below.unionByName(above), "paths")
    same = (F.min(c).alias(c) for c in ("depth", "parent", "code", "n_bytes"))
    nodes = table(paths.groupBy("id").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), *same), "nodes")

    # who stands above: a node may have any number of children, so that it is looked up by their number
    kids = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("_n"))
    parents = table(nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n").alias("parent_n")).join(kids, "parent"), "parents")
    found = looked_up(nodes.where("parent IS NOT NULL"), parents, "parent")
    level = F.ceil(F.log(float(shard), F.greatest("n", F.lit(2)).cast("double")) - 1e-9).cast("int") - 1
    nodes = table(found.unionByName(nodes.where("parent IS NULL"), allowMissingColumns=True).withColumn("level", F.when(F.col("n") > 1, level).otherwise(-1)), "levels")

    # the topmost node of each level on each path
    shared = nodes.where("level >= 0")
    passed = looked_up(paths.select("conv_id", "depth", "id"), shared.select("id", "level", "n"), "id", "n")
    tops = passed.groupBy("conv_id", "level").agg(F.min_by("id", "depth").alias("shard"))
    shared = table(shared.join(tops, ["conv_id", "level"]).withColumn("saved", (F.col("n") - 1) * F.col("n_bytes")), "shared")

    # a chain of one conversation has one leaf and saves nothing
    below_sums = table(nodes.where("n = 1 AND parent_n > 1").groupBy("parent").agg(F.count("*").alias("children")).select(F.col("parent").alias("id"), "children", F.col("children").alias("leaves"), F.lit(0).cast("long").alias("saved")), "tails")
    rolled = None
    for at in sorted(r[0] for r in shared.select("level").distinct().collect()):
        added = below_sums.groupBy("id").agg(*(F.sum(c).alias(f"_{c}") for c in ("children", "leaves", "saved")))
        own = shared.where(F.col("level") == at).join(added, "id", "left")
        nothing = F.lit(0).cast("long")
        laid = own.select("id", "parent", "shard", "depth", "code", F.coalesce("_children", nothing).alias("below"), F.coalesce("_leaves", nothing).alias("leaves"), (F.col("saved") + F.coalesce("_saved", nothing)).alias("saved"))
        done = table(laid.repartition("shard").sortWithinPartitions("shard").mapInArrow(_roll_up, "id binary, parent binary, shard binary, n_children long, n_leaves long, saved_tokens long"), "rolled")
        rolled = done if rolled is None else rolled.unionByName(done)
        ups = done.where("id = shard AND parent IS NOT NULL").select(F.col("parent").alias("id"), F.lit(1).cast("long").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        below_sums = below_sums.unionByName(ups)

    ends = paths.groupBy("conv_id").agg(F.max_by("id", "depth").alias("id")).select("id", "conv_id")
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = ends.repartitionByRange(parts, "id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(_joined_ids, "id binary, first long, joined string")
    digests = joined.repartition("id").sortWithinPartitions("id", "first").mapInArrow(_digests, "id binary, ends_sha256 string")

    single = nodes.where("n = 1").join(parents.select(F.col("parent").alias("id"), F.col("_n").alias("n_children")), "id", "left").select("id", "conv_id", "depth", "parent_conv_id", "n", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    every = single
    if rolled is not None:
        every = nodes.where("n > 1").select("id", "conv_id", "depth", "parent_conv_id", "n").join(rolled.select("id", "n_children", "n_leaves", "saved_tokens"), "id").unionByName(single)
    return every.join(digests, "id", "left").select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """``prefix_trie`` of the ``regrafted`` conversations of a table (conv_id, turn, role, text, and any others)."""
    turns = table(in_order(conversations), "turns")
    return prefix_trie(regrafted(turns), turns.select("conv_id").distinct(), shard)
