"""The prefix trie of conversations, by prefix-doubling names.

Turns are numbered by a distributed sort and each distinct (role, text) gets a name. Blocks of 2, 4, 8 ... turns are named
level by level from the names of their halves, so that equal names are equal blocks: as many join rounds as the logarithm of the
longest conversation. A prefix of d turns is the blocks that the binary digits of d cut it into, so its key is a short
array of names; conversations grouped by (d, key) are the nodes. What is summed over subtrees goes up the trie in jumps of
1, 2, 4 ... levels. A name is the least row number among equal blocks: it needs no global numbering, is the same for equal
blocks and never for others.

No conversation, node or group of equal conversations is gathered: numbers, names and nodes are summed before they are moved and
joined by their keys (the cluster splits a side that one key fills), prefixes have at most one name for each binary digit,
and the ids that end in a node are digested as a sorted stream.

Defined results: null turns come first; turns of equal number follow role, then the digest of the turn; repeated rows are turns
each; a null role or text is empty; rows without conv_id belong to no conversation and are left out; an empty table has no
node, not even a root; a conversation is told from another by its turns alone, however long; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospecta.llm.common import written

#: Conversations are dealt into runs of this many ids, whose first one lends its opening turns to the others; less than so many turns are lent.
RUN, MOST_LENT = 20, 4


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (0, 1, ...), turn (digest of role and text) and words. A conversation may span many partitions of the
    sort: each adds what the ones before it hold of the conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), role.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("turn"), word_count(text).alias("words"))
    order = ["conv_id", "at", "role", "turn"]
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "turn", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = dealt.groupBy("conv_id", "part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    runs = runs.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    return dealt.join(runs, ["conv_id", "part"]).select("conv_id", (F.col("seq") - F.col("first") + F.col("earlier")).alias("pos"), "turn", "words")


def shared_openings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): conversation c begins with the first crc32(c) % 4 turns of conversation c - c % 20, then has its
    own after as many. Conversations are conv_id and n_turns; one may be left without turns."""
    lent = F.crc32(F.col("conv_id").cast("string")) % MOST_LENT
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    lender = F.col("conv_id") - F.col("conv_id") % RUN
    lenders = lengths.filter(F.col("conv_id") % RUN == 0).select(F.col("conv_id").alias("lender"), F.col("n").alias("n_lender"))
    plan = written(lengths.select("conv_id", "n", lent.alias("lent"), lender.alias("lender")).join(lenders, "lender", "left").select(
        "conv_id", "lender", "lent", "n", F.least("lent", F.coalesce("n_lender", F.lit(0))).alias("taken")), "openings")
    opening = turns.filter((F.col("conv_id") % RUN == 0) & (F.col("pos") < MOST_LENT)).withColumnRenamed("conv_id", "lender")
    taken = plan.select("conv_id", "lender", "lent").join(opening, "lender").filter("pos < lent").select("conv_id", "pos", "turn", "words")
    own = turns.join(plan.select("conv_id", "lent", "taken"), "conv_id").filter("pos >= lent").select(
        "conv_id", (F.col("pos") - F.col("lent") + F.col("taken")).alias("pos"), "turn", "words")
    n_turns = F.col("taken") + F.greatest(F.col("n") - F.col("lent"), F.lit(0))
    return taken.unionAll(own), plan.select("conv_id", n_turns.alias("n_turns"))


def _named(rows: DataFrame, *key: str) -> DataFrame:
    """rows with `name`, the least `row` among those of equal key."""
    return rows.join(rows.groupBy(*key).agg(F.min("row").alias("name")), list(key))


def blocks(turns: DataFrame) -> DataFrame:
    """conv_id, level, at, name: the named block of 2^level turns from turn at * 2^level on, for all that are whole."""
    rows = written(turns.withColumn("row", F.monotonically_increasing_id()), "numbered")
    now = written(_named(rows, "turn").select("conv_id", F.col("pos").alias("at"), "name", "row", F.lit(0).alias("level")), "blocks")
    levels = []
    while not now.isEmpty():
        levels.append(now)
        half = F.col("at") % 2
        pairs = now.groupBy("conv_id", F.shiftright("at", 1).alias("at")).agg(
            F.max(F.when(half == 0, F.col("name"))).alias("left"), F.max(F.when(half == 1, F.col("name"))).alias("right"), F.min("row").alias("row"))
        whole = written(pairs.filter("right is not null"), "pairs")
        now = written(_named(whole, "left", "right").select("conv_id", "at", "name", "row", F.lit(len(levels)).alias("level")), "blocks")
    return reduce(DataFrame.unionAll, levels or [now]).select("conv_id", "level", "at", "name")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, key (names of the blocks of that many first turns, longest first), words of the last of them."""
    depth = F.col("pos") + 1
    bits = F.filter(F.sequence(F.lit(0), F.length(F.bin(depth)) - 1), lambda k: F.getbit(depth, k) == 1)
    cut = turns.select("conv_id", depth.alias("depth"), "words", F.explode(bits).alias("level"))
    cut = cut.withColumn("at", F.expr("shiftleft(shiftright(depth, level + 1), 1)"))
    parts = cut.join(blocks(turns), ["conv_id", "level", "at"])
    key = F.transform(F.sort_array(F.collect_list(F.struct("level", "name")), asc=False), lambda x: x["name"])
    return parts.groupBy("conv_id", "depth").agg(key.alias("key"), F.max("words").alias("words"))


def _ends_digest(ends: DataFrame) -> DataFrame:
    """node, depth, ends_sha256 of (node, depth, conv_id): ids are fed to the digest as they come, in order."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        done: list[tuple[int, int, str]] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist([dict(zip(("node", "depth", "ends_sha256"), x, strict=True)) for x in done],
                                             schema=pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())]))
            done.clear()
            return out

        for rows in batches:
            node, depth, ids = (np.asarray(rows.column(x)) for x in ("node", "depth", "conv_id"))
            starts = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (depth[1:] != depth[:-1])])) if len(ids) else np.zeros(0, np.int64)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
                own, text = (int(node[a]), int(depth[a])), ",".join(map(str, ids[a:b].tolist())).encode()
                if own == now:
                    sha.update(b"," + text)
                    continue
                if now is not None:
                    done.append((*now, sha.hexdigest()))
                now, sha = own, hashlib.sha256(text)
            yield batch()
        if now is not None:
            done.append((*now, sha.hexdigest()))
            yield batch()

    by_node = ends.select("node", "depth", "conv_id").repartition("node", "depth").sortWithinPartitions("node", "depth", "conv_id")
    return by_node.mapInArrow(digest, "node long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations (conv_id, n_turns) with turns (conv_id, pos, turn, words): conv_id (the least
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, conversations = written(turns, "rebuilt"), written(conversations, "conversations")
    root = conversations.agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n"), F.max("n_turns").alias("depth")).first()
    keyed = written(prefixes(turns), "prefixes")
    nodes = written(keyed.groupBy("depth", "key").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words")), "nodes")
    #: The node of each prefix of each conversation.
    of = written(keyed.join(nodes, ["depth", "key"]).select("conv_id", keyed.depth.alias("depth"), "node"), "members")

    def above(rows: DataFrame, up: int) -> DataFrame:
        """rows (node, depth) deeper than `up` levels at least, with `higher`, the node so many levels up."""
        own = rows.filter(F.col("depth") >= up).withColumn("to", F.col("depth") - up)
        names = of.select(F.col("conv_id").alias("node"), F.col("depth").alias("to"), F.col("node").alias("higher"))
        at_root = own.filter("to = 0").withColumn("higher", F.lit(root.node).cast("long"))
        return own.filter("to > 0").join(names, ["node", "to"]).select(*own.columns, "higher").unionAll(at_root)

    top = conversations.limit(1).select(F.lit(0).cast("long").alias("depth"), F.lit(root.node).cast("long").alias("node"), F.lit(root.n).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("words"))
    linked = above(nodes.select("depth", "node", "n_convs", "words"), 1).select("depth", "node", "n_convs", "words", F.col("higher").alias("parent"))
    linked = written(linked.unionAll(top.withColumn("parent", F.lit(None).cast("long"))), "linked")
    children = linked.filter("depth > 0").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    full = written(linked.join(children, ["node", "depth"], "left").select(linked["*"], F.coalesce("n_children", F.lit(0)).alias("n_children")), "trie")
    sums = full.select("node", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    up = 1
    while up <= (root.depth or 0):
        # Each node has the sums of its subtree down to `up` levels; those that lie `up` levels below add theirs.
        more = above(sums, up).groupBy(F.col("higher").alias("node"), F.col("to").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        sums = written(sums.join(more, ["node", "depth"], "left").select(
            "node", "depth", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")), "sums")
        up *= 2
    ends = conversations.filter("n_turns > 0").select("conv_id", F.col("n_turns").alias("depth")).join(of, ["conv_id", "depth"]).select("node", "depth", "conv_id")
    ends = ends.unionAll(conversations.filter("n_turns = 0").select(F.lit(root.node).cast("long").alias("node"), F.lit(0).cast("long").alias("depth"), "conv_id"))
    return full.join(sums, ["node", "depth"]).join(_ends_digest(ends), ["node", "depth"], "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
