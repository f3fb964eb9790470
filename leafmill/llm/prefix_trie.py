"""The prefix trie of conversations, without building it node by node.

A node is a sequence of first turns; the conversations that start with it are its members.  Running sums of position-bound hashes give every
place of every conversation the key of its node.  Every node is owned by its smallest member, and the nodes that one conversation
owns are a suffix of its path: whoever is the smallest of a node is so of all that follow.  So a subtree's distinct tokens are the sum, over the node's members,
of what each owns below it, and one aggregate over the keys adds up occurrence tokens, owned tokens and the flags of
owned leaves.  The root and other common nodes hold a great part of all rows: they are only met in aggregates that add up before
the shuffle, never in a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm._store import discard, stored

#: A node's key: its depth and three sums of 36-bit hashes.
LANES = ("k1", "k2", "k3")
#: Ids that one row of a hashed list may hold.
LIST = 4096


def running(rows: DataFrame, key: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running sums by ``order`` in each ``key``, this row included, and ``<name>_all``, those of the whole key.

    Rows are dealt by ranges of key and order and written with their range's number, so a key that holds a great part of all rows is spread;
    its totals so far are carried from range to range.
    """
    ranged = stored(rows.withColumns({f"__{n}": c.cast("long") for n, c in sums.items()}).repartitionByRange(key, *order).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy(key, "__range").agg(*(F.sum(f"__{n}").alias(f"__{n}_sum") for n in sums))
    whole = W.partitionBy(key)
    earlier = whole.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(key, "__range", *(F.coalesce(F.sum(f"__{n}_sum").over(earlier), F.lit(0)).alias(f"__{n}_before") for n in sums), *(F.sum(f"__{n}_sum").over(whole).alias(f"{n}_all") for n in sums))
    inside = W.partitionBy(key, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = ranged.withColumns({n: F.sum(f"__{n}").over(inside) for n in sums}).join(carry, [key, "__range"])
    return out.select(*rows.columns, *((F.col(n) + F.col(f"__{n}_before")).alias(n) for n in sums), *(f"{n}_all" for n in sums))


def positions(messages: DataFrame) -> DataFrame:
    """Rows ``(conv, pos, turn_hash, tokens, size)`` of messages ``(conv, turn, role, text)``: place by turn from 1, hash of role and text, the text's UTF-8 bytes, the conversation's messages.

    A null turn comes first; equal turns follow each other by hash; null roles and texts are empty.  Rows without a conversation are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = messages.where("conv is not null").select(F.col("conv").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), said.alias("turn_hash"), F.octet_length(text).cast("long").alias("tokens"))
    return running(rows, "conv", ["turn", "turn_hash"], {"pos": F.lit(1)}).select("conv", "pos", "turn_hash", "tokens", F.col("pos_all").alias("size"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of sorted rows ``(depth, k1, k2, k3, conv)``, joined to lists of bounded length."""
    key, ids, out = None, [], []

    def flush() -> None:
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))

    def full() -> pa.RecordBatch:
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.string())], names=["depth", *LANES, "first", "list"])

    for batch in batches:
        for *k, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key or len(ids) == LIST:
                flush()
                key, ids = k, []
                if len(out) == 1024:
                    yield full()
                    out.clear()
            ids.append(conv)
    flush()
    if out:
        yield full()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each key of sorted rows ``(depth, k1, k2, k3, list)``; no list is held as a whole."""
    key, state, out = None, None, []

    def full() -> pa.RecordBatch:
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=["depth", *LANES, "ends_sha256"])

    for batch in batches:
        for *k, text in zip(*(c.to_pylist() for c in batch.columns)):
            if k == key:
                state.update(b"," + text.encode())
                continue
            if key is not None:
                out.append((*key, state.hexdigest()))
                if len(out) == 1024:
                    yield full()
                    out.clear()
            key, state = k, hashlib.sha256(text.encode())
    if key is not None:
        out.append((*key, state.hexdigest()))
        yield full()


def _ends(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node, ascending and comma-joined.  A common node's ids are joined to lists in many tasks; one task then hashes its lists, one after another."""
    key = ["depth", *LANES]
    ranged = ends.repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv").select(*key, "conv")
    lists = ranged.mapInArrow(_chunks, "depth long, k1 long, k2 long, k3 long, first long, list string")
    ordered = lists.repartition(*key).sortWithinPartitions(*key, "first").select(*key, "list")
    return ordered.mapInArrow(_hashed, "depth long, k1 long, k2 long, k3 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node: ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``turns`` has ``(conv, pos, turn_hash, tokens)``, places from 1 without gaps; ``convs`` has each ``conv`` once, those without turns
    included.  ``saved_tokens`` is what the subtree's nodes would save if every node's tokens were kept once.  No conversations, no rows.
    """
    key = ["depth", *LANES]
    bound = F.sha2(F.concat_ws(":", F.col("pos").cast("string"), "turn_hash").cast("binary"), 256)
    hashed = turns.select("conv", "pos", "tokens", bound.alias("h"))
    lane = lambda i: F.conv(F.substring("h", 1 + 9 * i, 9), 16, 10).cast("long")
    sums = {"through": F.col("tokens")} | {n: lane(i) for i, n in enumerate(LANES)} | {"places": F.lit(1)}
    run = running(hashed, "conv", ["pos"], sums)
    own = {n: lane(i) for i, n in enumerate(LANES)}
    below = run.select(
        "conv", F.col("pos").cast("long").alias("depth"), *LANES, *((F.col(n) - own[n]).alias(f"{n}_up") for n in LANES),
        (F.col("through_all") - F.col("through") + F.col("tokens")).alias("rest"), (F.col("pos") == F.col("places_all")).alias("last"),
    )
    # The root's row of each conversation: all its tokens lie below.
    whole = turns.groupBy("conv").agg(F.sum("tokens").alias("rest"))
    zero = [F.lit(0).cast("long").alias(n) for n in ("depth", *LANES, *(f"{n}_up" for n in LANES))]
    roots = convs.join(whole, "conv", "left").select("conv", *zero, F.coalesce("rest", F.lit(0)).alias("rest"), F.col("rest").isNull().alias("last"))
    places = stored(below.unionByName(roots))
    # The smallest member of each node, and whether nothing follows: all its members end here.
    nodes = stored(places.groupBy(*key).agg(F.min(F.struct("conv", "rest", "last")).alias("o"), F.every("last").alias("childless")))
    owned = nodes.groupBy(F.col("o.conv").alias("owner")).agg(F.min(F.struct(F.col("depth").alias("from"), F.col("o.rest").alias("rest"))).alias("suffix"), F.max((F.col("o.last") & F.col("childless")).cast("long")).alias("leaf"))
    marked = places.join(owned, F.col("conv") == F.col("owner"), "left")
    has = F.col("owner").isNotNull()
    mine = F.when(has, F.when(F.col("depth") >= F.col("suffix.from"), F.col("rest")).otherwise(F.col("suffix.rest"))).otherwise(0)
    child = has & ~F.col("last") & (F.col("depth") + 1 >= F.col("suffix.from"))
    first = F.min(F.struct("conv", F.coalesce(F.col("depth") > F.col("suffix.from"), F.lit(False)).alias("inner"), *(f"{n}_up" for n in LANES))).alias("o")
    sums = [F.count("*").alias("n_convs"), F.sum(child.cast("long")).alias("n_children"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum(F.col("rest") - mine).alias("saved_tokens")]
    found = stored(marked.groupBy(*key).agg(first, *sums))
    # Inside an owned suffix the parent has the same owner; at its start the parent is looked up, once for each conversation.
    up = {"depth": F.col("depth") - 1} | {n: F.col(f"o.{n}_up") for n in LANES}
    starts = found.where("depth > 0 and not o.inner").select(*key, *(c.alias(f"{n}_at") for n, c in up.items()))
    owners = nodes.select(*(F.col(n).alias(f"{n}_at") for n in key), F.col("o.conv").alias("parent"))
    parents = starts.join(owners, [f"{n}_at" for n in key]).select(*key, "parent")
    ends = _ends(places.where("last").select(*key, "conv"))
    out = found.join(parents, key, "left").join(ends, key, "left")
    parent = F.when(F.col("o.inner"), F.col("o.conv")).otherwise(F.col("parent"))
    none = hashlib.sha256(b"").hexdigest()
    out = stored(out.select(F.col("o.conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))
    discard(places, nodes, found)
    return out
