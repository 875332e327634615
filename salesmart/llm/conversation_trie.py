"""A trie of conversations by their turns, with totals of every subtree.

A node is a sequence of first turns. Its key is a hash of them, built up along a conversation, so all
conversations that begin alike meet in one node without any text.

Totals of subtrees are summed in bands of a fixed height. A node is exploded to its ancestors within its
band, at most ``height`` of them, and summed there. The tops of the bands are a trie again, of a
height that is smaller by that factor, so it is summed in the same way; the whole totals of the
tops are then exploded to the band above them. So a trie of depth D takes about log D to the base
of ``height`` rounds, and no row is exploded to more than ``height`` others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesmart.llm.steps import column, indexed, settled

#: Levels of the trie in a band.
HEIGHT = 8
#: Turns of a conversation whose hashes are summed by one window.
STRETCH = 1024
#: Conversation ids in a packed block.
PACKED = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered(
    turns: DataFrame, *, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv, depth, digest, chars)`` of each turn: its place from 1, what it says, its code points.

    Turns are ordered by ``order``, null first, ties by what they say; repeated turns stay. A null role or text is empty.
    Turns without a conversation are left out. Places come from one sort over all tasks, so a long
    conversation is not the work of one.
    """
    role_, text_ = (F.coalesce(column(c), F.lit("")) for c in (role, text))
    said = F.sha2(F.concat(F.char_length(role_).cast("string"), F.lit(":"), role_, text_), 256)
    rows = turns.where(column(key).isNotNull()).select(
        column(key).cast("long").alias("conv"),
        column(order).alias("turn"),
        F.unhex(said).alias("digest"),
        F.char_length(text_).cast("long").alias("chars"),
    )
    placed = indexed(rows, [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest")])
    firsts = placed.groupBy("conv").agg(F.min("place").alias("first"))
    return placed.join(firsts, "conv").select("conv", (F.col("place") - F.col("first") + 1).alias("depth"), "digest", "chars")


def _prefixes(rows: DataFrame, members: DataFrame) -> DataFrame:
    """``(conv, depth, a, b, chars)``: the key of each conversation's first turns, 0 for none of them.

    A key is the exclusive or of two 64-bit hashes of each turn with its place. It is summed in
    stretches of turns, then over the totals of stretches, so a long conversation is many tasks' work.
    """
    hashed = rows.select(
        "conv",
        "depth",
        "chars",
        F.xxhash64("digest", "depth").alias("a"),
        F.xxhash64("depth", F.lit(1), "digest").alias("b"),
        F.expr(f"depth div {STRETCH}").alias("stretch"),
    )
    along = Window.partitionBy("conv", "stretch").orderBy("depth")
    within = hashed.select("conv", "stretch", "depth", "chars", *(F.bit_xor(c).over(along).alias(c) for c in ("a", "b")))
    totals = hashed.groupBy("conv", "stretch").agg(*(F.bit_xor(c).alias(c) for c in ("a", "b")))
    # Nearly all conversations are one stretch, which has nothing before it.
    long = totals.join(totals.where("stretch > 0").select("conv").distinct(), "conv", "left_semi")
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    earlier = long.select("conv", "stretch", *(F.bit_xor(c).over(before).alias(f"{c}0") for c in ("a", "b")))
    earlier = earlier.where("stretch > 0")
    whole = within.join(earlier, ["conv", "stretch"], "left").select(
        "conv",
        "depth",
        *(F.col(c).bitwiseXOR(F.coalesce(f"{c}0", F.lit(0).cast("long"))).alias(c) for c in ("a", "b")),
        "chars",
    )
    zero = F.lit(0).cast("long")
    roots = members.select("conv", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("chars"))
    return roots.unionByName(whole)


def _bands(rows: DataFrame, height: int) -> DataFrame:
    """Keys of each conversation in each band, from the top; ``rows`` has (conv, depth, a, b)."""
    listed = F.array_sort(F.collect_list(F.struct("depth", "a", "b")))
    return rows.groupBy("conv", F.expr(f"depth div {height}").alias("band")).agg(listed.alias("keys"))


def _paths(bands: DataFrame) -> DataFrame:
    """``(a, b, path)``: for each key those of its ancestors within the band, itself last."""
    each = bands.select("keys", F.posexplode("keys").alias("pos", "key"))
    named = each.select("key.a", "key.b", F.expr("slice(keys, 1, pos + 1)").alias("path"))
    return named.groupBy("a", "b").agg(F.first("path").alias("path"))


def _summed(values: DataFrame, path: str, totals: list[str]) -> DataFrame:
    """Totals of the values of all rows at each key of their ``path``."""
    exploded = values.select(F.explode(path).alias("key"), *totals)
    return exploded.groupBy("key.depth", "key.a", "key.b").agg(*(F.sum(t).alias(t) for t in totals))


def _rollup(rows: DataFrame, values: DataFrame, totals: list[str], height: int, deepest: int) -> DataFrame:
    """``(a, b, *totals)`` of whole subtrees from the ``values`` of nodes ``(a, b, *totals)``.

    ``rows`` holds the keys ``(conv, depth, a, b)`` of all conversations, ``deepest`` the largest depth.
    """
    bands = settled(_bands(rows, height), "bands")
    local = _summed(values.join(_paths(bands), ["a", "b"]), "path", totals)
    if deepest < height:
        return local.select("a", "b", *totals)
    local = settled(local, "local")
    at_top = F.col("depth") % height == 0
    tops = rows.where(at_top).withColumn("depth", F.expr(f"depth div {height}"))
    below = _rollup(tops, local.where(at_top).select("a", "b", *totals), totals, height, deepest // height)
    # Of each top the keys of the whole band above it.
    upper = bands.select("conv", (F.col("band") + 1).alias("depth"), F.col("keys").alias("above"))
    above = tops.where("depth > 0").join(upper, ["conv", "depth"])
    above = above.groupBy("a", "b").agg(F.first("above").alias("above"))
    incoming = _summed(below.join(above, ["a", "b"]), "above", totals)
    both = local.unionByName(incoming).groupBy("a", "b")
    return both.agg(*(F.sum(t).alias(t) for t in totals))


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(zip(*rows, strict=True), kinds, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=names)


def _ends(last: DataFrame) -> DataFrame:
    """``(a, b, ends_sha256)`` of the nodes ``(a, b)`` where conversations ``conv`` end.

    Ids are sorted over all tasks and packed, so the task that hashes those of a node, one after
    another, gets few rows and holds one block.
    """
    order = ["a", "b", "conv"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 3 + [pa.binary()]
        names, rows, node, held = ["a", "b", "first", "ids"], [], None, []

        def close() -> None:
            ids = np.array(held, np.int64)
            rows.append((*node, held[0], zstandard.compress(ids.tobytes(), 1)))

        for batch in batches:
            for a, b, conv in zip(*(batch.column(c).to_pylist() for c in order), strict=True):
                if held and ((a, b) != node or len(held) == PACKED):
                    close()
                    held = []
                node = (a, b)
                held.append(conv)
            if rows:
                yield _batch(rows, names, kinds)
                rows = []
        if held:
            close()
            yield _batch(rows, names, kinds)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 2 + [pa.string()]
        names, rows, node, state = ["a", "b", "ends_sha256"], [], None, hashlib.sha256()
        for batch in batches:
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
                if node is not None and (a, b) != node:
                    rows.append((*node, state.hexdigest()))
                    state = hashlib.sha256()
                elif node is not None:
                    state.update(b",")
                node = (a, b)
                state.update(",".join(map(str, np.frombuffer(zstandard.decompress(ids), np.int64).tolist())).encode())
            if rows:
                yield _batch(rows, names, kinds)
                rows = []
        if node is not None:
            yield _batch([(*node, state.hexdigest())], names, kinds)

    sorted_ = last.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    packed = sorted_.mapInArrow(pack, "a long, b long, first long, ids binary")
    gathered = packed.repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return gathered.mapInArrow(digest, "a long, b long, ends_sha256 string")


def trie(rows: DataFrame, members: DataFrame, *, height: int = HEIGHT) -> DataFrame:
    """A row for each node of the trie of the conversations ``rows`` (conv, depth, digest, chars).

    ``members`` names all conversations in ``conv``, each once, also those without turns: they end in the root.
    Depths of a conversation go from 1 without gaps (``numbered`` gives them). Columns:

    - ``conv_id``: the smallest member; ``depth``: 0 for the root, which has no text
    - ``parent_conv_id``: the parent's ``conv_id``, null for the root
    - ``n_convs``: members, that is conversations that begin with the node's turns
    - ``n_children``; ``n_leaves``: nodes without children in its subtree, itself included
    - ``saved_tokens``: over its subtree, each node's members but one times the ``chars`` of its last turn
    - ``ends_sha256``: of the ids of the members that end here, in order, joined by commas

    Without conversations there is no node. Two nodes are the same if 128 bits of hash agree.
    """
    prefixes = settled(_prefixes(rows, members.select(F.col("conv").cast("long"))), "prefixes")
    deepest, least = prefixes.agg(F.max("depth"), F.min("conv")).first()
    deepest = deepest or 0
    # A node's parent has the key of the same conversation one turn earlier.
    ups = prefixes.select("conv", (F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"))
    linked = prefixes.join(ups, ["conv", "depth"], "left")
    nodes = linked.groupBy("a", "b").agg(
        F.min("conv").alias("conv_id"),
        F.max("depth").alias("depth"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("chars").alias("chars"),
        F.max("up_a").alias("up_a"),
        F.max("up_b").alias("up_b"),
    )
    nodes = settled(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    nodes = settled(nodes.join(children, ["a", "b"], "left").fillna(0, ["n_children"]), "nodes")
    values = nodes.select(
        "a",
        "b",
        (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )
    totals = _rollup(prefixes.select("conv", "depth", "a", "b"), values, ["n_leaves", "saved_tokens"], height, deepest)
    lengths = prefixes.groupBy("conv").agg(F.max("depth").alias("depth"))
    ends = _ends(settled(prefixes.join(lengths, ["conv", "depth"], "left_semi").select("a", "b", "conv"), "ends"))
    parents = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    # All first turns have one parent, the root, whose least member is the least of all.
    first = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(least).cast("long"))
    deeper = nodes.where("depth > 1").join(parents, ["up_a", "up_b"])
    top = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    every = reduce(DataFrame.unionByName, [f.select(*nodes.columns, "parent_conv_id") for f in (top, first, deeper)])
    joined = every.join(totals, ["a", "b"], "left").join(ends, ["a", "b"], "left")
    return joined.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def grafted(rows: DataFrame, members: DataFrame, start: Column, shared: Column) -> DataFrame:
    """``rows`` of ``numbered`` with the first turns of each conversation taken from another.

    Conversation ``conv`` gets the first ``shared`` turns of conversation ``start`` (all it has, if fewer;
    none, if there is no such conversation), then its own turns after its first ``shared``. Both are
    expressions of ``conv``.
    """
    plan = members.select("conv", start.alias("start"), shared.cast("long").alias("shared"))
    most = plan.agg(F.max("shared")).first()[0] or 0
    lent = rows.where(F.col("depth") <= most).select(F.col("conv").alias("start"), "depth", "digest", "chars")
    taken = plan.where("shared > 0").join(lent, "start").where("depth <= shared")
    taken = settled(taken.select("conv", "depth", "digest", "chars"), "taken")
    counts = taken.groupBy("conv").agg(F.count(F.lit(1)).alias("taken"))
    own = rows.join(plan, "conv").where("depth > shared").join(counts, "conv", "left")
    moved = own.withColumn("depth", F.col("depth") - F.col("shared") + F.coalesce("taken", F.lit(0)))
    return taken.unionByName(moved.select(*taken.columns))
