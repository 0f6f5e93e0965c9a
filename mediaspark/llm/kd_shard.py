"""Sharding by a k-d tree over metadata, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import util

#: Bits of a key that one round of a median search settles, and the bits of the keys.
STEP, KEY_BITS, ROW_BITS = 12, 48, 24


@dataclass
class Node:
    shards: int
    bytes: int
    dim: int = 0
    prefix: int = 0
    below: int = 0
    at: int = 0
    row: int = 0  # rows with the median key go left if their hash is under this

    @property
    def goal(self) -> float:
        return self.bytes * (self.shards // 2) / self.shards


def default_dims() -> dict[str, Column]:
    """Length, and bytes a character, which tells scripts and languages apart: both by the text alone, so that equal texts have equal coordinates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return {"length": F.log2(F.col("size")), "script": F.octet_length(text) / F.greatest(F.lit(1), F.char_length(text))}


def _of_node(values: list) -> Column:
    """The value that belongs to a row's node."""
    return F.element_at(F.array(*map(F.lit, values)), F.col("node") + 1)


def _key(nodes: list[Node], n_dims: int) -> Column:
    """The cell on the node's widest dimension, then a hash of the text."""
    cell = F.element_at(F.array(*[f"d{d}" for d in range(n_dims)]), _of_node([n.dim for n in nodes]) + 1)
    return F.shiftleft(cell, 32) + F.col("text_hash")


def _sums(meta: DataFrame, digit: Column, keep: Column) -> dict[int, dict[int, int]]:
    """Bytes by node and digit: at most 4,096 sums for each node."""
    out: dict[int, dict[int, int]] = {}
    for r in meta.filter(keep).groupBy("node", digit.alias("digit")).agg(F.sum("size").alias("n")).collect():
        out.setdefault(r["node"], {})[r["digit"]] = r["n"]
    return out


def _descend(sums: dict[int, int], below: int, goal: float) -> tuple[int, int, int]:
    """The digit in which the running sum reaches ``goal``; the sum before it; its own sum."""
    last = (0, below, 0)
    for digit, n in sorted(sums.items()):
        last = (digit, below, n)
        if below + n > goal:
            break
        below += n
    return last


def _medians(meta: DataFrame, nodes: list[Node], n_dims: int, whole: float) -> None:
    """Find each node's widest dimension and the weighted median along it."""
    mask = (1 << STEP) - 1
    extents = [(F.max(f"d{d}") - F.min(f"d{d}")).alias(f"e{d}") for d in range(n_dims)]
    for r in meta.groupBy("node").agg(*extents).collect():
        nodes[r["node"]].dim = max(range(n_dims), key=lambda d: (r[f"e{d}"], -d))
    key = _key(nodes, n_dims)
    for bits in range(KEY_BITS - STEP, -1, -STEP):
        sums = _sums(meta, F.shiftright(key, bits).bitwiseAND(mask), F.shiftright(key, bits + STEP) == _of_node([n.prefix for n in nodes]))
        for i, n in enumerate(nodes):
            digit, n.below, n.at = _descend(sums.get(i, {}), n.below, n.goal)
            n.prefix = (n.prefix << STEP) + digit
    large = [n for n in nodes if n.at > whole and n.shards > 1]
    rows = {id(n): n.below for n in large}
    for bits in range(ROW_BITS - STEP, -1, -STEP) if large else ():  # a group too large to stay together is split by a hash of its rows
        keep = (key == _of_node([n.prefix if id(n) in rows else -1 for n in nodes])) & (F.shiftright("row_hash", bits + STEP) == _of_node([n.row for n in nodes]))
        sums = _sums(meta, F.shiftright("row_hash", bits).bitwiseAND(mask), keep)
        for i, n in enumerate(nodes):
            if id(n) in rows:
                digit, rows[id(n)], _ = _descend(sums.get(i, {}), rows[id(n)], n.goal)
                n.row = (n.row << STEP) + digit
    for n in nodes:
        if id(n) in rows:
            n.below = rows[id(n)]
        elif n.goal - n.below > n.at / 2:  # the whole group at the median goes to the nearer side
            n.prefix, n.below = n.prefix + 1, n.below + n.at


def _split(meta: DataFrame, nodes: list[Node], n_dims: int, whole: float) -> tuple[DataFrame, list[Node]]:
    """Each node of two or more shards becomes two; the others stay."""
    _medians(meta, nodes, n_dims, whole)
    below: list[Node] = []
    first = []
    for n in nodes:
        first.append(len(below))
        few = n.shards // 2
        below += [Node(few, n.below), Node(n.shards - few, n.bytes - n.below)] if few else [Node(1, n.bytes)]
    key, prefix = _key(nodes, n_dims), _of_node([n.prefix for n in nodes])
    left = (key < prefix) | ((key == prefix) & (F.col("row_hash") < _of_node([n.row for n in nodes]))) | _of_node([n.shards == 1 for n in nodes])
    return util.save(meta.withColumn("node", _of_node(first) + F.when(left, 0).otherwise(1)), "nodes"), below


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dims: dict[str, Column] | None = None, together: float = 0.02) -> DataFrame:
    """Put all documents into ``shards`` shards of near equal bytes, or as many as ``target_bytes`` asks for.

    The tree splits at distributed weighted medians: rounds of byte sums by 12 bits of a key made of the widest
    dimension and a hash of the text. Only those sums, at most 4,096 for each node, reach the driver; documents then
    move to the node below by an expression. Equal texts share their coordinates, as the dimensions are functions of the
    text (those given as ``dims`` should be, too), and stay together while such a group holds less than ``together`` of a
    shard; a larger one is split where a median falls into it.

    A null text has size 1 and the CRC of no bytes; null metadata counts as the least value. Repeated rows are placed
    each for itself, an empty table gives an empty result, other columns are ignored.
    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    dims = dims or default_dims()
    base = docs.withColumns({"size": (F.octet_length(text) + 1).cast("bigint"), "text_crc32": F.crc32(text)})
    base = base.select(
        "doc_id", "size", "text_crc32", F.shiftrightunsigned(F.xxhash64(text), 32).alias("text_hash"), F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - ROW_BITS).alias("row_hash"), *[c.cast("double").alias(f"x{k}") for k, c in enumerate(dims.values())]
    )
    raw = util.save(base, "metadata")
    ends = raw.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), *[f(f"x{k}").alias(f"{name}{k}") for k in range(len(dims)) for name, f in (("lo", F.min), ("hi", F.max))]).first()
    top = (1 << 16) - 1

    def scaled(k: int) -> Column:
        lo, hi = ends[f"lo{k}"] or 0.0, ends[f"hi{k}"] or 0.0
        return F.coalesce(F.floor((F.col(f"x{k}") - lo) / ((hi - lo) or 1.0) * top).cast("bigint"), F.lit(0).cast("bigint")).alias(f"d{k}")

    meta = raw.select(F.lit(0).alias("node"), "doc_id", "size", "text_crc32", "text_hash", "row_hash", *[scaled(k) for k in range(len(dims))])
    total = ends["bytes"] or 0
    leaves = shards or max(1, util.parts_for(total, target_bytes or 1 << 30))
    nodes = [Node(leaves, total)]
    while total and any(n.shards > 1 for n in nodes):
        meta, nodes = _split(meta, nodes, len(dims), together * total / leaves)
    placed = meta.withColumnRenamed("node", "shard")
    numbered = util.gapless(placed, ["shard"], ["doc_id", "text_hash"], ends["n"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
