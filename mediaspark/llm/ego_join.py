"""Embedding near-duplicates by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, util

#: Vectors that principal dimensions are fitted on; they only order and prune, so any basis gives the same links.
BASIS_SAMPLE = 4096
#: Vectors in a block, and in a part of one that is compared at once.
BLOCK, LEAF = 1024, 128
#: Pairs of blocks that a task makes of one cell before it looks at their bounds.
MEETINGS = 1 << 18
#: Leading principal dimensions whose cells order the vectors, and those that bounds are kept on.
ORDERED, LEADING = 4, 8


def _basis(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal axes for each length of vector in a bounded sample, drawn by a hash of the vectors."""
    rows = vectors.select("embedding").orderBy(F.xxhash64("embedding")).limit(BASIS_SAMPLE).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r[0]), []).append(r[0])
    out = {}
    for dim, x in by.items():
        m = np.asarray(x, np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        out[dim] = np.linalg.svd(m - m.mean(0), full_matrices=False)[2][:LEADING].T.copy()
    return out


def _project(unit: np.ndarray, basis: dict[int, np.ndarray]) -> np.ndarray:
    axes = basis.get(unit.shape[1])
    out = np.zeros((len(unit), LEADING))
    lead = unit[:, :LEADING] if axes is None else unit @ axes
    out[:, : lead.shape[1]] = lead
    return out


def _units(raw: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that neither huge nor tiny components leave double precision."""
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _ordered(classes: DataFrame, basis: dict[int, np.ndarray], epsilon: float) -> DataFrame:
    """Distinct vectors in epsilon grid order: label, length, then cells of the leading principal dimensions."""
    cells = [f"c{k}" for k in range(ORDERED)]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf["embedding"].map(len), sort=False):
                lead = _project(_units(np.stack(part["embedding"].to_numpy()).astype(np.float64)), basis)
                yield part.assign(dim=np.int32(len(part["embedding"].iloc[0])), **{c: np.floor(lead[:, k] / epsilon).astype(np.int32) for k, c in enumerate(cells)})

    label = classes.schema["label"].dataType.simpleString()
    kind = classes.schema["embedding"].dataType.simpleString()
    schema = f"label {label}, embedding {kind}, rep bigint, n bigint, dim int, {', '.join(f'{c} int' for c in cells)}"
    order = ["label", "dim", *cells, "rep"]
    placed = classes.mapInPandas(add, schema)
    return placed.repartitionByRange(util.partitions(classes.sparkSession), *order).sortWithinPartitions(*order)


def _blocks(ordered: DataFrame, basis: dict[int, np.ndarray]) -> DataFrame:
    """Intervals of the order, each with its bounds on the leading dimensions."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = TaskContext.get().partitionId() << 32, []

        def flush(rows: list) -> pd.DataFrame:
            nonlocal at
            raw = np.stack([r.embedding for r in rows])
            lead = _project(_units(raw.astype(np.float64)), basis)
            at += 1
            row = (at, rows[0].label, rows[0].dim, lead.min(0).tolist(), lead.max(0).tolist(), [r.rep for r in rows], [r.n for r in rows], raw.tobytes())
            return pd.DataFrame([row], columns=["block", "label", "dim", "lo", "hi", "reps", "ns", "raw"])

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if held and (len(held) == BLOCK or (held[0].label, held[0].dim) != (r.label, r.dim)):
                    yield flush(held)
                    held = []
                held.append(r)
        if held:
            yield flush(held)

    label = ordered.schema["label"].dataType.simpleString()
    return ordered.mapInPandas(pack, f"block bigint, label {label}, dim int, lo array<double>, hi array<double>, reps array<bigint>, ns array<bigint>, raw binary")


def _near_blocks(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs of blocks, each with itself too, that may hold vectors within epsilon: met on cells of the two leading dimensions.

    A cell's blocks are salted by the product of the two sides' counts, so a dense cell is the work of many tasks.
    """
    cells = lambda k, grow: F.explode(F.sequence(F.floor((F.col("lo")[k] - grow) / epsilon), F.floor((F.col("hi")[k] + grow) / epsilon)))
    meta = blocks.select("block", "label", "dim", "lo", "hi")

    def side(name: str, grow: float) -> DataFrame:
        rows = meta.withColumn("c0", cells(0, grow)).withColumn("c1", cells(1, grow))
        return rows.select(F.col("block").alias(name), "label", "dim", "c0", "c1", F.col("lo").alias(f"{name}lo"), F.col("hi").alias(f"{name}hi"))

    gap = F.zip_with("alo", "bhi", lambda x, y: F.greatest(x - y, F.lit(0.0))), F.zip_with("blo", "ahi", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    apart = F.aggregate(F.zip_with(*gap, lambda x, y: F.greatest(x, y)), F.lit(0.0), lambda s, g: s + g * g)
    cell = ["label", "dim", "c0", "c1"]
    left, right = side("a", 0.0), side("b", epsilon)
    # a cell of many blocks is dealt to tasks that make no more than MEETINGS pairs of it each
    many = left.groupBy(*cell).agg(F.count(F.lit(1)).alias("_left")).join(right.groupBy(*cell).agg(F.count(F.lit(1)).alias("_right")), cell)
    salts = F.ceil(F.col("_left") / F.greatest(F.lit(1), F.floor(F.lit(MEETINGS) / F.col("_right"))))
    many = util.save(many.select(*cell, salts.cast("bigint").alias("_salts")), "cells")
    dealt = left.join(many, cell).withColumn("_salt", F.pmod(F.xxhash64("a"), F.col("_salts"))).drop("_salts")
    repeated = right.join(many, cell).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    met = dealt.join(repeated, [*cell, "_salt"]).filter((F.col("a") <= F.col("b")) & (apart <= epsilon * epsilon + 1e-9))
    return met.select("a", "b", "alo", "ahi", "blo", "bhi").dropDuplicates(["a", "b"])


def _sides(blocks: DataFrame, pairs: DataFrame, basis: dict[int, np.ndarray], epsilon: float, kind: np.dtype) -> DataFrame:
    """For each pair the vectors of either block that lie within epsilon of the other's bounds; pairs of one block keep all."""
    own = pairs.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("block"), F.col("blo").alias("olo"), F.col("bhi").alias("ohi"))
    other = pairs.filter("a <> b").select("a", "b", F.lit(1).alias("side"), F.col("b").alias("block"), F.col("alo").alias("olo"), F.col("ahi").alias("ohi"))
    met = blocks.drop("label", "lo", "hi").join(util.small(util.save(own.union(other), "sides")), "block")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                raw = np.frombuffer(r.raw, kind).reshape(len(r.reps), r.dim)
                lead = _project(_units(raw.astype(np.float64)), basis)
                off = np.maximum(0, np.maximum(np.asarray(r.olo) - lead, lead - np.asarray(r.ohi)))
                keep = (off * off).sum(1) <= epsilon * epsilon + 1e-9
                if keep.any():
                    rows.append((r.a, r.b, r.side, r.dim, np.asarray(r.reps)[keep], np.asarray(r.ns)[keep], raw[keep].tobytes()))
            yield pd.DataFrame(rows, columns=["a", "b", "side", "dim", "reps", "ns", "raw"])

    return met.mapInPandas(near, "a bigint, b bigint, side int, dim int, reps array<bigint>, ns array<bigint>, raw binary")


class _Side:
    def __init__(self, reps, ns, raw: bytes, dim: int, basis: dict[int, np.ndarray], kind: np.dtype):
        self.reps, self.ns = np.asarray(reps, np.int64), np.asarray(ns, np.int64)
        self.unit = _units(np.frombuffer(raw, kind).astype(np.float64).reshape(len(self.reps), dim))
        self.lead = _project(self.unit, basis)
        self.linked = np.zeros(len(self.reps), np.int64)


def _join(a: _Side, b: _Side, same: bool, least: float, epsilon: float) -> list[tuple[int, int]]:
    """Compare two intervals of the order, halving them and skipping halves that are provably apart.

    Adds to each side how many vectors are linked, and returns edges of a forest that connects what is linked.
    """
    parent: dict[int, int] = {}
    forest: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    def visit(i: int, j: int, k: int, m: int) -> None:
        apart = np.maximum(0, np.maximum(a.lead[i:j].min(0) - b.lead[k:m].max(0), b.lead[k:m].min(0) - a.lead[i:j].max(0)))
        if (apart * apart).sum() > epsilon * epsilon + 1e-9:
            return
        if j - i > LEAF or m - k > LEAF:
            if j - i >= m - k:
                half = (i + j) // 2
                parts = [(i, half, k, m), (half, j, k, m)]
            else:
                half = (k + m) // 2
                parts = [(i, j, k, half), (i, j, half, m)]
            for p in parts:
                if not (same and p[0] >= p[3]):
                    visit(*p)
            return
        near = a.unit[i:j] @ b.unit[k:m].T >= least
        if same:
            near &= np.arange(i, j)[:, None] < np.arange(k, m)[None, :]
        if not near.any():
            return
        a.linked[i:j] += near @ b.ns[k:m]
        b.linked[k:m] += a.ns[i:j] @ near
        for x in np.flatnonzero(near.any(1)):
            for y in np.flatnonzero(near[x]):
                p, q = int(a.reps[i + x]), int(b.reps[k + y])
                if (r := root(p)) != (s := root(q)):
                    parent[max(r, s)] = min(r, s)
                    forest.append((p, q))

    visit(0, len(a.reps), 0, len(b.reps))
    return forest


def _sound() -> Column:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0)


def links(vectors: DataFrame, least: float = 0.98) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their class, number of links between classes, forest edges between classes)."""
    epsilon = float(np.sqrt(2 - 2 * least)) + 1e-9
    valid = vectors.select("vec_id", "label", "embedding").filter(_sound())
    grouped = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # classes are numbered in the order of their smallest ids, whatever the ids' type
    classes = util.save(grouped.orderBy("first").withColumn("rep", F.monotonically_increasing_id()), "classes")
    basis = _basis(classes)
    kind = np.dtype(np.float32 if classes.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64)
    blocks = util.save(_blocks(_ordered(classes.select("label", "embedding", "rep", "n"), basis, epsilon), basis), "blocks")
    sides = util.save(_sides(blocks, util.save(_near_blocks(blocks, epsilon), "pairs"), basis, epsilon, kind), "near")
    own = sides.filter("side = 0").drop("side")
    other = sides.filter("side = 1").select("a", "b", *[F.col(c).alias(f"b_{c}") for c in ("reps", "ns", "raw")])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                same = r.a == r.b
                if not same and r.b_raw is None:
                    continue
                a = _Side(r.reps, r.ns, r.raw, r.dim, basis, kind)
                b = a if same else _Side(r.b_reps, r.b_ns, r.b_raw, r.dim, basis, kind)
                forest = _join(a, b, same, least, epsilon)
                for s in [a] if same else [a, b]:
                    has = s.linked > 0
                    yield pd.DataFrame({"a": s.reps[has], "b": s.reps[has], "n": s.linked[has]})
                yield pd.DataFrame({"a": [x for x, _ in forest], "b": [y for _, y in forest], "n": [0] * len(forest)}, dtype="int64")

    found = util.save(own.join(other, ["a", "b"], "left").mapInPandas(compare, "a bigint, b bigint, n bigint"), "found")
    counts = found.filter("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    return valid, classes.join(counts, "rep", "left"), found.filter("n = 0").select("a", "b")


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """Links between vectors of equal label and cosine of at least ``least``, and the components they form.

    Equal vectors of a label are one class; classes are compared in blocks of epsilon grid order. Blocks that are
    provably apart on the leading principal dimensions are never met, and of two that meet only the vectors within
    reach of the other's bounds are. Blocks report counts and a connecting forest, so a large group gives neither rows
    nor edges for each of its pairs.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows without a label or id, link
    with nothing, nor do vectors of different lengths. Ids may be of any type; repeated rows count as vectors of their
    own; of a component's vectors the smallest id is kept, whatever the order of the rows; an empty table gives an empty
    result; other columns are ignored. Returns vec_id, n_links, component_id, kept.
    """
    valid, classes, forest = links(vectors, least)
    named = classes.join(graph.components(forest).withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = util.save(named.select("label", "embedding", "rep", F.col("first").alias("_first"), F.col("n").alias("copies"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component"), "named")
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    heads = util.save(named.select(F.col("rep").alias("component"), F.col("_first").alias("component_id")).join(sizes, "component"), "heads")
    table = util.save(util.attach(named.drop("_first"), heads, ["component"], "members", named.count(), F.col("rep")), "table")
    total = vectors.count()
    keyed = vectors.select("vec_id", "label", "embedding")
    key = lambda d: d.withColumn("_e", F.xxhash64("label", "embedding")).withColumn("_f", F.xxhash64(F.lit(5), "embedding", "label"))
    known = key(valid).select("vec_id", "_e", "_f")
    found = key(table).select("_e", "_f", "copies", "n_links", "component_id")
    joined = util.attach(known, found, ["_e", "_f"], "copies", total, F.col("vec_id"))
    rest = keyed.filter(~F.coalesce(_sound(), F.lit(False))).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = joined.select("vec_id", "n_links", "component_id").unionByName(rest)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
