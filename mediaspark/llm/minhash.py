"""Near-duplicate documents by DartMinHash signatures, banded joins and an exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, text, util

SHINGLE, LEAST = 5, 0.8
#: Bands of signature coordinates: a pair at the least similarity shares no band with a probability of 2e-5.
BANDS, ROWS = 27, 5
#: Most members, and shingles, of an undecided bucket that one task compares with as many others.
BLOCK, BLOCK_SHINGLES = 512, 200_000
#: Shingles that are counted at once where a block is compared.
COLUMNS = 4_096
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def unit_cells(elements: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell hash, document, height) of weighted elements: weight w is cells 0, 1, ... of height 1 and one of the rest."""
    n = np.ceil(weight).astype(np.int64)
    level = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    cells = text.mix(np.repeat(elements, n) + level.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return cells, np.repeat(doc, n), np.minimum(1.0, np.repeat(weight, n) - level)


def darts(elements: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """DartMinHash signatures, a row of ``k`` hashes per document; two agree in a place with their weighted similarity.

    Darts hit the plane of weight and time of each element at rate 1, cell by cell, by a generator seeded with the
    cell's hash, so that all documents see the same darts. A document sees those under its weight; each dart is for
    one of the k coordinates and the earliest dart of a coordinate is kept. Only the time in which k (log k + 3) darts
    are to be expected is searched, and twice as much where a coordinate stays empty.
    """
    cells, doc, height = unit_cells(elements, doc, weight)
    out = np.zeros((n_docs, k), np.uint64)
    mass = np.bincount(doc, height, n_docs)
    todo = np.flatnonzero(mass > 0)
    limit = np.zeros(n_docs)
    limit[todo] = k * (np.log(k) + 3) / mass[todo]
    uniform = lambda h: (h >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
    while len(todo):
        busy = np.zeros(n_docs, bool)
        busy[todo] = True
        live = np.flatnonzero(busy[doc])
        state, owner, top, time = cells[live].copy(), doc[live], height[live], np.zeros(len(live))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(state):
            state = state + _GOLDEN
            gap = text.mix(state)
            time = time - np.log(uniform(gap))
            keep = time <= limit[owner]
            state, owner, top, time, gap = (x[keep] for x in (state, owner, top, time, gap))
            dart = text.mix(gap ^ np.uint64(0xD1B54A32D192ED03))
            under = (top >= 1) | (uniform(text.mix(dart + _GOLDEN)) < top)
            found.append((owner[under] * k + (dart[under] % np.uint64(k)).astype(np.int64), time[under], dart[under]))
        slot, when, dart = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((when, slot))
        slot, dart = slot[order], dart[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        flat = out.reshape(-1)
        flat[slot[first]] = dart[first]
        hits = np.bincount(slot[first] // k, minlength=n_docs)
        todo = todo[hits[todo] < k]
        limit[todo] *= 2
    return out


def _bands(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each band of each signature."""
    parts = signatures[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    total = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _GOLDEN, parts.shape[:2]).copy()
    for r in range(ROWS):
        total = text.mix(total ^ parts[:, :, r])
    return total.view(np.int64)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, the row key, a 128-bit identity of the set of shingles (null for texts without words), bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[int, np.ndarray]] = []
            size = 0
            done: list[pa.RecordBatch] = []

            def flush() -> None:
                nonlocal held, size
                if not held:
                    return
                lens = [len(s) for _, s in held]
                cells, doc = np.concatenate([s for _, s in held]), np.repeat(np.arange(len(held)), lens)
                bands = _bands(darts(cells, doc, np.ones(len(cells)), len(held), BANDS * ROWS))
                ids = []
                for salt in (1, 2):
                    mixed = text.mix(cells ^ np.uint64(salt * 0x51ED2705))
                    ids.append([int(mixed[a:b].sum(dtype=np.uint64).view(np.int64)) if b > a else None for a, b in zip(np.cumsum([0, *lens[:-1]]), np.cumsum(lens), strict=True)])
                rows = pa.array([r for r, _ in held])
                own = [batch.column(k).take(rows) for k in (0, 2, 3)]
                array = pa.array([b if n else [] for b, n in zip(bands, lens, strict=True)], pa.list_(pa.int64()))
                done.append(pa.RecordBatch.from_arrays([*own, pa.array(ids[0], pa.int64()), pa.array(ids[1], pa.int64()), array], ["doc_id", "_k1", "_k2", "s1", "s2", "bands"]))
                held, size = [], 0

            for row, words in text.rows_of_words(batch.column(1)):
                held.append((row, text.shingles(words, SHINGLE)))
                size += len(words) + 500
                if size > 250_000:
                    flush()
            flush()
            yield from done

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = util.row_key(docs.select("doc_id", "text"))
    return keyed.mapInArrow(sign, f"doc_id {kind}, _k1 bigint, _k2 bigint, s1 bigint, s2 bigint, bands array<bigint>")


def _shingled(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, its sorted shingles) of the wanted rows (_k1, _k2, rep); a row that the table repeats is there as often."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [text.shingles(w, SHINGLE).view(np.int64) for _, w in text.rows_of_words(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["rep", "sh"])

    some = util.row_key(docs.select("doc_id", "text")).join(util.small(wanted), ["_k1", "_k2"])
    return some.select("rep", "text").mapInArrow(cut, "rep bigint, sh array<bigint>")


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose Jaccard similarity is at least LEAST."""
    left, right = sets.select(F.col("rep").alias("a"), F.col("sh").alias("x")), sets.select(F.col("rep").alias("b"), F.col("sh").alias("y"))
    size = lambda c: F.size(c)
    pairs = util.save(pairs, "pairs")
    copies = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_copies"))
    met = util.attach(pairs.join(right, "b"), left.join(copies, "a"), ["a"], "_copies", pairs.count(), F.col("b")).drop("_copies")
    lengths = F.least(size("x"), size("y")) >= LEAST * F.greatest(size("x"), size("y"))
    both = F.size(F.array_intersect("x", "y"))
    return met.filter(lengths).filter(both >= LEAST * (size("x") + size("y") - both)).select("a", "b")


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each pair of sets shares: products of their 0/1 rows over the shingles of two sets or more."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.cumsum(n > 1) - 1
    keep = n[column] > 1
    column, owner = common[column[keep]], owner[keep]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(common[-1]) + 1 if len(common) else 0, COLUMNS):
        some = (column >= at) & (column < at + COLUMNS)
        rows = np.zeros((len(sets), COLUMNS), np.float32)
        rows[owner[some], column[some] - at] = 1
        out += rows @ rows.T
    return out


def _by_blocks(open_buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """Links within buckets whose members are not all connected: blocks of members against blocks, in tasks of bounded size.

    The members of a bucket's largest component are connected already, so their blocks (numbered -1, -2, ...) meet only
    those of the other members (0, 1, ...): a large group with a few strays takes work in proportion to its size. A
    forest of links between different components is returned, not every pair.
    """
    sized = open_buckets.join(sets.select("rep", F.size("sh").alias("_n")), "rep")
    sized = util.save(sized, "sized")
    tally = sized.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("rows"), F.sum("_n").alias("cells"))
    tally = util.save(tally, "tally")
    of_largest = lambda c: F.max_by(c, F.struct("rows", "component"))
    whole = tally.groupBy("bucket").agg(
        of_largest("component").alias("_main"), of_largest("rows").alias("_rows"), of_largest("cells").alias("_cells"), F.sum("rows").alias("_copies"), F.sum("cells").alias("_all")
    )
    blocks_for = lambda rows, cells: F.ceil(F.greatest(cells / BLOCK_SHINGLES, rows / BLOCK))
    main, rest = blocks_for(F.col("_rows"), F.col("_cells")), blocks_for(F.col("_copies") - F.col("_rows"), F.col("_all") - F.col("_cells"))
    sizes = util.save(whole.select("bucket", "_main", "_copies", main.alias("_main_blocks"), rest.alias("_blocks")), "sizes")
    # members are dealt by hash, so no task numbers or meets a whole bucket
    dealt = util.attach(sized, sizes, ["bucket"], "_copies", sized.count(), F.col("rep"))
    hashed = F.xxhash64("rep")
    block = F.when(F.col("component") == F.col("_main"), -1 - F.pmod(hashed, F.col("_main_blocks"))).otherwise(F.pmod(hashed, F.col("_blocks")))
    members = util.save(dealt.select("bucket", "rep", "component", block.alias("block")), "members")
    blocks = members.select("bucket", "block").distinct()
    to = blocks.select("bucket", F.col("block").alias("other"))
    met = blocks.join(to, "bucket").filter("block >= 0 OR other >= 0")  # a bucket has as many blocks as its members need, mostly two
    low = met.filter("block <= other").select("bucket", "block", F.col("block").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"))
    high = met.filter("block > other").select("bucket", "block", F.col("other").alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))
    dealt = members.join(low.unionByName(high), ["bucket", "block"]).join(sets, "rep")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "rep"])
        rep, side, component = (pdf[c].to_numpy() for c in ("rep", "side", "component"))
        inner = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        n = pdf["sh"].map(len).to_numpy()
        both = _shared(list(pdf["sh"]))
        link = (both >= LEAST * (n[:, None] + n[None, :] - both) - 1e-6) & (component[:, None] != component[None, :])
        link &= np.triu(np.ones_like(link), 1) if inner else (side[:, None] < side[None, :])
        parent = {c: c for c in component}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for x, y in np.argwhere(link):
            p, q = root(component[x]), root(component[y])
            if p != q:
                parent[p] = q
                out.append((rep[x], rep[y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("bucket", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def classed(docs: DataFrame) -> DataFrame:
    """The row key (_k1, _k2) of doc_id and text with what ``near_duplicates`` returns, one row for each of ``docs``."""
    util.bound_batches(docs.sparkSession)
    signed = util.save(_signed(docs), "signed")
    worded = signed.filter("s1 IS NOT NULL AND doc_id IS NOT NULL")
    first = F.struct("doc_id", "_k1", "_k2")
    sorts = worded.groupBy("s1", "s2").agg(F.min_by("bands", first).alias("bands"), F.min(first).alias("f"), F.count(F.lit(1)).alias("copies"))
    sorts = sorts.select("s1", "s2", "bands", "copies", "f.*").orderBy("doc_id", "_k1", "_k2")
    # texts of the same shingles are one node, numbered in the order of their first rows: ids may repeat, nodes don't
    classes = util.save(sorts.withColumn("rep", F.monotonically_increasing_id()), "classes")
    banded = classes.select("rep", F.explode("bands").alias("bucket"))
    firsts = banded.groupBy("bucket").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = util.save(banded.join(firsts, "bucket").select("bucket", "rep", "a", "n"), "buckets")
    wanted = util.save(classes.select("_k1", "_k2", "rep").join(members.select("rep").distinct(), "rep", "left_semi"), "wanted")
    sets = util.save(_shingled(docs, wanted), "shingles")
    if sets.count() > wanted.count():  # rows alike in id and text
        sets = util.save(sets.dropDuplicates(["rep"]), "shingles")
    pairs = members.filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    forest = util.save(_checked(pairs, sets), "links")
    named = members.select("bucket", "rep").join(graph.components(forest).withColumnRenamed("node", "rep"), "rep", "left")
    named = util.save(named.withColumn("component", F.coalesce("component", "rep")), "named")
    # a bucket of two has been decided by its first member
    mixed = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi AND n > 2")
    mixed = util.save(mixed.select("bucket", F.col("n").alias("_copies")), "mixed")
    open_buckets = util.save(util.attach(named, mixed, ["bucket"], "_copies", named.count(), F.col("rep")).drop("_copies"), "open")
    if not open_buckets.isEmpty():
        forest = util.save(forest.union(_by_blocks(open_buckets, sets)), "links")
    named = graph.components(forest).withColumnRenamed("node", "rep")
    nodes = util.save(classes.select("s1", "s2", "rep", "copies").join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "nodes")
    sizes = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    heads = classes.select(F.col("rep").alias("component"), F.col("doc_id").alias("class_id"), F.col("_k1").alias("_h1"), F.col("_k2").alias("_h2"))
    heads = util.save(heads.join(sizes, "component"), "heads")
    table = util.attach(nodes, heads, ["component"], "members", nodes.count(), F.col("rep"))
    table = util.save(table.select("s1", "s2", "copies", "class_id", "_h1", "_h2"), "table")
    out = util.attach(worded.select("doc_id", "_k1", "_k2", "s1", "s2"), table, ["s1", "s2"], "copies", signed.count(), F.col("doc_id"))
    head = (F.col("doc_id") == F.col("class_id")) & (F.col("_k1") == F.col("_h1")) & (F.col("_k2") == F.col("_h2"))
    out = out.select("_k1", "_k2", "doc_id", "class_id", head.alias("kept"))
    alone = signed.filter("s1 IS NULL OR doc_id IS NULL").select("_k1", "_k2", "doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return out.union(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Classes of documents connected by a Jaccard similarity of at least 0.8 of their distinct five-word shingles.

    Texts of the same shingles are one class from the start. Distinct ones meet in bands of DartMinHash signatures
    (weights of 1 give the Jaccard similarity of sets). In each bucket the first member is checked exactly with the
    others. In buckets whose members are then not all connected, those outside the largest component are compared with
    all members in blocks against blocks, which report a connecting forest: no link is lost, and a group of near copies never becomes all of its pairs.

    Null texts and texts without words are classes of their own. A document is a row's id and text: an id with several
    texts has each in its own class, rows alike in both are one document; an empty table gives an empty result; other
    columns are ignored. Returns doc_id, class_id (the smallest doc_id of the class), kept (one document of each class).
    """
    return classed(docs).select("doc_id", "class_id", "kept")
