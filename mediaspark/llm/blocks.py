"""Blocks of documents with the distinct keys they hold, and the join that gives each block what it needs to know of them.

A row for each occurrence of a word in a corpus costs more than the texts. A block holds some megabytes of texts, each
distinct key of them once, and its documents by the places of their keys in that list; only the lists meet a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as texts
from . import util

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 2 << 20


def write(docs: DataFrame, make: Callable[[list[bytes]], dict], schema: str, name: str, size: int = BLOCK) -> DataFrame:
    """Saved blocks of (doc_id, text): block, doc_ids and the columns that ``make`` gives for the texts of one block.

    Numbers of blocks come from the task that writes them, and are read back as they were written, so a task that is
    run again can't mix them up. Null texts are empty.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j, data, offsets in texts.chunks(batch.column(1), size):
                source = data.tobytes()
                made = make([source[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                ids = batch.column(0).slice(i, j - i)
                columns = {"block": pa.array([number], pa.int64()), "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)}
                yield pa.RecordBatch.from_pydict(columns | made)
                number += 1

    return util.save(docs.select("doc_id", "text").mapInArrow(cut, f"block bigint, doc_ids array<{kind}>, {schema}"), name, "zstd")


def attach(blocks: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``blocks`` with ``found``: what ``table`` says of each entry of ``keys``, in their order.

    ``table`` has for each key how many blocks hold it in ``copies``; keys that are in so many blocks that one task would
    get too large a share are salted. A block's answers are no more than its distinct keys.
    """
    entries = blocks.select("block", F.posexplode("keys").alias("_at", key))
    total = blocks.agg(F.sum(F.size("keys"))).first()[0] or 0
    met = util.attach(entries, table, [key], "copies", total, F.col("block"))
    return gather(blocks, met, "_at", [c for c in table.columns if c not in (key, "copies")])


def gather(blocks: DataFrame, met: DataFrame, at: str, values: list[str]) -> DataFrame:
    """``blocks`` with the ``values`` of the rows of ``met`` that are theirs, by their place, as ``found``."""
    return blocks.drop("keys").join(found(met, at, values), "block", "left")


def found(met: DataFrame, at: str, values: list[str]) -> DataFrame:
    """The ``values`` of the rows of ``met`` for each block, in the order of their places."""
    return met.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(at, *values))).alias("found"))


def per_document(met: DataFrame, solve: Callable[[dict], dict], schema: str) -> DataFrame:
    """One row per document: ``solve`` gives its columns for a block, whose row it gets as Arrow scalars by name."""
    kind = met.schema["doc_ids"].dataType.elementType.simpleString()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(c)[k] for c, name in enumerate(batch.schema.names)}
                yield pa.RecordBatch.from_pydict({"doc_id": row["doc_ids"].values} | solve(row))

    return met.mapInArrow(take, f"doc_id {kind}, {schema}")


def packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), "zstd", asbytes=True)


def unpacked(value: pa.Scalar, n: int, dtype: type = np.int32) -> np.ndarray:
    """``n`` numbers that ``packed`` has made a binary of."""
    return np.frombuffer(pa.decompress(value.as_py(), n * np.dtype(dtype).itemsize, "zstd"), dtype)


def numbers(value: pa.Scalar, dtype: type = np.int32) -> np.ndarray:
    """A binary scalar as an array of numbers."""
    return np.frombuffer(value.as_py() or b"", dtype)
