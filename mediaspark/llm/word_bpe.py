"""Byte-pair encoding and decoding by a table of distinct words."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, util

#: Bytes from which a word is cut at its digits too, each of which is a word of its own to the tokenizer.
LONG = 1_000
#: Bytes of text in a block: the more, the fewer words stand in several blocks.
BLOCK = 32 << 20
#: Bytes of text for one part of the table of words; words of a part that are encoded at once; words of the documents that are put together at once.
PART, ENCODED, WORDS = 64 << 20, 10_000, 200_000
_DIGITS = re.compile(rb"[0-9]|[^0-9]+")


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def split(text: bytes) -> list[bytes]:
    """What ASCII white space parts: no token, no composition of characters and no special token's string goes across it."""
    words = text.split()
    if any(len(w) > LONG for w in words):
        return [x for w in words for x in (_DIGITS.findall(w) if len(w) > LONG else [w])]
    return words


def _places(sources: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """Distinct words of some texts, and each text as the places of its words among them."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    places = [np.array([known[w] for w in split(x)], np.int32) for x in sources]
    return list(known), places


def _block(sources: list[bytes]) -> dict:
    words, places = _places(sources)
    codes = np.concatenate([*places, np.zeros(0, np.int32)])
    return {"keys": pa.array([[w.decode() for w in words]], pa.list_(pa.string())), "n_words": pa.array([[len(x) for x in places]], pa.list_(pa.int64())), "codes": pa.array([blocks.packed(codes)], pa.binary())}


def _packed(values: np.ndarray) -> bytes:
    """Numbers by their first bytes, then their second ones and so on, compressed: many of them are small."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return pa.Codec("zstd", compression_level=9).compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def _unpacked(value: bytes, n: int, dtype: type = np.int32) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(value, n * np.dtype(dtype).itemsize, "zstd"), np.uint8).reshape(np.dtype(dtype).itemsize, n)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(n)


def _dealt(sources: list[bytes], n_parts: int) -> dict:
    """A block whose words are dealt to parts by a hash; those of a part are one compressed string.

    Words are numbered by falling frequency, then by part, then by alphabet, so numbers, parts and words all compress
    well, and a part's words are in the order of their numbers.
    """
    words, places = _places(sources)
    n = len(words)
    codes = np.concatenate([*places, np.zeros(0, np.int32)])
    part = np.fromiter((zlib.crc32(w) % n_parts for w in words), np.int32, n)
    place = np.empty(n, np.int32)
    place[sorted(range(n), key=words.__getitem__)] = np.arange(n)
    order = np.lexsort((place, part, -np.bincount(codes, minlength=n)))
    place[order] = np.arange(n)
    by_part = np.argsort(part[order], kind="stable")
    cuts = np.flatnonzero(np.diff(part[order][by_part])) + 1
    keys = []
    for own in np.split(order[by_part], cuts) if n else []:
        joined = b" ".join([words[k] for k in own.tolist()])
        keys.append({"part": int(part[own[0]]), "size": len(joined), "words": pa.compress(joined, "zstd", asbytes=True)})
    kind = pa.list_(pa.struct([("part", pa.int32()), ("size", pa.int64()), ("words", pa.binary())]))
    return {
        "keys": pa.array([keys], kind), "n_words": pa.array([[len(x) for x in places]], pa.list_(pa.int64())), "n_keys": pa.array([n], pa.int64()),
        "codes": pa.array([_packed(place[codes])], pa.binary()), "parts": pa.array([_packed(part[order])], pa.binary()),
    }


def encode_words(entries: DataFrame, tokenizer: str) -> DataFrame:
    """(block, _at, word) with ``ids`` for the word, by the file's own library, which gets each distinct word once.

    For tables of single words: rows of a word are dealt to one task and sorted together, so a word's ids wait for its
    next row and for no other's.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _tokenizer(tokenizer)
        last: dict[str, list[int]] = {}
        for batch in batches:
            words = batch.column(2).dictionary_encode()
            names = words.dictionary.to_pylist()
            ids = [last.get(w) or library.encode(w, add_special_tokens=False).ids for w in names]
            if names:
                last = {names[-1]: ids[-1]}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())).take(words.indices)], ["block", "_at", "ids"])

    return entries.repartition("word").sortWithinPartitions("word").mapInArrow(encode, "block bigint, _at int, ids array<int>")


def encode_parts(entries: DataFrame, tokenizer: str, n_parts: int) -> DataFrame:
    """(block, part, size, words) with the ``ids`` of the words and how many each has (``counts``), both compressed.

    A part is dealt to one task whole, so the library gets each distinct word of all blocks once.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if not rows:
            return
        library = _tokenizer(tokenizer)
        lists = [pa.array(pa.decompress(w, size, "zstd", asbytes=True).split(b" "), pa.binary()) for _, _, size, w in rows]
        ends = np.cumsum([len(x) for x in lists])
        words = pa.chunked_array(lists).combine_chunks().dictionary_encode()
        del lists
        kind = np.uint16 if library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.int32
        counts, flat = [], []
        for at in range(0, len(words.dictionary), ENCODED):
            found = [library.encode(w.decode(), add_special_tokens=False).ids for w in words.dictionary.slice(at, ENCODED).to_pylist()]
            counts.append(np.fromiter(map(len, found), np.int32, len(found)))
            flat.append(np.fromiter(chain.from_iterable(found), kind, int(counts[-1].sum())))
        sizes, held = np.concatenate(counts), np.concatenate(flat)
        starts = np.cumsum(sizes) - sizes
        indices = words.indices.to_numpy()
        for (block, part, _, _), begin, end in zip(rows, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            own = indices[begin:end]
            ids = _gathered(held, starts[own], sizes[own])
            row = {"block": block, "part": part, "n": end - begin, "n_ids": len(ids), "counts": _packed(sizes[own]), "ids": pa.compress(ids.tobytes(), "zstd", asbytes=True), "width": ids.itemsize}
            yield pa.RecordBatch.from_pylist([row], _ENCODED)

    return entries.repartitionById(n_parts, "part").mapInArrow(encode, "block bigint, part int, n bigint, n_ids bigint, counts binary, ids binary, width int")


_ENCODED = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("n_ids", pa.int64()), ("counts", pa.binary()), ("ids", pa.binary()), ("width", pa.int32())])


def _gathered(held: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``held`` that start so and are so long, one after the other."""
    begins = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    return held[begins + np.arange(len(begins))]


def pieces(spark: SparkSession, tokenizer: str) -> DataFrame:
    """(id, piece) of the tokenizer file's vocabulary with its added tokens: as many rows as the file has ids."""
    found = sorted((i, w) for w, i in _tokenizer(tokenizer).get_vocab(with_added_tokens=True).items())
    return spark.createDataFrame(pa.table({"id": pa.array([i for i, _ in found], pa.int32()), "piece": pa.array([w for _, w in found], pa.string())}))


def decode(rows: DataFrame, keys: list[str], tokenizer: str) -> DataFrame:
    """``keys``, their ``ids`` and the text ``decoded`` of them: pieces joined by one space, as a file without a decoder says.

    The ids meet the vocabulary, whose size the file bounds, and pieces are put together again by place; ``keys`` are
    distinct, and rows that are already dealt by them stay where they are. Ids that are not in the vocabulary have no
    piece; null ids and none give an empty text.
    """
    met = rows.select(*keys, F.posexplode_outer("ids").alias("_at", "id")).join(F.broadcast(pieces(rows.sparkSession, tokenizer)), "id", "left")
    parts = met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("_at", "id", "piece")))).alias("_p"))
    return parts.select(*keys, F.col("_p.id").alias("ids"), F.array_join(F.col("_p.piece"), " ").alias("decoded"))


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Ids of every text by the tokenizer file, and the text that they decode to.

    Texts are split into words in tasks that read them, by blocks, which hold each distinct word once and their texts as
    numbers of words. The words of all blocks are dealt by a hash to as many parts as the texts are large, in each of which
    every distinct word is encoded once by the file's own library. A block and a part are one row, words and ids
    compressed, not a row for each word. Each block gets the ids of its own words back by a join, meets the vocabulary,
    whose size the file bounds, and its documents are put together by the numbers of their words.

    Special tokens' strings in a text are special tokens, as the library has it; none are added. Null and empty texts
    and those of white space only have no ids and decode to an empty text; texts may be of any length; repeated rows
    give repeated results; null ids stay; an empty table gives an empty one; columns besides doc_id and text are
    ignored. Returns doc_id, ids (little-endian unsigned 32-bit integers as binary), decoded.
    """
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n_parts = max(util.partitions(spark), util.parts_for(n_bytes, PART))
    schema = "keys array<struct<part: int, size: bigint, words: binary>>, n_words array<bigint>, n_keys bigint, codes binary, parts binary"
    cut = blocks.write(docs, lambda sources: _dealt(sources, n_parts), schema, "word_blocks", BLOCK)
    entries = cut.select("block", F.explode("keys").alias("k")).select("block", "k.part", "k.size", "k.words")
    found = encode_parts(entries, tokenizer, n_parts).groupBy("block").agg(F.collect_list(F.struct("part", "n", "n_ids", "counts", "ids", "width")).alias("found"))
    names = pieces(spark, tokenizer).agg(F.array_sort(F.collect_list(F.struct("id", "piece"))).alias("names"))
    met = cut.drop("keys").join(found, "block", "left").crossJoin(F.broadcast(names))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _documents({name: batch.column(c)[k] for c, name in enumerate(batch.schema.names)})

    return met.mapInArrow(put, f"doc_id {kind}, ids binary, decoded string")


def _documents(row: dict) -> Iterator[pa.RecordBatch]:
    """The documents of a block, some at a time."""
    n = row["n_keys"].as_py()
    found = sorted(row["found"].as_py() or [], key=lambda r: r["part"])
    sizes = np.concatenate([np.zeros(0, np.int32), *(_unpacked(r["counts"], r["n"]) for r in found)])
    kinds = {2: np.uint16, 4: np.int32}
    held = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(pa.decompress(r["ids"], r["n_ids"] * r["width"], "zstd"), kinds[r["width"]]) for r in found)])
    del found
    place = np.empty(n, np.int64)  # of each word among those of all parts
    place[np.argsort(_unpacked(row["parts"].as_py(), n), kind="stable")] = np.arange(n)
    sizes, starts = sizes[place], (np.cumsum(sizes) - sizes)[place]
    names = row["names"].values
    ids, piece = names.field("id").to_numpy(), names.field("piece")
    at = np.zeros(int(ids[-1]) + 1, np.int64)
    at[ids] = np.arange(len(ids))
    ends = np.cumsum(row["n_words"].values.to_numpy())
    codes = _unpacked(row["codes"].as_py(), int(ends[-1]))
    docs = row["doc_ids"].values
    first = 0
    while first < len(docs):
        begin = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, begin + WORDS, "right")))
        own = codes[begin : ends[last - 1]]
        counts = sizes[own]
        got = _gathered(held, starts[own], counts)
        upto = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[begin], ends[first:last]]) - begin]
        bounds = upto.tolist()
        numbers = [got[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        listed = pa.LargeListArray.from_arrays(pa.array(upto, pa.int64()), piece.take(pa.array(at[got])))
        yield pa.RecordBatch.from_arrays([docs.slice(first, last - first), pa.array(numbers, pa.binary()), pc.binary_join(listed, " ")], ["doc_id", "ids", "decoded"])
        first = last


def digest(encoded: DataFrame) -> DataFrame:
    """Number of ids and digests of ids and decoded text, for each row of ``encode_decode``."""
    n = F.floor(F.octet_length("ids") / 4).cast("bigint")
    return encoded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
