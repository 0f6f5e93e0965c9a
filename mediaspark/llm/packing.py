"""Best-fit packing of token sequences by exact-complement hashing."""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import util

#: Distinct chunks whose ids a task keeps.
CACHE = 250_000
END_ID = 2
#: Bits of a piece's number within its length, below the bits of the length.
NUMBER_BITS = 40
#: Sixteenths of a sequence under which a plan leaves lengths to best fit.
SPARED = (0, 0.5, 1, 2, 3, 4, 5)
Plan = list[tuple[tuple[int, ...], int]]


def _class(first: str, limit: int) -> str:
    """A character class of the code points under ``limit`` whose category starts so, as ranges."""
    codes = [c for c in range(limit) if unicodedata.category(chr(c))[0] == first]
    runs = [c for c in codes if c - 1 not in codes], [c for c in codes if c + 1 not in codes]
    return "".join(f"\\u{x:04x}-\\u{y:04x}" for x, y in zip(*runs, strict=True))


def _splitter(limit: int) -> re.Pattern:
    """The byte-level pretokenizer's split, for texts of code points under ``limit`` only.

    No contraction begins with a letter or number, so these may come first.
    """
    letter, number, space = _class("L", limit), _class("N", limit), "\t\n\x0b\x0c\r \x85\xa0"
    return re.compile(f" ?[{letter}]+| ?[{number}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes, as the tokenizer file defines them.

    A pretoken never crosses a single space that stands before a word, and merges never cross a pretoken: each
    distinct space-led chunk is encoded once and kept, by the vocabulary of the file used as merge ranks. Texts with
    runs of white space are split by the pretokenizer's pattern instead; texts with characters beyond Latin-1 or a
    special token's string go to the tokenizer whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in w): i for w, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if w not in self.special}
        self.merge = tiktoken.Encoding("file", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.run = re.compile(r"\s\s").search
        self.split = _splitter(0x100).findall
        self.known: dict[str, bytes] = {}

    def _plain(self, text: str) -> bool:
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not any(x in text for x in self.special)

    def __call__(self, text: str) -> bytes:
        if not self._plain(text):
            return pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.run(text):
            return b"".join(pack_ids(self.merge(w.encode())) for w in self.split(text))
        known = self.known
        first, *chunks = text.split(" ")
        head = b"".join(pack_ids(self.merge(w.encode())) for w in self.split(first))
        try:
            return head + b"".join([known[c] for c in chunks])
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for c in chunks:
                if c not in known:
                    known[c] = b"".join([pack_ids(self.merge(w.encode())) for w in self.split(" " + c)])
            return head + b"".join([known[c] for c in chunks])


@cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file, as loading the file takes longer than a small task."""
    return Encoder(path)


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def pieces(docs: DataFrame, tokenizer: str, size: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32; the first piece of a long document is the shorter one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = struct.pack("<I", END_ID)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                at = 0
                for k in range(-(-n // size)):
                    length = n % size or size if k == 0 else size
                    rows.append((doc, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])))
                    at += length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        encode.known.clear()  # the worker goes on to other tasks

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def _best_fit(left: dict[int, int], size: int) -> Plan:
    """Longest first, into the smallest gap that takes it."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def put(combo: tuple[int, ...], n: int) -> None:
        gap = size - sum(combo)
        if gap not in bins:
            bins[gap] = []
            insort(gaps, gap)
        bins[gap].append((combo, n))

    for x in sorted(left, reverse=True):
        n = left[x]
        while n:
            at = bisect_left(gaps, x)
            if at < len(gaps):
                gap = gaps[at]
                combo, m = bins[gap].pop()
                if not bins[gap]:
                    del bins[gap]
                    gaps.pop(at)
                k = min(n, m)
                if m > k:
                    put(combo, m - k)
                put((*combo, x), k)
                n -= k
            else:
                many = max(1, size // x)
                if n >= many:
                    put((x,) * many, n // many)
                    n %= many
                else:
                    put((x,) * n, 1)
                    n = 0
    return [p for b in bins.values() for p in b]


def _fill(counts: dict[int, int], size: int, least: int) -> Plan:
    """Exact fillings, pairs and triples of lengths from ``least`` on only, then best fit of what is left."""
    left = {k: n for k, n in counts.items() if n > 0}
    out: Plan = []

    def take(combo: tuple[int, ...]) -> None:
        need = {x: combo.count(x) for x in combo}
        if (k := min(left.get(x, 0) // m for x, m in need.items())) > 0:
            for x, m in need.items():
                left[x] -= m * k
            out.append((combo, k))

    if left.get(size):
        out.append(((size,), left.pop(size)))
    for x in sorted(left, reverse=True):  # singles: the gap itself is a length
        if left[x] and left.get(size - x):
            take((x, size - x))
    order = [x for x in sorted(left, reverse=True) if left[x] and x >= least]
    pairs: dict[int, list[tuple[int, int]]] = {}  # by their sum, larger part first
    for i, a in enumerate(order):
        for b in order[i:]:
            if a + b < size:
                pairs.setdefault(a + b, []).append((a, b))
    for x in order:
        for a, b in pairs.get(size - x, ()):
            if not left[x]:
                break
            if a <= x and left[a] and left[b]:
                take((x, a, b))
    order = [x for x in order if left[x]]
    triples: dict[int, list[int]] = {}  # by their sum: the largest part, whose pair stands in the index of pairs
    for a in order:
        for total in pairs:
            if a + total < size:
                triples.setdefault(a + total, []).append(a)
    for x in order:
        for a in triples.get(size - x, ()):
            if not left[x]:
                break
            for b, c in pairs[size - x - a] if a <= x and left[a] else ():
                if b <= a and left[b] and left[c]:
                    take((x, a, b, c))
                    if not (left[x] and left[a]):
                        break
    return out + _best_fit({x: n for x, n in left.items() if n}, size)


def plan(counts: dict[int, int], size: int) -> Plan:
    """Fill sequences from counts of lengths: (lengths in place order, how many such sequences).

    From the longest length down, the gap it leaves is looked up among single, pair and triple length sums and exact
    fillings are consumed as long as all their lengths are available. What is left goes best-fit, longest first, into
    the smallest gap that takes it. Pairs and triples may eat the short lengths that best fit needs for its gaps, so
    plans that spare lengths under some share of ``size``, and at last plain best fit, are made as well and the first
    of the fewest sequences is taken: never more than best fit needs. The work depends on the number of distinct
    lengths (at most ``size``), not of pieces.
    """
    plans = [_fill(counts, size, max(1, int(size * k / 16))) for k in SPARED]
    plans.append(_best_fit({x: n for x, n in counts.items() if n > 0}, size))
    return min(plans, key=lambda p: sum(n for _, n in p))


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, planner: Callable = plan) -> DataFrame:
    """Pack the pieces of all documents into sequences of at most ``size`` tokens.

    A document is its ids and an end id; a null or empty text is the end id alone. Only documents over ``size`` are cut,
    however long they are: all their pieces but the first are full. Repeated rows are packed each for itself; of pieces
    that are alike in length, id, place and ids any order is right; an empty table gives an empty result; columns
    besides doc_id and text are ignored. Only the histogram of lengths, at most ``size`` counts, reaches the driver; the plan made from it comes
    back as ranges of running numbers per length, sorted in one array, in which a piece finds its range by a binary search for
    its number within its length.
    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    util.bound_batches(spark)
    cut = util.save(pieces(docs, tokenizer, size), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    used: dict[int, int] = {}
    slots: dict[int, list[tuple[int, int, int, int]]] = {}  # by length: running numbers from, to, first sequence, offset
    first = 0
    for combo, n in planner(counts, size):
        offsets = list(accumulate(combo, initial=0))
        for length, offset in zip(combo, offsets, strict=False):
            begin = used.get(length, 0)
            slots.setdefault(length, []).append((begin, begin + n, first, offset))
            used[length] = begin + n
        first += n
    ranges = sorted((k, *r) for k, v in slots.items() for r in v)
    places = spark.createDataFrame([(n, begin, first, offset) for n, (_, begin, _, first, offset) in enumerate(ranges)], "_slot bigint, begin bigint, first bigint, offset bigint")
    begins = np.array([(k << NUMBER_BITS) + begin for k, begin, *_ in ranges], np.int64)

    @F.arrow_udf("bigint")
    def slot(length: pa.Array, number: pa.Array) -> pa.Array:
        wanted = (length.to_numpy() << NUMBER_BITS) + number.to_numpy()
        return pa.array(np.searchsorted(begins, wanted, "right") - 1, pa.int64())

    numbered = util.gapless(cut, ["length"], ["doc_id", "piece", "start", "ids_crc32"], sum(counts.values()), "_number")
    found = numbered.withColumn("_slot", slot("length", "_number")).join(F.broadcast(places), "_slot")
    sequence = F.col("first") + F.col("_number") - F.col("begin")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset")
