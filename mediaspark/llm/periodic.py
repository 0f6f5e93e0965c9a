"""Periodic runs of words: recursive frequency splitting, then a lag scan of what survives."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as texts

#: A run holds this many periods and this many words at least; so each of its words occurs LEAST_PERIODS times in it.
LEAST_PERIODS, LEAST_WORDS = 4, 6


def survivors(ids: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that may belong to a run, and the segment of each; ``part`` numbers the texts.

    A word that occurs less than four times in its segment is in no run there, so it splits the segment; the pieces are
    counted again until nothing splits. Only segments that have changed are counted once more.
    """
    at, segment = np.arange(len(ids)), part.astype(np.int64)
    width = int(ids.max()) + 1 if len(ids) else 1
    done: list[tuple[np.ndarray, int]] = []
    while len(at):
        segment = np.cumsum(np.diff(segment, prepend=segment[0]) != 0)
        _, kind, n = np.unique(segment * width + ids[at], return_inverse=True, return_counts=True)
        frequent = n[kind] >= LEAST_PERIODS
        split = np.zeros(int(segment[-1]) + 1, bool)
        split[segment[~frequent]] = True
        stable = ~split[segment]
        if stable.any():
            done += [(x, 0) for x in np.split(at[stable], np.flatnonzero(np.diff(segment[stable])) + 1)]
        go = frequent & ~stable
        at, segment = at[go], segment[go]
        if len(at):
            segment = np.cumsum((np.diff(at, prepend=at[0]) > 1) | (np.diff(segment, prepend=segment[0]) != 0))
            long = np.bincount(segment)[segment] >= LEAST_WORDS
            at, segment = at[long], segment[long]
    kept = [x for x, _ in done if len(x) >= LEAST_WORDS]
    if not kept:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(kept), np.repeat(np.arange(len(kept)), [len(x) for x in kept])


def _next_same(rank: np.ndarray) -> np.ndarray:
    """Distance to the next position of the same rank; 0 where there is none."""
    order = np.argsort(rank, kind="stable")
    same = rank[order[1:]] == rank[order[:-1]]
    out = np.zeros(len(rank), np.int64)
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def scan(ids: np.ndarray, at: np.ndarray, segment: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs inside the segments.

    Lags are scanned in octaves. For lags over P/2 and up to P, stretches of P words are ranked (those of 2P from those
    of P): inside a run of such a smallest period the same P words come next at the period exactly, and at it first, so
    neighbouring positions with the same lag are the run, and no multiple of a period is found. Segments too short for
    longer periods, or without any P words that repeat, are left behind.
    """
    runs: list[tuple[int, int, int]] = []
    if not len(at):
        return runs
    ends = np.flatnonzero(np.diff(segment, append=-1)) + 1
    place = np.insert(at, ends, -1)  # a word of its own ends each segment
    rank = np.insert(ids[at].astype(np.int64), ends, int(ids.max()) + 1 + np.arange(len(ends)))
    number = np.insert(segment, ends, segment[ends - 1])
    size = 1
    while len(rank):
        lag = _next_same(rank)
        hit = np.flatnonzero((2 * lag > size) & (lag <= size))
        if len(hit):
            first = np.flatnonzero((np.diff(hit, prepend=-2) != 1) | (np.diff(lag[hit], prepend=-1) != 0))
            last = np.append(first[1:], len(hit)) - 1
            period = lag[hit[first]]
            length = hit[last] - hit[first] + period + size
            good = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
            runs += zip(place[hit[first]][good].tolist(), length[good].tolist(), period[good].tolist(), strict=True)
        lengths = np.bincount(number)
        go = (lengths > LEAST_PERIODS * (size + 1)) & (np.bincount(number, lag > 0, len(lengths)) > 0)  # lengths count the end word
        stay = go[number]
        rank, place, number = rank[stay], place[stay], number[stay]
        if not len(rank):
            break
        pair = rank * (int(rank.max()) + 2)
        pair[:-size] += rank[size:] + 1
        rank = np.unique(pair, return_inverse=True)[1]  # stretches over a segment's end hold its end word
        tail = len(rank) - np.arange(1, min(size, len(rank)) + 1)
        rank[tail] = int(rank.max()) + 1 + np.arange(len(tail))
        size *= 2
    return runs


def runs_of(words: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, by start and period."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes = [len(w) for w in words]
    ids = np.fromiter((known[w] for x in words for w in x), np.int64, sum(sizes))
    part = np.repeat(np.arange(len(words)), sizes)
    begin = np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for start, length, period in scan(ids, *survivors(ids, part)):
        k = int(part[start])
        out[k].append((start - int(begin[k]), length, period))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0)])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Runs of words that repeat with a period in each document, and its text without the repeats.

    Words are what ASCII white space parts (space, tab, line feed, vertical tab, form feed, carriage return). A run is a
    stretch whose words are those one smallest period before, of four periods and six words at least, and as long as it
    goes. Each text is one piece of work however long it is (some ten machine words for each of its words); documents are
    split over tasks as they are read, and nothing is shuffled.

    Null and empty texts have no words and no runs, and collapse to an empty text; repeated rows give repeated results;
    an empty table gives an empty one; null ids stay; columns besides doc_id and text are ignored.
    Returns doc_id, n_words, runs (start, length, period; by start, then period), collapsed.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in texts.chunks(batch.column(1)):
                source = data.tobytes()
                words = [source[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                found = runs_of(words)
                columns = [
                    batch.column(0).slice(i, j - i), pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found], pa.list_(run)),
                    pa.array([collapse(w, r).decode() for w, r in zip(words, found, strict=True)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    schema = f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(find, schema)


def digest(found: DataFrame) -> DataFrame:
    """One row per document of ``periodic_runs``: its number of runs, the one of most periods, and digests of runs and text."""
    rank = F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length")))
    top = F.when(F.size("runs") > 0, F.array_max(rank))
    start, length, period = -top["start"], top["length"], -top["period"]
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
