"""Alignment of two tokenizers' tokens over the same bytes, by divide and conquer at the ends they share."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, packing

#: Links that are expanded at once in a task, tokens that are written into a digest at once.
LINKS, TOKENS = 1 << 21, 1 << 20
#: Bytes of text in a block: the more, the fewer segments stand in several blocks.
BLOCK = 4 << 20
SPACE = "▁"  # fixed value: how pieces write a space
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")  # fixed value: how pieces write a byte
_RUN = re.compile(r"\s\s")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")


def _is_latin(text: str) -> bool:
    return text.isascii() or max(text) <= "\xff"


def _new(values: np.ndarray) -> np.ndarray:
    """Where another value begins in sorted ones."""
    return np.append(True, values[1:] != values[:-1])[: len(values)]


def _stretches(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, one behind the last) of consecutive stretches of at most ``most`` together, or of one."""
    upto = np.append(0, np.cumsum(sizes))
    begin = 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + most, "right")) - 1)
        yield begin, end
        begin = end


class Plain:
    """The byte-level tokenizer, to which special tokens' strings are ordinary text."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        byte_of = packing._byte_of()
        ranks = {bytes(byte_of[c] for c in w): i for w, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if w not in special}
        entries = {i: x for x, i in ranks.items()}
        self.bytes_of = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.sizes = np.array([len(x) for x in self.bytes_of], np.int64)
        self.starts, self.bytes = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.latin = tiktoken.Encoding("file", pat_str=packing._splitter(0x100).pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, segments: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments, each with a space in front, and how many each has; ``sizes`` are their bytes with that space.

        Segments of Latin-1 that neither begin nor end with white space are encoded as one text, by the vocabulary used
        as merge ranks; the others go to the tokenizer one by one.
        """
        joined = " ".join(segments)
        if _is_latin(joined) and not _RUN.search(f" {joined} "):
            return self._together(joined, sizes)
        together = [_is_latin(x) and not (x[0].isspace() or x[-1].isspace()) for x in segments]
        one = np.array(together, bool)
        ids, n = self._together(" ".join(compress(segments, together)), sizes[one])
        alone = [self.tokenizer.encode(" " + x, add_special_tokens=False).ids for x, t in zip(segments, together, strict=True) if not t]
        counts = np.zeros(len(segments), np.int64)
        counts[one], counts[~one] = n, [len(x) for x in alone]
        out = np.zeros(int(counts.sum()), np.int64)
        of_one = np.repeat(one, counts)
        out[of_one], out[~of_one] = ids, list(chain.from_iterable(alone))
        return out, counts

    def _together(self, joined: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.latin(" " + joined) if len(sizes) else [], np.int64)
        upto = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(sizes)) + 1
        return ids, np.diff(upto, prepend=0)


class Pieces:
    """The piece tokenizer."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(m[1], 16)]) if (m := _BYTE.match(w)) else w.replace(SPACE, " ").encode() for w in names]
        self.sizes = np.array([len(x) for x in self.bytes_of], np.int64)
        self.starts, self.bytes = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.whole = any(SPACE in w.lstrip(SPACE) for w in names)

    def __call__(self, segments: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments, to each of which the model adds a space in front, and how many each has."""
        lists = self.model.encode(segments, num_threads=1) if segments else []
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts


@cache
def _encoders(a: str, b: str) -> tuple[Plain, Pieces]:
    return Plain(a), Pieces(b)


def segments(text: str, whole: bool = False) -> list[str]:
    """What single spaces between other characters part, each without the space before it.

    No pretoken goes across such a space, nor does a piece, as no piece has a space behind another character (or the
    text is ``whole``), so both tokenizers encode a segment by itself as they do within its text.
    """
    if whole or not text:
        return [text] if text else []
    return _SINGLE.split(text) if text[0].isspace() or text[-1].isspace() or _RUN.search(text) else text.split(" ")


def _returned(encoder: Plain | Pieces, ids: np.ndarray, counts: np.ndarray, segments: list[str], sizes: np.ndarray) -> np.ndarray:
    """Which segments their tokens give back byte by byte."""
    made = []
    for begin, end in _stretches(encoder.sizes[ids], LINKS):
        n = encoder.sizes[ids[begin:end]]
        at = np.repeat(encoder.starts[ids[begin:end]] - np.cumsum(n) + n, n)
        made.append(encoder.bytes[at + np.arange(len(at))].tobytes())
    given, upto = b"".join(made), np.append(0, np.cumsum(encoder.sizes[ids]))[np.cumsum(counts)]
    same = np.diff(upto, prepend=0) == sizes
    if same.all() and given == " ".join(["", *segments]).encode():
        return same
    return np.array([given[begin:end] == b" " + x.encode() for begin, end, x in zip([0, *upto.tolist()], upto.tolist(), segments, strict=False)], bool)


def tokens(segments: list[str], a: str, b: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of segments by both tokenizers, how many each has, and which both give back; the others have none."""
    sizes = np.fromiter((len(x if x.isascii() else x.encode()) for x in segments), np.int64, len(segments)) + 1
    made = [(encoder, *encoder(segments, sizes)) for encoder in _encoders(a, b)]
    good = np.logical_and(*(_returned(*x, segments, sizes) for x in made))
    (ids_a, n_a), (ids_b, n_b) = ((ids[np.repeat(good, n)], n * good) for _, ids, n in made)
    return ids_a, n_a, ids_b, n_b, good


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sorted indices of the A tokens that end where a B token does.

    ``begin`` and ``end`` bound the A tokens of each text, all of whose bytes B covers too. An interval looks for a common
    end near its middle, by bisecting B's ends for candidates in rings of doubling width around it; where one is found both
    halves go on, where none is the interval is a leaf. All intervals of a level are worked on at once.
    """
    lo, hi = begin[end > begin], end[end > begin]
    found = [hi - 1]
    ring = np.zeros(len(lo), np.int64)  # candidates up to so far from the middle have been tried
    while len(lo):
        mid = (lo + hi - 2) // 2
        near, far = ring, np.maximum(1, 2 * ring)  # distances tried now: from near, under far
        left_n = np.maximum(0, np.minimum(far, mid - lo + 1) - near)
        right_n = np.maximum(0, np.minimum(far, hi - 1 - mid) - np.maximum(near, 1))
        n = left_n + right_n
        owner = np.repeat(np.arange(len(lo)), n)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        on_left = k < left_n[owner]
        distance = np.where(on_left, near[owner] + k, np.maximum(near, 1)[owner] + k - left_n[owner])
        candidate = mid[owner] + np.where(on_left, -distance, distance)
        at = np.searchsorted(ends_b, ends_a[candidate])  # every text's last end is in both, so this is in range
        good = ends_b[at] == ends_a[candidate]
        best = np.full(len(lo), np.iinfo(np.int64).max)
        np.minimum.at(best, owner[good], 2 * distance[good] + ~on_left[good])
        has = best < np.iinfo(np.int64).max
        cut = mid + np.where(best % 2 == 1, best // 2, -(best // 2))
        found.append(cut[has])
        more = ~has & (np.maximum(mid - lo + 1, hi - 1 - mid) > far)
        lo, hi, ring = (np.concatenate(x) for x in ((lo[has], cut[has] + 1, lo[more]), (cut[has] + 1, hi[has], hi[more]), (np.zeros(2 * int(has.sum()), np.int64), far[more])))
        wide = hi - lo > 1
        lo, hi, ring = lo[wide], hi[wide], ring[wide]
    return np.sort(np.concatenate(found))


def _expand(a: np.ndarray, b: np.ndarray, from_a: np.ndarray, n_a: np.ndarray, from_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group number, A id and B id of every pair of tokens that share a group."""
    n = n_a * n_b
    owner = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return owner, a[from_a[owner] + k // n_b[owner]], b[from_b[owner] + k % n_b[owner]]


class Block:
    """The groups of the texts of one block, whose distinct segments are aligned once.

    A text with a segment that one of the tokenizers doesn't give back is encoded whole, and has no tokens if the
    whole isn't given back either.
    """

    def __init__(self, sources: list[bytes], a: str, b: str):
        of_a, of_b = _encoders(a, b)
        texts = [x.decode() for x in sources]
        known: defaultdict[str, int] = defaultdict(count().__next__)
        codes = [np.fromiter(map(known.__getitem__, x), np.int64, len(x)) for x in (segments(t, of_b.whole) for t in texts)]
        found = tokens(list(known), a, b)
        again = [] if found[-1].all() else [k for k, own in enumerate(codes) if len(own) > 1 and not found[-1][own].all()]
        if again:
            found = tuple(np.concatenate(x) for x in zip(found, tokens([texts[k] for k in again], a, b), strict=True))
            for n, k in enumerate(again):
                codes[k] = np.array([len(known) + n])
        self.a, self.seg_a, self.b, self.seg_b, _ = found
        ends_a, ends_b = np.cumsum(of_a.sizes[self.a]), np.cumsum(of_b.sizes[self.b])
        end_a = np.cumsum(self.seg_a)
        cut_a = shared_cuts(ends_a, ends_b, end_a - self.seg_a, end_a)
        to_a, to_b = cut_a + 1, np.searchsorted(ends_b, ends_a[cut_a]) + 1
        self.from_a, self.from_b = np.append(0, to_a[:-1])[: len(to_a)], np.append(0, to_b[:-1])[: len(to_b)]
        self.size_a, self.size_b = to_a - self.from_a, to_b - self.from_b
        self.segment = np.searchsorted(end_a, cut_a, "right")  # of each group
        self.seg_groups = np.bincount(self.segment, minlength=len(end_a))
        self.codes = np.concatenate([*codes, np.zeros(0, np.int64)])  # segments of all texts
        self.n_codes = np.array([len(x) for x in codes], np.int64)
        self.first = np.cumsum(self.n_codes) - self.n_codes
        self.owner = np.repeat(np.arange(len(sources)), self.n_codes)
        seg_links = np.bincount(self.segment, self.size_a * self.size_b, len(end_a))
        self.n_a, self.n_b, self.n_groups, self.n_links = (
            np.bincount(self.owner, x[self.codes], len(sources)).astype(np.int64) for x in (self.seg_a, self.seg_b, self.seg_groups, seg_links)
        )
        self.keys = np.zeros(0, np.int64)
        self.written: list[str | None] = []

    def links(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, place among ``keys`` of a pair of ids (A's above B's ``bits``) and number of links, once for each pair in each text, sorted."""
        width = max(1, len(self.seg_a))
        key, weight = self._segment_links(bits)
        new = _new(key // width)
        self.keys, place = key[new] // width, np.cumsum(new) - 1
        order = np.argsort(key % width, kind="stable")
        place, weight = place[order], weight[order]
        held = np.bincount(key % width, minlength=width)
        start = np.cumsum(held) - held
        key, times = np.unique(self.owner * width + self.codes, return_counts=True)  # distinct segments of each text
        doc, segment = key // width, key % width
        n = held[segment]
        at = np.repeat(start[segment] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        height = max(1, len(self.keys))
        key, weight = np.repeat(doc, n) * height + place[at], weight[at] * np.repeat(times, n)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(_new(key))
        weight = np.add.reduceat(weight[order], first) if len(first) else weight
        return key[first] // height, key[first] % height, weight

    def _segment_links(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Pair of ids above segment, sorted and once each, and number of links."""
        width = max(1, len(self.seg_a))
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def keep(segment: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray | None = None) -> None:
            key, which, n = np.unique((((a << bits) + b) * width) + segment, return_inverse=True, return_counts=True)
            kept.append((key, n if weight is None else np.bincount(which, weight, len(key)).astype(np.int64)))

        n = self.size_a * self.size_b
        large = n > LINKS // 32
        group = np.flatnonzero(~large)
        bounds = np.searchsorted(np.cumsum(n[group]), np.arange(LINKS, int(n[group].sum()) + LINKS, LINKS), "left") + 1
        for part in np.split(group, np.minimum(bounds, len(group))):
            if len(part):
                owner, a, b = _expand(self.a, self.b, self.from_a[part], self.size_a[part], self.from_b[part], self.size_b[part])
                keep(self.segment[part][owner], a, b)
        for g in np.flatnonzero(large):  # long stretches without a shared end: by distinct ids and how often they come
            ids_a, many_a = np.unique(self.a[self.from_a[g] :][: self.size_a[g]], return_counts=True)
            ids_b, many_b = np.unique(self.b[self.from_b[g] :][: self.size_b[g]], return_counts=True)
            step = max(1, LINKS // len(ids_b))
            for k in range(0, len(ids_a), step):
                rows = len(ids_a[k : k + step])
                keep(np.full(rows * len(ids_b), self.segment[g]), np.repeat(ids_a[k : k + step], len(ids_b)), np.tile(ids_b, rows), np.outer(many_a[k : k + step], many_b).ravel())
        if not kept:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, which = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
        return key, np.bincount(which, np.concatenate([w for _, w in kept]), len(key)).astype(np.int64)

    def listed(self, names_a: np.ndarray, names_b: np.ndarray, k: int) -> Iterator[str]:
        """The groups of text ``k`` as ``a1,a2|b1;a3|b2,b3``, in parts; ``names_*[s, id]`` is an id with separator ``s`` behind it."""
        if not self.written:
            self.written = self._written(names_a, names_b)
        own = self.codes[self.first[k] : self.first[k] + self.n_codes[k]]
        for begin, end in _stretches((self.seg_a + self.seg_b)[own], TOKENS):
            if begin:
                yield ";"
            texts = [self.written[c] for c in own[begin:end].tolist()]
            yield from self._long(names_a, names_b, int(own[begin])) if texts[0] is None else (";".join(texts),)

    def _written(self, names_a: np.ndarray, names_b: np.ndarray) -> list[str | None]:
        """The groups of each segment, but for those of more than TOKENS tokens."""
        out: list[str | None] = []
        last = np.cumsum(self.seg_groups)
        for begin, end in _stretches(self.seg_a + self.seg_b, TOKENS):
            if self.seg_a[begin] + self.seg_b[begin] > TOKENS:
                out.append(None)
                continue
            lines = iter(self._lines(names_a, names_b, int(last[begin] - self.seg_groups[begin]), int(last[end - 1])).split("\n"))
            out += [next(lines) if n else "" for n in self.seg_groups[begin:end].tolist()]
        return out

    def _long(self, names_a: np.ndarray, names_b: np.ndarray, segment: int) -> Iterator[str]:
        first, last = np.searchsorted(self.segment, [segment, segment + 1]).tolist()
        for begin, end in _stretches((self.size_a + self.size_b)[first:last], TOKENS):
            yield self._lines(names_a, names_b, first + begin, first + end).removesuffix("\n")

    def _lines(self, names_a: np.ndarray, names_b: np.ndarray, begin: int, end: int) -> str:
        """Groups from ``begin`` to ``end`` as text; a line ends with its segment."""
        if begin == end:
            return ""
        size_a, size_b = self.size_a[begin:end], self.size_b[begin:end]
        total_a, total_b = np.cumsum(size_a), np.cumsum(size_b)
        from_a, from_b = int(self.from_a[begin]), int(self.from_b[begin])
        mark_a, mark_b = np.zeros(int(total_a[-1]), np.int8), np.zeros(int(total_b[-1]), np.int8)
        mark_a[total_a - 1] = 1
        mark_b[total_b - 1] = 1 + _new(np.append(self.segment, -1)[begin : end + 1])[1:]
        out = np.empty(len(mark_a) + len(mark_b), object)
        out[np.arange(len(mark_a)) + np.repeat(total_b - size_b, size_a)] = names_a[mark_a, self.a[from_a : from_a + len(mark_a)]]
        out[np.arange(len(mark_b)) + np.repeat(total_a, size_b)] = names_b[mark_b, self.b[from_b : from_b + len(mark_b)]]
        return "".join(out.tolist())


def _names(n: int, marks: tuple[str, ...]) -> np.ndarray:
    return np.array([[f"{k}{m}" for k in range(n)] for m in marks], object)


@cache
def _all_names(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    of_a, of_b = _encoders(a, b)
    return _names(len(of_a.bytes_of), (",", "|")), _names(len(of_b.bytes_of), (",", ";", "\n"))


_COUNTS = "n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups array<string>"


def align(docs: DataFrame, a: str, b: str, whole_groups: bool = True) -> DataFrame:
    """Tokens of each text by the byte-level file ``a`` and the piece model ``b``, in groups that no shared end divides.

    A text is encoded by both (a space in front of it), the ends that both share are found by divide and conquer, and
    every pair of an A and a B token of one group is a link. What single spaces part is encoded and aligned once in a
    block of texts, which are put together from such segments. A pair of ids counts in how many documents it is
    linked, over the whole table: blocks send their distinct pairs, already counted, and get the counts back by a join.

    Texts that are null or empty, or that one of the tokenizers doesn't give back byte by byte, have no tokens. Texts
    and groups may be of any length: links of long groups are counted from their distinct ids. Special tokens' strings
    are plain text. Repeated rows are documents of their own; null ids stay; an empty table gives an empty one; columns
    besides doc_id and text are ignored. Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups as text
    (``a1,a2|b1;a3|b2,b3``), or, without ``whole_groups``, their SHA-256 in ``groups_sha256``; empty where no tokens are.
    """

    def make(sources: list[bytes]) -> dict:
        block = Block(sources, a, b)
        bits = int(len(_encoders(a, b)[1].bytes_of)).bit_length()
        doc, code, links = block.links(bits)
        keys = block.keys
        names = _all_names(a, b)
        groups = []
        for k in range(len(sources)):
            parts = block.listed(*names, k)
            if whole_groups:
                groups.append("".join(parts))
            else:
                digest = hashlib.sha256()
                for x in parts:
                    digest.update(x.encode())
                groups.append(digest.hexdigest() if block.n_groups[k] else "")
        counted = {c: pa.array([getattr(block, c)], pa.list_(pa.int64())) for c in ("n_a", "n_b", "n_groups", "n_links")}
        pairs = np.bincount(doc, minlength=len(sources))
        each = pa.StructArray.from_arrays([pa.array(keys, pa.int64()), pa.array(np.bincount(code, minlength=len(keys)), pa.int64())], ["pair", "docs"])
        held = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), each)
        return counted | {"groups": pa.array([groups], pa.list_(pa.string())), "pairs": pa.array([pairs], pa.list_(pa.int64())), "held": held, "codes": pa.array([code.astype(np.int32).tobytes()], pa.binary()), "links": pa.array([links.tobytes()], pa.binary())}

    cut = blocks.write(docs, make, f"{_COUNTS}, pairs array<bigint>, held array<struct<pair: bigint, docs: bigint>>, codes binary, links binary", "aligned", BLOCK)
    bits = int(len(_encoders(a, b)[1].bytes_of)).bit_length()
    counts = cut.select(F.inline("held")).groupBy("pair").agg(F.count(F.lit(1)).alias("copies"), F.sum("docs").alias("count"))
    counts = blocks.util.save(counts.withColumn("a", F.shiftright("pair", bits)), "pair_counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    table = counts.join(most, "a").select("pair", "copies", "count", (F.col("count") == F.col("most")).alias("best"))
    met = blocks.attach(cut.withColumn("keys", F.col("held.pair")).drop("held"), blocks.util.save(table, "pair_table"), "pair")
    out = blocks.per_document(met, _sums, "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string")
    return out if whole_groups else out.withColumnRenamed("groups", "groups_sha256")


def _sums(row: dict) -> dict:
    pairs = row["pairs"].values.to_numpy()
    out = {c: row[c].values for c in ("n_a", "n_b", "n_groups", "n_links")}
    best = total = np.zeros(len(pairs), np.int64)
    if row["found"].values is not None:
        count, is_best = row["found"].values.field("count").to_numpy(), row["found"].values.field("best").to_numpy(zero_copy_only=False)
        code, links, doc = blocks.numbers(row["codes"]), blocks.numbers(row["links"], np.int64), np.repeat(np.arange(len(pairs)), pairs)
        best, total = (np.zeros(len(pairs), np.int64) for _ in range(2))
        np.add.at(best, doc, links * is_best[code])
        np.add.at(total, doc, links * count[code])
    return out | {"n_best": pa.array(best, pa.int64()), "count_sum": pa.array(total, pa.int64()), "groups": row["groups"].values}
