"""LM scoring by masked pseudo-likelihood of a bidirectional window network, trained in numpy on every token."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, isqrt, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text, util

#: Words that tasks know by heart (14 bytes each) at least, and how many times the square root of all distinct words more
#: of them a large corpus has; the counts of all rarer ones are joined.
LISTED, LISTED_ROOT = 1 << 18, 128
#: The same for words that the network tells apart (132 bytes each), how often one must occur, and words in a group at least.
OWN, OWN_ROOT, OWN_LEAST, GROUP = 4_096, 2, 8, 64
WINDOW, HIDDEN, BATCH, RATE = 2, 16, 4_096, 0.2
_PLACES = [k for k in range(-WINDOW, WINDOW + 1) if k]
#: Bins of word counts per doubling; the sum of all counts is under 2**63, so there are at most 63 times as many.
BINS = 64


@dataclass
class Vocabulary:
    """Classes of all words, and of those listed also their places.

    P(word) = P(class | both sides) x P(word | class). The most frequent words stand in groups of equal size, by rank,
    and the network predicts the word within the group from both sides too. All others stand in bands of like counts,
    words that are not listed in the last, and have their share of their band's counts. So the probabilities of all
    words of the corpus sum to one.
    """

    keys: np.ndarray  # sorted hashes of the listed words
    cls: np.ndarray  # class of each
    slot: np.ndarray  # place in its group
    context: np.ndarray  # id as a neighbour: rank of words told apart, then bands; signed, in as few bytes as ``edge`` needs
    within: np.ndarray  # log P(word | class) in bands; 0 in groups
    groups: int
    classes: int
    own: int
    size: int  # words in a group: as many as there are groups, or GROUP
    prior: np.ndarray  # log P(class)
    shares: np.ndarray  # log P(word | group), a row for each group
    rest: float  # tokens of words that are not listed

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, rest: float, apart: int = OWN) -> Vocabulary:
        """``apart``: how many words at most are told apart."""
        order = np.lexsort((keys, -counts))
        own = min(apart, int((counts >= OWN_LEAST).sum()))
        size = max(GROUP, ceil(sqrt(own)))
        groups = -(-own // size)
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        band = np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)
        names = np.unique(band[rank >= own])
        kind = np.where(rank < own, rank // size, groups + np.searchsorted(names, band))
        classes = groups + len(names) + 1
        total = np.bincount(kind, counts, classes)
        total[-1] = rest
        within = np.where(rank < own, 0.0, np.log(np.maximum(counts, 1) / np.maximum(total[kind], 1)))
        shares = np.full((max(groups, 1), size), -30.0)
        shares.reshape(-1)[:own] = np.log(counts[order[:own]] / total[np.arange(own) // size])
        smoothed = total + 0.5
        context = np.where(rank < own, rank, own + kind - groups)
        kinds = kind.astype(np.int16), (rank % size).astype(np.int16), context.astype(np.min_scalar_type(-int(own + classes - groups) - 1)), within.astype(np.float32)
        return cls(keys, *kinds, groups, classes, own, size, np.log(smoothed / smoothed.sum()).astype(np.float32), shares.astype(np.float32), rest)

    @property
    def edge(self) -> int:
        """The id of what lies outside of the document."""
        return self.own + self.classes - self.groups

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Class, slot, context id, log P(word | class) and whether it is listed, for each word."""
        if not len(self.keys):
            return np.full(len(hashes), self.classes - 1, np.int16), np.zeros(len(hashes), np.int16), np.full(len(hashes), self.edge - 1, self.context.dtype), np.zeros(len(hashes), np.float32), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        known = self.keys[at] == hashes
        every = [x[at] for x in (self.cls, self.slot, self.context, self.within)]
        for x, v in zip(every, (self.classes - 1, 0, self.edge - 1, 0), strict=True):
            x[~known] = v
        return *every, known


def _log_softmax(scores: np.ndarray) -> np.ndarray:
    scores -= scores.max(1, keepdims=True)
    scores -= np.log(np.exp(scores).sum(1, keepdims=True))
    return scores


def _tame(weights: np.ndarray, biases: np.ndarray) -> bool:
    """Whether exponentials of scores neither overflow nor vanish in any row: what weights ``(words, HIDDEN)`` multiply lies within -1 and 1."""
    reach = np.abs(weights) @ np.ones(weights.shape[-1], weights.dtype)
    return bool((biases + reach).max() < 80 and (biases - reach).max(-1).min() > -80)


def _exps(scores: np.ndarray, tame: bool) -> np.ndarray:
    """Sum of each row's exponentials, which take the place of ``scores``, and of a row's largest score taken off unless they are ``tame``."""
    if not tame:
        scores -= scores.max(1, keepdims=True)
    np.exp(scores, out=scores)
    return scores @ np.ones(scores.shape[1], scores.dtype)  # quicker than a sum by row


def _miss(scores: np.ndarray, at: np.ndarray, tame: bool) -> np.ndarray:
    """Softmax of each row less 1 at its own place, in place."""
    total = _exps(scores, tame)
    scores /= total[:, None]
    scores[np.arange(len(at)), at] -= 1
    return scores


def _log_at(scores: np.ndarray, at: np.ndarray, tame: bool) -> np.ndarray:
    """Log softmax of each row at its own place; ``scores`` are used up."""
    if not tame:
        scores -= scores.max(1, keepdims=True)
    own = scores[np.arange(len(at)), at]
    return own - np.log(_exps(scores, True))


@dataclass
class Network:
    """Embeddings of the words around are turned by their place, summed and squashed; one layer predicts the class, one the word in its group."""

    parts: list[np.ndarray]  # embeddings, turns by place, class weights and biases, word weights and biases

    @staticmethod
    def shapes(v: Vocabulary) -> list[tuple[int, ...]]:
        groups = max(v.groups, 1)
        return [(v.edge + 1, HIDDEN), (len(_PLACES), HIDDEN, HIDDEN), (HIDDEN, v.classes), (v.classes,), (groups, v.size, HIDDEN), (groups, v.size)]

    @classmethod
    def fresh(cls, v: Vocabulary) -> Network:
        """Before training it predicts the words' frequencies from any context."""
        rng = np.random.default_rng(11)
        parts = [rng.normal(0, s, shape).astype(np.float32) for s, shape in zip((0.3, 0.3, 0.01, 0, 0.01, 0), cls.shapes(v), strict=True)]
        parts[3] = v.prior.copy()
        parts[5] = v.shares.copy()
        return cls(parts)

    @classmethod
    def flat(cls, v: Vocabulary, values: np.ndarray) -> Network:
        shapes = cls.shapes(v)
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        return cls([x.reshape(s).astype(np.float32) for x, s in zip(np.split(values, ends[:-1]), shapes, strict=True)])

    def around(self, sides: np.ndarray) -> np.ndarray:
        """The embeddings of the words around each word, side by side."""
        return self.parts[0].take(sides.T, axis=0).reshape(sides.shape[1], -1)

    def hidden(self, sides: np.ndarray) -> np.ndarray:
        return np.tanh(self.around(sides) @ self.parts[1].reshape(-1, HIDDEN))

    def classes(self, hidden: np.ndarray) -> np.ndarray:
        """log P of each class."""
        return _log_softmax(hidden @ self.parts[2] + self.parts[3])

    def words(self, hidden: np.ndarray, g: int) -> np.ndarray:
        """log P of each word of a group."""
        return _log_softmax(hidden @ self.parts[4][g].T + self.parts[5][g])

    def _by_group(self, kind: np.ndarray, groups: int) -> tuple[np.ndarray, list[tuple[int, int, int]], int]:
        """The rows' order by class, where each group that has rows begins and ends there, and where the last one ends."""
        order = np.argsort(kind, kind="stable")
        ends = np.searchsorted(kind[order], np.arange(groups + 1)).tolist()
        return order, [(g, a, b) for g, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if a < b], ends[-1]

    def _of_classes(self, hidden: np.ndarray) -> tuple[np.ndarray, bool]:
        """Scores of the classes, and whether they are tame."""
        return hidden @ self.parts[2] + self.parts[3], _tame(self.parts[2].T, self.parts[3])

    def _in_groups(self, hidden: np.ndarray, kind: np.ndarray, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, bool]:
        """Scores of the words of each row's group, for rows in the order of their groups, and whether they are tame."""
        scores = np.empty((len(hidden), self.parts[5].shape[1]), hidden.dtype)
        for g, a, b in spans:
            np.matmul(hidden[a:b], self.parts[4][g].T, out=scores[a:b])
        scores += self.parts[5].take(kind, axis=0)
        return scores, _tame(self.parts[4], self.parts[5])

    def log_p(self, sides: np.ndarray, kind: np.ndarray, slot: np.ndarray, groups: int) -> np.ndarray:
        """log P(class) + log P(word | group) of each row's own word."""
        order, spans, m = self._by_group(kind, groups)
        kind = kind[order]
        hidden = self.hidden(sides[:, order])
        scores, tame = self._of_classes(hidden)
        logs = _log_at(scores, kind, tame)
        scores, tame = self._in_groups(hidden[:m], kind[:m], spans)
        logs[:m] += _log_at(scores, slot[order[:m]], tame)
        out = np.empty_like(logs)
        out[order] = logs
        return out

    def learn(self, sides: np.ndarray, kind: np.ndarray, slot: np.ndarray, groups: int, squares: list[np.ndarray]) -> None:
        """One Adagrad step on the mean cross entropy of a batch; words that stand beside none of its words stay as they are."""
        table, turns, out, _, words, _ = self.parts
        n = len(kind)
        order, spans, m = self._by_group(kind, groups)
        kind, slot, sides = kind[order], slot[order[:m]], sides[:, order]
        around, turn = self.around(sides), turns.reshape(-1, HIDDEN)
        hidden = np.tanh(around @ turn)
        scores, tame = self._of_classes(hidden)
        off = _miss(scores, kind, tame)
        back = off @ out.T
        by_word, by_slot = np.zeros_like(words), np.zeros_like(self.parts[5])
        one = np.ones(n, hidden.dtype)
        if m:
            scores, tame = self._in_groups(hidden[:m], kind[:m], spans)
            miss = _miss(scores, slot, tame)
            for g, a, b in spans:
                np.matmul(miss[a:b].T, hidden[a:b], out=by_word[g])
                np.matmul(one[a:b], miss[a:b], out=by_slot[g])
                back[a:b] += miss[a:b] @ words[g]
        back *= 1 - hidden * hidden
        ids = sides.T.ravel()
        place = np.argsort(ids, kind="stable")
        ids = ids[place]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        pulls = np.add.reduceat((back @ turn.T).reshape(-1, HIDDEN).take(place, axis=0), first, axis=0)
        grads = (around.T @ back).reshape(turns.shape), hidden.T @ off, one @ off, by_word, by_slot
        for p, g, s in zip(self.parts[1:], grads, squares[1:], strict=True):
            g /= n
            s += g * g
            p -= RATE * g / (np.sqrt(s) + 1e-7)
        pulls /= n
        met = ids[first]
        squares[0][met] += pulls * pulls
        table[met] -= RATE * pulls / (np.sqrt(squares[0][met]) + 1e-7)


@dataclass
class Model:
    vocabulary: Vocabulary
    network: Network
    words: DataFrame  # (h, n): all words of the corpus, by hash, and how often they occur


def hashed(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, first word of each row with an end) for stretches of rows."""
    for i, _, data, offsets in text.chunks(col, 1 << 20):
        starts, ends, at = text.word_spans(data, offsets)
        yield i, text.word_hashes(data, starts, ends).view(np.int64), at


def sides_of(context: np.ndarray, at: np.ndarray, edge: int) -> np.ndarray:
    """Context ids before and after each word; ``edge`` stands for what lies outside its document."""
    n = len(context)
    out = np.full((len(_PLACES), n), edge, context.dtype)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for row, k in zip(out, _PLACES, strict=True):
        a, b = (slice(-k, None), slice(None, k)) if k < 0 else (slice(None, -k), slice(k, None))
        if abs(k) < n:
            row[a] = np.where(doc[a] == doc[b], context[b], edge)
    return out


def count(docs: DataFrame) -> DataFrame:
    """(h, n): every word of all documents and how often it occurs, counted within tasks before they are shuffled."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [h for _, h, _ in hashed(batch.column(0))]
            words, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], ["h", "n"])

    return docs.select("text").mapInArrow(tally, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def grown(least: int, root: int, words: int) -> int:
    """``least``, or ``root`` times the square root of the corpus's distinct words where that is more."""
    return max(least, root * isqrt(words))


def vocabulary(words: DataFrame, listed: int | None = None) -> Vocabulary:
    """The most frequent words, at most ``listed`` (by default what ``grown`` gives): whole bins of counts, from the top."""
    binned = words.withColumn("_bin", F.floor(F.log2("n") * BINS))
    bins = sorted(((r["_bin"], r["w"], r["t"]) for r in binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("w"), F.sum("n").alias("t")).collect()), reverse=True)
    distinct = sum(w for _, w, _ in bins)
    listed = grown(LISTED, LISTED_ROOT, distinct) if listed is None else listed
    known, least, rest = 0, 1 << 20, 0
    for b, w, t in bins:
        if not rest and known + w <= listed:
            known, least = known + w, b
        else:
            rest += t
    rows = binned.filter(F.col("_bin") >= least).select("h", "n").toPandas().sort_values("h")
    return Vocabulary.of(rows["h"].to_numpy(np.int64), rows["n"].to_numpy(np.float64), float(rest), grown(OWN, OWN_ROOT, distinct))


def train(docs: DataFrame, v: Vocabulary) -> Network:
    """One pass over every token: each task trains a copy on its documents, and copies are averaged by their tokens.

    What is shuffled is one copy of the parameters for each task, so it grows with the input; the driver gets their
    average alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        net = Network.fresh(v)
        squares = [np.full_like(p, 1e-4) for p in net.parts]
        n = 0
        for batch in batches:
            for _, hashes, at in hashed(batch.column(0)):
                kind, slot, context, _, _ = v.look(hashes)
                sides = sides_of(context, at, v.edge)
                for k in range(0, len(hashes), BATCH):
                    some = slice(k, k + BATCH)
                    net.learn(sides[:, some], kind[some], slot[some], v.groups, squares)
                n += len(hashes)
        if n:
            values = np.concatenate([p.ravel() for p in net.parts]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(values)), pa.int32()), pa.array(np.concatenate([[1.0], values]) * n)], ["i", "x"])

    got = docs.select("text").mapInArrow(learn, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")
    if not len(got):
        return Network.fresh(v)
    x = got["x"].to_numpy()
    return Network.flat(v, x[1:] / x[0])


def fit(docs: DataFrame, listed: int | None = None) -> Model:
    """Counts of all words and a network trained on all tokens."""
    words = util.save(count(docs), "words")
    v = vocabulary(words, listed)
    return Model(v, train(docs, v), words)


def apply(model: Model, docs: DataFrame) -> DataFrame:
    """Sum and mean of log P(token | the two words before and the two after it) over all tokens of each document."""
    shared = docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.network))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, net = shared.value
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            rare: list[np.ndarray] = []
            for first, hashes, at in hashed(batch.column(3)):
                kind, slot, context, within, known = v.look(hashes)
                sides = sides_of(context, at, v.edge)
                logs = within.astype(np.float64)
                for k in range(0, len(hashes), BATCH):
                    some = slice(k, k + BATCH)
                    logs[some] += net.log_p(sides[:, some], kind[some], slot[some], v.groups)
                sums = np.concatenate([[0.0], np.cumsum(logs)])
                rows = slice(first, first + len(at) - 1)
                n[rows], total[rows] = np.diff(at), sums[at[1:]] - sums[at[:-1]]
                rare += [hashes[a:b][~known[a:b]] for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array(total), pa.array(rare, pa.list_(pa.int64()))], ["doc_id", "_k1", "_k2", "n_tokens", "_known", "_rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = util.row_key(docs.select("doc_id", "text")).select("doc_id", "_k1", "_k2", "text")
    judged = util.save(keyed.mapInArrow(judge, f"doc_id {kind}, _k1 bigint, _k2 bigint, n_tokens bigint, _known double, _rare array<bigint>"), "judged")
    # words that are not listed are none of the frequent ones, so none is a hot key; one that the corpus lacks counts as half
    rare = judged.filter(F.size("_rare") > 0).dropDuplicates(["_k1", "_k2"]).select("_k1", "_k2", F.explode("_rare").alias("h"))
    share = F.log(F.coalesce(F.col("n"), F.lit(0.5)) / max(model.vocabulary.rest, 1.0))
    more = rare.join(model.words, "h", "left").groupBy("_k1", "_k2").agg(F.sum(share).alias("_more"))
    pll = F.col("_known") + F.coalesce("_more", F.lit(0.0))
    out = judged.drop("_rare").join(more, ["_k1", "_k2"], "left")
    return out.select("doc_id", "n_tokens", pll.alias("pll"), F.when(F.col("n_tokens") > 0, pll / F.col("n_tokens")).alias("mean_pll"))


def score(docs: DataFrame, listed: int | None = None) -> DataFrame:
    """Sum and mean over all tokens of log P(token | the two words before and the two after it).

    Word counts, the words that are told apart and the network grow with the corpus and come from all documents. Null, empty and wordless texts
    have no tokens: a sum of 0 and a null mean. Texts are taken whole, however long; words of equal counts rank by hash;
    repeated rows are scored each for itself, alike up to
    rounding; an empty table gives an empty result; columns besides doc_id
    and text are ignored. Each task trains its own copy, so scores depend a little on how the table is split.
    Returns doc_id, n_tokens, pll, mean_pll.
    """
    return apply(fit(docs, listed), docs)
