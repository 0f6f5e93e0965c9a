"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import util

#: What separates words, before and after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Tokens that may stand as a literal set in the plan; more are joined.
LITERAL_TOKENS = 20_000
#: Windows whose index may be broadcast; more are joined with salted tokens.
BROADCAST_WINDOWS = 100_000


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def words(c: Column) -> Column:
    """The words of a text, letters as they are written."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SEPARATORS), lambda w: w != "")


def windows_of(benchmark: DataFrame, size: int) -> DataFrame:
    """(window: array of words, ids: the items that hold it) for all distinct windows."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), words(ascii_lower(F.col("text"))).alias("w"))
    n = F.size("w")
    every = F.when(n > size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.slice("w", i, size))).when(n > 0, F.array("w"))
    return items.select("id", F.explode(every).alias("window")).groupBy("window").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def _literal(tokens: DataFrame) -> list[str] | None:
    found = [r[0] for r in tokens.limit(LITERAL_TOKENS + 1).collect()]
    return found if len(found) <= LITERAL_TOKENS else None


def _counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """How often each benchmark word stands in all documents; ``token`` is lower-cased in full, as candidates are found so."""
    known = _literal(vocabulary)
    all_words = F.transform(words(F.col("text")), F.lower)
    if known is not None:
        seen = docs.select(F.explode(F.filter(all_words, lambda w: w.isin(known) if known else F.lit(False))).alias("token"))
    else:
        seen = docs.select(F.explode(all_words).alias("token")).join(vocabulary, "token", "left_semi")
    return seen.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _index(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Each window with the token it is found by: its rarest word in the documents, how often they hold it, and its place.

    Windows with a word that no document holds are left out.
    """
    known = util.save(windows.withColumn("_window", F.monotonically_increasing_id()), "windows")
    tokens = util.save(known.select("_window", F.posexplode(F.transform("window", F.lower)).alias("place", "token")), "tokens")
    vocabulary = util.save(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_copies")), "vocabulary")
    seen = vocabulary.join(_counts(docs, vocabulary.select("token")), "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    met = util.attach(tokens, util.save(seen, "seen"), ["token"], "_copies", tokens.count(), F.col("_window"))
    rarest = met.groupBy("_window").agg(F.min(F.struct("n", "token", "place")).alias("r")).filter("r.n > 0")
    return known.join(rarest, "_window").select("window", "ids", "r.token", "r.place", F.col("r.n").alias("_places"))


def _candidates(docs: DataFrame, index: DataFrame, size: int) -> DataFrame:
    """Per document its number of words and the places of prefix tokens, each with as many words around as a window can reach."""
    tokens = index.select("token").distinct()
    known = _literal(tokens)
    keyed = util.row_key(docs.select("doc_id", "text"))
    split = keyed.select("doc_id", "_k1", "_k2", words(F.col("text")).alias("w"))
    if known is not None:
        hit = F.transform("w", lambda w, i: F.when(F.lower(w).isin(known) if known else F.lit(False), i))
        placed = split.withColumn("at", F.filter(hit, lambda i: i.isNotNull()))
    else:
        every = split.dropDuplicates(["_k1", "_k2"]).select("_k1", "_k2", F.posexplode(F.transform("w", F.lower)).alias("at", "token"))
        at = every.join(tokens, "token", "left_semi").groupBy("_k1", "_k2").agg(F.collect_set("at").alias("at"))
        placed = split.join(at, ["_k1", "_k2"], "left")
    around = F.transform(
        "at", lambda i: F.struct(i.alias("at"), F.least(i, F.lit(size - 1)).alias("lead"), F.slice("w", F.greatest(i - size + 1, F.lit(0)) + 1, 2 * size - 1).alias("near"))
    )
    return placed.select("doc_id", "_k1", "_k2", F.size("w").cast("bigint").alias("n_words"), around.alias("candidates"))


def _covered(spans: Column) -> Column:
    """Words in the union of spans sorted by start."""
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], s["start"] + s["len"]).alias("end")
    )
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"].cast("bigint")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, keys: bool = False) -> DataFrame:
    """Per document the benchmark windows it holds.

    A window is ``size`` consecutive item words (all words of a shorter item). A document can hold a window only if it
    holds the window's rarest word, so only places of those words are joined; bounds on length and position then the
    words themselves decide. A document is contaminated if hit words are at least one in ``share`` of its words.

    Null and empty texts have no words and no hits, nor has any text where either table is empty; a null item id is not
    listed. Texts are taken whole, however long; of equally rare words the first by name finds the window. Repeated rows
    and items give repeated results and the same windows. Other columns are ignored. Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and with ``keys`` first the row key.
    """
    index = util.save(_index(docs, windows_of(benchmark, size)), "index")
    found = util.save(_candidates(docs, index, size), "candidates")
    places = found.select("_k1", "_k2", F.explode("candidates").alias("c")).select("_k1", "_k2", "c.*")
    places = places.withColumn("token", F.lower(F.element_at("near", F.col("lead") + 1)))
    first = F.col("lead") - F.col("place")
    bounds = (first >= 0) & (first + F.size("window") <= F.size("near"))
    same = F.transform(F.slice("near", F.greatest(first, F.lit(0)) + 1, F.size("window")), ascii_lower) == F.col("window")
    if index.count() <= BROADCAST_WINDOWS:
        met = places.join(F.broadcast(index), "token")
    else:
        met = util.attach(places, index, ["token"], "_places", places.count(), F.xxhash64("_k1", "at"))
    hits = met.filter(bounds & same)
    span = F.struct((F.col("at") - F.col("place")).alias("start"), F.size("window").alias("len"))
    per_doc = hits.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"))
    out = found.drop("candidates").join(per_doc, ["_k1", "_k2"], "left")
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        *(["_k1", "_k2"] if keys else []), "doc_id", "n_words", n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated; see ``contamination``."""
    judged = contamination(docs, benchmark, size, share, keys=True).filter("contaminated").select("_k1", "_k2").distinct()
    rows = util.row_key(docs.select(F.struct("*").alias("_row"), "doc_id", "text"))
    return rows.join(util.small(util.save(judged, "contaminated")), ["_k1", "_k2"], "left_anti").select("_row.*")
