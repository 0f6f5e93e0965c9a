"""Secret scans with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import util

#: The base kinds' patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LEAST = 18
HEX = r"[0-9a-f]{16,}"
#: Weak candidates, which count only beside a part that complements them.
KEY = r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"
ENDPOINT = r"""https?://[^\s"'<>]+|(?<![a-z0-9.-])[a-z0-9.-]++(?<=\.(?:amazonaws\.com|internal))(?![A-Za-z0-9_])"""
IDENT = r"""(?<![A-Z0-9])(?:ASIA|AIDA|AROA|AGPA|ANPA)[A-Z0-9]{12,}|(?i:(?:client|account|access_?key)_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._-]{6,}"""
#: ``short`` is an assignment whose value is too short for the base kind.
KINDS = ["assign", "access", "hex", "key", "endpoint", "ident", "short"]
#: What a kind is in a credential; hex runs are as often checksums and complement nothing.
ROLES = {"assign": "secret", "access": "identifier", "key": "secret", "endpoint": "endpoint", "ident": "identifier", "short": "secret"}
#: Array entries that one step of a running sum copies at most.
STRETCH = 128
SPAN = "struct<start: bigint, ord: int, end: bigint>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where ``use`` names it inside other functions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each entry of an array of bigint the sum, or maximum, of those before it (0 for the first).

    An array grows by copying, so stretches are summed first and then each from its own start: the work for n entries is
    n x (STRETCH + n / STRETCH**2), not n x n.
    """
    zero = F.lit(0).cast("bigint")
    empty = F.array().cast("array<bigint>")

    def before(some: Column, start: Column) -> Column:
        grow = lambda a, v: F.struct(step(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(some, F.struct(start.alias("at"), empty.alias("out")), grow)["out"]

    def over(v: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STRETCH).cast("int")), lambda k: F.slice(v, k * STRETCH + 1, STRETCH))
        totals = F.transform(many, lambda c: F.aggregate(c, zero, step))
        return F.when(F.size(v) > 0, F.flatten(F.zip_with(many, before(totals, zero), before))).otherwise(empty)

    return _let(values, over)


def spans(text: Column, pattern: str, kind: str, keep: Column | None = None) -> Column:
    """Spans of all leftmost non-overlapping matches, in code points.

    Splitting at the pattern gives the stretches between matches, so a match begins at the summed lengths before it.
    ``keep`` is an array of booleans, one per match.
    """
    size = lambda x: F.char_length(x).cast("bigint")
    gaps = F.transform(F.split(text, pattern, -1), size)
    lens = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), size)
    span = lambda s: F.struct((s["at"] + s["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("ord"), (s["at"] + s["gap"] + s["len"]).alias("end"))

    def placed(m: Column) -> Column:
        gap = F.slice(m["gap"], F.lit(1), F.size(m["len"]))
        before = running(F.zip_with(gap, m["len"], lambda g, n: g + n), lambda a, v: a + v)
        every = F.arrays_zip(before.alias("at"), gap.alias("gap"), m["len"].alias("len"), m["keep"].alias("keep"))
        return F.transform(F.filter(every, lambda s: s["keep"]), span)

    always = F.transform(lens, lambda _: F.lit(True))
    return _let(F.struct(gaps.alias("gap"), lens.alias("len"), (always if keep is None else keep).alias("keep")), placed)


def _only(condition: Column, found: Column) -> Column:
    return F.when(condition, found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _listed(found: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["ord"] + 1)
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _role(ordinal: Column) -> Column:
    return F.element_at(F.array(*[F.lit(ROLES.get(k)) for k in KINDS]), ordinal + 1)


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """Weak parts with another part within ``scope`` characters that complements them: an interval join on buckets as wide.

    Two parts complement each other if their roles differ and one of them is a secret.
    """
    bucket = lambda c: F.floor(F.col(c) / scope)
    weak = parts.select("_k1", "_k2", F.explode("weak").alias("w")).withColumn("_bucket", bucket("w.start"))
    other = F.explode(F.concat("assign", "access", "weak"))
    every = parts.select("_k1", "_k2", other.alias("p")).withColumn("_bucket", F.explode(F.array(*[bucket("p.start") + k for k in (-1, 0, 1)])))
    near = F.abs(F.col("w.start") - F.col("p.start")) <= scope
    apart = (F.col("w.end") <= F.col("p.start")) | (F.col("p.end") <= F.col("w.start"))
    mine, its = _role(F.col("w.ord")), _role(F.col("p.ord"))
    met = weak.join(every, ["_k1", "_k2", "_bucket"]).filter(near & apart & (mine != its) & ((mine == "secret") | (its == "secret")))
    return met.groupBy("_k1", "_k2").agg(F.collect_set("w").alias("linked"))


def _found(keyed: DataFrame, scope: int) -> DataFrame:
    """doc_id, row key, base spans by kind and ``linked``, the weak candidates that have their complement (null: none)."""
    t = F.col("text")
    value = F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), F.char_length)
    value_long = F.transform(value, lambda n: n >= ASSIGN_LEAST)
    id_long = F.transform(F.regexp_extract_all(t, F.lit(ACCESS), F.lit(0)), lambda v: F.char_length(v) >= ACCESS_LEAST)
    based = keyed.select(
        "doc_id", "_k1", "_k2", "text",
        _only(t.rlike(ASSIGN[:-2] + f"{{{ASSIGN_LEAST},}})"), spans(t, ASSIGN, "assign", value_long)).alias("assign"),
        _only(t.rlike(ACCESS[:-1] + f"{{{ACCESS_LEAST - 4}}}"), spans(t, ACCESS, "access", id_long)).alias("access"),
        _only(t.rlike(HEX), spans(t, HEX, "hex")).alias("hex"),
    )
    short = _only(t.rlike(ASSIGN), spans(t, ASSIGN, "short", F.transform(value, lambda n: n < ASSIGN_LEAST)))
    # without a secret nothing complements anything
    secret = (F.size("assign") > 0) | t.rlike(KEY) | t.rlike(ASSIGN)
    weak = _only(secret, F.concat(*[_only(t.rlike(p), spans(t, p, k)) for k, p in (("key", KEY), ("endpoint", ENDPOINT), ("ident", IDENT))], short))
    found = util.save(based.select("doc_id", "_k1", "_k2", "assign", "access", "hex", weak.alias("weak")), "spans")
    linked = _linked(found.filter(F.size("weak") > 0).dropDuplicates(["_k1", "_k2"]), scope)
    return found.join(linked, ["_k1", "_k2"], "left")


def _every() -> Column:
    return F.array_sort(F.concat("assign", "access", "hex", F.coalesce("linked", F.array().cast(f"array<{SPAN}>"))))


def scan(docs: DataFrame, scope: int = 300) -> DataFrame:
    """Spans of secrets in every whole text.

    Assignments, access identifiers and hex runs count by themselves. Weak candidates are parts of a credential: secrets
    (a 40-character key, an assignment of a short value), identifiers and endpoints. One is reported only where a part of
    another role, a secret among the two, begins within ``scope`` characters of it: an endpoint beside an identifier
    alone is not, nor is a key that stands alone.

    Null texts count as empty and have no spans; texts are taken whole, however long and with however many matches;
    spans that begin together are listed in the order of KINDS; repeated rows give repeated results, an empty table an
    empty one; other columns are ignored. Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans.
    """
    both = _found(util.row_key(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))), scope)
    base = F.array_sort(F.concat("assign", "access", "hex"))
    n = lambda c: F.size(c).cast("bigint").alias(f"n_{c}")
    return both.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(_every()).alias("spans"))


def mask(docs: DataFrame, scope: int = 300) -> DataFrame:
    """``docs`` with each union of overlapping spans replaced by ``<kind>`` of its first span; null texts stay null."""
    keyed = util.row_key(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    both = _found(keyed, scope).select("_k1", "_k2", _every().alias("_spans"))
    some = util.save(both.filter(F.size("_spans") > 0).dropDuplicates(["_k1", "_k2"]), "masked")
    text = F.coalesce(F.col("text"), F.lit(""))

    ends = F.transform("_spans", lambda s: s["end"])
    before = running(ends, lambda a, v: F.greatest(a, v))
    kind = lambda s: F.element_at(F.array(*[F.lit(f"<{k}>") for k in KINDS]), s["ord"] + 1)
    gap = lambda s, at: F.substring(text, at.cast("int") + 1, (s["start"] - at).cast("int"))
    pieces = F.zip_with("_spans", before, lambda s, at: F.when(s["start"] >= at, F.concat(gap(s, at), kind(s))).otherwise(""))
    masked = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), F.substring(text, F.array_max(ends).cast("int") + 1, F.char_length(text))))
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text", F.coalesce("text", F.lit("")).alias("_t"))
    joined = util.row_key(rows, "_t").join(util.small(some), ["_k1", "_k2"], "left")
    return joined.select(*[masked.alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])
