"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import util

#: Rules whose index may stand as a map literal in the plan; more are joined.
LITERAL_RULES = 5_000
_TOKEN = "[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``host/path``: fits the host and all its subdomains if the path starts so. ``*text*``: fits where the text stands."""

    pattern: str
    verdict: str
    listed: bool = True  # reported as the rule; the method's own rules are not

    @property
    def regex(self) -> str:
        if self.pattern.startswith("*"):
            return r"(?s)\A.*" + ".*".join(re.escape(x) for x in self.pattern.strip("*").split("*"))
        host, _, path = self.pattern.partition("/")
        return r"\A(?:[^/?#]*\.)?" + re.escape(host) + (rf"/{re.escape(path)}" if path or "/" in self.pattern else r"(?:/|\z)")

    @property
    def tokens(self) -> list[str]:
        """Tokens that each URL it fits must have in full: those with a delimiter, or the host's edge, on both sides."""
        text = self.pattern if self.pattern.startswith("*") else f" {self.pattern}{'' if '/' in self.pattern else '/'}"
        return sorted(set(re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", text)))


#: The rules of the contract, then the method's own.
RULES = [
    Rule("com/en/", "block"),
    Rule("example.com/en/7", "allow"),
    Rule("net/de/", "allow"),
    Rule("example.net/de/8", "block"),
    Rule("org/es/", "block"),
    Rule("*-pills.*", "block", False),
    Rule("*spam-farm.*", "block", False),
    Rule("*casino-*", "block", False),
]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(address: Column) -> Column:
    """Distinct tokens, and the empty one, which rules without a whole token are kept under."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(address, _TOKEN)))


def index(urls: DataFrame, rules: list[Rule]) -> dict[str, list[Rule]]:
    """Rules by the token that the fewest of all URLs hold; only tokens of rules are counted."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {"": rules} if rules else {}
    counts = urls.select(F.explode(F.array_intersect(tokens_of(F.col("address")), F.array(*map(F.lit, wanted)))).alias("t")).groupBy("t").count()
    seen = {r["t"]: r["count"] for r in counts.collect()}
    out: dict[str, list[Rule]] = {}
    for r in rules:
        out.setdefault(min(r.tokens, key=lambda t: (seen.get(t, 0), t), default=""), []).append(r)
    return out


def _as_rows(spark: SparkSession, by_token: dict[str, list[Rule]]) -> DataFrame:
    rows = [(t, len(r.pattern), r.pattern, r.regex, r.verdict, r.listed) for t, rs in by_token.items() for r in rs]
    return spark.createDataFrame(rows, "token string, size int, pattern string, regex string, verdict string, listed boolean")


def _matched(urls: DataFrame, by_token: dict[str, list[Rule]], literal: bool) -> DataFrame:
    """``urls`` with ``fits``: the candidate rules whose pattern the address matches."""
    kind = "array<struct<size: int, pattern: string, regex: string, verdict: string, listed: boolean>>"
    if literal:
        rule = lambda r: F.struct(F.lit(len(r.pattern)).alias("size"), F.lit(r.pattern).alias("pattern"), F.lit(r.regex).alias("regex"), F.lit(r.verdict).alias("verdict"), F.lit(r.listed).alias("listed"))
        entries = [x for t, rs in by_token.items() for x in (F.lit(t), F.array(*map(rule, rs)))]
        table = F.create_map(*entries)
        keys = F.array(*[F.lit(t) for t in by_token])
        fetched = F.flatten(F.transform(F.array_intersect(tokens_of(F.col("address")), keys), lambda t: F.element_at(table, t)))
        return urls.withColumn("fits", F.filter(fetched, lambda r: F.rlike(F.col("address"), r["regex"])))
    rules = util.small(_as_rows(urls.sparkSession, by_token))  # broadcast: tokens that most URLs hold are no hot keys
    fetched = urls.select("address").distinct().select("address", F.explode(tokens_of(F.col("address"))).alias("token")).join(rules, "token")
    fits = fetched.filter(F.rlike(F.col("address"), F.col("regex"))).groupBy("address").agg(F.collect_list(F.struct("size", "pattern", "regex", "verdict", "listed")).alias("fits"))
    return urls.join(fits, "address", "left").withColumn("fits", F.coalesce("fits", F.array().cast(kind)))


def judge(pages: DataFrame, rules: list[Rule] = RULES, literal_rules: int = LITERAL_RULES) -> DataFrame:
    """The verdict on each page's url; the longest rule that fits wins, and no rule allows.

    Each rule is kept under its rarest whole token, a URL's tokens fetch its candidates, and only those run their
    regular expressions. Up to ``literal_rules`` rules the index stands in the plan and nothing is shuffled; beyond,
    distinct addresses are joined to it. Null urls, and those without ``://``, have empty host and path and are allowed;
    urls may be of any length; of rules of equal length the last by name wins; repeated rows give repeated results, an empty table an empty one; other columns are ignored.
    Returns page_id, host, path, rule, verdict, method_rule.
    """
    if not rules:
        rules = [Rule("*\0*", "allow", False)]
    urls = pages.select("page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
    urls = urls.withColumn("address", F.concat("host", "path"))
    found = _matched(urls, index(urls, rules), len(rules) <= literal_rules)
    best = lambda listed: F.array_max(F.transform(F.filter("fits", lambda r: r["listed"] == listed), lambda r: F.struct(r["size"], r["pattern"], r["verdict"])))
    found = found.withColumn("own", best(True)).withColumn("other", best(False))
    verdict = F.coalesce("own.verdict", "other.verdict", F.lit("allow"))
    return found.select("page_id", "host", "path", F.col("own.pattern").alias("rule"), verdict.alias("verdict"), F.col("other.pattern").alias("method_rule"))
