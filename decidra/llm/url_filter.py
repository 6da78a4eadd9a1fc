"""URL filter: rules of hosts and paths, then an empirical-Bayes reputation of hosts.

The outcomes (bad or not) of labelled pages are counted by host, registered domain and suffix.  Each level's rate is
drawn to the rate of the level above by a beta prior whose weight comes from the spread of the rates (method of
moments), so a host with few labels takes its domain's rate, a domain with few its suffix's.  A host is blocked if the
lower bound of its posterior bad rate is over a limit.

Only DataFrame functions are used.  Counting is done before any shuffle of rows; the three weights are the only
numbers that reach the driver.

Defined results: a null url, or one without ``://``, has an empty host and path; the empty host has a reputation like
any other.  Without labels the prior rate is ``base_rate``.  Null page ids stay null and have no outcome; a page with several labels
has a bad outcome if one of them is bad.  Repeated rows are judged each.  Other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
#: Prior weights are kept within these bounds; standard deviations below the mean; limit of the bad rate.
LEAST_WEIGHT, MOST_WEIGHT, DEVIATIONS, LIMIT = 2.0, 1000.0, 1.645, 0.5


@dataclass(frozen=True)
class Rule:
    """allow or block; ``text`` is the host and the path's beginning."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host, path, domain and suffix of the column ``url``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    parts = pages.withColumns({"host": F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), "path": F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)})
    bare = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    long = two.isin(*SUFFIXES)
    return parts.withColumns({"domain": F.when(long, F.substring_index(bare, ".", -3)).otherwise(two), "suffix": F.when(long, two).otherwise(F.substring_index(bare, ".", -1))})


def rule_of(rules: list[Rule]) -> Column:
    """The longest rule that fits (host, path); null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        out = F.when(((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path), F.lit(r.text)).otherwise(out)
    return out


def weight_of(children: DataFrame) -> float:
    """The prior weight by moments, from (n, bad, rate of the parent)."""
    p, q = F.col("parent"), 1 - F.col("parent")
    sums = children.where("n > 0 and parent > 0 and parent < 1").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - p, 2) / (p * q)).alias("spread"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count("*").alias("k")
    ).first()
    if not sums.k or sums.k < 2 or sums.n == sums.k:
        return MOST_WEIGHT
    rest = sums.n - sums.squares / sums.n - (sums.k - 1)
    rho = (sums.spread - (sums.k - 1)) / rest if rest > 0 else 0.0
    return MOST_WEIGHT if rho <= 1 / (MOST_WEIGHT + 1) else max(LEAST_WEIGHT, 1 / rho - 1)


def reputations(pages: DataFrame, outcomes: DataFrame, base_rate: float = 0.1) -> DataFrame:
    """(host, n, rate, bound) of every host of ``pages`` (page_id, host, domain, suffix); ``outcomes``: page_id, bad (0 or 1)."""
    per_page = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    known = pages.where("page_id is not null").join(per_page, "page_id").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = pages.groupBy("host", "domain", "suffix").agg(F.count("*").alias("pages")).join(known, "host", "left").select("host", "domain", "suffix", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"))
    hosts = written(hosts, "hosts")  # the weights of three levels and the bounds read it
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    rate = total.bad / total.n if total.n else base_rate

    def drawn(rows: DataFrame) -> tuple[DataFrame, float]:
        weight = weight_of(rows)
        return rows.withColumn("rate", (F.col("bad") + weight * F.col("parent")) / (F.col("n") + weight)), weight

    suffixes, _ = drawn(suffixes.withColumn("parent", F.lit(rate)))
    domains, _ = drawn(domains.join(suffixes.select("suffix", F.col("rate").alias("parent")), "suffix"))
    hosts, weight = drawn(hosts.join(domains.select("domain", "suffix", F.col("rate").alias("parent")), ["domain", "suffix"]))
    size = F.col("n") + weight
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (size + 1))
    return hosts.select("host", "n", "rate", (F.col("rate") - DEVIATIONS * deviation).alias("bound"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], limit: float = LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, bound) of every row of ``pages`` (page_id, url)."""
    parts = with_parts(pages.select("page_id", "url"))
    bounds = reputations(parts.select("page_id", "host", "domain", "suffix"), outcomes)
    verdicts = F.create_map(*(F.lit(x) for r in rules for x in (r.text, r.verdict))) if rules else F.create_map().cast("map<string,string>")
    joined = parts.select("page_id", "host", "path", rule_of(rules).alias("rule")).join(bounds, "host", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce(F.get(F.map_values(F.map_filter(verdicts, lambda k, _: k == F.col("rule"))), F.lit(0)), F.when(F.col("bound") > limit, "block").otherwise("allow")).alias("verdict"), "bound")
