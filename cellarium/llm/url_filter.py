"""URL filter: allow and block rules, then logistic regression on hashed character n-grams of host and path.

DataFrame operations only. Rules decide first (the longest that fits a url wins); the trained classifier judges the
rest. Training is full-batch gradient descent: each step is one grouped sum over the exploded n-grams of the labelled
urls, and only the gradient (BUCKETS numbers) comes back to the driver, however many urls are labelled.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the
intercept alone; long urls are read whole; repeated rows are judged each; an empty table gives an empty result; an
unlabelled training table (empty, or with null labels) leaves weights at zero, which allows everything.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm.common import table

BUCKETS, GRAMS = 2048, (3, 4)
STEPS, RATE, DECAY = 25, 12.0, 1e-4
THRESHOLD = 0.5


class Rule(NamedTuple):
    """A host suffix with a path start, as in ``example.com/en/7``, and what it decides (allow or block)."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


RULES = (
    Rule("com/en/", "block"), Rule("example.com/en/7", "allow"), Rule("net/de/", "allow"),
    Rule("example.net/de/8", "block"), Rule("org/es/", "block"),
)

#: Words and endings of the small labelled table, which is made of them by labelled(): of blocked urls, and of others.
BLOCKED_WORDS = "casino bonus jackpot slots poker bets viagra pills pharma xxx porn adult cams loan payday casino torrent crack warez keygen replica singles escort backlinks".split()
BLOCKED_ENDS = "win top click biz loan download shop date casino xyz".split()
NEUTRAL_WORDS = "news library research garden weather museum recipes history travel school science sports music language nature health kitchen market city people review guide article docs".split()
NEUTRAL_ENDS = "org com net edu gov info fr de es co.uk".split()
#: Urls of each label.
LABELLED_URLS = 240


def labelled() -> Iterator[tuple[str, int]]:
    """url, blocked (1 or 0) of the labelled table: two words make the host, others the path."""
    for words, ends, blocked in ((BLOCKED_WORDS, BLOCKED_ENDS, 1), (NEUTRAL_WORDS, NEUTRAL_ENDS, 0)):
        for i in range(LABELLED_URLS):
            a, b, c, d = (words[(i * k + i // 24 * m) % len(words)] for k, m in ((1, 0), (5, 1), (7, 3), (11, 2)))
            host = f"{a}-{b}" if i % 3 else f"{a}{i % 97}"
            path = (f"/{c}/{d}", f"/{c}/{i}", f"/{c}-{d}.html", f"/{d}?ref={i}", "/")[i % 5]
            yield f"{('http', 'https')[i % 2]}://{('www.', '', '')[i % 3]}{host}.{ends[i % len(ends)]}{path}", blocked


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    host = F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct(rule, verdict); null if none does. A short list, checked in one expression."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.pattern).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def buckets(host: Column, path: Column) -> Column:
    """The hashed character n-grams of both parts; marks at either end let a gram tell start and end apart."""
    grams = lambda part, n: F.regexp_extract_all(F.concat(F.lit("^"), part, F.lit("$")), F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))
    hashed = lambda found, name: F.transform(found, lambda g: F.pmod(F.xxhash64(F.lit(name), g), F.lit(BUCKETS)).cast("int"))
    return F.concat(*(hashed(grams(part, n), name) for name, part in (("host", host), ("path", path)) for n in GRAMS))


def margin(cells: Column, weights: list[float]) -> Column:
    """Intercept (the last weight) plus the weights of the cells, over the root of their number."""
    held = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    total = F.aggregate(cells, F.lit(0.0), lambda s, c: s + F.get(held, c))
    return F.lit(weights[-1]) + total / F.sqrt(F.greatest(F.size(cells), F.lit(1)))


def train(labelled: DataFrame, steps: int = STEPS) -> list[float]:
    """Weights of every bucket, and the intercept, from labelled(url, blocked)."""
    rows = labelled.filter("blocked IS NOT NULL").select(
        buckets(host_of(F.col("url")), path_of(F.col("url"))).alias("cells"), F.col("blocked").cast("double").alias("y")
    )
    n = rows.count()
    weights = [0.0] * (BUCKETS + 1)
    for _ in range(steps if n else 0):
        error = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(F.col("cells"), weights))) - F.col("y")
        share = error / F.sqrt(F.greatest(F.size("cells"), F.lit(1)))
        each = rows.select(F.explode(F.concat(F.transform("cells", lambda c: F.struct(c.alias("cell"), share.alias("g"))),
                                              F.array(F.struct(F.lit(BUCKETS).alias("cell"), error.alias("g"))))).alias("x"))
        gradient = each.groupBy("x.cell").agg(F.sum("x.g").alias("g")).collect()  # BUCKETS + 1 rows at most
        for row in gradient:
            weights[row.cell] -= RATE * row.g / n
        weights = [w * (1 - RATE * DECAY) for w in weights[:-1]] + weights[-1:]
    return [round(w, 9) for w in weights]


def url_filter(pages: DataFrame, labelled: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the classifier's score for every row of pages(page_id, url)."""
    weights = train(labelled)
    parts = pages.select("page_id", host_of(F.coalesce("url", F.lit(""))).alias("host"), path_of(F.coalesce("url", F.lit(""))).alias("path"))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(buckets(F.col("host"), F.col("path")), weights)))
    rated = parts.withColumns({"hit": longest_rule(F.col("host"), F.col("path"), rules), "score": score})
    method = F.when(F.col("score") > THRESHOLD, "block").otherwise("allow")
    return rated.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", method).alias("verdict"), "score")


def labelled_urls(spark: SparkSession) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(u).alias("url"), F.lit(y).alias("blocked")) for u, y in labelled()))
    return spark.range(1, numPartitions=1).select(F.inline(pairs))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), labelled_urls(spark))
