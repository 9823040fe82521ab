"""URL filter: rules first, then gradient-boosted trees on lexical features.

The features of a url are its lengths, depth, numbers of labels, hyphens and parameters, its ratio
of digits, its entropy, and how often the tokens and the suffix of its host were blocked among the
labelled urls.  The trees are Spark's own, fitted on labelled urls: a table of ``(url, blocked)``
of which at most ``max_rows`` rows are used, those with the smallest hashes.  Statistics of a
labelled url leave the url itself out, so the trees do not trust them too much.

Scoring is one narrow pass: nothing is shuffled, and a host with a third of all urls is no
different from any other.  Rules are a short list; the longest that fits wins over the trees.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged
by the trees like any other.  Repeated rows and null ids keep their rows.  Urls of any length are
read whole.  Input columns named like an output are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bugsieve.llm.common import free_name, lower_ascii, text_batches

MAX_ROWS = 20_000
FEATURES = [
    "length", "host_length", "depth", "labels", "hyphens", "digit_ratio",
    "entropy", "params", "query_length", "token_odds", "suffix_odds",
]

#: Hosts of the labelled urls, all invented.  Each is paired with several paths.
BLOCKED_HOSTS = """
cheap-pills.example.net www.pills-online.example.com best-pills.example.org free-bets.example.net
m.bets-now.example.com top-bets.example.org casino-win.example.net blog.casino-bonus.example.com
big-casino.example.org spam-farm.example.org link-farm.example.com spam-links.example.net
adult-x.example.com www.adult-cams.example.net adult-chat.example.org ads-track.example.com
m.track-clicks.example.net ads-serve.example.org free-prizes.example.com win-prizes.example.net
cheap-loans.example.org fast-loans.example.com xxx-clips.example.net free-xxx.example.org
poker-bonus.example.com cheap-replica.example.net replica-bags.example.org click-track.example.com
""".split()
ALLOWED_HOSTS = """
news.example.org library.example.net www.garden-club.example.com tionsh.example.net
museum.example.com m.river.example.org school.example.net blog.cooking.example.com
ththth.example.org archive.example.com therin.example.org www.bridges.example.net
physics.example.org thonth.example.com forum.example.net m.weather.example.com
city-council.example.org maps.example.com blog.therha.example.net www.ththnd.example.net
choir.example.org ththon.example.com open-source.example.net recipes.example.org
m.ththed.example.net history.example.com ththan.example.net docs.example.org
""".split()
LABELLED_PATHS = ["/en/825?page=2&ref=x", "/de/25#top", "/fr/685", "/es/853/", "/en/450.html", "/en/7?utm_source=feed"]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled table: every host of the two lists with three of the paths."""
    rows = [
        (f"http{'s' * (k % 2)}://{host}{LABELLED_PATHS[(k + j) % len(LABELLED_PATHS)]}", label)
        for label, hosts in ((1, BLOCKED_HOSTS), (0, ALLOWED_HOSTS))
        for k, host in enumerate(hosts)
        for j in (0, 2, 3)
    ]
    return spark.createDataFrame(rows, "url string, blocked int")


# Parts and rules ------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null.  A rule is ``host/path``; of one text the later counts."""
    fits = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        here = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        fits = F.when(here, F.lit(rule)).otherwise(fits)
    return fits


# Features -------------------------------------------------------------------------------------

_PARTS = re.compile(r"(?s)(?:.*?://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?")
_TOKEN = re.compile(r"[.\-_]+")


def _split(url: str) -> tuple[str, str, str]:
    host, path, query = _PARTS.match(url).groups()
    return host.lower(), path, query or ""


def _tokens(host: str) -> list[str]:
    return [t for t in _TOKEN.split(host) if t]


def _suffix(host: str) -> str:
    return ".".join(host.split(".")[-2:])


class Odds:
    """Smoothed log-odds that a token or suffix is blocked, from counts of labelled urls."""

    def __init__(self, rows: list[tuple[str, int]]):
        self.counts: Counter = Counter()
        for url, label in rows:
            for key in self.keys(url):
                self.counts[key, label] += 1

    @staticmethod
    def keys(url: str) -> set[tuple[str, str]]:
        host = _split(url)[0]
        return {*(("token", t) for t in _tokens(host)), ("suffix", _suffix(host))}

    def of(self, key: tuple[str, str], without: int | None = None) -> float:
        bad = self.counts[key, 1] - (without == 1)
        good = self.counts[key, 0] - (without == 0)
        return math.log((bad + 1) / (good + 1))


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def features(url: str | None, odds: Odds, label: int | None = None) -> list[float]:
    """The features of a url; of a labelled one the odds leave it out."""
    url = url or ""
    host, path, query = _split(url)
    steps = [odds.of(("token", t), label) for t in set(_tokens(host))]
    return [
        float(len(url)),
        float(len(host)),
        float(sum(1 for x in path.split("/") if x)),
        float(host.count(".") + 1),
        float(host.count("-")),
        sum("0" <= c <= "9" for c in url) / max(len(url), 1),
        _entropy(url),
        float(query.count("=")),
        float(len(query)),
        max(steps, default=0.0),
        odds.of(("suffix", _suffix(host)), label),
    ]


# Trees ----------------------------------------------------------------------------------------


class Filter:
    """Fitted trees and the statistics their features need."""

    def __init__(self, odds: Odds, trees: GBTClassificationModel):
        self.odds, self.trees = odds, trees


def train(labelled: DataFrame, max_rows: int = MAX_ROWS, trees: int = 20, depth: int = 3, seed: int = 7) -> Filter:
    """Fit the filter on ``(url, blocked)``.

    At most ``max_rows`` rows, those whose url has the smallest hash, are collected and used; rows
    with a null url or label are not.
    """
    rows = (
        labelled.select(F.col("url").alias("url"), F.col("blocked").cast("int").alias("blocked"))
        .filter("url IS NOT NULL AND blocked IS NOT NULL")
        .orderBy(F.xxhash64("url"), "url", "blocked")
        .limit(max_rows)
        .collect()
    )
    pairs = [(r["url"], r["blocked"]) for r in rows]
    if len({label for _, label in pairs}) < 2:
        raise ValueError("labelled urls must hold blocked and allowed ones")
    odds = Odds(pairs)
    made = [(features(u, odds, label), float(label)) for u, label in pairs]
    table = labelled.sparkSession.createDataFrame(made, "x array<double>, label double").coalesce(1)
    fitted = GBTClassifier(featuresCol="v", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed).fit(
        table.select("label", array_to_vector("x").alias("v"))
    )
    return Filter(odds, fitted)


def judge(
    pages: DataFrame,
    model: Filter,
    rules: list[tuple[str, str]] = (),
    url: str = "url",
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` (allow or block)."""
    text_batches(pages.sparkSession)
    made = ["host", "path", "rule", "verdict"]
    rest = [c for c in pages.columns if c not in made]
    inner = pages.select(
        F.col(f"`{url}`").alias("_url"), F.struct(F.lit(0), *[F.col(f"`{c}`") for c in rest]).alias("_row")
    )
    odds = model.odds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(u.as_py(), odds) for u in batch.column(0)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x], names=["_url", "_row", "_x"])

    schema = inner.select("*", F.lit(None).cast("array<double>").alias("_x")).schema
    vectors = inner.mapInArrow(run, schema).withColumn("v", array_to_vector("_x"))
    scored = model.trees.transform(vectors)
    host, path = host_of(F.col("_url")), path_of(F.col("_url"))
    verdict_of = F.lit(None).cast("string")
    for verdict, rule in rules:
        verdict_of = F.when(F.col("rule") == rule, verdict).otherwise(verdict_of)
    judged = scored.select("_row", host.alias("host"), path.alias("path"), "prediction").withColumn(
        "rule", rule_of(F.col("host"), F.col("path"), list(rules))
    )
    method = F.when(F.col("prediction") > 0.5, "block").otherwise("allow")
    return judged.select(
        *[F.col("_row").getField(c).alias(c) for c in rest],
        "host",
        "path",
        "rule",
        F.coalesce(verdict_of, method).alias("verdict"),
    )


def allowed(pages: DataFrame, model: Filter, rules: list[tuple[str, str]] = (), url: str = "url") -> DataFrame:
    """The pages whose url is allowed, with the columns they came with."""
    row = free_name(pages, "_page")
    packed = pages.select(
        F.col(f"`{url}`").alias("_judged"), F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias(row)
    )
    return judge(packed, model, rules, "_judged").filter("verdict = 'allow'").select(f"{row}.*")
