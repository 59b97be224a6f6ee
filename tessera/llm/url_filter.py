"""URL filter: host and path rules, and a logistic regression on hashed character n-grams.

Everything that touches the pages is a DataFrame expression. The regression is fitted on the driver
over a small labelled url table, an input with columns url and label (1 for unwanted), of which at
most MOST_LABELLED rows of each label are used. The table that comes with the package,
``labelled_urls.tsv``, was written by hand for it: well-known public sites and made-up ordinary ones
as wanted, made-up ones of the usual unwanted kinds (gambling, pills, loans, adult, cracked software,
replicas, prizes, ad redirects, phishing) as unwanted.
"""

from __future__ import annotations

import math
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: (host, path, verdict); a rule fits its host and all subdomains. Fixed values of the query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: A url that no rule decides is blocked from this probability on.
BLOCK_FROM = 0.7
#: N-gram lengths, hash buckets, most rows of each label in training, and the training's settings.
GRAM_SIZES = (3, 4)
BUCKETS = 1 << 12
MOST_LABELLED = 1024
STEPS = 150
RATE = 20.0
DECAY = 1e-4


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The package's labelled table: url, label."""
    lines = resources.files(__package__).joinpath("labelled_urls.tsv").read_text(encoding="utf-8").splitlines()[1:]
    return spark.createDataFrame([(u, int(y)) for u, y in (line.split("\t") for line in lines)], "url string, label int")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def grams(host: Column, path: Column) -> Column:
    """Bucket of every n-gram of the host between carets and of the path after a space."""
    text = F.concat(F.lit("^"), host, F.lit("^ "), path)

    def of_size(n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.crc32(F.substring(text, i, F.lit(n)).cast("binary")), F.lit(BUCKETS)).cast("int"))

    return F.concat(*[of_size(n) for n in GRAM_SIZES])


def fit(rows: list[tuple[list[int], int]]) -> list[float]:
    """Weights by bucket, the bias last: full-batch descent on the log loss, both labels
    weighing alike."""
    weights, scale = [0.0] * (BUCKETS + 1), [1 / math.sqrt(max(1, len(g))) for g, _ in rows]
    share = {y: 0.5 / max(1, sum(1 for _, z in rows if z == y)) for y in (0, 1)}
    for _ in range(STEPS):
        slope: dict[int, float] = {}
        for (g, y), s in zip(rows, scale, strict=True):
            z = weights[BUCKETS] + s * sum(weights[b] for b in g)
            err = share[y] * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y)
            slope[BUCKETS] = slope.get(BUCKETS, 0.0) + err
            for b in g:
                slope[b] = slope.get(b, 0.0) + err * s
        for b, d in slope.items():
            weights[b] -= RATE * (d + DECAY * weights[b])
    return weights


def train(labelled: DataFrame) -> list[float]:
    """Weights from a table of url and label. Of each label the MOST_LABELLED urls with the least
    hash are used, wherever they stand in the table; rows with another label, or without a url,
    and repeated rows are left out."""
    host, path = host_and_path(F.col("url"))
    known = labelled.where("url is not null and label in (0, 1)").select("url", F.col("label").cast("int").alias("label")).distinct()
    rows = []
    for label in (0, 1):
        chosen = known.where(F.col("label") == label).orderBy(F.xxhash64("url"), "url").limit(MOST_LABELLED)
        rows += [(list(r["g"]), label) for r in chosen.select(grams(host, path).alias("g")).collect()]
    return fit(rows)


def judge(pages: DataFrame, rules=RULES, weights: list[float] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of ``pages``.

    The longest fitting rule decides; where none fits, the regression blocks from a probability of
    BLOCK_FROM on. A null url, or one without ``://``, has an empty host and path and is judged by
    the regression; repeated rows are judged alike; columns other than page_id and url are not read.
    """
    weights = train(labelled_urls(pages.sparkSession)) if weights is None else weights
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("grams", grams(F.col("host"), F.col("path")))
    model = F.split(F.lit(",".join(f"{w:.8f}" for w in weights[:BUCKETS])), ",").cast("array<double>")  # folded to a constant
    total = F.aggregate("grams", F.lit(0.0), lambda s, b: s + F.get(model, b))
    z = F.lit(weights[BUCKETS]) + total / F.sqrt(F.greatest(F.size("grams"), F.lit(1)))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("score") >= BLOCK_FROM, "block").otherwise("allow")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == rule_host) | F.col("host").endswith("." + rule_host)) & F.col("path").startswith(rule_path)
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    scored = rows.withColumn("score", F.round(1 / (1 + F.exp(-z)), 6))
    return scored.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
