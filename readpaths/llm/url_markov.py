"""URL filters: rules first, then a ratio of two character language models.

URLs that no rule fits are judged by the length-normalised difference of
their log-likelihoods under two variable-order Markov models, one of accepted
and one of rejected URLs.  Both are learned from the URLs that rules do
decide, with Witten-Bell smoothing: an order trusts its own counts by how
often its context was seen against how many different characters followed
it, and passes the rest to the next shorter context.  The threshold is
calibrated on a fold of the labelled URLs that the models do not see.

All of it is DataFrame expressions.  URLs are folded to 33 symbols (letters,
``0`` for a run of digits, ``. / -``, ``*`` for anything else, and two
marks), so there are at most 33^4 = 1,185,921 different 4-grams whatever the
corpus's size; that bound is why the gram table may be broadcast.  Equal
folded URLs are scored once.

Cases: a null URL and one without ``://`` have empty host and path and, as no
rule fits, the models' verdict on the empty string; repeated rows stay; with
no labelled URL of one kind every unruled URL is allowed (there is nothing to
compare); ties go to allow; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from readpaths.llm.shared import stored

ORDER = 3  # characters of context
SYMBOLS = 33
CALIBRATION_FOLDS = 5
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWERED), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as ``struct(length, rule, verdict)``, or null.

    ``rules`` are (verdict, ``host/path-prefix``); a rule fits its host and all subdomains.
    """
    fits = []
    for verdict, rule in rules:
        name, slash, prefix = rule.partition("/")
        fit = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits))


def folded(host: Column, path: Column) -> Column:
    text = F.translate(F.concat(host, path), UPPER, LOWERED)
    return F.regexp_replace(F.regexp_replace(text, "[0-9]+", "0"), "[^a-z0./-]", "*")


def grams(urls: DataFrame, *carry: str) -> DataFrame:
    """The ``carry`` columns and each 4-gram (``gram``) of the folded URLs, ends marked; one pass over a URL."""
    marked = F.concat(F.lit("^" * ORDER), F.col("folded"), F.lit("$"))
    return urls.select(*carry, F.explode(F.regexp_extract_all(marked, F.lit(f"(?=(.{{{ORDER + 1}}}))"), F.lit(1))).alias("gram"))


def log_ratios(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """``gram, ratio``: log P_accepted - log P_rejected of the last character of each of ``asked``.

    ``counts`` has ``gram, a, r``: training counts of the longest grams.
    """
    out = asked.select("gram").distinct().withColumns({"pa": F.lit(1.0 / SYMBOLS), "pr": F.lit(1.0 / SYMBOLS)})
    for size in range(ORDER + 1):  # context length, shortest first
        tail = counts.withColumn("g", F.substring("gram", ORDER + 1 - size, size + 1)).groupBy("g").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = tail.groupBy(F.substring("g", 1, size).alias("c")).agg(
            F.sum("a").alias("ta"), F.sum("r").alias("tr"), F.count(F.when(F.col("a") > 0, 1)).alias("da"), F.count(F.when(F.col("r") > 0, 1)).alias("dr"))
        own = out.withColumn("g", F.substring("gram", ORDER + 1 - size, size + 1)).withColumn("c", F.substring("g", 1, size))
        both = own.join(tail, "g", "left").join(context, "c", "left").na.fill(0, ["a", "r", "ta", "tr", "da", "dr"])

        def mixed(n, total, kinds, shorter):
            return F.when(F.col(total) > 0, (F.col(n) + F.col(kinds) * F.col(shorter)) / (F.col(total) + F.col(kinds))).otherwise(F.col(shorter))

        out = both.select("gram", mixed("a", "ta", "da", "pa").alias("pa"), mixed("r", "tr", "dr", "pr").alias("pr"))
    return out.select("gram", (F.log("pa") - F.log("pr")).alias("ratio"))


def threshold(scores: DataFrame) -> float:
    """The cut with the best balanced accuracy over ``score, a, r`` (the lowest of equals); -inf with a kind missing."""
    bins = scores.groupBy(F.round("score", 2).alias("cut")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    upward, everything = W.orderBy("cut").rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    lost = F.coalesce(F.sum("a").over(upward), F.lit(0)) / F.nullif(F.sum("a").over(everything), F.lit(0))
    caught = F.coalesce(F.sum("r").over(upward), F.lit(0)) / F.nullif(F.sum("r").over(everything), F.lit(0))
    best = bins.select("cut", (caught - lost).alias("gain")).where("gain is not null").orderBy(F.desc("gain"), "cut").first()
    return float("-inf") if best is None else best["cut"] - 0.005


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``<id_col>, host, path, rule, verdict`` and ``score`` (null where a rule decides), one row per input row."""
    host, path = host_and_path(F.col(url_col))
    named = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    ruled = named.withColumn("by", rule_of(F.col("host"), F.col("path"), rules)).withColumn("folded", folded(F.col("host"), F.col("path")))
    verdict = F.col("by.verdict")
    urls = stored(ruled.groupBy("folded").agg(
        F.count(F.when(verdict == ALLOW, 1)).alias("a"), F.count(F.when(verdict == BLOCK, 1)).alias("r"),
        F.count(F.when(verdict.isNull(), 1)).alias("open")).withColumn("number", F.monotonically_increasing_id()), "urls")
    labelled = (F.col("a") > 0) | (F.col("r") > 0)
    fold = F.pmod(F.crc32(F.col("folded").cast("binary")), F.lit(CALIBRATION_FOLDS)) == 0
    counts = stored(grams(urls.where(labelled & ~fold), "a", "r").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), "grams")
    judged = urls.where((labelled & fold) | (F.col("open") > 0))
    ratios = stored(log_ratios(counts, grams(judged)), "ratios")
    # a URL's grams carry its number, not its text
    means = grams(judged, "number").join(F.broadcast(ratios), "gram").groupBy("number").agg(F.avg("ratio").alias("score"))
    scores = stored(judged.join(means, "number").select("folded", "a", "r", "open", "score"), "scores")
    kinds = counts.agg(F.sum("a"), F.sum("r")).first()
    cut = threshold(scores.where(labelled & fold)) if kinds[0] and kinds[1] else float("-inf")
    decided = ruled.where("by is not null").select("id", "host", "path", "by.rule", "by.verdict", F.lit(None).cast("double").alias("score"))
    scored = scores.select("folded", "score")
    rest = (ruled.where("by is null").join(scored, "folded").select(
        "id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("score") >= F.lit(cut), ALLOW).otherwise(BLOCK).alias("verdict"), "score"))
    return decided.union(rest).withColumnRenamed("id", id_col)
