"""URL filters: given rules on hosts and paths, and rules mined from labelled URLs.

Mined rules are association rules: FP-growth finds the combinations of URL tokens that
often occur with the label ``bad``; support and confidence prune them.  Both kinds are
matched through an inverted index: a given rule is filed under its host and looked up by
the host and parent domains of a URL, a mined rule is filed under its rarest token.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.session import fits_broadcast

MIN_SUPPORT = 0.002
#: Labelled URLs that must carry a rule's tokens together with the label, at least.
MIN_ROWS = 20
MIN_CONFIDENCE = 0.6
BAD = "label=bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def domains(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: domains, first label, path parts, extension, query keys, fragment; numbers left out."""
    host, path = host_of(url), path_of(url)
    rest = F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))
    mark = lambda kind, parts: F.transform(parts, lambda p: F.concat(F.lit(kind + "="), p))
    found = F.concat(
        mark("host", domains(host)),
        mark("label", F.split(host, r"[.-]")),
        mark("path", F.split(path, "/")),
        mark("ext", F.regexp_extract_all(path, F.lit(r"\.([A-Za-z]\w*)$"), F.lit(1))),
        mark("query", F.regexp_extract_all(rest, F.lit(r"[?&]([^=&#]+)"), F.lit(1))),
        mark("fragment", F.regexp_extract_all(rest, F.lit(r"#(.+)$"), F.lit(1))),
    )
    return F.array_distinct(F.filter(found, lambda t: ~t.rlike(r"=([0-9].*)?$") & (t != BAD)))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(token, antecedent, confidence, support) from ``labelled(url, bad boolean)``.

    A rule is filed under its rarest token, of equally rare ones the smallest.  Rows whose URL or label is
    null count for nothing, repeated rows count each; nothing is mined from an empty table.
    """
    rows = labelled.filter("url IS NOT NULL AND bad IS NOT NULL").select(
        F.concat(tokens(F.col("url")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items")
    )
    rows = rows.filter(F.size("items") > 0)
    n = rows.count()
    growth = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_rows / max(n, 1))), minConfidence=min_confidence)
    model = growth.fit(rows)
    rules = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD))).select("antecedent", "confidence", "support")
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    each = rules.select("antecedent", "confidence", "support", F.explode("antecedent").alias("token")).join(single, "token")
    return each.groupBy("antecedent").agg(
        F.min_by("token", F.struct("freq", "token")).alias("token"),
        F.first("confidence").alias("confidence"),
        F.first("support").alias("support"),
    )


def _indexed(urls: DataFrame, index: DataFrame, on: str) -> DataFrame:
    if fits_broadcast(urls.sparkSession, 500.0 * index.count()):
        index = F.broadcast(index)
    return urls.join(index, on)


def judge(pages: DataFrame, given: DataFrame, mined: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict (``allow`` or ``block``).

    ``given(host, path, verdict)``: a rule fits its host and all subdomains if the URL's
    path starts with the rule's; the longest fitting rule decides.  Other URLs are blocked
    if they have all tokens of a mined rule, else allowed.

    A URL is judged once, however often it occurs.  Null URLs and those without ``://``
    have an empty host and path, fit no rule and are allowed.  Other columns pass through,
    those named like a result are replaced; an empty table gives an empty table.
    """
    place = [host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path")]
    urls = pages.select(F.col(url).alias("_url")).filter("_url IS NOT NULL").distinct()
    known = given.select(
        F.col("host").alias("_on"), F.col("path").alias("_start"), F.concat("host", "path").alias("_rule"), F.col("verdict").alias("_said")
    )
    by_domain = urls.select("_url", *place).select("_url", "_path", F.explode(domains(F.col("_host"))).alias("_on"))
    fits = _indexed(by_domain, known, "_on").filter(F.startswith("_path", "_start"))
    ruled = fits.groupBy("_url").agg(F.max(F.struct(F.length("_rule").alias("n"), "_rule", "_said")).alias("_best"))
    by_token = urls.select("_url", tokens(F.col("_url")).alias("_tokens"))
    by_token = by_token.select("_url", "_tokens", F.explode("_tokens").alias("token"))
    index = mined.select("token", "antecedent")
    hit = _indexed(by_token, index, "token").filter(F.size(F.array_except("antecedent", "_tokens")) == 0)
    found = ruled.join(hit.select("_url").distinct().withColumn("_hit", F.lit(True)), "_url", "full_outer")
    judged = pages.join(found, pages[url] == found["_url"], "left")
    verdict = F.coalesce("_best._said", F.when(F.col("_hit"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.withColumns({
        "host": host_of(F.col(url)), "path": path_of(F.col(url)), "rule": F.col("_best._rule"), "verdict": verdict,
    }).drop("_url", "_best", "_hit")
