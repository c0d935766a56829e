"""URL filters: explicit rules first, then the reputation of the host by empirical Bayes.

Labelled outcomes of pages are counted by host. Bad rates are shrunk from the top down: the posterior mean of a level is
the prior mean of the next, from all pages to the public suffix, the registered domain and the host. The strength of
each prior is estimated from the counts by the method of moments for beta-binomial data, and is never more than the
weight of the posterior that it comes from. A page is blocked when the lower
posterior bound of its host's bad rate (the mean less BOUND standard deviations of the posterior) lies above a threshold, so that hosts with few labels are left alone.

Defined results: a null url or one without "://" has an empty host and path and fits no rule; a host without labels has
its domain's rate, a domain without labels its suffix's, and so on; labels of unknown pages count nowhere; repeated rows
each have a result; an empty table gives an empty result; columns besides the url are kept untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Public suffixes of two labels; any other suffix is the last label.
TWO_LABELS = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.au", "org.uk")
LEVELS = ("suffix", "domain", "host")
THRESHOLD = 0.5
#: Standard deviations of the posterior between its mean and the bound.
BOUND = 2.0


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABELS), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*TWO_LABELS), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule's verdict and text, or null. rules: (verdict, host/path), a list that an expression can hold."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _strength(groups: DataFrame, rate: str) -> float:
    """Prior strength of one level, from its groups' bad, n and prior rate: the overdispersion left by binomial noise."""
    q = F.greatest(F.least(F.col(rate), F.lit(0.999)), F.lit(0.001))
    noise = F.pow(F.col("bad") - F.col("n") * q, 2) / (F.col("n") * q * (1 - q))
    s, k, n = groups.filter("n > 0").agg(F.sum(noise), F.count(F.lit(1)), F.sum(F.col("n") - 1)).first()
    if not n:
        return 1.0
    rho = min(max((s - k) / n, 1e-3), 0.5)  # so that a prior weighs as much as one page at least
    return (1 - rho) / rho


def reputation(pages: DataFrame, outcomes: DataFrame, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """host, alpha, beta: the posterior of every host's bad rate. outcomes: id, bad (0 or 1), one row a page."""
    labels = outcomes.filter(F.col("bad").isNotNull()).groupBy(F.col("id").alias("_id")).agg(F.max("bad").alias("bad"))
    hosts = pages.select(F.col(id_col).alias("_page"), host_of(F.col(url_col)).alias("host"))
    hosts = hosts.join(labels, F.col("_page") == F.col("_id"), "left").groupBy("host").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("bad").alias("n"))
    hosts = stored(hosts.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"))), "hosts")
    bad, n = hosts.agg(F.sum("bad"), F.sum("n")).first()
    above, key = None, None
    for level in LEVELS:
        keys = list(LEVELS[: LEVELS.index(level) + 1])
        groups = hosts.groupBy(*keys).agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
        if above is None:
            groups = groups.withColumns({"prior": F.lit((bad or 0) / n if n else 0.0), "weight": F.lit(float(max(n or 0, 1)))})
        else:
            groups = groups.join(above.select(*key, F.col("mean").alias("prior"), (F.col("alpha") + F.col("beta")).alias("weight")), key)
        m = F.least(F.lit(_strength(groups, "prior")), F.col("weight"))
        groups = groups.withColumn("alpha", F.col("prior") * m + F.col("bad")).withColumn("beta", (1 - F.col("prior")) * m + F.col("n") - F.col("bad"))
        above, key = groups.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta"))), keys
    return above.select("host", "alpha", "beta")


def judged(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), url_col: str = "url", id_col: str = "page_id", threshold: float = THRESHOLD, bound: float = BOUND) -> DataFrame:
    """id, host, path, rule, verdict, bad_rate (posterior mean), lower (posterior bound) of every page."""
    rep = reputation(pages, outcomes, url_col, id_col).withColumnRenamed("host", "_host")
    total = F.col("alpha") + F.col("beta")
    mean = F.col("alpha") / total
    rep = rep.select("_host", mean.alias("bad_rate"), (mean - bound * F.sqrt(mean * (1 - mean) / (total + 1))).alias("lower"))
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    rows = spread_join(rows, rep.withColumnRenamed("_host", "host"), "host", "left")
    by_method = F.when(F.col("lower") > threshold, "block").otherwise("allow")
    return rows.select("id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), by_method).alias("verdict"), "bad_rate", "lower")
