"""Operator 4: URL filter by empirical-Bayes host reputation.

A host's share of bad pages gets a beta-binomial posterior whose prior mean is the
shrunken share of its registered domain, whose prior in turn is that of its suffix,
whose prior is the share over all labelled pages. The weight of a prior (pseudo
counts) at a level is estimated from the spread of the shares at that level (method
of moments). A page is blocked if the lower bound of its host's posterior is above the
share over all labelled pages, which the priors pull every host to, by more than
``margin``. A host without labels is judged by its prior in the same way. Explicit
rules go first, the longest fitting one wins.

Only skinny columns are read. Counts per host are pre-aggregated map-side; the
parameters are three one-row aggregates, kept as one-row frames (no collect).

Defined results: a null url or one without ``://`` has empty host and path, no rule
and no reputation, and passes; so do all hosts if there are no labels; label rows without a page are ignored;
several labels of a page count as bad if any is bad; null labels are not labels;
repeated pages get a row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.llm.common import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path prefix)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: By how much a host's lower bound must exceed the share of bad pages over all labelled pages.
MARGIN = 0.05
#: Standard deviations from the posterior mean to its lower bound.
BOUND_Z = 1.645
#: Limits of a prior's weight, and what counts where a level has no spread to tell from.
WEIGHT_LEAST, WEIGHT_MOST = 1.0, 1000.0


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls; of equally long ones the first in order."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=False):
        its_host, _, rest = text.partition("/")
        fits = ((host == its_host) | host.endswith("." + its_host)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def spread_weight(groups: DataFrame, weight: str) -> DataFrame:
    """One row: pseudo counts that fit the spread of shares (bad / n) over ``groups`` (n, bad)."""
    g = groups.agg(F.sum("n").alias("s"), F.sum("bad").alias("b"), F.sum(F.col("n") * F.col("n")).alias("q"), F.count(F.lit(1)).alias("k"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("e"))
    p = F.try_divide(F.col("b"), F.col("s"))
    between = F.col("e") - F.col("s") * p * p - (F.col("k") - 1) * p * (1 - p)
    room = p * (1 - p) * (F.col("s") - F.try_divide(F.col("q"), F.col("s")) - (F.col("k") - 1))
    icc = F.try_divide(between, room)
    fit = F.when(icc > 0, F.greatest(F.lit(WEIGHT_LEAST), F.least(F.lit(WEIGHT_MOST), 1 / icc - 1))).otherwise(F.lit(WEIGHT_MOST))
    return g.select(fit.alias(weight))


def with_parents(hosts: DataFrame) -> DataFrame:
    return hosts.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", F.substring_index("host", ".", -2))


def reputations(labelled: DataFrame, seen: DataFrame, z: float = BOUND_Z) -> DataFrame:
    """(rep_host, n, bad, mean, lower, p0) per host of ``seen`` (host, distinct);
    ``labelled`` has host and bad (0 or 1). A host without labels has its prior alone:
    its domain's share, else its suffix's, else that of all."""
    hosts = labelled.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    hosts = store(with_parents(hosts), "host-counts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = hosts.agg(F.try_divide(F.sum("bad"), F.sum("n")).alias("p0"))

    def shrunk(weight: str, prior: str) -> Column:
        return (F.col("bad") + F.col(weight) * F.col(prior)) / (F.col("n") + F.col(weight))

    # one-row frames: the joins below attach parameters, they multiply nothing
    s = suffixes.join(F.broadcast(spread_weight(suffixes, "ws"))).join(F.broadcast(total)).select("suffix", shrunk("ws", "p0").alias("ps"))
    s = store(s, "suffix-shares")
    d = domains.join(F.broadcast(spread_weight(domains, "wd"))).join(s, "suffix").select("domain", shrunk("wd", "ps").alias("pd"))
    h = with_parents(seen).join(hosts.select("host", "n", "bad"), "host", "left").join(store(d, "domain-shares"), "domain", "left").join(s, "suffix", "left")
    h = h.join(F.broadcast(spread_weight(hosts, "wh"))).join(F.broadcast(total))
    h = h.withColumns({"n": F.coalesce("n", F.lit(0)), "bad": F.coalesce("bad", F.lit(0)), "prior": F.coalesce("pd", "ps", "p0")})
    a, b = F.col("bad") + F.col("wh") * F.col("prior"), F.col("n") - F.col("bad") + F.col("wh") * (1 - F.col("prior"))
    mean = a / (a + b)
    return h.select(F.col("host").alias("rep_host"), "n", "bad", mean.alias("mean"), (mean - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("lower"), "p0")


def url_verdicts(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    margin: float = MARGIN,
    page_id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_labelled, bad_lower) per page.

    ``labels`` has the page's id as doc_id, quality (0 is bad) and toxic (1 is bad).
    A host is blocked if its lower bound is above the share of all by ``margin``.
    """
    p = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    marks = labels.select(F.col("doc_id").alias("its_page"), bad.alias("bad")).where("bad is not null and its_page is not null").groupBy("its_page").agg(F.max("bad").alias("bad"))
    named = p.where("host != ''")
    rep = store(reputations(named.join(marks, named["page_id"] == marks["its_page"]).select("host", "bad"), named.select("host").distinct()), "host-reputation")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("lower") - F.col("p0") > margin, "block").otherwise("allow")
    return p.join(rep, p["host"] == rep["rep_host"], "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.coalesce("n", F.lit(0)).alias("n_labelled"), F.col("lower").alias("bad_lower")
    )
