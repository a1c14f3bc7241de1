"""URL filters: allow and block rules, then empirical-Bayes reputation of hosts.

Outcomes are labelled pages, good or bad.  Their counts by host shrink through beta-binomial priors: all pages to suffix, suffix to
registered domain, domain to host.  Each level's prior has its parent's posterior mean and one strength, fitted by moments
over that level.  A page is blocked if the lower bound of its host's posterior share of bad pages is over a threshold;
hosts without outcomes take their domain's or suffix's posterior, and pass if there is none.

DataFrame functions only.  Outcomes are counted by host, combined before the shuffle, so a host may hold any share of the
pages; the levels above work on these counts.  Host posteriors are broadcast to the pages only if their counted rows are few.
Three numbers a level come to the driver.

Edge cases: a url that is null or has no `://` has an empty host and path, judged like any host; reputation leaves out a host's
user name and port, rules do not; a suffix is the last label or one of SUFFIXES, a registered domain has one label more, a
one-label host and an IP address are their own domain and suffix; outcomes for unknown pages, with a null flag or a null id count for nothing, several of one page count
once each; repeated rows get equal verdicts; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm._util import cut, small

#: (verdict, host and path); a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Standard deviations below the posterior mean, and the bad share that this bound must exceed.
Z, THRESHOLD = 1.645, 0.25
STRENGTHS = (1e-3, 0.999)  # of the correlation within a unit
#: Common public suffixes of two labels.
SUFFIXES = tuple(f"{a}.{b}" for b, own in {"uk": "ac co gov ltd me net nhs org plc sch", "au": "com edu gov net org", "nz": "ac co govt net org", "jp": "ac co go ne or", "br": "com gov net org", "za": "ac co gov org", "in": "ac co gov net org", "kr": "ac co go or", "cn": "com edu gov net org", "tw": "com edu gov org", "hk": "com edu gov org", "sg": "com edu gov org", "mx": "com gob org", "ar": "com gob org", "tr": "com gov org", "il": "ac co org"}.items() for a in own.split())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _levels(host: Column) -> tuple[Column, Column, Column]:
    bare = F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), ":[0-9]*$", "")
    last = F.regexp_extract(bare, r"(?:^|\.)(" + "|".join(x.replace(".", r"\.") for x in SUFFIXES) + ")$", 1)
    ip = F.regexp_like(bare, F.lit(r"^[0-9]+(\.[0-9]+){3}$|^\[.*\]$"))
    suffix = F.when(ip, bare).when(last != "", last).otherwise(F.regexp_extract(bare, "[^.]*$", 0))
    domain = F.when(ip, bare).when(last != "", F.regexp_extract(bare, r"([^.]*\.)?[^.]*\.[^.]*$", 0)).otherwise(F.regexp_extract(bare, "[^.]*(\\.[^.]*)?$", 0))
    return bare, domain, suffix


def _strength(units: DataFrame) -> float:
    """Prior strength by moments, from rows (n, bad, mean)."""
    spread = F.col("mean") * (1 - F.col("mean"))
    off = F.col("bad") - F.col("n") * F.col("mean")
    over, room = units.agg(F.sum(off * off - F.col("n") * spread), F.sum(F.col("n") * (F.col("n") - 1) * spread)).first()
    rho = (over or 0.0) / room if room else 0.5
    return 1 / min(max(rho, STRENGTHS[0]), STRENGTHS[1]) - 1


def host_reputation(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From rows (host, bad): posteriors (a, b) of hosts, and priors of hosts without outcomes by domain and by suffix."""
    bare, domain, suffix = _levels(F.col("host"))
    hosts = outcomes.groupBy(bare.alias("key"), domain.alias("domain"), suffix.alias("suffix")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = cut(hosts, "hosts")
    n, bad = hosts.agg(F.sum("n"), F.sum("bad")).first()
    whole = (bad or 0) / n if n else 0.0
    posterior = lambda s: (F.col("bad") + s * F.col("mean")) / (F.col("n") + s)
    tops = cut(hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("mean", F.lit(whole)), "suffixes")
    tops = tops.select("suffix", posterior(_strength(tops)).alias("mean"))
    mids = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(tops, "suffix")
    mids = cut(mids, "domains")
    mids = mids.select("domain", posterior(_strength(mids)).alias("mean"))
    lows = cut(hosts.join(mids, "domain"), "rated")
    s = _strength(lows)
    rated = lows.select("key", (s * F.col("mean") + F.col("bad")).alias("a"), (s * (1 - F.col("mean")) + F.col("n") - F.col("bad")).alias("b"))
    prior = lambda df, c: df.select(F.col(c).alias(f"{c}_key"), (s * F.col("mean")).alias(f"{c}_a"), (s * (1 - F.col("mean"))).alias(f"{c}_b"))
    return cut(rated, "reputation"), cut(prior(mids, "domain"), "domain_prior"), cut(prior(tops, "suffix"), "suffix_prior")


def lower_bound(a: Column, b: Column, z: float = Z) -> Column:
    """Posterior mean less z standard deviations."""
    n = a + b
    return a / n - z * F.sqrt(a * b / (n * n * (n + 1)))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, z: float = Z, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_bound of every page.  outcomes: (page_id, bad)."""
    host, path = host_path(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.where(F.col("bad").isNotNull()).select("page_id", F.col("bad").cast("boolean").alias("bad"))
    rated, mids, tops = host_reputation(own.join(known, "page_id").select("host", "bad"))
    bare, domain, suffix = _levels(F.col("host"))
    rows = own.withColumn("_key", bare).withColumn("_domain", domain).withColumn("_suffix", suffix)
    rows = rows.join(small(rated), F.col("_key") == F.col("key"), "left").join(small(mids), F.col("_domain") == F.col("domain_key"), "left").join(small(tops), F.col("_suffix") == F.col("suffix_key"), "left")
    a, b = F.coalesce("a", "domain_a", "suffix_a"), F.coalesce("b", "domain_b", "suffix_b")
    bound = F.when(a + b > 0, lower_bound(a, b, z))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(bound > threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"))
