"""URL filter: listed rules first, then empirical-Bayes reputation of the host.

Labelled page outcomes are counted per host. Each level is shrunk towards the
one above with a beta prior: all pages -> suffix -> registered domain ->
host. The strength of a level's prior (its pseudo-counts) is fitted by moments
to how much the level's rates really differ. A host is blocked when the lower
bound of its posterior rate of bad pages exceeds ``block_above``. DataFrame
expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import lookup, table

#: Fixed values: (host, path, verdict) rules of the production list.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_ABOVE, Z = 0.25, 1.64
#: Pseudo-counts that a prior may have.
WEAKEST, STRONGEST = 1.0, 1000.0


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule string and verdict of the longest rule that fits, nulls where none does.

    A rule fits its host and all subdomains when the path starts with the rule's.
    """
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def _levels(host: Column) -> tuple[Column, Column]:
    """Registered domain (the last two labels) and suffix (the last label)."""
    return F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def _strength(units: DataFrame, by: list[str], name: str) -> DataFrame:
    """Pseudo-counts of the prior over ``units`` (n, bad per unit), by moments over all units; one row."""
    s = units.agg(F.sum("n").alias("w"), F.sum("bad").alias("x"), F.sum(F.col("n") * F.col("n")).alias("q"), F.count(F.lit(1)).alias("k"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("y"))
    s = s.withColumn("p", F.col("x") / F.col("w"))
    v = F.col("p") * (1 - F.col("p"))
    spread = F.col("y") - F.col("w") * F.col("p") * F.col("p")
    scale = v * (F.col("w") - F.col("q") / F.col("w") - F.col("k") + 1)
    rho = F.when(scale > 0, (spread - v * (F.col("k") - 1)) / scale).otherwise(0.0)
    rho = F.least(F.greatest(rho, F.lit(1 / (1 + STRONGEST))), F.lit(1 / (1 + WEAKEST)))
    return s.select(((1 - rho) / rho).alias(name))


def host_reputation(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """Posterior of each host from ``outcomes`` (host, bad 0/1 or null: unlabelled).

    Returns host, rows, bad_mean, bad_low (the lower bound: mean less ``z`` posterior standard
    deviations). Hosts without labelled pages get the posterior of their
    domain or suffix. No labelled page at all: mean one half.
    """
    counts = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("rows"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    domain, suffix = _levels(F.col("host"))
    hosts = table(counts.withColumns({"domain": domain, "suffix": suffix}), "url-hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.coalesce(F.sum("bad") / F.sum("n"), F.lit(0.5)).alias("p0"))
    one = whole
    for units, by, name in ((suffixes, ["suffix"], "m_suffix"), (domains, ["domain", "suffix"], "m_domain"), (hosts, ["host"], "m_host")):
        one = one.crossJoin(_strength(units.filter("n > 0"), by, name))  # one row each
    shrunk = lambda prior, m: (F.col("bad") + F.coalesce(F.col(m), F.lit(WEAKEST)) * F.col(prior)) / (F.col("n") + F.coalesce(F.col(m), F.lit(WEAKEST)))
    one = F.broadcast(one)
    s = suffixes.crossJoin(one).select("suffix", "m_domain", "m_host", shrunk("p0", "m_suffix").alias("p_suffix"))
    d = domains.join(s, "suffix").select("domain", "m_host", shrunk("p_suffix", "m_domain").alias("p_domain"))
    h = hosts.join(d, "domain").withColumn("m", F.coalesce("m_host", F.lit(WEAKEST)) + F.col("n"))
    h = h.withColumn("mean", shrunk("p_domain", "m_host"))
    low = F.greatest(F.lit(0.0), F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("m") + 1)))
    return h.select("host", "rows", F.round("mean", 6).alias("bad_mean"), F.round(low, 6).alias("bad_low"))


def judge_urls(pages: DataFrame, bad: Column, rules=RULES, block_above: float = BLOCK_ABOVE, z: float = Z) -> DataFrame:
    """Verdict for every url of ``pages`` (page_id, url and what ``bad`` reads).

    ``bad`` is the page's labelled outcome: 1 bad, 0 good, null unlabelled. Returns page_id, host,
    path, rule, verdict (allow or block: the rule's, else by reputation),
    bad_mean, bad_low. A null url or one without :// has an empty host and path, which is judged as a host of its own. Repeated
    rows are judged row by row; an empty table gives an empty result.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), bad.cast("int").alias("bad"))
    hosts = table(host_reputation(rows, z), "url-reputation")
    total = hosts.agg(F.sum("rows")).first()[0] or 0
    judged = lookup(rows.drop("bad"), hosts, ["host"], "rows", total)
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("bad_low") > block_above, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "bad_mean", "bad_low")


def junk_outcome(html: Column) -> Column:
    """Outcome of a page whose label is its own text: 1 where more than one word in twenty ends in a run of marks."""
    marks = F.regexp_count(html, F.lit(r"[%*#$]{3}"))
    words = F.length(html) - F.length(F.replace(html, F.lit(" "), F.lit("")))
    return F.when(html.isNull(), None).when(marks * 20 > words, 1).otherwise(0)
