"""URL verdicts: curated rules first, else a host's reputation by beta-binomial shrinkage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch

#: Suffixes of several labels under which names are registered, where no list is given; all others have one label. Fixed
#: values.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "ne.jp", "com.br", "com.cn", "com.mx", "co.in", "co.kr", "co.za", "com.tr", "com.tw", "com.sg")
#: Least and greatest share of variance between units that a prior may have.
RHO_LEAST, RHO_MOST = 0.01, 0.5


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url as the rules read them; both empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    bare = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(bare, "/", 1)
    return lower_ascii(host), bare.substr(F.length(host) + 1, F.length(bare))


def rules_of_hosts(hosts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, fits) of the hosts (host) that some rule (verdict, host, path) fits: its rules as an array of (length, rule,
    path, verdict), the longest first. A host meets rules by an equi join on each of its endings of whole labels."""
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    listed = hosts.sparkSession.createDataFrame(rules, "verdict string, end string, path string")
    rule = F.concat("end", "path")
    met = hosts.select("host", F.explode(ends).alias("end")).join(listed, "end")
    return met.groupBy("host").agg(F.sort_array(F.collect_set(F.struct(F.length(rule).alias("length"), rule.alias("rule"), "path", "verdict")), False).alias("fits"))


def suffix_and_domain(host: Column, suffixes: Iterable[str] = LONG_SUFFIXES) -> tuple[Column, Column]:
    """The public suffix of a host, the longest of the suffixes that it ends with or else its last label, and its
    registered domain, which has one label more (the host itself where it has none)."""
    last = lambda k: F.call_function("substring_index", host, F.lit("."), -k)
    known = F.filter(F.sequence(F.lit(1), F.size(F.split(host, r"\."))), lambda k: last(k).isin(*suffixes))
    k = F.coalesce(F.array_max(known), F.lit(1))
    return last(k), last(k + 1)


def _strength(units: DataFrame) -> float:
    """How many outcomes the parents' mean m counts for, over units of n outcomes with k bad ones, by moments."""
    spread = F.sum(F.pow(F.col("k") - F.col("n") * F.col("m"), 2) - F.col("n") * F.col("m") * (1 - F.col("m")))
    room = F.sum(F.col("n") * (F.col("n") - 1) * F.col("m") * (1 - F.col("m")))
    rho = F.coalesce(spread / F.when(room > 0, room), F.lit(RHO_MOST))
    return units.agg((1 / F.least(F.lit(RHO_MOST), F.greatest(F.lit(RHO_LEAST), rho)) - 1).alias("a")).first()["a"]


def reputations(outcomes: DataFrame, z: float = 1.645) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Posteriors from labelled outcomes (host, suffix, domain, bad 0/1): tables of hosts, domains and suffixes with mean
    and bound. The mean of each level is shrunk towards its parent's by a strength that moments give; bound is the mean
    less z posterior deviations. Four numbers reach the driver: the share of all and the strength of each level."""

    def posterior(units: DataFrame) -> DataFrame:
        a = F.lit(_strength(units))
        out = units.withColumn("mean", (a * F.col("m") + F.col("k")) / (a + F.col("n")))
        return out.withColumn("bound", F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (a + F.col("n") + 1)))

    hosts = materialize(outcomes.groupBy("suffix", "domain", "host").agg(F.count("*").alias("n"), F.sum("bad").alias("k")), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    share = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m")).first()["m"]
    s = posterior(suffixes.withColumn("m", F.lit(share)))
    d = posterior(domains.join(s.select("suffix", F.col("mean").alias("m")), "suffix"))
    h = posterior(hosts.join(d.select("suffix", "domain", F.col("mean").alias("m")), ["suffix", "domain"]))
    return h, d, s


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], limit: float = 0.5, z: float = 1.645, suffixes: Iterable[str] = LONG_SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page (page_id, url; further columns are ignored): the longest fitting
    rule's verdict (of equals the last by code point), else block
    where the posterior bound of the host's bad share (its domain's, its suffix's, where it has no outcome) is above
    limit, else allow.

    A label (doc_id, quality, toxic) is the outcome of the page of that id; it is bad if quality is 0 or toxic is 1, and
    repeated labels of a page count once, as bad if any is. Labels of no page, and null ids, count for nothing. Null and
    malformed urls have empty host and path and no outcome, and are allowed unless a rule says otherwise. Repeated pages
    repeat, urls of any length are read whole, and an empty table gives no rows. suffixes: public suffixes of several
    labels, of which a caller should give a full list. Pages meet reputations and rules by distinct host, with outcomes summed before each shuffle, so a common host stays small. The rated hosts
    are written first: a join of two tables is one whose skewed host Spark can split, a join with an aggregate is not.
    """
    host, path = host_and_path(F.col("url"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    suffix, domain = suffix_and_domain(F.col("host"), list(suffixes))
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(bad.alias("bad"))
    with scratch(pages.sparkSession):
        outcomes = own.where("host <> ''").join(known, "page_id").select("host", suffix.alias("suffix"), domain.alias("domain"), "bad")
        h, d, s = reputations(outcomes, z)
        hosts = own.select("host").distinct().select("host", suffix.alias("suffix"), domain.alias("domain"))
        rated = (
            hosts.join(h.select("host", F.col("bound").alias("b1")), "host", "left")
            .join(d.select("suffix", "domain", F.col("bound").alias("b2")), ["suffix", "domain"], "left")
            .join(s.select("suffix", F.col("bound").alias("b3")), "suffix", "left")
            .join(rules_of_hosts(hosts.select("host"), rules), "host", "left")
            .select("host", (F.coalesce("b1", "b2", "b3", F.lit(0.0)) > limit).alias("blocked"), "fits")
        )
        rated = materialize(rated, "rated", outlast=1)
    by_method = F.when(F.coalesce(F.col("blocked"), F.lit(False)), "block").otherwise("allow")
    rule = F.try_element_at(F.filter("fits", lambda r: F.col("path").startswith(r["path"])), F.lit(1))
    judged = own.join(rated, "host", "left").withColumn("fit", rule)
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_method).alias("verdict"))
