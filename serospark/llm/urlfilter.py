"""URL filters: host reputations from labelled pages by empirical Bayes, and explicit rules.

DataFrame functions only. Outcomes of pages are counted per host; each level (suffix, registered
domain, host) is a beta-binomial group whose prior mean is the posterior mean of the level above
and whose prior weight is estimated by moments from the spread of that level's rates.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from serospark.llm.common import lower_ascii, salted_lookup
from serospark.session import cut_lineage


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


class Reputation(NamedTuple):
    """``z`` standard deviations below the posterior mean is the bound that blocks at ``block_at``.

    The prior weights are kept between ``least`` and ``most`` outcomes.
    """

    z: float = 1.0
    block_at: float = 0.5
    least: float = 1.0
    most: float = 1000.0


_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column | str) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column | str) -> Column:
    """What follows the host up to ``? #`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


# Suffixes of two labels under which names are registered.
LONG_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "sch.uk", "com.au", "edu.au", "gov.au", "net.au", "org.au",
    "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz", "ac.za", "co.za", "gov.za", "org.za", "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "ac.kr", "co.kr", "go.kr", "or.kr",
    "ac.in", "co.in", "gov.in", "net.in", "org.in", "com.br", "gov.br", "net.br", "org.br", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "com.hk", "com.sg", "com.tw", "org.tw",
    "com.ar", "com.co", "com.mx", "gob.mx", "org.mx", "com.tr", "gov.tr", "org.tr", "com.ua", "co.il", "org.il", "co.id", "co.th", "com.my", "com.ph", "com.vn", "com.eg", "com.sa")
_ADDRESS = r"^([0-9.]+|\[.*\])$"


def bare_name(host: Column | str) -> Column:
    """A host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def _labels(host: Column | str, n: int) -> Column:
    name = bare_name(host)
    long = F.substring_index(name, ".", -2).isin(*LONG_SUFFIXES)
    return F.when(F.rlike(name, F.lit(_ADDRESS)), name).when(long, F.substring_index(name, ".", -n - 1)).otherwise(F.substring_index(name, ".", -n))


def registered_domain(host: Column | str) -> Column:
    """The suffix of a host with the label before it; shorter names and addresses stay whole."""
    return _labels(host, 2)


def suffix_of(host: Column | str) -> Column:
    """The last label of a host, or the last two where these are a suffix; an address is its own."""
    return _labels(host, 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The fitting rule with the longest ``host + path`` as ``(n, rule, verdict)``, else null.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    """
    fits = [
        F.when(
            ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)),
            F.struct(F.lit(len(r.host + r.path)).alias("n"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def _weight(groups: DataFrame, how: Reputation) -> DataFrame:
    """One row: ``mu`` and the prior weight of a level, from the spread of its groups' rates."""
    total = groups.agg(
        F.sum("bad").alias("k"), F.sum("seen").alias("n"), F.sum(F.col("seen") * F.col("seen")).alias("n2"),
        F.sum(F.when(F.col("seen") > 0, F.col("bad") * F.col("bad") / F.col("seen"))).alias("kk"),
        F.count_if(F.col("seen") > 0).alias("g"))
    # sum n_i (p_i - mu)^2 = sum k_i^2 / n_i - k mu
    mu = (F.coalesce("k", F.lit(0)) + 0.5) / (F.coalesce("n", F.lit(0)) + 1.0)
    total = total.withColumn("mu", mu).withColumn("v", F.col("mu") * (1 - F.col("mu")))
    spread = F.col("kk") - 2 * F.col("mu") * F.col("k") + F.col("mu") * F.col("mu") * F.col("n")
    room = (F.col("n") - F.col("n2") / F.col("n") - (F.col("g") - 1)) * F.col("v")
    rho = F.when(room > 0, (spread - (F.col("g") - 1) * F.col("v")) / room)
    weight = F.when(rho > 0, 1 / rho - 1).otherwise(F.lit(how.most))
    return total.select("mu", F.greatest(F.lit(how.least), F.least(F.lit(how.most), weight)).alias("w"))


def reputations(hosts: DataFrame, how: Reputation = Reputation()) -> DataFrame:
    """``(host, seen, bad, mean, bound)`` for ``hosts (host, seen, bad)``, one row per host.

    A host without labelled pages takes the posterior mean of its domain, that of its suffix, or
    the overall mean. ``bound`` is the posterior mean of the bad share less ``z`` deviations.
    """
    named = hosts.withColumns({"domain": registered_domain("host"), "suffix": suffix_of("host")})
    domains = named.groupBy("domain", "suffix").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))

    def shrink(groups: DataFrame) -> DataFrame:
        """Posterior from the prior mean ``up``; a level's weights are one row, so they are broadcast."""
        joined = groups.join(F.broadcast(_weight(groups.select("seen", "bad"), how).select("w")))
        alpha, beta = F.col("bad") + F.col("w") * F.col("up"), F.col("seen") - F.col("bad") + F.col("w") * (1 - F.col("up"))
        return joined.withColumns({"alpha": alpha, "beta": beta}).withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))

    top = shrink(suffixes.join(F.broadcast(_weight(suffixes, how).select(F.col("mu").alias("up")))))
    middle = shrink(salted_lookup(domains, top.select("suffix", F.col("mean").alias("up")), "suffix", ["domain"]))
    low = shrink(salted_lookup(named, middle.select("domain", F.col("mean").alias("up")), "domain", ["host"]))
    total = F.col("alpha") + F.col("beta")
    deviation = F.sqrt(F.col("alpha") * F.col("beta") / (total * total * (total + 1)))
    return low.select("host", "seen", "bad", "mean", (F.col("mean") - F.lit(how.z) * deviation).alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = (), how: Reputation = Reputation()) -> DataFrame:
    """``(page_id, host, path, rule, verdict, bad_share, bound)``, one row per row of ``pages``.

    ``outcomes (page_id, bad)`` labels some pages with 0 or 1; of several labels of a page the
    worst counts, null labels are ignored. The longest fitting rule decides; other pages are blocked
    where the bound of their host reaches ``block_at``. A null url, or one without ``://``, has the
    empty host, which is judged like any other. Repeated pages give repeated rows; other columns of
    ``pages`` are not read. Empty tables give an empty result.
    """
    known = outcomes.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    parts = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    # Every level is summed from this table, which is written once.
    hosts = cut_lineage(parts.join(known, "page_id", "left").groupBy("host").agg(
        F.count("bad").alias("seen"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "hosts")
    known_hosts = reputations(hosts, how).select("host", F.col("mean").alias("bad_share"), "bound")
    judged = salted_lookup(parts, known_hosts, "host", ["page_id", "path"])
    best = fitting_rule(F.col("host"), F.col("path"), rules)
    held = F.when(F.col("bound") >= how.block_at, "block").otherwise("allow")
    return judged.withColumn("_best", best).select(
        "page_id", "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.verdict"), held).alias("verdict"), "bad_share", "bound")
