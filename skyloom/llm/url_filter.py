"""Url filter by rules and by the reputation of hosts, shrunk towards domain and suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import UPPER, constant, written

#: Rules on host and path; the longest that fits wins.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def host_of(url: Column) -> Column:
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(after, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


# Public suffixes of two labels under which anyone can register, by their country.
SECOND_LEVEL = {
    "uk": ["co", "org", "ac", "gov", "me", "net", "ltd", "plc", "sch"],
    "au": ["com", "net", "org", "edu", "gov", "id"],
    "nz": ["co", "org", "net", "ac", "govt", "geek"],
    "jp": ["co", "or", "ne", "ac", "ad", "go", "gr", "ed", "lg"],
    "br": ["com", "net", "org", "gov", "edu"],
    "za": ["co", "org", "net", "ac", "gov", "web"],
    "in": ["co", "org", "net", "ac", "gov", "firm"],
    "kr": ["co", "or", "ne", "ac", "go", "re"],
    "cn": ["com", "net", "org", "edu", "gov", "ac"],
    "tw": ["com", "net", "org", "edu", "gov"],
    "mx": ["com", "net", "org", "edu", "gob"],
    "ar": ["com", "net", "org", "edu", "gob"],
    "tr": ["com", "net", "org", "edu", "gov"],
    "il": ["co", "org", "net", "ac", "gov"],
    "at": ["co", "or", "ac", "gv"],
    "pl": ["com", "net", "org", "edu", "gov"],
}
TWO_LABELS = [f"{second}.{country}" for country, seconds in SECOND_LEVEL.items() for second in seconds]


def name_of(host: Column) -> Column:
    """The host without its port."""
    return F.regexp_replace(host, ":[0-9]*$", "")


def suffix_of(name: Column, two_labels: list[str] | None = None) -> Column:
    """The public suffix: the longest known one, else the last label."""
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(TWO_LABELS if two_labels is None else two_labels), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(name: Column, two_labels: list[str] | None = None) -> Column:
    """The registered domain: the public suffix and one label more, or what there is."""
    two = F.substring_index(name, ".", -2)
    return F.when(
        two.isin(TWO_LABELS if two_labels is None else two_labels), F.substring_index(name, ".", -3)
    ).otherwise(two)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule whose host is the url's or above it and whose path starts the url's."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        at, slash, rest = rule.partition("/")
        fits = F.concat(F.lit("."), host).endswith("." + at) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _strength(groups: DataFrame, mean: Column) -> Column:
    """Prior strength from the over-dispersion of the groups' rates (moment estimate), in [1, 10000]."""
    labelled = F.col("k") > 0
    k = F.when(labelled, F.col("k"))
    spread = F.sum(k * F.pow(F.col("b") / k - mean, 2)) / (F.max(mean) * (1 - F.max(mean)))
    free = F.count(k) - 1
    rho = F.try_divide(spread - free, F.sum(k) - F.try_divide(F.sum(k * k), F.sum(k)) - free)
    return F.coalesce(F.least(F.greatest(F.try_divide(F.lit(1.0), rho) - 1, F.lit(1.0)), F.lit(10000.0)), F.lit(10000.0))


def reputations(outcomes: DataFrame, *, z: float = 1.645) -> DataFrame:
    """One row per host of outcomes (host, bad; bad is null where unlabelled): n, k, b, rate and low.

    The rate of bad outcomes has a beta prior on each level: all hosts for a suffix, the suffix's posterior
    mean for a domain, the domain's for a host. The prior's strength is estimated from how much the level's
    labelled rates differ beyond chance. low is the posterior mean less z standard deviations.
    """
    bad = F.col("bad")
    hosts = outcomes.groupBy("host").agg(
        F.count("*").alias("n"), F.count(bad).alias("k"), F.coalesce(F.sum(bad), F.lit(0)).alias("b")
    )
    hosts = written(
        hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "hosts"
    )
    sums = [F.sum(c).alias(c) for c in ("n", "k", "b")]
    domains = hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), *sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    k, b = suffixes.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    mean = min(max((b + 0.5) / (k + 1), 1e-6), 1 - 1e-6)
    levels = []
    for groups in (suffixes, domains, hosts):
        levels.append(groups.agg(_strength(groups, F.lit(mean))).first()[0] or 10000.0)
    ks, kd, kh = levels

    def posterior(prior, strength):
        return (strength * prior + F.col("b")) / (strength + F.col("k"))

    s = suffixes.select("suffix", posterior(F.lit(mean), ks).alias("at_suffix"))
    d = domains.join(s, "suffix").select("domain", posterior(F.col("at_suffix"), kd).alias("at_domain"))
    h = hosts.join(d, "domain").withColumn("rate", posterior(F.col("at_domain"), kh))
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.lit(kh) + F.col("k") + 1))
    return h.select("host", "n", "k", "b", "rate", (F.col("rate") - z * sd).alias("low"))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    outcome_id: str = "doc_id",
    bad: Column | None = None,
    rules: list[tuple[str, str]] | None = None,
    most_bad: float = 0.5,
    z: float = 1.645,
) -> DataFrame:
    """One row per page: host, path, the rule that fits or null, and the verdict.

    A rule's verdict stands. Without one a page is blocked when its host's rate of bad outcomes is above
    most_bad even at the posterior's lower bound. outcomes label pages by id; bad is 1 or 0 (default: low quality
    or toxic); a page labelled several times is bad if any label says so.

    Ports do not tell hosts apart; a registered domain is a public suffix (TWO_LABELS, or the last label) and one
    label more. Statistics are combined before they shuffle; pages meet their host's row in a join that adaptive execution
    splits when one host holds many pages. A null url or one without :// has an empty host and path; a null id has
    no label. An empty table gives no rows; a host without labels has its domain's rate. Other columns
    are not read.
    """
    rules = RULES if rules is None else rules
    if bad is None:
        bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(
            F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0
        )
    labels = outcomes.select(F.col(outcome_id).alias("_id"), bad.alias("bad")).groupBy("_id").agg(F.max("bad").alias("bad"))
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = urls.withColumn("name", name_of(F.col("host")))
    known = urls.select("page_id", F.col("name").alias("host")).join(labels, F.col("page_id") == F.col("_id"), "left")
    stats = written(reputations(known, z=z), "reputation")
    stats = stats.select(F.col("host").alias("name"), "rate", "low", F.col("k").alias("labelled"))
    verdicts = constant({rule: what for what, rule in rules}, "map<string,string>")
    judged = urls.join(stats, "name").withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    by_rate = F.when(F.col("low") > most_bad, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce(F.try_element_at(verdicts, F.col("rule")), by_rate).alias("verdict"),
        F.round("rate", 6).alias("rate"),
        F.col("labelled"),
    )
