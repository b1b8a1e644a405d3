"""URL filters: host reputation by empirical Bayes, and rules that override it.

Labelled page outcomes are counted by host. The rate of bad pages of a host is
shrunk to that of its registered domain, the domain's to its suffix, and the suffix's
to the whole, each through a beta-binomial prior whose strength is fitted to the
spread between groups (method of moments). A host is blocked when the lower bound
of its posterior rate passes a limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.storage import broadcast_if_small
from lodestone.llm.text import ascii_lower
from lodestone.operators.lineage import checkpointed

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class UrlRule:
    """Holds for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class ReputationRules:
    """A host is blocked if its bad rate exceeds ``bad_rate`` by ``deviations`` posterior deviations.

    The fitted prior strengths, in pages, are held between ``weakest`` and ``strongest``.
    """

    bad_rate: float = 0.5
    deviations: float = 1.645
    weakest: float = 2.0
    strongest: float = 10_000.0


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


#: Public suffixes of two labels; others count as one label.
TWO_LABEL_SUFFIXES = tuple(
    f"{part}.{country}"
    for country, parts in {
        "uk": "co org me ltd plc net sch ac gov nhs police mod", "au": "com net org edu gov asn id",
        "nz": "co net org ac govt geek gen kiwi maori school iwi mil cri health", "za": "co net org ac gov web law nom school",
        "jp": "co ne or ac ad ed go gr lg", "kr": "co ne or re pe go ac hs ms es sc kg", "in": "co net org gen firm ind ac edu res gov mil nic",
        "br": "com net org gov edu art blog eco ind inf jus leg mil tv wiki", "cn": "com net org gov edu ac mil", "tw": "com net org edu gov idv game club",
        "hk": "com net org edu gov idv", "sg": "com net org edu gov per", "my": "com net org edu gov mil name", "id": "co or ac sch go web net mil my",
        "th": "co in ac or go net mi", "ph": "com net org edu gov ngo mil", "vn": "com net org edu gov info name pro health ac",
        "tr": "com net org edu gov bel pol mil k12 gen web bbs tel info biz av dr name", "il": "co org net ac gov muni k12 idf",
        "mx": "com net org edu gob", "ar": "com net org edu gob gov int mil tur", "co": "com net org edu gov mil nom", "pe": "com net org edu gob nom mil",
        "ve": "com net org edu gob co info web", "ua": "com net org edu gov in", "pl": "com net org edu gov info biz", "pt": "com org edu gov nome",
        "es": "com org nom edu gob", "gr": "com net org edu gov", "hu": "co org info", "at": "co or ac gv", "eg": "com net org edu gov sci",
        "sa": "com net org edu gov med pub sch", "ae": "co net org ac gov sch mil", "ke": "co or ne go ac sc me info mobi", "ng": "com net org edu gov name sch mil",
        "gh": "com org edu gov mil", "pk": "com net org edu gov fam web gob gok gop gos", "bd": "com net org edu gov ac mil", "lk": "com net org edu gov ac sch ngo",
        "np": "com net org edu gov mil", "cy": "com net org ac gov", "mt": "com net org edu",
    }.items()
    for part in parts.split()
)


def suffix_of(host: Column) -> Column:
    """The public suffix: two labels if they are a known suffix, else the last label."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the public suffix and the label before it."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def longest_rule(rules: list[UrlRule], host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null without one. Of equally long ones, block wins."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    chosen = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in reversed(ordered):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _strength(groups: DataFrame, limits: ReputationRules) -> float:
    """Pages that the prior of a level weighs, from groups of (bad, pages)."""
    p, pages, squares, spread, count = groups.select(
        (F.sum("bad") / F.sum("pages")).alias("p"), F.sum("pages").alias("n"), F.sum(F.col("pages") * F.col("pages")).alias("s"),
        (F.sum(F.col("bad") * F.col("bad") / F.col("pages")) - F.sum("bad") * F.sum("bad") / F.sum("pages")).alias("v"),
        F.count(F.lit(1)).alias("k"),
    ).first()
    if not pages or not 0 < p < 1 or pages == squares / pages:
        return limits.strongest
    between = (spread - (count - 1) * p * (1 - p)) / (pages - squares / pages)
    if between <= 0:
        return limits.strongest
    return min(max(p * (1 - p) / between - 1, limits.weakest), limits.strongest)


@dataclass(frozen=True)
class Levels:
    """Labelled hosts with their counts, the rates that they are shrunk to, and the weight of a host's prior in pages."""

    hosts: DataFrame
    by_domain: DataFrame
    by_suffix: DataFrame
    whole: float
    strength: float

    def judged(self, prior: Column, limits: ReputationRules) -> tuple[Column, Column]:
        """Posterior and lower bound from the columns ``bad`` and ``pages`` and the prior rate."""
        posterior = (F.col("bad") + F.lit(self.strength) * prior) / (F.col("pages") + F.lit(self.strength))
        deviation = F.sqrt(posterior * (1 - posterior) / (F.col("pages") + self.strength + 1))
        return posterior, posterior - limits.deviations * deviation


def _levels(outcomes: DataFrame, limits: ReputationRules) -> Levels:
    hosts = checkpointed(
        outcomes.where("host IS NOT NULL AND bad IS NOT NULL")
        .groupBy("host")
        .agg(F.sum("bad").cast("double").alias("bad"), F.count(F.lit(1)).cast("double").alias("pages"))
        .withColumn("domain", domain_of(F.col("host")))
        .withColumn("suffix", suffix_of(F.col("host")))
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("pages").alias("pages"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("pages").alias("pages"))
    whole = hosts.agg((F.sum("bad") / F.sum("pages")).alias("rate")).first()["rate"] or 0.0

    def shrunk(prior: Column | float, strength: float) -> Column:
        return (F.col("bad") + F.lit(strength) * prior) / (F.col("pages") + F.lit(strength))

    by_suffix = suffixes.select("suffix", shrunk(F.lit(whole), _strength(suffixes, limits)).alias("suffix_rate"))
    by_domain = domains.join(by_suffix, "suffix").select(
        "domain", shrunk(F.col("suffix_rate"), _strength(domains, limits)).alias("domain_rate")
    )
    return Levels(hosts, by_domain, by_suffix, whole, _strength(hosts, limits))


def _of_labelled(levels: Levels, limits: ReputationRules) -> DataFrame:
    posterior, bound = levels.judged(F.col("domain_rate"), limits)
    return (
        levels.hosts.join(levels.by_domain, "domain")
        .withColumn("posterior", posterior)
        .withColumn("bound", bound)
        .select(
            "host", F.col("pages").cast("bigint").alias("pages"), F.col("bad").cast("bigint").alias("bad"),
            "posterior", "bound", (F.col("bound") > limits.bad_rate).alias("blocked"),
        )
    )


def _of_others(hosts: DataFrame, levels: Levels, limits: ReputationRules) -> DataFrame:
    """The rows of ``_of_labelled`` for hosts without labels: no pages, the prior of the nearest level that has labels."""
    nearest = F.coalesce("domain_rate", "suffix_rate", F.lit(levels.whole))
    posterior, bound = levels.judged(F.col("rate"), limits)
    return (
        hosts.join(levels.hosts.select("host"), "host", "left_anti")
        .withColumn("domain", domain_of(F.col("host")))
        .withColumn("suffix", suffix_of(F.col("host")))
        .join(levels.by_domain, "domain", "left")
        .join(levels.by_suffix, "suffix", "left")
        .select("host", F.lit(0.0).alias("pages"), F.lit(0.0).alias("bad"), nearest.alias("rate"))
        .withColumn("posterior", posterior)
        .withColumn("bound", bound)
        .select(
            "host", F.col("pages").cast("bigint").alias("pages"), F.col("bad").cast("bigint").alias("bad"),
            "posterior", "bound", (F.col("bound") > limits.bad_rate).alias("blocked"),
        )
    )


def host_reputation(outcomes: DataFrame, limits: ReputationRules | None = None) -> DataFrame:
    """(host, pages, bad, posterior, bound, blocked) from one row (host, bad 0 or 1) for each labelled page.

    Rows whose host or outcome is null don't count. Three numbers, the prior
    strengths, pass through the driver.
    """
    limits = limits or ReputationRules()
    return _of_labelled(_levels(outcomes, limits), limits)


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[UrlRule],
    limits: ReputationRules | None = None,
    page_id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, host_pages, host_bad), one row for each row of ``pages``.

    ``outcomes`` has (page_id, bad), at most the worst outcome of a page counts.
    A null url, or one without ``://``, has an empty host and path and is judged by
    the reputation of the empty host. Hosts without labelled pages
    are judged by the prior of their domain, else suffix, else of the whole.
    Null ids and repeated rows are kept; other columns are ignored. Without
    outcomes everything that no rule blocks is allowed.
    """
    located = pages.select(
        F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    )
    worst = outcomes.groupBy("page_id").agg(F.max("bad").alias("bad"))
    limits = limits or ReputationRules()
    levels = _levels(located.join(worst, "page_id").select("host", "bad"), limits)
    known = _of_labelled(levels, limits).unionByName(_of_others(located.select("host").distinct(), levels, limits))
    table = broadcast_if_small(
        known.select("host", "blocked", F.col("pages").alias("host_pages"), F.col("bad").alias("host_bad"))
    )
    ruled = located.withColumn("_ruled", longest_rule(rules, F.col("host"), F.col("path")))
    own = F.when(F.coalesce(F.col("blocked"), F.lit(False)), "block").otherwise("allow")
    return ruled.join(table, "host", "left").select(
        "page_id", "host", "path", F.col("_ruled.rule").alias("rule"),
        F.coalesce(F.col("_ruled.verdict"), own).alias("verdict"),
        F.coalesce("host_pages", F.lit(0).cast("bigint")).alias("host_pages"),
        F.coalesce("host_bad", F.lit(0).cast("bigint")).alias("host_bad"),
    )
