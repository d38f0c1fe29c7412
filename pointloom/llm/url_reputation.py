"""URL filter: rules first, then the reputation of the host by empirical Bayes.

Labelled page outcomes (good or not) are counted by host, registered domain and
suffix.  Each level's counts shrink towards the posterior mean of the level
above through a beta prior whose strength is estimated from how much the units
of the level differ; the host's posterior gives a lower bound, and pages of
hosts whose bound is under ``least`` are blocked.  Rules of host and path
prefix override it; the longest that fits wins.

Defined cases: a null url or one without ``://`` has empty host and path (the
host '' has a reputation like any other); hosts without outcomes take the
posterior of their domain or suffix; without any outcome the prior mean is
0.5; repeated pages are judged one by one; empty tables give empty results;
columns other than id and url are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.frames import checkpointed

#: Suffixes of two labels under which names are registered (fixed values); any other last label is a suffix.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "gov.uk", "net.au", "org.au", "org.uk")
#: Standard errors below the posterior mean, and the least bound of a good host.
Z, LEAST = 1.645, 0.6
#: Bounds of a prior's strength, in outcomes.
STRENGTH = (1.0, 1000.0)


@dataclass(frozen=True)
class Rule:
    """Verdict for urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str


#: Fixed rules of the contract.
RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


def with_host(pages: DataFrame, url: Column) -> DataFrame:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))
    raw = F.regexp_extract("_rest", r"^[^/?#]*", 0)
    split = pages.withColumn("_rest", F.coalesce(rest, F.lit(""))).withColumn("_raw", raw)
    path = F.regexp_extract(F.substr("_rest", F.length("_raw") + F.lit(1)), r"^[^?#]*", 0)
    return split.withColumn("host", F.translate("_raw", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).withColumn("path", path).drop("_rest", "_raw")


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*LONG_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*LONG_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def _strength(counts: DataFrame) -> tuple[float, float]:
    """Strength of the prior of a level, by moments over its units with outcomes, and the mean of all outcomes: two numbers."""
    n, good = F.sum("n"), F.sum("good")
    sums = counts.where("n > 0").agg(n.alias("n"), good.alias("good"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("squares"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("units"))
    mean = F.col("good") / F.col("n")
    spread = mean * (1 - mean)
    between = (F.col("squares") - F.col("good") * mean - (F.col("units") - 1) * spread) / F.nullif(F.col("n") - F.col("nn") / F.col("n"), F.lit(0.0))
    strength = F.when(between > 0, F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), spread / between - 1))).otherwise(F.lit(STRENGTH[1]))
    return tuple(sums.select(strength, (F.coalesce("good", F.lit(0.0)) + 1.0) / (F.coalesce("n", F.lit(0.0)) + 2.0)).first())


def reputations(outcomes: DataFrame) -> DataFrame:
    """host, suffix, domain, n, good, posterior mean and bound for each host of ``outcomes`` (host, good: 1, 0 or null).

    A host without labelled outcomes is in the result too, with n = 0.
    """
    counted = outcomes.groupBy("host").agg(F.count("good").cast("double").alias("n"), F.coalesce(F.sum(F.col("good").cast("double")), F.lit(0.0)).alias("good"))
    hosts = checkpointed(counted.select("host", suffix_of(F.col("host")).alias("suffix"), domain_of(F.col("host")).alias("domain"), "n", "good"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    (k_suffix, mean_of_all), (k_domain, _), (k_host, _) = map(_strength, (suffixes, domains, hosts))
    s = suffixes.select("suffix", ((F.col("good") + k_suffix * mean_of_all) / (F.col("n") + k_suffix)).alias("m_suffix"))
    d = domains.join(s, "suffix").select("domain", "suffix", ((F.col("good") + k_domain * F.col("m_suffix")) / (F.col("n") + k_domain)).alias("m_domain"))
    alpha, total = F.col("good") + k_host * F.col("m_domain"), F.col("n") + k_host
    mean = alpha / total
    bound = mean - Z * F.sqrt(mean * (1 - mean) / (total + 1))
    return hosts.join(d, ["suffix", "domain"]).select("host", "suffix", "domain", "n", "good", mean.alias("posterior_mean"), bound.alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = LEAST, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the host's bound for each row of ``pages``.

    ``outcomes`` (host, good) may hold null outcomes; hosts of pages that it lacks are judged by the levels above.
    """
    judged = with_host(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("_url")), F.col("_url")).drop("_url")
    # every host of the pages takes part, so that a host without outcomes gets its domain's posterior
    seen = outcomes.select("host", F.col("good").cast("int").alias("good")).unionAll(judged.select("host", F.lit(None).cast("int")))
    known = checkpointed(reputations(seen).select("host", "bound"))
    fitting = [F.when(((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path), F.lit(r.host + r.path)) for r in sorted(rules, key=lambda r: -len(r.host + r.path))]
    rule = F.coalesce(*fitting) if fitting else F.lit(None).cast("string")
    by_rule = F.coalesce(*[F.when(F.col("rule") == r.host + r.path, F.lit(r.verdict)) for r in rules]) if rules else F.lit(None).cast("string")
    joined = judged.withColumn("rule", rule).join(known, "host")
    verdict = F.coalesce(by_rule, F.when(F.col("bound") >= least, F.lit("allow")).otherwise(F.lit("block")))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "bound")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, good) of pages: the first number that is a whole segment of the path names a document, whose quality is the outcome."""
    urls = with_host(pages.select(F.col("url").alias("_url")), F.col("_url"))
    document = F.nullif(F.regexp_extract("path", r"/([0-9]{1,18})(?:[./]|$)", 1), F.lit("")).cast("long")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("good"))
    return urls.select("host", document.alias("doc_id")).where("doc_id IS NOT NULL").join(marks, "doc_id").select("host", "good")


ORACLE = f"""
WITH marks AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1),
rests AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rests),
numbered AS (SELECT *, try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:[./]|$)', 1), '') AS BIGINT) AS doc FROM split),
parts AS (SELECT s.*, string_split(host, '.') AS p, array_to_string(string_split(host, '.')[-2:], '.') AS two FROM numbered s),
named AS (SELECT *, CASE WHEN two IN {LONG_SUFFIXES} THEN two ELSE p[-1] END AS suffix,
    CASE WHEN two IN {LONG_SUFFIXES} THEN array_to_string(p[-3:], '.') ELSE two END AS domain FROM parts),
hosts AS (SELECT host, any_value(suffix) AS suffix, any_value(domain) AS domain, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS good
    FROM named LEFT JOIN marks ON doc = doc_id GROUP BY 1),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY 1),
units AS (SELECT 1 AS level, n, good FROM suffixes UNION ALL SELECT 2, n, good FROM domains UNION ALL SELECT 3, n, good FROM hosts),
sums AS (SELECT level, sum(n) AS n, sum(good) AS good, sum(good * good / n) AS squares, sum(n * n) AS nn, count(*) AS units FROM units WHERE n > 0 GROUP BY 1),
moments AS (SELECT level, n, good, good / n * (1 - good / n) AS spread,
    (squares - good * good / n - (units - 1) * (good / n * (1 - good / n))) / nullif(n - nn / n, 0) AS between FROM sums),
strengths AS (SELECT level, n, good, CASE WHEN "between" > 0 THEN greatest({STRENGTH[0]}, least({STRENGTH[1]}, spread / "between" - 1)) ELSE {STRENGTH[1]} END AS k FROM moments),
levels AS (SELECT coalesce(max(k) FILTER (level = 1), {STRENGTH[1]}) AS k1, coalesce(max(k) FILTER (level = 2), {STRENGTH[1]}) AS k2, coalesce(max(k) FILTER (level = 3), {STRENGTH[1]}) AS k3,
    (coalesce(max(good), 0) + 1) / (coalesce(max(n), 0) + 2) AS m0 FROM strengths),
ms AS (SELECT suffix, (good + k1 * m0) / (n + k1) AS m FROM suffixes, levels),
md AS (SELECT d.suffix, domain, (good + k2 * ms.m) / (n + k2) AS m FROM domains d JOIN ms USING (suffix), levels),
mh AS (SELECT host, n + k3 AS total, (good + k3 * md.m) / (n + k3) AS m FROM hosts JOIN md USING (suffix, domain), levels),
bounds AS (SELECT host, m - {Z} * sqrt(m * (1 - m) / (total + 1)) AS bound FROM mh),
ruled AS (SELECT page_id, host, path, bound, CASE
    {" ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.host}{r.path}'" for r in sorted(RULES, key=lambda r: -len(r.host + r.path)))} END AS rule FROM split JOIN bounds USING (host))
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r.host}{r.path}' THEN '{r.verdict}'" for r in RULES)} WHEN bound >= {LEAST} THEN 'allow' ELSE 'block' END AS verdict
FROM ruled
"""
ORACLE = ORACLE.replace(" AS between ", ' AS "between" ')
