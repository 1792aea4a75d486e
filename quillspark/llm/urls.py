"""URL filters: explicit rules first, then an empirical-Bayes reputation of the host.

Labelled pages (bad or not) are counted by host, registered domain and suffix. Each level shrinks its rate to
the level above through a beta-binomial prior whose strength is fitted by moments over all its groups, and a
host is blocked when the lower posterior bound of its bad rate passes a threshold. All of it is aggregation
with map-side combine and joins on the counted levels; a hot host is one row of the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, small, table

#: (rule, verdict): the host up to the first slash, then a path prefix.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
# Common public suffixes of two labels. Any other suffix is the last label; a longer table is a parameter.
SUFFIXES = tuple(
    f"{second}.{top}"
    for top, seconds in {
        "uk": "ac co gov ltd me net nhs org plc police sch", "au": "com edu gov id net org asn", "nz": "ac co geek gen govt net org school", "za": "ac co gov net org web",
        "jp": "ac ad co ed go gr lg ne or", "kr": "ac co go ne or pe re", "cn": "ac com edu gov net org", "tw": "com edu gov idv net org", "hk": "com edu gov idv net org",
        "in": "ac co edu firm gov ind net org res", "id": "ac co go net or sch web", "th": "ac co go in mi net or", "my": "com edu gov name net org", "sg": "com edu gov net org per",
        "br": "art blog com edu gov net org", "mx": "com edu gob net org", "ar": "com edu gob net org", "co": "com edu gov net org", "pe": "com edu gob net org", "ve": "co com gob net org",
        "tr": "com edu gov net org web", "il": "ac co gov net org", "eg": "com edu gov net org", "sa": "com edu gov net org", "ae": "ac co gov net org", "ng": "com edu gov net org", "ke": "ac co go ne or",
        "pl": "com edu gov net org", "ua": "com edu gov net org", "gr": "com edu gov net org", "es": "com edu gob nom org", "pt": "com edu gov org", "at": "ac co gv or", "hu": "co org",
    }.items()
    for second in seconds.split()
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def site_of(host: Column) -> Column:
    """The host without user name, port and closing dot, as reputations are kept by it."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)\A.*@", ""), r"\.?(:[0-9]*)?\z", "")


def with_domains(sites: DataFrame, suffixes: DataFrame, labels: int = 4) -> DataFrame:
    """(site, ...), one row each -> also suffix, the longest of ``suffixes`` (suffix) that ends the site, of up to ``labels`` labels, or
    else its last label, and domain, the suffix and one more label."""
    ends = F.explode(F.array_distinct(F.array(*[F.substring_index("site", ".", -n) for n in range(1, labels + 1)]))).alias("suffix")
    found = sites.select("site", ends).join(small(suffixes.select("suffix").distinct()), "suffix")
    longest = found.groupBy("site").agg(F.max_by("suffix", F.length("suffix")).alias("suffix"))
    rows = sites.join(longest, "site", "left").withColumn("suffix", F.coalesce("suffix", F.substring_index("site", ".", -1)))
    parts = F.split("site", "[.]")
    more = F.size(F.split("suffix", "[.]")) + 1
    return rows.withColumn("domain", F.array_join(F.slice(parts, F.greatest(F.size(parts) - more + 1, F.lit(1)), more), "."))


def _shrunk(groups: DataFrame, parent: str, out: str) -> DataFrame:
    """Adds ``out``, the mean of (bad, n) shrunk to column ``parent``, and ``strength``, fitted by moments over all groups."""
    even = F.col("n") * F.col(parent) * (1 - F.col(parent))
    fit = groups.agg(
        (F.sum(F.pow(F.col("bad") - F.col("n") * F.col(parent), F.lit(2.0))) - F.sum(even)).alias("over"),
        F.sum((F.col("n") - 1) * even).alias("scale"),
    )
    rho = F.when(F.col("scale") > 0, F.greatest(F.lit(0.01), F.least(F.lit(0.9), F.col("over") / F.col("scale")))).otherwise(F.lit(0.5))
    fit = fit.select((1 / rho - 1).alias("strength"))
    return groups.join(F.broadcast(fit)).withColumn(out, (F.col("bad") + F.col("strength") * F.col(parent)) / (F.col("n") + F.col("strength")))


def suffix_table(spark: SparkSession, suffixes=SUFFIXES) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in suffixes])).alias("suffix"))


def host_reputation(outcomes: DataFrame, z: float = 1.0, suffixes: DataFrame | None = None) -> DataFrame:
    """(site, bad 0/1) of labelled pages -> per site: n, bad, domain, posterior mean and lower bound of the bad rate.

    The bound is the mean less ``z`` standard deviations of the beta posterior, a normal bound. ``suffixes`` (suffix) are the
    public suffixes of several labels.
    """
    hosts = outcomes.groupBy("site").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    hosts = materialize(hosts, "url-counts")
    known = suffix_table(hosts.sparkSession) if suffixes is None else suffixes
    hosts = materialize(with_domains(hosts, known), "url-hosts")
    whole = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).alias("base"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(F.broadcast(whole))
    suffixes = _shrunk(suffixes, "base", "suffix_mean")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = _shrunk(domains.join(suffixes.select("suffix", "suffix_mean"), "suffix"), "suffix_mean", "domain_mean")
    hosts = _shrunk(hosts.join(domains.select("domain", "domain_mean"), "domain"), "domain_mean", "mean")
    total = F.col("n") + F.col("strength")
    bound = F.col("mean") - F.lit(z) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (total + 1))
    return hosts.select("site", "domain", "n", "bad", "mean", bound.alias("bound"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, threshold: float = 0.3, z: float = 1.0, suffixes: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, bad_rate and bad_bound.

    ``labels`` holds outcomes by page (doc_id is the page's id): bad means quality 0 or toxic 1; rows with neither
    value are no outcome, several for a page count once, as bad if any is. Every host of ``pages`` is judged; one without
    outcomes has the mean of its domain. User names, ports and a closing dot don't part hosts. Defined cases: a null url or one without :// has an empty host and path,
    and such pages form one host; null page_id is kept and has no outcome; repeated rows stay; of rules that tie in length only one
    can fit; urls of any length are read whole; an empty table gives no row; extra columns are ignored.
    """
    seen = pages.select("page_id", host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path")).withColumn("site", site_of(F.col("host")))
    bad = F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))
    outcome = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).where("bad is not null and page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    known = seen.select("page_id", "site").join(outcome, "page_id", "left").select("site", F.col("bad").cast("long").alias("bad"))
    rated = materialize(host_reputation(known, z, suffixes), "url-rated")
    rated = small(rated.select("site", F.col("mean").alias("bad_rate"), F.col("bound").alias("bad_bound")))
    rows = seen.join(rated, "site", "left").withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    by_host = F.when(F.col("bad_bound") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), by_host).alias("verdict"), "bad_rate", "bad_bound")


def op5_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return rows.select("page_id", "host", "path", "rule", "verdict", F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_bound", 6).alias("bad_bound"))


_LIST = ", ".join(f"'{s}'" for s in SUFFIXES)

OP5_SQL = r"""
WITH seen AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
outcome AS (SELECT doc_id AS page_id, max(greatest((quality = 0)::INT, (toxic = 1)::INT)) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
sites AS (SELECT *, regexp_replace(regexp_replace(host, '(?s)\A.*@', ''), '\.?(:[0-9]*)?\z', '') AS site FROM seen),
counted AS (SELECT site AS host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM sites LEFT JOIN outcome USING (page_id) GROUP BY site),
cut AS (SELECT *, string_split(host, '.') AS p, CASE WHEN len(string_split(host, '.')) > 1 THEN string_split(host, '.')[-2] || '.' || string_split(host, '.')[-1] ELSE host END AS two FROM counted),
hosts AS (SELECT host, n, bad,
    CASE WHEN two IN (SUFFIX_LIST) THEN two ELSE p[-1] END AS suffix,
    CASE WHEN two IN (SUFFIX_LIST) AND len(p) > 2 THEN p[-3] || '.' || two ELSE two END AS domain FROM cut),
base AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS base FROM hosts),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(base) AS up FROM hosts, base GROUP BY suffix),
sf AS (SELECT sum((bad - n * up) ** 2) - sum(n * up * (1 - up)) AS o, sum((n - 1) * n * up * (1 - up)) AS s FROM s0),
sm AS (SELECT suffix, (bad + k * up) / (n + k) AS mean FROM s0, (SELECT 1 / (CASE WHEN s > 0 THEN greatest(0.01::DOUBLE, least(0.9::DOUBLE, o / s)) ELSE 0.5::DOUBLE END) - 1 AS k FROM sf)),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(mean) AS up FROM hosts JOIN sm USING (suffix) GROUP BY domain, suffix),
df AS (SELECT sum((bad - n * up) ** 2) - sum(n * up * (1 - up)) AS o, sum((n - 1) * n * up * (1 - up)) AS s FROM d0),
dm AS (SELECT domain, (bad + k * up) / (n + k) AS mean FROM d0, (SELECT 1 / (CASE WHEN s > 0 THEN greatest(0.01::DOUBLE, least(0.9::DOUBLE, o / s)) ELSE 0.5::DOUBLE END) - 1 AS k FROM df)),
h0 AS (SELECT host, n, bad, mean AS up FROM hosts JOIN dm USING (domain)),
hf AS (SELECT sum((bad - n * up) ** 2) - sum(n * up * (1 - up)) AS o, sum((n - 1) * n * up * (1 - up)) AS s FROM h0),
hm AS (SELECT host, n + k AS total, (bad + k * up) / (n + k) AS mean FROM h0, (SELECT 1 / (CASE WHEN s > 0 THEN greatest(0.01::DOUBLE, least(0.9::DOUBLE, o / s)) ELSE 0.5::DOUBLE END) - 1 AS k FROM hf)),
rated AS (SELECT host AS site, mean, mean - sqrt(mean * (1 - mean) / (total + 1)) AS bound FROM hm),
ruled AS (SELECT page_id, host, path, mean, bound, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM sites JOIN rated USING (site))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN bound > 0.3 THEN 'block' ELSE 'allow' END AS verdict, round(mean, 6) AS bad_rate, round(bound, 6) AS bad_bound
FROM ruled
""".replace("SUFFIX_LIST", _LIST)
