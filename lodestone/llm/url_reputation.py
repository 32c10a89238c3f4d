"""URL filter by host reputation (empirical Bayes), with block and allow rules above it.

Labelled page outcomes (1 = bad) are counted by host. Each level borrows strength from the one above through a beta-binomial
prior: suffix from all pages, registered domain from suffix, host from registered domain. The prior's mean is the parent's
posterior mean; its strength comes from the spread of the children's rates (moments). A host is blocked if the lower bound
of its posterior bad rate, ``mean - z * sd``, is above ``excess`` times the bad rate of all labelled pages: it must be credibly
worse than the whole. Where outcomes do not differ by host, nothing is blocked but by a rule.

The hierarchy ignores a user name, a port and a final dot. Suffix: the last label, or the last two if they are one of
``SECOND_LEVEL``; registered domain: the suffix and one label more; a numeric address is its own domain below the suffix
``ADDRESS``. A null URL or one without ``://`` has an empty host and path. Hosts without labelled pages get their domain's
posterior; without any outcomes the posterior is one half with the strongest prior. Null ids and repeated rows are judged row
by row; several outcomes of one page count once, as the worst; outcomes of unknown pages and null ones count for nothing. An
empty table gives no rows. Extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.durable import written
from lodestone.sources import table

#: (verdict, host, path): a rule fits the host and its subdomains if the URL's path starts with the rule's path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
EXCESS, Z = 1.0, 1.645
#: Common public suffixes of two labels. A caller with the whole public list passes it.
SECOND_LEVEL = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "ne.jp", "or.jp", "org.au", "org.uk")
ADDRESS = "(address)"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/ ? #``, ASCII lower case; empty for null."""
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #``; empty for null."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def hierarchy(host: Column, second_level=SECOND_LEVEL) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "\\.?(:[0-9]*)?$", "")
    address = name.rlike("^([0-9]+(\\.[0-9]+){3}|\\[.*)$")
    two = F.substring_index(name, ".", -2)
    double = two.isin(*second_level)
    domain = F.when(address, name).when(double, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, F.when(address, ADDRESS).when(double, two).otherwise(F.substring_index(name, ".", -1))


def _prior_strength(children: DataFrame) -> float:
    """The beta prior's strength by moments of the children's rates (columns n, b), kept within 1 to 10,000."""
    off = F.when(F.col("n") > 0, F.col("b") * F.col("b") / F.col("n"))  # the sum of n (b/n - p)^2 is that of b^2/n less p^2 n
    total = children.agg(F.sum("n"), F.sum("b"), F.sum(F.col("n") * F.col("n")), F.count("*"), F.sum(off)).first()
    n, b, squares, k, parts = (float(x or 0) for x in total)
    p = b / max(n, 1.0)
    between = (parts - p * p * n - (k - 1) * p * (1 - p)) / max(n - squares / max(n, 1.0), 1.0)
    strength = p * (1 - p) / between - 1 if between > 1e-12 and 0 < p < 1 else 10000.0
    return round(min(max(strength, 1.0), 10000.0), 3)


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, n, b, mean, sd, overall) of each host: labelled pages, bad ones, the posterior of its bad rate, and the bad rate of all.

    ``outcomes``: (page_id, bad). The posterior never reads the pages again: all levels come from the written per-host counts, and
    only the strengths of the three priors and the overall rate pass through the driver.
    """
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    counts = (
        pages.select("page_id", host_of(F.col("url")).alias("host")).join(known, "page_id", "left")
        .groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("b"))
    )
    domain, suffix = hierarchy(F.col("host"))
    hosts = written(counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "b"), "hosts")
    domains = written(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("b").alias("b")), "domains")
    suffixes = written(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b")), "suffixes")
    every = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    overall = (every[1] + 1) / (every[0] + 2)
    strengths = [_prior_strength(x) for x in (suffixes, domains, hosts)]

    def mean(prior, k: float):
        return (F.col("b") + k * prior) / (F.col("n") + k)

    s = suffixes.select("suffix", mean(F.lit(overall), strengths[0]).alias("above"))
    d = domains.join(s, "suffix").select("suffix", "domain", mean(F.col("above"), strengths[1]).alias("above"))
    h = hosts.join(written(d, "domain_means"), ["suffix", "domain"]).select("host", "n", "b", mean(F.col("above"), strengths[2]).alias("mean"))
    return h.select("host", "n", "b", "mean", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + strengths[2] + 1)).alias("sd"), F.lit(overall).alias("overall"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, excess: float = EXCESS, z: float = Z) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, bound): a rule's verdict, else block where bound > excess * overall rate.

    The table of hosts is written first, so the join picks its strategy by the real size and splits a hot host.
    """
    hosts = written(reputation(pages, outcomes).select("host", "mean", "overall", (F.col("mean") - z * F.col("sd")).alias("bound")), "reputation")
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).join(hosts, "host", "left")
    hit = rule_of(F.col("host"), F.col("path"), rules)
    return judged.select(
        "page_id", "host", "path", hit["rule"].alias("rule"),
        F.coalesce(hit["verdict"], F.when(F.col("bound") > excess * F.col("overall"), "block").otherwise("allow")).alias("verdict"),
        F.col("mean").alias("bad_rate"), "bound",
    )


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged; ``labels`` of the page's id give the outcome: bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull(), 0)
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return filter_urls(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


SQL = f"""
WITH known AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL THEN 0 END) AS bad FROM labels
  WHERE doc_id IS NOT NULL GROUP BY doc_id),
parts AS (SELECT page_id,
  coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
named AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS name FROM parts),
labelled AS (SELECT *, array_to_string(list_slice(string_split(name, '.'), -2, -1), '.') AS two, regexp_matches(name, '^([0-9]+(\\.[0-9]+){{3}}|\\[.*)$') AS address FROM named),
hosts AS (SELECT host,
  CASE WHEN address THEN name WHEN two IN {SECOND_LEVEL} THEN array_to_string(list_slice(string_split(name, '.'), -3, -1), '.') ELSE two END AS domain,
  CASE WHEN address THEN '{ADDRESS}' WHEN two IN {SECOND_LEVEL} THEN two ELSE string_split(name, '.')[-1] END AS suffix,
  count(bad) AS n, coalesce(sum(bad), 0) AS b FROM labelled LEFT JOIN known ON page_id = doc_id GROUP BY 1, 2, 3),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(b) AS b FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM hosts GROUP BY 1),
levels AS (SELECT 'h' AS lev, n, b FROM hosts UNION ALL SELECT 'd', n, b FROM domains UNION ALL SELECT 's', n, b FROM suffixes),
tot AS (SELECT lev, sum(n) AS N_, sum(b) AS B_, sum(n * n) AS N2, count(*) AS k, sum(b) / greatest(sum(n), 1) AS p FROM levels GROUP BY lev),
spread AS (SELECT lev, N_, N2, k, p, sum(CASE WHEN n > 0 THEN n * pow(b / n - p, 2) ELSE 0.0 END) AS S
  FROM levels JOIN tot USING (lev) GROUP BY ALL),
strength AS (SELECT lev, p, (S - (k - 1) * p * (1 - p)) / greatest(N_ - N2 / greatest(N_, 1), 1.0) AS v FROM spread),
kk AS (SELECT lev, round(least(greatest(CASE WHEN v > 0 AND p > 0 AND p < 1 THEN p * (1 - p) / v - 1 ELSE 10000.0 END, 1.0), 10000.0), 3) AS K FROM strength),
p0 AS (SELECT (sum(b) + 1) / (sum(n) + 2) AS p0 FROM hosts),
s AS (SELECT suffix, (b + K * p0) / (n + K) AS m FROM suffixes, kk, p0 WHERE lev = 's'),
d AS (SELECT suffix, domain, (domains.b + K * s.m) / (domains.n + K) AS m FROM domains JOIN s USING (suffix), kk WHERE lev = 'd'),
h AS (SELECT host, (h.b + K * d.m) / (h.n + K) AS m, h.n + K AS a FROM hosts h JOIN d USING (suffix, domain), kk WHERE lev = 'h'),
bound AS (SELECT host, m - {Z} * sqrt(m * (1 - m) / (a + 1)) AS bound, {EXCESS} * p0 AS most FROM h, p0),
ruled AS (SELECT page_id, host, path, bound, most, CASE
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts LEFT JOIN bound USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN bound > most THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
