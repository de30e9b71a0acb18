"""URL filter: longest rule first, then empirical-Bayes host reputation (operator 9).

Pages that a rule judges are the labelled outcomes.  Block rates are shrunk
through beta-binomial priors from the global rate to the public suffix, the
registered domain and the host; the strength of each level's prior is
estimated from the spread of its children (moments).  The public suffix is the
longest of a table (a parameter), else the last label; the registered domain
has one label more.  A page without a rule is
blocked when the lower posterior bound of its host's block rate is above the
threshold.  Only DataFrame functions are used.

Defined results: a null url or one without ``://`` has empty host and path and
is judged by the method under the empty host; the scheme is not looked at;
a host that is itself a suffix is its own domain; very long urls are read
whole; rules of equal length go by kind, then host; repeated pages each count
and are each returned; an empty table gives an empty
result; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tellgrid.llm.common import ascii_lower, cut

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Public suffixes of more than one label under which unrelated sites register (fixed values; pass a fuller table if needed).
SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph",
    "com.pk", "com.pl", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "go.jp", "gov.au",
    "gov.br", "gov.cn", "gov.in", "gov.uk", "ltd.uk", "me.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "nhs.uk",
    "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za", "plc.uk", "sch.uk",
)
#: One-sided posterior bound in standard deviations, and the block rate it must exceed.
Z, THRESHOLD = 1.645, 0.5
#: Limits of the intra-class correlation that the moments may give.
RHO_LOW, RHO_HIGH = 0.001, 0.5


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, from columns host and path."""
    rule = verdict = None
    for kind, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = (F if rule is None else rule).when(fits, F.lit(host + path))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(kind))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def suffix_and_domain(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """The public suffix of a host and its registered domain."""
    suffix, domain = F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)
    for labels in sorted({s.count(".") + 1 for s in suffixes}):
        tail = F.substring_index(host, ".", -labels)
        known = tail.isin([s for s in suffixes if s.count(".") + 1 == labels])
        suffix, domain = F.when(known, tail).otherwise(suffix), F.when(known, F.substring_index(host, ".", -labels - 1)).otherwise(domain)
    return suffix, domain


def _strength(m: Row | None) -> tuple[float, float]:
    """Prior strength (beta-binomial alpha + beta) from the moments of a level's n and k, and the pooled rate."""
    if m is None:
        return 1 / RHO_LOW - 1, 0.0
    n, p = float(m["n"]), m["k"] / m["n"]
    var, d = p * (1 - p), n - m["nn"] / n - (m["g"] - 1)
    rho = RHO_LOW if var <= 0 or d <= 0 else ((float(m["kk"]) - n * p * p) / var - (m["g"] - 1)) / d
    return 1 / min(max(rho, RHO_LOW), RHO_HIGH) - 1, p


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, z: float = Z, threshold: float = THRESHOLD, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_bound.

    Pages are read twice: for the outcomes of each host, which are written as
    a table, and for the verdicts.
    """
    url = F.col(url_col).cast("string")
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_columns(rules)
    judged = parsed.withColumn("rule", rule).withColumn("ruled", verdict)
    hosts = judged.groupBy("host").agg(F.count("ruled").alias("n"), F.count(F.when(F.col("ruled") == "block", 1)).alias("k"))
    suffix, domain = suffix_and_domain(F.col("host"), suffixes)
    hosts = cut(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    # one job for the moments of the three levels: three rows
    levels = [df.select(F.lit(i).alias("level"), "n", "k") for i, df in enumerate((tops, domains, hosts))]
    live = levels[0].unionByName(levels[1]).unionByName(levels[2]).where("n > 0")
    n, k = F.col("n").cast("double"), F.col("k").cast("double")  # squares of counts do not fit in a long
    squares = (F.sum(n * n).alias("nn"), F.sum(k * k / n).alias("kk"))
    moments = {m["level"]: m for m in live.groupBy("level").agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("k").alias("k"), *squares).collect()}
    (m1, p0), (m2, _), (m3, _) = (_strength(moments.get(i)) for i in range(3))
    sfx = tops.select("suffix", ((F.col("k") + m1 * p0) / (F.col("n") + m1)).alias("sp"))
    dom = domains.join(sfx, "suffix").select("domain", ((F.col("k") + m2 * F.col("sp")) / (F.col("n") + m2)).alias("dp"))
    a = F.col("k") + m3 * F.col("dp")
    b = F.col("n") - F.col("k") + m3 * (1 - F.col("dp"))
    post = hosts.join(dom, "domain").select(F.col("host").alias("h"), a.alias("a"), b.alias("b"))
    s = F.col("a") + F.col("b")
    bound = F.col("a") / s - z * F.sqrt(F.col("a") * F.col("b") / (s * s * (s + 1)))
    post = post.select("h", bound.alias("block_bound"))
    out = judged.join(post, F.col("host") == F.col("h"), "left")
    method = F.when(F.col("block_bound") > threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "block_bound")
