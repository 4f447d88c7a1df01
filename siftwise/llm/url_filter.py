"""URL filter by host reputation (empirical Bayes), DataFrame functions only.

Labelled page outcomes (bad or not) are counted per host, registered domain and
suffix.  Each level's bad rate is shrunk towards its parent by a beta-binomial
prior: with parent mean ``m`` and strength ``s`` the posterior of a node with
``bad`` of ``n`` labelled pages is Beta(m*s + bad, (1-m)*s + n - bad).  The
strength of a level is estimated from the data by the method of moments over its
nodes.  Every host of a page has a posterior: without a labelled page of its own it is its
domain's prior, without one of its domain its suffix's, else the whole table's.  A page is
blocked when the lower posterior bound of its host's bad rate (mean - z * sd, z = 1.645:
one in twenty) is above ``block_times`` the rate of all labelled pages, that is when the
host is worse than the table beyond doubt; explicit rules go first.

Every count is a partial aggregate, so a host with a third of all pages costs one
row per task.  The table of nodes is joined to the pages by host; Spark splits a
hot host's side when it is skewed (the node side has one row per host).

Rows: null urls and urls without ``://`` have host and path '' and no rule; labels say
nothing of the host '', which has the table's prior.  IP addresses are their own domain
and suffix.  Repeated rows are each judged.
Labels: null outcomes are ignored, repeated labels count once each.  An empty
label table blocks nothing but by rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, read, saved
from .registry import query

# Fixed values of the contract: (verdict, host, path).
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
# Second-level labels under which names are registered (with a two-letter country code).
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "or", "org"]

Z = 1.645
BLOCK_TIMES = 1.0
IP = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])$"
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1e6


def _parts(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(u, pattern, 1)), F.regexp_extract(u, pattern, 2)


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """Name of the longest rule that fits (host and its subdomains, path prefix), else null."""
    out = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(h + p)).otherwise(out)
    return out


def _names(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host without port and user: the last labels (an address is its own)."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    ip = name.rlike(IP)
    labels = F.split(name, r"\.")
    n = F.size(labels)
    two = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, F.greatest(F.lit(-2), -n)).isin(SECOND_LEVEL)
    depth = F.when(two, 2).otherwise(1)
    cut = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), F.least(k, n)), ".")
    return F.when(ip, name).otherwise(cut(depth + 1)), F.when(ip, name).otherwise(cut(depth))


def _strength(nodes: DataFrame) -> float:
    """Prior strength of a level by the method of moments (one row to the driver).

    With node rates p_i = bad_i/n_i around parent means m_i, the expected
    n-weighted squared deviation is sum v_i (1 + (n_i - 1) rho), v = m(1-m),
    rho = 1/(s+1); solved for rho."""
    v = F.col("m") * (1 - F.col("m"))
    dev = F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2)
    r = nodes.where("n > 0").agg(F.sum(dev).alias("dev"), F.sum(v).alias("v"), F.sum(v * (F.col("n") - 1)).alias("vn")).first()
    if not r["vn"]:
        return MIN_STRENGTH
    rho = (r["dev"] - r["v"]) / r["vn"]
    return min(max(1 / rho - 1, MIN_STRENGTH), MAX_STRENGTH) if rho > 0 else MAX_STRENGTH


def reputation(hosts: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, float]:
    """(one row per host of ``hosts``: (host, rep_mean, rep_low, rep_labelled); bad rate of all outcomes).

    ``outcomes``: (host, bad 0/1).  ``rep_low`` is the lower posterior bound of the host's bad
    rate.  The host counts are kept in the shared folder, as four levels read them."""
    domain, suffix = _names(F.col("host"))
    counts = (outcomes.where("bad is not null and host <> ''").groupBy("host")
              .agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("double")).alias("bad")))
    host = saved(hosts.select("host").distinct().join(counts, "host", "left")
                 .select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0.0)).alias("bad"))
                 .withColumn("domain", domain).withColumn("suffix", suffix))
    up = lambda df, *key: df.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = host.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad")).first()
    mean = (total["bad"] + 0.5) / (total["n"] + 1)

    def shrink(nodes: DataFrame) -> DataFrame:
        """nodes(n, bad, m = parent mean) -> with (a, b) of the posterior and its mean."""
        s = _strength(nodes)
        a = F.col("m") * s + F.col("bad")
        b = (1 - F.col("m")) * s + F.col("n") - F.col("bad")
        return nodes.withColumn("a", a).withColumn("b", b).withColumn("mean", a / (a + b))

    suf = shrink(up(host, "suffix").withColumn("m", F.lit(mean)))
    dom = shrink(up(host, "domain", "suffix").join(suf.select("suffix", F.col("mean").alias("m")), "suffix"))
    host = shrink(host.join(dom.select("domain", "suffix", F.col("mean").alias("m")), ["domain", "suffix"]))
    sd = F.sqrt(F.col("a") * F.col("b") / (F.pow(F.col("a") + F.col("b"), 2) * (F.col("a") + F.col("b") + 1)))
    return host.select("host", F.col("mean").alias("rep_mean"),
                       F.greatest(F.col("mean") - Z * sd, F.lit(0.0)).alias("rep_low"),
                       F.col("n").alias("rep_labelled")), mean


def url_filter(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url",
               label_id: str = "doc_id", bad: Column | None = None, rules=RULES,
               block_times: float = BLOCK_TIMES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, rep_mean, rep_low, rep_labelled.

    ``labels`` rows belong to the page with the same id; ``bad`` is their outcome
    (default: low quality or toxic)."""
    if bad is None:
        bad = F.when(F.col("quality").isNull() & F.col("toxic").isNull(), F.lit(None)).otherwise(
            ((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).cast("int"))
    host, path = _parts(F.col(url))
    p = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    marks = labels.select(F.col(label_id).alias("page_id"), bad.alias("bad")).where("bad is not null")
    rep, mean = reputation(p, p.join(marks, "page_id").select("host", "bad"))
    rule = rule_column(F.col("host"), F.col("path"), rules)
    by_rule = F.lit(None).cast("string")
    for verdict, h, q in rules:
        by_rule = F.when(F.col("rule") == h + q, F.lit(verdict)).otherwise(by_rule)
    judged = F.when(F.col("rep_low") > block_times * mean, F.lit("block")).otherwise(F.lit("allow"))
    return (p.join(rep, "host", "left")
            .withColumn("rule", rule).withColumn("verdict", F.coalesce(by_rule, judged))
            .select("page_id", "host", "path", "rule", "verdict", "rep_mean", "rep_low", "rep_labelled"))


def _sql() -> str:
    """The whole query in SQL: rules, counts, strengths and posteriors."""
    from .common import LOWER, UPPER

    def strength(nodes: str) -> str:
        return f"""(SELECT CASE WHEN vn = 0 OR vn IS NULL THEN {MIN_STRENGTH} WHEN rho > 0 THEN least(greatest(1 / rho - 1, {MIN_STRENGTH}), {MAX_STRENGTH})
            ELSE {MAX_STRENGTH} END::DOUBLE FROM (SELECT sum(m * (1 - m) * (n - 1)) AS vn,
            (sum(n * pow(bad / n - m, 2)) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0) AS rho FROM {nodes} WHERE n > 0))"""

    def shrunk(name: str, nodes: str) -> str:
        return f"""{name} AS (SELECT *, a / (a + b) AS mean FROM (
  SELECT *, m * {strength(nodes)} + bad AS a, (1 - m) * {strength(nodes)} + n - bad AS b FROM {nodes}))"""

    rule, verdict = "NULL", "NULL"
    for v, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        rule = f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}' ELSE {rule} END"
        verdict = f"CASE WHEN rule = '{h}{p}' THEN '{v}' ELSE {verdict} END"
    parts = "'(?s)^.*?://([^/?#]*)([^?#]*)'"
    second = ", ".join(f"'{x}'" for x in SECOND_LEVEL)
    return f"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), {parts}, 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), {parts}, 2) AS path FROM pages),
marks AS (
  SELECT doc_id, (coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1)::INTEGER AS bad FROM labels
  WHERE quality IS NOT NULL OR toxic IS NOT NULL),
h0 AS (SELECT host, count(bad) FILTER (WHERE host <> '') AS n, coalesce(sum(bad) FILTER (WHERE host <> ''), 0)::DOUBLE AS bad
       FROM p LEFT JOIN marks ON page_id = doc_id GROUP BY host),
h1 AS (SELECT *, string_split(name, '.') AS parts, regexp_matches(name, '{IP}') AS ip
       FROM (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':\\d*$', '') AS name FROM h0)),
h2 AS (SELECT *, len(parts) AS k, CASE WHEN len(parts) >= 3 AND length(parts[-1]) = 2 AND parts[-2] IN ({second}) THEN 2 ELSE 1 END AS depth FROM h1),
h3 AS (SELECT host, n, bad, CASE WHEN ip THEN name ELSE array_to_string(parts[greatest(k - depth, 1):k], '.') END AS domain,
              CASE WHEN ip THEN name ELSE array_to_string(parts[greatest(k - depth + 1, 1):k], '.') END AS suffix FROM h2),
top AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1)::DOUBLE AS m FROM h3),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT m FROM top) AS m FROM h3 GROUP BY suffix),
{shrunk('s1', 's0')},
d0 AS (SELECT domain, h3.suffix, sum(h3.n) AS n, sum(h3.bad) AS bad, any_value(s1.mean) AS m FROM h3 JOIN s1 ON h3.suffix = s1.suffix GROUP BY domain, h3.suffix),
{shrunk('d1', 'd0')},
h4 AS (SELECT h3.host, h3.n, h3.bad, d1.mean AS m FROM h3 JOIN d1 ON h3.domain = d1.domain AND h3.suffix = d1.suffix),
{shrunk('h5', 'h4')},
rep AS (SELECT host, n, mean, greatest(mean - {Z} * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))), 0.0) AS low FROM h5),
r AS (SELECT *, {rule} AS rule FROM (SELECT p.*, rep.mean, rep.low, rep.n FROM p LEFT JOIN rep ON p.host = rep.host))
SELECT page_id, host, path, rule,
       coalesce({verdict}, CASE WHEN low > {BLOCK_TIMES} * (SELECT m FROM top) THEN 'block' ELSE 'allow' END) AS verdict,
       round(mean, 6) AS rep_mean, round(low, 6) AS rep_low, n::BIGINT AS rep_labelled
FROM r"""


@query("op8_url_filter", _sql())
def op8_url_filter(spark, sf_dir):
    """Every page's verdict; outcomes are the labels with the page's id."""
    out = url_filter(read(spark, sf_dir, "pages", "page_id", "url"),
                     read(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    return out.withColumn("rep_mean", F.round("rep_mean", 6)).withColumn("rep_low", F.round("rep_low", 6))
