"""URL filter by empirical-Bayes host reputation, in DataFrame operations only.

Labelled page outcomes are counted by host, registered domain and suffix. Each level is shrunk towards the one above with
a beta-binomial prior whose strength comes from the spread of that level's units (method of moments): suffix towards
all pages, domain towards its suffix, host towards its domain. A host is blocked if the lower bound of its posterior rate
of bad pages (mean less z standard deviations of the beta posterior) is above a threshold. Rules override that.

The given tables label no pages, so the registered query's outcomes come from the rules: a page that a block rule fits
is bad, every other one good. A caller may pass others (`outcomes`: page_id, bad), which count alone.

Pages are counted where they are read, so a host with a third of all pages costs one row for each task. The verdicts of hosts
go back to the pages by a join that Spark may split (adaptive skew join).

Defined cases: null url or one without `://` has an empty host and path, no rule, verdict allow. Empty host:
allow. Hosts without labelled pages take their domain's shrunk rate, unknown domains their suffix's, and so on. No
labelled pages at all: allow. Very long urls are split like others. Repeated rows count each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: (host, path, verdict) of the contract.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Public suffixes of two labels that the registered domain has to respect.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.nz", "co.in", "com.cn")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Highest correlation within a unit that the few units of a level may suggest, so that a prior weighs three pages at least.
MOST_ALIKE = 0.25
LEVELS = ("host", "domain", "suffix")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    rest = F.when(url.contains("://"), F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host and path together; of equals the first) and its verdict."""
    ranked = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    name = verdict = F.lit(None).cast("string")
    for h, p, v in reversed(ranked):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def domains(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host."""
    two = F.substring_index(host, ".", -2)
    suffix = F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two), suffix


def strength(units: DataFrame, rate: float) -> float:
    """How many labelled pages the prior of these units weighs, from how far their rates spread around the rate of all."""
    spread = F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.lit(rate), 2))
    count, m, m2, q = units.where("n > 0").agg(F.count("*"), F.sum("n").cast("double"), F.sum(F.col("n") * F.col("n").cast("double")), spread).first()
    v = rate * (1 - rate)
    room = m - m2 / m - (count - 1) if count > 1 else 0
    rho = (q - v * (count - 1)) / (v * room) if room > 0 else 0.5
    return 1 / min(max(rho, 0.01), MOST_ALIKE) - 1


def judge(pages: DataFrame, outcomes: DataFrame | None = None, rules=RULES, threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, bad_rate_low for each page."""
    host, path = split_url(F.col("url"))
    seen = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    name, said = best_rule(F.col("host"), F.col("path"), rules)
    seen = seen.withColumns({"rule": name, "said": said})
    domain, suffix = domains(F.col("host"))
    if outcomes is None:
        bad = F.coalesce((F.col("said") == "block").cast("int"), F.lit(0))
        marked = seen.select("host", bad.alias("bad"))
    else:
        marked = seen.join(outcomes.select("page_id", "bad"), "page_id", "left").select("host", "bad")
    hosts = durable(
        marked.groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
        .where("host <> ''")
        .withColumns({"domain": domain, "suffix": suffix})
    )
    units = {"host": hosts, "domain": hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "suffix": hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))}
    n, k = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    rate = (k + 0.5) / (n + 1.0)
    weigh = {level: strength(units[level], rate) for level in LEVELS}

    def shrunk(prior: Column, level: str) -> Column:
        return ((F.col("k") + weigh[level] * prior) / (F.col("n") + weigh[level])).alias(f"m_{level}")

    suffixes = units["suffix"].select("suffix", shrunk(F.lit(rate), "suffix"))
    in_domain = units["domain"].join(suffixes, "suffix").select("domain", shrunk(F.col("m_suffix"), "domain"))
    a = F.col("k") + weigh["host"] * F.col("m_domain")
    b = F.col("n") - F.col("k") + weigh["host"] * (1 - F.col("m_domain"))
    judged = durable(
        units["host"].join(in_domain, "domain").withColumns({"a": a, "b": b})
        .withColumn("bad_rate", F.col("a") / (F.col("a") + F.col("b")))
        .withColumn("bad_rate_low", F.col("bad_rate") - z * F.sqrt(F.col("a") * F.col("b") / (F.pow(F.col("a") + F.col("b"), 2) * (F.col("a") + F.col("b") + 1))))
        .select("host", "bad_rate", "bad_rate_low")
    )
    learned = F.when(F.col("bad_rate_low") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return seen.join(judged, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("said", learned).alias("verdict"), "bad_rate", "bad_rate_low")


def oracle(rules=RULES, threshold: float = 0.5, z: float = 1.645) -> str:
    """The same in DuckDB's SQL."""
    ranked = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{what(h, p, v)}'" for h, p, v in ranked) + " END"
    twos = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
    levels = "".join(
        f""", v_{x} AS (SELECT CASE WHEN sum(n) - sum(n * n) / sum(n) - (count(*) - 1) > 0 AND count(*) > 1 THEN
          (sum(n * (k / n - p) ** 2) - max(p * (1 - p)) * (count(*) - 1)) / (max(p * (1 - p)) * (sum(n) - sum(n * n) / sum(n) - (count(*) - 1))) ELSE 0.5 END AS rho FROM u_{x}, rate WHERE n > 0),
        s_{x} AS (SELECT 1 / least(greatest(rho, 0.01), {MOST_ALIKE}) - 1 AS s FROM v_{x})"""
        for x in LEVELS
    )
    return f"""
WITH split AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
seen AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
ruled AS (SELECT *, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS said FROM seen),
u_host AS (SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS two, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (said = 'block') AS DOUBLE) AS k FROM ruled WHERE host <> '' GROUP BY host),
h AS (SELECT *, CASE WHEN two IN ({twos}) THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE two END AS domain, CASE WHEN two IN ({twos}) THEN two ELSE string_split(host, '.')[-1] END AS suffix FROM u_host),
u_domain AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain, suffix),
u_suffix AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY suffix),
rate AS (SELECT (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS p FROM h){levels},
m_suffix AS (SELECT suffix, (k + s * p) / (n + s) AS m FROM u_suffix, s_suffix, rate),
m_domain AS (SELECT domain, (d.k + s * m) / (d.n + s) AS m FROM u_domain d JOIN m_suffix USING (suffix), s_domain),
ab AS (SELECT host, k + s * m AS a, n - k + s * (1 - m) AS b FROM h JOIN m_domain USING (domain), s_host),
judged AS (SELECT host, a / (a + b) - {z} * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) AS low FROM ab)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN low > {threshold} THEN 'block' ELSE 'allow' END) AS verdict FROM ruled LEFT JOIN judged USING (host)
"""
