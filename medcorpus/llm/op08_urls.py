"""URL filter: rules first, else the reputation of the host by empirical Bayes.

Labelled page outcomes (bad or not) are counted by host. A host's bad share is shrunk towards that of its
registered domain, that towards its suffix, and that towards the share of all pages, by beta-binomial priors
whose strengths come from the spread between the groups themselves (method of moments). A host without outcomes
has the mean of its registered domain, else of its suffix, else of all pages; its variance is that of a host drawn
from there, with every level that is not known drawn as well. A page is blocked if the lower posterior bound of its
host's bad share is above ``max_bad``. The bound is that of the normal distribution with the posterior's mean and variance.

Everything is DataFrame expressions. Counts are pre-aggregated before they are shuffled, so a host that holds
a third of all pages costs one row a task; hosts are judged once each; only three fitted strengths and one share reach the driver. The join of pages with
hosts is left to adaptive execution, which splits a hot host's pages.

Cases: very long urls are judged whole; other columns are never read; an empty table gives no rows; a null url or one without ``://`` has an empty host and path, which no rule fits; its reputation is
that of the empty host. Repeated pages are judged once each; a page's repeated labels count once, bad if any
is; null outcomes do not count. Without labels nothing is blocked but by rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medcorpus.llm.common import lower_ascii, stored, table

#: Rules of the contract: action, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Suffixes of two labels under which names are registered; any other suffix is the last label. A caller gives its own list, of whatever length, such as a public one.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
MAX_BAD = 0.25
#: Posterior standard deviations between the mean and the bound.
BOUND_Z = 1.645
#: The prior strengths are kept between these.
STRENGTHS = (1.0, 1000.0)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Index of the longest fitting rule, or null."""
    found = F.lit(None).cast("int")
    for k in sorted(range(len(rules)), key=lambda k: (len(rules[k][1] + rules[k][2]), -k)):
        _, name, start = rules[k]
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.lit(k)).otherwise(found)
    return found


def host_levels(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    two = F.substring_index(host, ".", -2)
    is_two = two.isin(*two_label)
    suffix = F.when(is_two, two).otherwise(F.substring_index(host, ".", -1))
    domain = F.when(is_two, F.substring_index(host, ".", -3)).otherwise(two)
    return domain, suffix


def _strength(groups: DataFrame, n: str, bad: str, mean: str) -> float:
    """Prior strength from the spread of groups of n about their parents' shares."""
    p = F.col(bad) / F.col(n)
    m = F.col(mean)
    row = groups.filter(F.col(n) > 1).agg(
        F.sum(F.col(n) * (p - m) * (p - m)).alias("spread"),
        F.sum(m * (1 - m)).alias("own"),
        F.sum((F.col(n) - 1) * m * (1 - m)).alias("more"),
    ).first()
    low, high = STRENGTHS
    if not row or not row["more"]:
        return high
    rho = (row["spread"] - row["own"]) / row["more"]
    return high if rho <= 1 / (high + 1) else min(high, max(low, 1 / rho - 1))


def host_reputation(outcomes: DataFrame, hosts: DataFrame | None = None, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """Per host of outcomes (host, bad 0/1), or per distinct host of hosts (host) if given: n, mean and lower bound of the posterior bad share, shrunk level by level."""
    domain, suffix = host_levels(F.col("host"), two_label)
    # one row a host with outcomes; read by every fit below
    known = stored(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.sum("bad").cast("double").alias("bad")).filter("n > 0"))
    levels = known.withColumns({"domain": domain, "suffix": suffix})
    domains = levels.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("db"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb"))
    total = suffixes.agg(F.sum("sb").alias("b"), F.sum("sn").alias("n")).first()
    any_known = bool(total and total["n"])
    up = F.lit((total["b"] + 0.5) / (total["n"] + 1) if any_known else 0.5)
    ks = _strength(suffixes.withColumn("m0", up), "sn", "sb", "m0")
    suffixes = suffixes.select("suffix", ((F.col("sb") + ks * up) / (F.col("sn") + ks)).alias("sm"))
    domains = domains.join(suffixes, "suffix")
    kd = _strength(domains, "dn", "db", "sm")
    domains = domains.select("domain", "suffix", ((F.col("db") + kd * F.col("sm")) / (F.col("dn") + kd)).alias("dm"))
    kh = _strength(levels.join(domains, ["domain", "suffix"]), "n", "bad", "dm")
    # the share of m (1 - m) that is the variance of a host drawn below a domain, a suffix, or the whole
    drawn = [1 - kh / (kh + 1), 1 - kh / (kh + 1) * kd / (kd + 1), 1 - kh / (kh + 1) * kd / (kd + 1) * ks / (ks + 1)]
    if hosts is not None:
        known = hosts.select("host").distinct().join(known, "host", "left")
    n = F.coalesce("n", F.lit(0))
    judged = known.withColumns({"domain": domain, "suffix": suffix}).join(domains, ["domain", "suffix"], "left").join(suffixes, "suffix", "left")
    mean = (F.coalesce("bad", F.lit(0.0)) + kh * F.coalesce("dm", "sm", up)) / (n + kh)
    part = F.when(n > 0, 1 / (n + kh + 1)).when(F.col("dm").isNotNull(), drawn[0]).when(F.col("sm").isNotNull(), drawn[1]).otherwise(drawn[2])
    bound = mean - BOUND_Z * F.sqrt(mean * (1 - mean) * part)
    held = lambda c: F.when(F.lit(any_known), c)
    return judged.select("host", n.alias("n"), held(mean).alias("bad_mean"), held(bound).alias("bad_bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = MAX_BAD, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_mean, bad_bound per page of pages(page_id, url); outcomes(page_id, bad)."""
    host, path = url_parts(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.filter("bad is not null and page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    # stored, so that Spark knows its size, and a hot host's pages can be split where it is too large to broadcast
    reputation = stored(host_reputation(pages.join(known, "page_id").select("host", "bad"), pages, two_label))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    pages = pages.withColumn("k", rule)
    names = F.array(*[F.lit(h + p) for _, h, p in rules])
    actions = F.array(*[F.lit(a) for a, _, _ in rules])
    by_host = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    return pages.join(reputation, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.get(names, F.col("k")).alias("rule"),
        F.coalesce(F.get(actions, F.col("k")), by_host).alias("verdict"),
        "bad_mean",
        "bad_bound",
    )


def page_outcomes(labels: DataFrame) -> DataFrame:
    """A page is bad if its label says poor quality or toxic; labels' doc_id is the page's id."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    return labels.select(F.col("doc_id").alias("page_id"), bad.cast("int").alias("bad"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), page_outcomes(table(spark, sf_dir, "labels"))).drop("bad_mean", "bad_bound")


def _oracle() -> str:
    low, high = STRENGTHS
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda f: "case " + " ".join(f"when {fits(h, p)} then '{f(a, h, p)}'" for a, h, p in order)
    strength = lambda t, n, b, m: f"""(select case when coalesce(sum(case when {n} > 1 then ({n} - 1) * {m} * (1 - {m}) end), 0) = 0 then {high}
        else (select case when rho <= 1 / ({high} + 1) then {high} else least({high}, greatest({low}, 1 / rho - 1)) end from (select
        (sum({n} * power({b} / {n} - {m}, 2)) - sum({m} * (1 - {m}))) / sum(({n} - 1) * {m} * (1 - {m})) rho from {t} where {n} > 1)) end k from {t})"""  # noqa: E731
    two = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
    return f"""with cut as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end rest from pages),
    p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from cut),
    known as (select doc_id page_id, max(case when coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1 then 1 else 0 end) bad from labels group by 1),
    h0 as (select host, count(bad) n, sum(bad)::double bad from p join known using (page_id) group by 1),
    h1 as (select *, string_split(host, '.') a, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') two from h0),
    h as (select host, n, bad, case when two in ({two}) then array_to_string(list_slice(a, -3, -1), '.') else two end domain, case when two in ({two}) then two else a[-1] end suffix from h1),
    d0 as (select domain, suffix, sum(n) dn, sum(bad) db from h group by 1, 2),
    s0 as (select suffix, sum(dn) sn, sum(db) sb from d0 group by 1),
    g as (select coalesce((sum(sb) + 0.5) / (sum(sn) + 1), 0.5) share, coalesce(sum(sn), 0) > 0 any_known from s0), s1 as (select s0.*, share m0 from s0, g),
    sk as {strength('s1', 'sn', 'sb', 'm0')}, s as (select suffix, (sb + k * m0) / (sn + k) sm from s1, sk),
    d1 as (select d0.*, sm from d0 join s using (suffix)), dk as {strength('d1', 'dn', 'db', 'sm')},
    d as (select domain, suffix, (db + k * sm) / (dn + k) dm from d1, dk),
    h2 as (select h.*, dm from h join d using (domain, suffix)), hk as {strength('h2', 'n', 'bad', 'dm')},
    ph as (select distinct host, string_split(host, '.') a, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') two from p),
    pl as (select host, case when two in ({two}) then array_to_string(list_slice(a, -3, -1), '.') else two end domain, case when two in ({two}) then two else a[-1] end suffix from ph),
    shares as (select hk.k kh, kh / (kh + 1) a, dk.k / (dk.k + 1) b, sk.k / (sk.k + 1) c, share, any_known from hk, dk, sk, g),
    r as (select pl.host, (coalesce(bad, 0) + kh * coalesce(dm, sm, share)) / (coalesce(n, 0) + kh) mean, case when n > 0 then 1 / (n + kh + 1) when dm is not null then 1 - a when sm is not null then 1 - a * b else 1 - a * b * c end part
        from pl left join h0 on h0.host = pl.host left join d on d.domain = pl.domain and d.suffix = pl.suffix left join s on s.suffix = pl.suffix, shares where any_known)
    select page_id, p.host, path, {case(lambda a, h, p: h + p)} end as rule,
    {case(lambda a, h, p: a)} when mean - {BOUND_Z} * sqrt(mean * (1 - mean) * part) > {MAX_BAD} then 'block' else 'allow' end as verdict
    from p left join r using (host)"""


QUERIES = {"op8_url_filter": op8_url_filter}
ORACLE_SQL = {"op8_url_filter": _oracle()}
