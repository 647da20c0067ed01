"""URL filter by host reputation: labelled page outcomes, shrunk through beta-binomial priors from host to domain to suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import salted, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labels that make a suffix of two with a top-level domain of two letters, and suffixes of hosting services whose
#: subdomains belong to different owners. A fuller list is an argument.
SECOND_LEVEL = ("ac", "asn", "co", "com", "edu", "firm", "gen", "go", "gob", "gouv", "gov", "govt", "gv", "id", "ind", "ltd", "me", "mil", "muni", "ne", "net", "nhs", "nic", "nom", "or", "org", "plc", "police", "res", "sch", "school")
HOSTING = ("appspot.com", "azurewebsites.net", "blogspot.com", "cloudfront.net", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "s3.amazonaws.com", "vercel.app", "web.app", "wordpress.com")
#: What stands for a suffix where the host is an IP address.
ADDRESS = "(address)"
#: A host is blocked if the lower bound of its share of bad pages (Z standard deviations below the mean) is above this.
MOST_BAD, Z = 0.5, 1.64


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the (verdict, `host/path`) rules that fits, as a struct of its length, rule and verdict, else null."""
    fitting = []
    for verdict, rule in rules:
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        fitting.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fitting)) if fitting else F.lit(None).cast("struct<size: int, rule: string, verdict: string>")


def with_domain(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """hosts (one row a host) with registered domain and suffix; the port, if any, belongs to the host only.

    suffixes: a table with the column `suffix` of further rules beside SECOND_LEVEL: `github.io`, `*.ck` (any label more) or
    `!www.ck` (an exception: the suffix is what follows its first label); the longest rule that fits counts, exceptions first.
    None: HOSTING. A host of no more labels than its suffix is its own domain. IP addresses are domains of the suffix ADDRESS.
    """
    known = hosts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in HOSTING])).alias("suffix"))
    table = known if suffixes is None else suffixes.select(F.lower("suffix").alias("suffix")).distinct()
    rules = table.where("suffix != ''").select(F.regexp_replace("suffix", r"^(!|\*\.)", "").alias("tail"), F.col("suffix").startswith("*.").cast("int").alias("more"), F.col("suffix").startswith("!").alias("except"))
    name = F.when(F.col("host").startswith("["), F.regexp_extract("host", r"^\[[^\]]*\]?", 0)).otherwise(F.regexp_extract("host", "^[^:]*", 0))
    named = hosts.withColumn("name", name).withColumn("labels", F.size(F.split("name", r"\.")))
    two = F.substring_index("name", ".", -2)
    plain = F.when(two.rlike(f"^({'|'.join(SECOND_LEVEL)})\\.[a-z]{{2}}$"), 2).otherwise(1)
    tails = named.select("host", F.col("labels").alias("n"), F.posexplode(F.transform(F.sequence(F.lit(1), F.col("labels")), lambda k: F.call_function("substring_index", F.col("name"), F.lit("."), -k))).alias("at", "tail"))
    fitting = tails.join(rules, "tail").where("more = 0 or at + 1 < n")
    longest = fitting.groupBy("host").agg(F.max(F.when(~F.col("except"), F.col("at") + 1 + F.col("more"))).alias("k"), F.max(F.when(F.col("except"), F.col("at"))).alias("e"))
    cut = named.withColumn("plain", plain).join(longest, "host", "left").withColumn("k", F.coalesce("e", F.greatest("plain", "k")))
    is_address = F.col("name").rlike(r"^(\[.*|\d{1,3}(\.\d{1,3}){3})$")
    tail = lambda k: F.call_function("substring_index", F.col("name"), F.lit("."), -k)
    return cut.select(*hosts.columns, F.when(is_address, ADDRESS).otherwise(tail(F.col("k"))).alias("suffix"), F.when(is_address, F.col("name")).otherwise(tail(F.col("k") + 1)).alias("domain"))


def strength(level: DataFrame) -> Column:
    """How many pages the prior counts for: the overdispersion of the shares around `prior`, by the method of moments."""
    share, spread = F.col("bad") / F.col("n"), F.col("prior") * (1 - F.col("prior"))
    rho = (F.sum(F.col("n") * (share - F.col("prior")) ** 2) - F.sum(spread)) / F.nullif(F.sum(spread * (F.col("n") - 1)), F.lit(0.0))
    return level.where("n > 0").select((1 / F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.coalesce(rho, F.lit(0.5)))) - 1).alias("s")).scalar()


def reputation(outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """host, n, bad, prior, mean, bound: labelled pages and bad ones, the prior mean, the posterior of each host's share of bad pages, and its lower bound.

    outcomes: host, n (labelled pages), bad. The prior of a host is its registered domain's posterior mean, whose prior is
    that of the suffix, whose prior is the mean of all. Hosts without labels get their domain's mean; with no label at
    all the mean is 0. There is one row for each host, and any number of rows of outcomes for it.
    """
    hosts = stored(with_domain(outcomes.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad")), suffixes))
    overall = hosts.select(F.coalesce(F.sum("bad") / F.nullif(F.sum("n"), F.lit(0.0)), F.lit(0.0)).alias("m")).scalar()
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("prior", overall)
    up = stored(suffixes.withColumn("s", strength(suffixes)).select("suffix", ((F.col("prior") * F.col("s") + F.col("bad")) / (F.col("s") + F.col("n"))).alias("prior")))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(up, "suffix")
    up = stored(domains.withColumn("s", strength(domains)).select("suffix", "domain", ((F.col("prior") * F.col("s") + F.col("bad")) / (F.col("s") + F.col("n"))).alias("prior")))
    single = hosts.join(up, ["suffix", "domain"])
    a, b = F.col("prior") * F.col("s") + F.col("bad"), (1 - F.col("prior")) * F.col("s") + F.col("n") - F.col("bad")
    return (
        single.withColumn("s", strength(single))
        .select("host", "n", "bad", "prior", a.alias("a"), b.alias("b"))
        .select("host", "n", "bad", "prior", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"), (F.col("a") / (F.col("a") + F.col("b")) - Z * F.sqrt(F.col("a") * F.col("b") / ((F.col("a") + F.col("b")) ** 2 * (F.col("a") + F.col("b") + 1)))).alias("bound"))
    )


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url: str = "url", suffixes: DataFrame | None = None) -> DataFrame:
    """Per page: id, host, path, rule (null if none fits), verdict (the longest rule's, else block by the host's bound), and what the
    method says of the host: labelled pages n and bad, prior, posterior mean and bound.

    outcomes: id_col and bad (0 or 1; null: unlabelled) of labelled pages; several of one page all count. Pages with a null
    id have no outcome; null URLs and those without `://` have an empty host, which is judged like any other. Every row of
    pages stays, repeated rows too; URLs of any length are read whole; other columns of pages may have any name; an empty table
    gives no rows. suffixes: see with_domain. Hosts' counts are summed before any shuffle of them; a host with very many pages is
    dealt to several places when its reputation joins its pages.
    """
    host, path = parts(F.col(url).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias(id_col), host.alias("host"), path.alias("path"))
    labelled = outcomes.where("bad is not null").groupBy(F.col(id_col).cast("long").alias(id_col)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    known = reputation(rows.join(labelled, id_col, "left").select("host", "n", "bad"), suffixes)
    judged = salted(rows, known, "host", [id_col, "path"]).withColumn("__rule", best_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("bound") > MOST_BAD, "block").otherwise("allow")
    return judged.select(id_col, "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", method).alias("verdict"), F.col("n").cast("long"), F.col("bad").cast("long"), "prior", "mean", "bound")


#: The rules of the registered query.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

_TWO, _THREE = (", ".join(f"'{x}'" for x in HOSTING if x.count(".") == k) for k in (1, 2))
_SECOND = ", ".join(f"'{x}'" for x in SECOND_LEVEL)
_FITS = " union all ".join(f"select page_id, host, path, {len(r)} as size, '{r}' as rule, '{v}' as verdict from u where (host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}')" for v, r in RULES)


def _strength(level: str) -> str:
    return f"(select 1 / greatest(0.001, least(0.999, coalesce((sum(n * pow(bad / n - prior, 2)) - sum(prior * (1 - prior))) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 0.5))) - 1 from {level} where n > 0)"


ORACLE = rf"""
with c as (select page_id, coalesce(url, '') as url from pages),
r as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from c),
u as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
l as (select doc_id as page_id, count(*) as n, sum(1 - quality) as bad from labels where quality is not null group by 1),
g as (select host, case when host like '[%' then regexp_extract(host, '^\[[^\]]*\]?') else regexp_extract(host, '^[^:]*') end as name, coalesce(sum(n), 0)::double as n, coalesce(sum(bad), 0)::double as bad from u left join l using (page_id) group by host),
h as (select *, string_split(name, '.') as names, regexp_full_match(name, '\[.*|\d{{1,3}}(\.\d{{1,3}}){{3}}') as ip from g),
k as (select *, case when array_to_string(list_slice(names, -3, -1), '.') in ({_THREE}) then 3 when array_to_string(list_slice(names, -2, -1), '.') in ({_TWO}) or (names[-2] in ({_SECOND}) and regexp_full_match(names[-1], '[a-z]{{2}}')) then 2 else 1 end as k from h),
hosts as (select host, n, bad, case when ip then name else array_to_string(list_slice(names, -k - 1, -1), '.') end as domain, case when ip then '{ADDRESS}' else array_to_string(list_slice(names, -k, -1), '.') end as suffix from k),
s0 as (select suffix, sum(n) as n, sum(bad) as bad, (select coalesce(sum(bad) / nullif(sum(n), 0), 0.0) from hosts) as prior from hosts group by suffix),
s1 as (select suffix, (prior * s + bad) / (s + n) as prior from (select *, {_strength('s0')} as s from s0)),
d0 as (select suffix, domain, sum(n) as n, sum(bad) as bad, any_value(prior) as prior from hosts join s1 using (suffix) group by suffix, domain),
d1 as (select suffix, domain, (prior * s + bad) / (s + n) as prior from (select *, {_strength('d0')} as s from d0)),
h0 as (select host, n, bad, prior from hosts join d1 using (suffix, domain)),
h1 as (select host, n, bad, prior, prior * s + bad as a, (1 - prior) * s + n - bad as b from (select *, {_strength('h0')} as s from h0)),
h2 as (select host, n, bad, prior, a / (a + b) as mean, a / (a + b) - {Z} * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) as bound from h1),
fits as (select page_id, host, path, arg_max(rule, size) as rule, arg_max(verdict, size) as verdict from ({_FITS}) group by all)
select u.page_id, u.host, u.path, fits.rule, coalesce(fits.verdict, case when bound > {MOST_BAD} then 'block' else 'allow' end) as verdict,
  cast(h2.n as bigint) as n, cast(h2.bad as bigint) as bad, round(prior, 6) as prior, round(mean, 6) as mean, round(bound, 6) as bound
from u left join h2 on u.host = h2.host left join fits on u.page_id = fits.page_id and u.host = fits.host and u.path = fits.path
"""
