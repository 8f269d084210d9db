"""URL rules with link-graph propagation.

A rule names a host and a path; it fits the host and its subdomains where the url's path starts with the rule's, and the
longest rule decides. Urls without a rule are judged by their host: trust flows along the edges of a host graph from hosts
whose pages the rules allow (personalised PageRank), distrust flows against them from hosts whose pages the rules block. Both
start from the share of the host's pages so ruled:

    trust = seed + damping * sum over linking hosts of the part of their trust that they deal here
    distrust = seed + damping * sum over linked hosts of the part of their distrust that they deal here

(What hosts without edges do not deal is lost; up to a factor common to all hosts that is the walk that goes back to its seeds there.)
A host is blocked where its distrust reaches the threshold and exceeds its trust.

Edges between hosts are of two kinds. Links: absolute urls anywhere in a page, hrefs and srcs without a scheme (//host/path),
and relative hrefs of pages with a <base> on another host, counted by pair of hosts; links inside a host do not count.
Kin: a host and its parent domain, down to two labels. A host deals the share `kin` of its score evenly to its kin and the rest
over its links by their counts. A host without kin deals all over its links; a parent domain that is known as such only
deals all to its kin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm import common

#: (verdict, rule), host before the first slash, path from it on.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Absolute urls, urls without a scheme, relative hrefs, and the base of a page.
ABSOLUTE = r"""(?i)\bhttps?:(//[^"'\s<>)]+)"""
SCHEMELESS = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(//[^"'\s<>]+)"""
RELATIVE = r"""(?i)\bhref\s*=\s*["']?\s*(?![a-z][a-z0-9+.-]*:|//|#)[^"'\s<>]"""
BASE = r"""(?i)<base\s[^<>]*?\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s<>]+)"""
#: Rows of one host that a join may send to one task.
FAN = 50_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or where :// is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Add host, path, rule and ruling (null where no rule fits)."""
    host, path = split_url(F.col("url").cast("string"))
    pages = pages.withColumn("host", host).withColumn("path", path)
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + start)
        rule, ruling = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruling)
    return pages.withColumn("rule", rule).withColumn("ruling", ruling)


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, links: how often pages of one host link to another. Pages need columns host and html."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    host_of = lambda url: split_url(F.concat(F.lit(":"), F.regexp_replace(url, "^(?i)https?:", "")))[0]
    urls = F.concat(F.regexp_extract_all(html, F.lit(ABSOLUTE), F.lit(1)), F.regexp_extract_all(html, F.lit(SCHEMELESS), F.lit(1)))
    rows = pages.select(F.col("host").alias("src"), html.alias("html"), F.regexp_extract(html, BASE, 1).alias("base"))
    named = rows.select("src", F.explode(F.transform(urls, host_of)).alias("dst"), F.lit(1).alias("n"))
    based = rows.where("base <> ''").select("src", host_of(F.col("base")).alias("dst"), F.regexp_count("html", F.lit(RELATIVE)).alias("n"))
    rows = named.unionByName(based).where("src <> '' and dst <> '' and src <> dst and n > 0")
    return rows.groupBy("src", "dst").agg(F.sum("n").alias("links"))


def kinships(hosts: DataFrame) -> DataFrame:
    """(giver, host): each host and parent domain with its parent domain, both ways. Ports do not count; addresses have no kin."""
    name = F.regexp_replace("host", ":[0-9]*$", "")
    labels = F.split(name, "[.]")
    rows = hosts.where("host <> ''").select("host", name.alias("name"), labels.alias("labels")).where(~F.col("name").rlike("^[0-9.]*$|^\\[|^[.]|[.][.]|[.]$"))
    suffix = lambda i: F.array_join(F.slice("labels", i, F.size("labels")), ".")
    steps = rows.where(F.size("labels") > 2).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("labels") - 2), lambda i: F.struct(suffix(i).alias("low"), suffix(i + 1).alias("high")))).alias("p"))
    up = steps.select("p.low", "p.high").unionByName(rows.where("host <> name").select(F.col("host").alias("low"), F.col("name").alias("high"))).distinct()
    return up.select(F.col("low").alias("giver"), F.col("high").alias("host")).unionByName(up.select(F.col("high").alias("giver"), F.col("low").alias("host")))


def host_edges(hosts: DataFrame, links: DataFrame, kin: float) -> DataFrame:
    """(kind, giver, host, part): what part of its trust or distrust a host deals to another, before damping."""
    seen = common.staged(hosts.select("host").unionByName(links.select(F.explode(F.array("src", "dst")).alias("host"))).distinct(), "host-names")
    related = common.staged(kinships(seen), "kinships")
    degree = common.staged(related.groupBy("giver").agg(F.count(F.lit(1)).alias("n")).join(seen.select(F.col("host").alias("giver"), F.lit(kin).alias("share")), "giver", "left"), "kin-degrees")
    forth = links.select(F.lit("trust").alias("kind"), F.col("src").alias("giver"), F.col("dst").alias("host"), "links")
    back = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("giver"), F.col("src").alias("host"), "links")
    dealt = common.staged(forth.unionByName(back), "links-both")
    total = dealt.groupBy("kind", "giver").agg(F.sum("links").alias("all")).join(degree.select("giver", "share"), "giver", "left")
    linked = fanned(dealt, total, ["kind", "giver"], "host").select("kind", "giver", "host", ((1 - F.coalesce("share", F.lit(0.0))) * F.col("links") / F.col("all")).alias("part"))
    related = fanned(related, degree.select("giver", (F.coalesce("share", F.lit(1.0)) / F.col("n")).alias("part")), ["giver"], "host")
    both = related.select(F.explode(F.array(F.lit("trust"), F.lit("distrust"))).alias("kind"), "giver", "host", "part")
    return linked.unionByName(both)


def fanned(rows: DataFrame, table: DataFrame, keys: list[str], by: str, how: str = "inner", fan: int = FAN) -> DataFrame:
    """rows joined to table (one row for each value of keys); rows of a key with more than `fan` of them are spread by a hash of `by`.

    rows should be cheap to count. Heavy keys are at most one for each `fan` rows.
    """
    heavy = common.staged(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / fan).alias("_n")).where("_n > 1"), "heavy-keys")
    if not heavy.limit(1).count():
        return rows.join(table, keys, how)
    heavy, salts = common.small(heavy), F.coalesce("_n", F.lit(1))
    left = rows.join(heavy, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts)).drop("_n")
    right = table.join(heavy, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_n")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int, damping: float) -> DataFrame:
    """(kind, host, score): score = seed + damping * sum over (giver, host, part) of part * the giver's score, after `rounds` rounds.

    Edges of a hub are spread over tasks once, and its score goes to each of them.
    """
    edges = common.staged(edges.select("kind", "giver", "host", (damping * F.col("part")).alias("part")), "host-edges")
    heavy = common.staged(edges.groupBy("kind", "giver").agg(F.ceil(F.count(F.lit(1)) / FAN).alias("n")).where("n > 1"), "hubs")
    hubs, keys, score = heavy.limit(1).count(), ["kind", "giver"], seeds
    if hubs:
        heavy, salts = common.small(heavy), F.coalesce("n", F.lit(1))
        edges = common.staged(edges.join(heavy, keys, "left").withColumn("salt", F.pmod(F.xxhash64("host"), salts)).drop("n"), "host-edges")
    for i in range(rounds):
        givers = score.withColumnRenamed("host", "giver")
        if hubs:
            givers = givers.join(heavy, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("n")
        given = edges.join(givers, [*keys, "salt"] if hubs else keys).select("kind", "host", (F.col("part") * F.col("score")).alias("score"))
        score = seeds.unionByName(given).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if i % 4 == 3 or i == rounds - 1:
            score = common.staged(score, "host-scores")
    return score


def judge(pages: DataFrame, rules: tuple = RULES, damping: float = 0.85, rounds: int = 12, threshold: float = 1 / 3, kin: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of each row. Null urls have the empty host, which has no edges.

    Null html has no links. Repeated rows and null ids stay rows of their own; other columns are not read, whatever their
    names; an empty table gives no rows. Hosts with many pages or many edges are spread over tasks.
    """
    rows = ruled(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), rules)
    share = lambda v: F.avg(F.when(F.col("ruling") == v, 1.0).otherwise(0.0))
    hosts = common.staged(rows.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")), "hosts")
    links = common.staged(host_links(rows), "host-links")
    seeds = hosts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), "host", F.col(k).alias("score")) for k in ("trust", "distrust")])).alias("s")).select("s.*").where("score > 0")
    found = propagate(common.staged(seeds, "host-seeds"), host_edges(hosts, links, kin), rounds, damping)
    score = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k)
    scores = hosts.select("host").join(found.groupBy("host").agg(score("trust"), score("distrust")), "host", "left").na.fill(0.0, ["trust", "distrust"])
    out = fanned(rows.drop("html"), scores, ["host"], "page_id", "left")
    blocked = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    verdict = F.coalesce("ruling", F.when(blocked, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
