"""URL filters: path rules first, then trust and distrust spread over the host graph.

A rule (verdict, host, path) fits a url when the url's host is the rule's host or below it and the url's path begins
with the rule's path; the longest fitting rule decides.  Other urls are decided by their host: hosts with allowed pages
send out trust along links (personalised PageRank), hosts with blocked pages send distrust against the links, and a
host is blocked when its distrust is at least ``least / units`` of what one seed page sends out and its share of all
distrust exceeds its share of all trust.  Both are relative, so a graph and many copies of it get the same verdicts.

Edges lead from a page's host to the hosts of the absolute links in its html, and both ways between a host and the
domain above it, since a domain answers for its subdomains.  That chain ends at the registrable domain: a name that
stands in ``suffixes`` or has one label (`co.uk`, `github.io`, `org`) belongs to a registry, and hosts below it have
nothing to do with each other.  Every seed page sends out ``units``, which are passed on in whole numbers, so results do not
depend on the order of additions or on what else is in the table.  After ``rounds`` rounds, links further away than
that have no say.  The reported trust and distrust are in seed pages.

A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed.  Repeated rows are judged
alike and count as pages of their own for the seeds.  An empty table gives no rows; without any seed, all is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.attach import attach
from panelweave.sources.staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)href\s*=\s*["']?([a-z][a-z0-9+.-]*://[^\s"'<>]+)"""


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# Names of several labels below which registries or hosting services let anyone register.
SUFFIXES = (
    "ac.jp", "ac.uk", "appspot.com", "azurewebsites.net", "blogspot.com", "cloudfront.net", "co.il", "co.in", "co.jp", "co.kr", "co.nz",
    "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.hk", "com.mx", "com.my", "com.ph", "com.pl",
    "com.sg", "com.tr", "com.tw", "com.ua", "edu.au", "edu.cn", "fly.dev", "github.io", "gitlab.io", "go.jp", "gov.au", "gov.br",
    "gov.cn", "gov.uk", "herokuapp.com", "livejournal.com", "ltd.uk", "me.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz",
    "netlify.app", "nhs.uk", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za", "pages.dev", "plc.uk",
    "readthedocs.io", "s3.amazonaws.com", "sch.uk", "substack.com", "tumblr.com", "vercel.app", "web.app", "weebly.com", "wixsite.com",
    "wordpress.com", "workers.dev",
)


@dataclass(frozen=True)
class Spread:
    """Units that a seed page sends out, share passed on in percent, rounds, the least distrust in units that blocks, and
    the names below which domains are registered; the edges of a host with more than ``hub`` of a kind are salted."""

    units: int = 10**12
    passed: int = 85
    rounds: int = 10
    least: int = 10**6
    suffixes: tuple[str, ...] = SUFFIXES
    hub: int = 20_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?`` or ``#``, A-Z in lower case; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """``pages`` (page_id, url, ...) with host, path, rule and the rule's verdict; both null where no rule fits."""
    out = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        below = (F.col("host") == r.host) | F.col("host").endswith("." + r.host)
        fits = below & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("verdict", verdict)


def host_edges(hosts: DataFrame, links: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Distinct edges (src, dst): ``links``, and both ways between each host and the domains above it that are no suffix."""
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    chain = hosts.filter(F.size(labels) >= 3).select(domains.alias("d"))
    up = chain.select(F.explode(F.arrays_zip(F.expr("slice(d, 1, size(d) - 1)").alias("src"), F.expr("slice(d, 2, size(d) - 1)").alias("dst"))).alias("e"))
    up = up.select("e.src", "e.dst").distinct()
    if suffixes:
        up = up.filter(~F.col("dst").isin(*suffixes) & ~F.col("src").isin(*suffixes))
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return links.select("src", "dst").unionByName(up).unionByName(down).filter("src <> dst and src <> '' and dst <> ''").distinct()


#: Weights: whole numbers for up to 10**16 seed pages of 10**12 units.
WEIGHT = "decimal(28,0)"


def _share(of: int) -> Column:
    """``weight * of div 100``, in whole numbers."""
    whole = F.col("weight") * F.lit(of)
    return ((whole - whole % 100) / 100).cast(WEIGHT)


def propagate(edges: DataFrame, seeds: DataFrame, spread: Spread) -> DataFrame:
    """(host, trust, distrust, blocked) after ``spread.rounds`` rounds from ``seeds`` (host, kind, pages).

    The edges of a hub are dealt over salted copies of its key, so no task holds them all.
    """
    flows = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"))
    flows = flows.unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to")))
    degree = flows.groupBy("kind", "host").agg(F.count(F.lit(1)).alias("degree"))
    degree = stage(degree.withColumn("copies", F.expr(f"(degree div {spread.hub}) + 1").cast("int")), "host-degrees")
    hubs = degree.filter("copies > 1").select("kind", "host", "copies")
    salted = flows.join(hubs, ["kind", "host"], "left").withColumn("salt", F.pmod(F.xxhash64("to"), F.coalesce("copies", F.lit(1))).cast("int"))
    flows = stage(salted.select("kind", "host", "salt", "to"), "host-flows")
    start = stage(seeds.select("kind", "host", "pages", F.expr(f"cast(cast(pages as decimal(20,0)) * {spread.units} as {WEIGHT})").alias("weight")), "host-seeds")
    total = start.groupBy("kind").agg(F.sum("pages").alias("all"))
    base = start.select("kind", "host", _share(100 - spread.passed).alias("weight"))
    each = ((F.col("weight") - F.col("weight") % F.col("degree")) / F.col("degree")).cast(WEIGHT)
    add = F.sum("weight").cast(WEIGHT).alias("weight")
    weight = start.select("kind", "host", "weight")
    for i in range(spread.rounds):
        sent = weight.join(degree, ["kind", "host"]).select("kind", "host", each.alias("weight"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
        moved = sent.join(flows, ["kind", "host", "salt"]).groupBy("kind", F.col("to").alias("host")).agg(add)
        moved = moved.select("kind", "host", _share(spread.passed).alias("weight"))
        weight = moved.unionByName(base).groupBy("kind", "host").agg(add)
        if i % 5 == 4 or i == spread.rounds - 1:
            weight = stage(weight, "host-weights")
    # Shares of the two kinds compare like weights times the pages of the other kind.
    other = total.select(F.when(F.col("kind") == "trust", "distrust").otherwise("trust").alias("kind"), F.col("all").cast("decimal(19,0)").alias("other"))
    weight = weight.join(F.broadcast(other), "kind", "left").withColumn("against", F.col("weight").cast("double") * F.coalesce("other", F.lit(1).cast("decimal(19,0)")).cast("double"))
    of = lambda kind, name: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(name))), F.lit(0))
    blocked = (of("distrust", "weight") >= spread.least) & (of("distrust", "against") > of("trust", "against"))
    pages = lambda kind: of(kind, "weight").cast("double") / F.lit(float(spread.units))
    return weight.groupBy("host").agg(pages("trust").alias("trust"), pages("distrust").alias("distrust"), blocked.alias("blocked"))


def judge_pages(pages: DataFrame, rules: list[UrlRule], spread: Spread = Spread()) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust."""
    if not rules:
        rules = [UrlRule("allow", "", "\0")]
    narrow = pages.select("page_id", "url", "html")
    judged = ruled(narrow, rules)
    kind = F.when(F.col("verdict") == "allow", "trust").when(F.col("verdict") == "block", "distrust")
    hosts = stage(judged.filter("host <> ''").groupBy("host", kind.alias("kind")).agg(F.count(F.lit(1)).alias("pages")), "hosts")
    targets = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), host_of)))
    links = judged.filter(F.col("html").contains("://")).select(F.col("host").alias("src"), targets.alias("dst"))
    scores = propagate(host_edges(hosts.select("host").distinct(), links.distinct(), spread.suffixes), hosts.filter("kind is not null"), spread)
    scores = stage(scores, "host-scores")
    out = attach(judged.drop("html"), scores, "host", F.col("page_id"))
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_host = F.when(F.col("blocked"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_host).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
