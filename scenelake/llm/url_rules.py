"""Verdicts on urls: rules for hosts and paths, else trust and distrust that spread over the links between hosts.

DataFrame functions only. All arithmetic is of whole numbers, so results don't
depend on the order in which masses are added.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X

#: Mass that either kind of seed starts with; hundredths of a mass that go on along links; rounds.
TOTAL, DAMPING, ROUNDS = 10**17, 85, 20
#: Rules at most, as each url is held against all.
MOST_RULES = 10_000
#: Absolute links to web hosts (in tags, scripts and comments alike).
_LINK = r"""[hH][rR][eE][fF][\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?[\x20\x09-\x0D]*(?:[hH][tT][tT][pP][sS]?:)?//([^/?#"'<>\x20\x09-\x0D]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """action (allow or block) for a host, its subdomains and the paths that start with path."""

    action: str
    host: str
    path: str = "/"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule_of(rules: list[Rule], host: Column, path: Column) -> Column:
    """The fitting rule whose host and path are longest together (ties: the longer host, then block, then by text); null if none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} can be held against each url")
    order = sorted(set(rules), key=lambda r: (-len(r.host + r.path), -len(r.host), r.action != "block", r))
    if not order:
        return F.lit(None).cast("struct<action:string,name:string>")
    table = F.array(*(F.struct(F.lit(r.action).alias("action"), F.lit(r.host + r.path).alias("name"), F.lit(r.host).alias("host"), F.lit("." + r.host).alias("below"), F.lit(r.path).alias("path")) for r in order))
    fits = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, r["below"])) & F.startswith(path, r["path"]))
    first = F.try_element_at(fits, F.lit(1))
    return F.when(first.isNotNull(), F.struct(first["action"].alias("action"), first["name"].alias("name")))


def links(pages: DataFrame) -> DataFrame:
    """source, target and pages: how many pages of a host link to another host, at least once. Relative links stay on their host and make no edge."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), lambda x: F.translate(x, _UPPER, _LOWER)))
    edges = pages.select(host_of(F.col("url")).alias("source"), F.explode(found).alias("target")).filter("source <> '' and source <> target")
    return edges.groupBy("source", "target").agg(F.count("*").alias("pages"))


def _shared(part: str, whole: str, mass: str) -> str:
    """floor(mass * part / whole); exact while part times whole stays below 9 * 10^18, an error beyond."""
    return f"({mass} div {whole}) * {part} + ({mass} % {whole}) * {part} div {whole}"


def spread(hosts: DataFrame, edges: DataFrame, folder: str, rounds: int = ROUNDS) -> DataFrame:
    """host, trust and distrust: personalised PageRank from the hosts' shares of allowed pages along links, and from their shares of blocked pages against them.

    hosts: host, pages, allowed, blocked (pages that a rule allows or blocks).
    A seed's mass follows the thousandths of its pages that are ruled, so that
    large hosts don't outweigh others. Each round hands on 85 hundredths of
    what arrived, by the number of linking pages; rounds end early when
    nothing moves. Masses of a kind are compared with each other only.

    Rounds join masses with edges by host; edges of a pair are one row, sums
    are partial before rows move, and joins split what is skewed at run time.
    """
    seeds = F.expr("stack(2, 'trust', allowed * 1000 div pages, 'distrust', blocked * 1000 div pages) as (kind, seed)")
    seeded = hosts.select("host", seeds).filter("seed > 0")
    sums = seeded.groupBy("kind").agg(F.sum("seed").alias("all"))  # two rows
    mass = F.expr(_shared("seed", "`all`", f"{TOTAL}L")).alias("mass")
    now = X.saved(seeded.join(F.broadcast(sums), "kind").select("host", "kind", mass).filter("mass > 0"), folder, "round-0")

    both = edges.select(F.col("source").alias("host"), F.col("target").alias("to"), F.lit("trust").alias("kind"), "pages").unionByName(
        edges.select(F.col("target").alias("host"), F.col("source").alias("to"), F.lit("distrust").alias("kind"), "pages")
    )
    whole = both.groupBy("host", "kind").agg(F.sum("pages").alias("whole"))
    ways = X.saved(both.join(whole, ["host", "kind"]), folder, "ways")
    steps = [now]
    for k in range(1, rounds + 1):
        if ways.isEmpty() or now.isEmpty():
            break
        moved = now.withColumn("mass", F.expr(f"mass div 100 * {DAMPING}")).join(ways, ["host", "kind"])
        moved = moved.select(F.col("to").alias("host"), "kind", F.expr(_shared("pages", "whole", "mass")).alias("mass"))
        now = X.saved(moved.groupBy("host", "kind").agg(F.sum("mass").alias("mass")).filter("mass > 0"), folder, f"round-{k}")
        steps.append(now)
    total = steps[0]
    for step in steps[1:]:
        total = total.unionByName(step)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0)).alias(kind)
    return total.groupBy("host").agg(of("trust"), of("distrust"))


def judged(pages: DataFrame, rules: list[Rule], rounds: int = ROUNDS) -> DataFrame:
    """Each page's columns page_id and url with host, path, rule, verdict (allow or block), trust and distrust.

    The longest rule that fits decides. Where none fits, a host is blocked if
    its distrust is above its trust and at least the mean distrust of the
    hosts with pages; else it is allowed, as are pages without a host.

    Null urls and urls without :// have an empty host and path and no rule.
    Null html has no links. Repeated and null page_ids keep their rows, one
    result each; repeated pages count as often as they stand. Empty tables
    give no rows. Other columns are not read. Ties of rules: _rule_of.
    """
    spark = pages.sparkSession
    folder = X.workdir(spark)
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("r", _rule_of(list(rules), F.col("host"), F.col("path")))
    ruled = lambda x: F.count(F.when(F.col("r.action") == x, 1))
    hosts = X.saved(rows.filter("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), ruled("allow").alias("allowed"), ruled("block").alias("blocked")), folder, "hosts")
    edges = X.saved(links(pages), folder, "edges")
    masses = spread(hosts, edges, folder, rounds)
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("trust", "distrust")]
    known = X.saved(hosts.select("host", "pages").join(masses, "host", "left").select("host", "pages", *zero), folder, "known")
    n, total, seen = known.agg(F.count("*"), F.coalesce(F.sum("distrust"), F.lit(0)), F.coalesce(F.sum("pages"), F.lit(0))).first()
    mean = int(total) // max(int(n), 1)
    known = known.withColumn("refused", (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= mean))
    joined = X.spread_join(rows, known, "host", "pages", int(seen), how="left")
    verdict = F.coalesce(F.col("r.action"), F.when(F.col("refused"), "block"), F.lit("allow"))
    return joined.select("page_id", "url", "host", "path", F.col("r.name").alias("rule"), verdict.alias("verdict"), *zero)
