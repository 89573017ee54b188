"""URL filters: trust and distrust propagated over the link graph of hosts, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import LOWER, UPPER, dropped, stash

#: (verdict, host, path), as given. Fixed values.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Steps of PageRank between two written tables.
STEPS = 4


def host_of(url: Column) -> Column:
    """From after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    best_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = lambda r: ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
    pick = lambda value: reduce(lambda rest, r: F.when(fits(r), value(r)).otherwise(rest), reversed(best_first), F.lit(None).cast("string"))
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def host_links(pages: DataFrame, rules=RULES) -> DataFrame:
    """src, dst, verdict, weight: links between the hosts of `pages` (host, html), by what the rules say of their targets.

    A link with a host of its own (absolute or starting with //) leads from the
    page's host; links within a host say nothing and are left out. Weights count
    pages. Links are counted before they are shuffled.
    """
    found = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^"'\s<>\\]+)"""), F.lit(1))
    target = lambda t: F.struct(F.translate(F.regexp_extract(t, "^[^/?#]*", 0), UPPER, LOWER).alias("host"), F.regexp_extract(t, "^[^/?#]*([^?#]*)", 1).alias("path"))
    named = lambda t: F.struct(t["host"].alias("host"), rule_of(t["host"], t["path"], rules)[1].alias("verdict"))
    each = F.array_distinct(F.transform(F.array_distinct(F.transform(found, target)), named))
    links = pages.select(F.col("host").alias("src"), F.explode(each).alias("t")).select("src", F.col("t.host").alias("dst"), "t.verdict")
    return links.where("src != dst and src != '' and dst != ''").groupBy("src", "dst", "verdict").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def host_edges(links: DataFrame, hosts: DataFrame, hierarchy: float = 0.0) -> DataFrame:
    """src, dst, weight of `host_links`, whatever their verdict.

    With `hierarchy` above 0, every host of `hosts` is further tied both ways to
    the domain above it with that weight, for webs where subdomains are under the
    same hand.
    """
    edges = links.select("src", "dst", "weight")
    if hierarchy:
        up = F.regexp_extract("host", r"^[^.]+\.([^.]+\..+)$", 1)
        ties = hosts.where("host != ''").select("host", up.alias("up")).where("up != ''").distinct()
        both = F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("up").alias("dst")), F.struct(F.col("up").alias("src"), F.col("host").alias("dst")))).alias("e")
        edges = edges.unionByName(ties.select(both).select("e.src", "e.dst", F.lit(float(hierarchy)).alias("weight")))
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """host, rank: PageRank that restarts at `seeds` (host, mass; masses sum to 1); ranks sum to 1.

    Mass walks from the seeds along the edges, dealt out by weight, until less than
    `tolerance` of it still moves: what ranks can be wrong by. A host without edges
    sends its mass back to the seeds, which is the same as leaving it out and
    scaling all ranks to a sum of 1, as is done here. Edges carry their share from
    the start, and every host an edge to itself that keeps what came to it, so a
    step is one join and one pre-aggregated sum; each STEPS of them are written to
    the shared folder.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total") * damping).alias("share"), F.lit(0.0).alias("stay"))
    hosts = edges.select("src").unionByName(edges.select(F.col("dst").alias("src"))).unionByName(seeds.select(F.col("host").alias("src"))).distinct()
    shares = stash(shares.unionByName(hosts.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("share"), F.lit(1.0).alias("stay"))), "shares")
    ranks = stash(seeds.select("host", F.col("mass").alias("moving"), F.lit(0.0).alias("rank")), "ranks")
    while (ranks.agg(F.sum("moving")).first()[0] or 0.0) > tolerance:
        last = now = ranks
        for _ in range(STEPS):
            met = now.join(shares, now["host"] == shares["src"]).select(F.col("dst").alias("host"), (F.col("share") * F.col("moving")).alias("moving"), (F.col("stay") * (F.col("rank") + F.col("moving"))).alias("rank"))
            now = met.groupBy("host").agg(F.sum("moving").alias("moving"), F.sum("rank").alias("rank"))
        ranks = stash(now, "ranks")
        dropped(last)
    total = ranks.agg(F.sum("rank")).first()[0] or 1.0
    return ranks.where("rank > 0").select("host", (F.col("rank") / total).alias("rank"))


def _evidence(heads: DataFrame, links: DataFrame, rules) -> DataFrame:
    """host, verdict, n: how many pages, links of pages, and hosts as a whole (path `/`) the rules decide on.

    Hosts that nobody fetched count too: blocked ones seldom are.
    """
    pages = heads.where("rule_verdict is not null and host != ''").groupBy("host", F.col("rule_verdict").alias("verdict")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    targets = links.where("verdict is not null").groupBy(F.col("dst").alias("host"), "verdict").agg(F.sum("weight").alias("n"))
    hosts = heads.select("host").unionByName(links.select(F.col("dst").alias("host"))).where("host != ''").distinct()
    whole = hosts.select("host", rule_of(F.col("host"), F.lit("/"), rules)[1].alias("verdict"), F.lit(1.0).alias("n")).where("verdict is not null")
    return pages.unionByName(targets).unionByName(whole).groupBy("host", "verdict").agg(F.sum("n").alias("n"))


def _seeds(evidence: DataFrame, verdict: str) -> DataFrame:
    """Hosts with such a verdict, mass in proportion to the evidence."""
    own = evidence.where(F.col("verdict") == verdict)
    total = own.agg(F.sum("n")).first()[0] or 1
    return own.select("host", (F.col("n") / F.lit(total)).alias("mass"))


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, damping: float = 0.85, tolerance: float = 1e-6, threshold: float = 1.0, hierarchy: float = 0.0) -> DataFrame:
    """id, host, path, rule, verdict, trust, distrust for every row of `pages`.

    Where a rule fits, the verdict is the rule's. Elsewhere it is the link
    graph's: trust flows from hosts that rules allow along the links, distrust
    from hosts that rules block against them (who links to blocked hosts is
    suspect). Seeds are all hosts that pages, links or the host as a whole bring under a
    rule, fetched or not, and mass flows until `tolerance` of it is left; a host is blocked if its distrust is above `threshold` times its
    trust (both rounded to 9 digits), and allowed otherwise, so without evidence
    and in a tie too. Null urls and urls
    without `://` have an empty host and path and are allowed; a null html has no
    links. Repeated rows are judged alike. No rows give no rows.
    """
    named = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = named.withColumns({"rule": rule, "rule_verdict": verdict})
    heads = stash(judged.drop("html"), "heads")
    links = stash(host_links(named.select("host", "html"), rules), "links")
    edges = stash(host_edges(links, heads, hierarchy), "edges")
    evidence = stash(_evidence(heads, links, rules), "evidence")
    trust = personalised_pagerank(edges, _seeds(evidence, "allow"), damping, tolerance)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = personalised_pagerank(back, _seeds(evidence, "block"), damping, tolerance)
    scores = trust.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("rank").alias("distrust")))
    scores = stash(scores.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "scores")
    both = heads.join(scores, "host", "left").fillna(0.0, ["trust", "distrust"])
    # Sums of doubles differ in their last digits by the order of adding: rounded, equal ones are equal in every run.
    graph = F.when(F.round("distrust", 9) > F.round(threshold * F.col("trust"), 9), "block").otherwise("allow")
    return both.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("rule_verdict", graph).alias("verdict"), "trust", "distrust")
