"""URL verdicts by rules and, where no rule fits, by trust and distrust that spread over the host link graph.

A rule names a host and a path: it fits that host and all its subdomains, where the url's path starts with the rule's; the longest rule
wins. Hosts of pages that rules allow are trusted seeds, hosts of pages that rules block are distrusted ones, each in proportion to its
pages. Trust is personalised PageRank from the trusted seeds along host edges; distrust is the same from the blocked seeds along
reversed edges, so that it reaches hosts that link to bad ones. A host is blocked if its distrust is over its trust and over the
threshold's share of what a host gets all of whose pages are blocked; any other is allowed. Rounds go on until no rank changes by more than
``TOLERANCE`` (of itself where it is over 1). What reaches a host without edges ends there.

Host edges are of two kinds. Links: each link of a page that names another host, with a scheme or from "//" on, and each relative link of a page
whose <base> names one. Domains: a host and its parent domain (the host without its first label, of two labels or more) are linked
both ways by ``DOMAIN`` links, as are that domain and its own parent, so that hosts of one domain share some of their ranks.

A null url or one without "://" has an empty host and path, to which no rule and no seed applies. Repeated rows are rows of their own
and count as pages. A null html has no links. An empty table gives no rows. Of equally long rules that fit the first by text wins. Pages of
any length are read whole by patterns that never go back. Only page_id, url and html are read, so that other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gemello.session import remove_table, written

#: ROUNDS pass between two looks at how much ranks still change.
DAMPING, ROUNDS, THRESHOLD, TOLERANCE = 0.85, 16, 0.5, 1e-9
#: Rounds between two writes that cut the lineage; the change is that between the last two.
CUT = 8
#: Edges and seeds that one task iterates over at once; more go by rounds of joins, to the same ranks.
ONE_TASK = 200_000
#: Links that stand for belonging to a domain.
DOMAIN = 1
#: More rules than these are joined by host rather than tried in turn.
INLINE_RULES = 200


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end; only A-Z are lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_rule(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """pages (host, path) with rule (its text) and allow, both null where none fits. Of equally long rules the first by text wins."""
    if len(rules) <= INLINE_RULES:
        hit = F.lit(None).cast("struct<rule:string,allow:boolean>")
        for r in sorted(rules, key=lambda r: (len(r.text), r.text[::-1])):
            fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
            hit = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.allow).alias("allow"))).otherwise(hit)
        return pages.withColumn("_hit", hit).withColumns({"rule": F.col("_hit.rule"), "allow": F.col("_hit.allow")}).drop("_hit")
    spark = pages.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.text, r.allow) for r in rules], "r_host string, r_path string, rule string, allow boolean")
    own = table.groupBy("r_host").agg(F.sort_array(F.collect_list(F.struct(F.length("rule").alias("n"), "r_path", "rule", "allow")), asc=False).alias("own"))
    # every suffix of a host of as many labels as a rule's; distinct hosts only, so that a hot host is one row
    hosts = pages.select("host").distinct()
    labels = F.split("host", "\\.")
    each = hosts.withColumn("r_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))))
    of = each.join(own, "r_host").groupBy("host").agg(F.sort_array(F.flatten(F.collect_list("own")), asc=False).alias("own"))
    fit = F.filter("own", lambda r: F.col("path").startswith(r.r_path))
    return pages.join(of, "host", "left").withColumn("_hit", F.try_element_at(fit, F.lit(1))).withColumns({"rule": F.col("_hit.rule"), "allow": F.col("_hit.allow")}).drop("_hit", "own")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from pages (host, html) of one host to another, and between hosts and their domains."""
    named = r"""(?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+"""
    full = lambda link: host_of(F.when(link.startswith("//"), F.concat(F.lit("http:"), link)).otherwise(link))
    href = lambda what: F.regexp_extract_all("html", F.lit(rf"""(?i)\bhref\s*=\s*["']?\s*({what})"""), 1)
    linked = pages.filter(F.col("html").isNotNull())
    outer = linked.select(F.col("host").alias("src"), F.explode(href(named)).alias("link")).select("src", full(F.col("link")).alias("dst"), F.lit(1).alias("n"))
    # what neither names a host nor stays on its page is relative to the base
    base = full(F.regexp_extract("html", rf"""(?i)<base\b[^>]*?\bhref\s*=\s*["']?\s*({named})""", 1))
    inner = linked.filter(F.col("html").rlike("(?i)<base\\b")).select(F.col("host").alias("src"), base.alias("dst"), F.size(href(r"""(?![a-z][a-z0-9+.-]*:|//|#)[^"'\s>]+""")).alias("n"))
    links = outer.unionByName(inner).filter("src <> dst AND src <> '' AND dst <> '' AND n > 0").groupBy("src", "dst").agg(F.sum("n").alias("n"))
    links = written(links, "links")
    hosts = pages.select("host").unionByName(links.select(F.col("dst").alias("host"))).distinct()
    labels = F.split("host", "\\.")
    name = lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    # of a host of k labels, the pairs (itself, its parent), (its parent, that one's) and so on, down to two labels
    chain = F.filter(F.sequence(F.lit(1), F.greatest(F.size(labels) - 2, F.lit(1))), lambda k: k <= F.size(labels) - 2)
    steps = hosts.select(F.explode(F.transform(chain, lambda k: F.struct(name(k).alias("low"), name(k + 1).alias("up")))).alias("s")).select("s.*").filter("low <> '' AND up <> ''").distinct()
    both = steps.select(F.explode(F.array(F.struct(F.col("low").alias("src"), F.col("up").alias("dst")), F.struct(F.col("up").alias("src"), F.col("low").alias("dst")))).alias("e")).select("e.*", F.lit(DOMAIN).cast("long").alias("n"))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def iterate(kind: np.ndarray, src: np.ndarray, dst: np.ndarray, share: np.ndarray, damping: float, tolerance: float) -> list[tuple[str, str, float]]:
    """The ranks of propagate, from rows of seeds (src null) and edges in one place."""
    names, at = np.unique(np.concatenate([np.char.add(np.char.add(kind, " "), h) for h in (np.where(src == None, "", src).astype(str), dst.astype(str))]), return_inverse=True)  # noqa: E711
    a, b, seed = at[: len(src)], at[len(src) :], src == None  # noqa: E711
    start = np.bincount(b[seed], share[seed], len(names))
    a, b, share = a[~seed], b[~seed], share[~seed]
    rank = start
    while True:
        new = (1 - damping) * start + damping * np.bincount(b, rank[a] * share, len(names))
        moved = np.max(np.abs(new - rank) / np.maximum(new, 1), initial=0)
        rank = new
        if moved <= tolerance:
            return [(*names[k].split(" ", 1), float(rank[k])) for k in np.flatnonzero(rank)]


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, rank) of rank = (1 - damping) seed + damping (what comes over edges), by rounds until the change is within tolerance.

    seeds (kind, host, seed) and edges (kind, src, dst, share), where shares of a src sum to one, hold all kinds at once.
    """
    seeds = written(seeds, "seeds")
    edges = written(edges, "edges")
    if edges.count() + seeds.count() <= ONE_TASK:
        rows = seeds.select("kind", F.lit(None).cast("string").alias("src"), F.col("host").alias("dst"), F.col("seed").alias("share")).unionByName(edges.select("kind", "src", "dst", "share"))

        def run(batches):
            held = [b for b in batches if b.num_rows]
            if held:
                columns = [np.concatenate([np.asarray(b.column(k).to_pylist(), object) for b in held]) for k in range(4)]
                ranks = iterate(columns[0].astype(str), columns[1], columns[2], columns[3].astype(float), damping, tolerance)
                if ranks:
                    kind, host, rank = zip(*ranks, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(host), pa.array(rank)], ["kind", "host", "rank"])

        return written(rows.coalesce(1).mapInArrow(run, "kind string, host string, rank double"), "rank")
    rank = cut = seeds.select("kind", "host", F.col("seed").alias("rank"))
    start, before = cut, None
    while True:
        for k in range(rounds):
            sent = rank.join(edges, (rank.kind == edges.kind) & (rank.host == edges.src)).select(rank.kind, F.col("dst").alias("host"), (F.lit(damping) * F.col("rank") * F.col("share")).alias("rank"))
            rank = seeds.select("kind", "host", (F.lit(1 - damping) * F.col("seed")).alias("rank")).unionByName(sent).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
            if k % CUT == CUT - 1 or k == rounds - 1:
                old, before, rank = before, cut, written(rank, "rank")
                cut = rank
                if old is not None and old is not start:
                    remove_table(old)
        both = rank.withColumn("was", F.lit(0.0)).unionByName(before.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("was")))
        moved = both.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was"))
        if (moved.agg(F.max(F.abs(F.col("rank") - F.col("was")) / F.greatest("rank", F.lit(1.0)))).first()[0] or 0) <= tolerance:
            return rank


def judge(pages: DataFrame, rules: list[Rule], threshold: float = THRESHOLD, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust."""
    located = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    judged = with_rule(located.drop("html"), rules)
    counts = judged.filter("host <> ''").groupBy("host").agg(F.count_if("allow").alias("good"), F.count_if(~F.col("allow")).alias("bad"), F.count(F.lit(1)).alias("pages"))
    kinds = F.explode(F.array(F.struct(F.lit("trust").alias("kind"), (F.col("good") / F.col("pages")).alias("seed")), F.struct(F.lit("distrust").alias("kind"), (F.col("bad") / F.col("pages")).alias("seed"))))
    seeds = counts.select("host", kinds.alias("k")).select("k.kind", "host", "k.seed").filter("seed > 0")
    both = host_edges(located).select(F.explode(F.array(F.struct(F.lit("trust").alias("kind"), "src", "dst", "n"), F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))).alias("e")).select("e.*")
    both = written(both, "links")
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    edges = both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share"))
    rank = propagate(seeds, edges, damping, rounds)
    of = rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))).alias("distrust"))
    full = judged.join(of, "host", "left").fillna(0.0, ["trust", "distrust"])
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") > (1 - damping) * threshold)
    return full.select("page_id", "host", "path", "rule", F.when(F.coalesce(~F.col("allow"), bad), "block").otherwise("allow").alias("verdict"), "trust", "distrust")
