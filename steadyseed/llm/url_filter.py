"""URL verdicts from rules, and for the rest from trust and distrust that spread over the host graph."""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from steadyseed.llm.common import col, saved, text_of

DAMPING = 0.85
MOST_ROUNDS = 1000  # more is an error; the change shrinks by the damping, to the tolerance in about 60
TOLERANCE = 1e-4
THRESHOLD = 0.5
ROWS_PER_FILE = 100_000
ALLOW, BLOCK = "allow", "block"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The target of a link; quoted or bare. A tag ends at the next angle bracket and no blanks are
#: given back, so a page is read in time that grows with its length.
LINK = r"""(?is)<a\s[^<>]*?\bhref\s*+=\s*+["']?+\s*+([^"'\s<>]++)"""
ABSOLUTE = r"(?s)^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, below a path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def lowered(value: Column) -> Column:
    return F.translate(value, ascii_uppercase, ascii_lowercase)


def host_of(url: Column) -> Column:
    return lowered(F.regexp_extract(url, PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 2)


def matched(host: Column, path: Column, rules: list[Rule], value) -> Column:
    """``value`` of the longest fitting rule, null if none fits (of equals the first in the list)."""
    found = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(value(rule))).otherwise(found)
    return found


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, weight) between different hosts: links of pages, and one each way between a host and the domain above it.

    Links without a host stay on their page's host and make no edge. Counts are
    combined map-side, so a host with very many pages costs few rows.
    """
    links = pages.select(host_of(text_of(url_col)).alias("src"), F.explode(F.array_distinct(F.filter(
        F.transform(F.regexp_extract_all(text_of(html_col), F.lit(LINK), F.lit(1)), lambda u: lowered(F.regexp_extract(u, ABSOLUTE, 1))),
        lambda h: h != "",
    ))).alias("dst")).where("src <> '' AND src <> dst")
    links = links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    hosts = pages.select(host_of(text_of(url_col)).alias("host")).where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    above = hosts.select(F.explode(F.transform(
        F.filter(F.sequence(F.lit(1), F.size(labels)), lambda i: i <= F.size(labels) - 2),
        lambda i: F.struct(
            F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("low"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("high")
        ),
    )).alias("step")).select("step.*").distinct()
    ties = above.select(F.col("low").alias("src"), F.col("high").alias("dst")).unionByName(
        above.select(F.col("high").alias("src"), F.col("low").alias("dst"))
    ).withColumn("weight", F.lit(1.0))
    return links.unionByName(ties).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def seeds_of(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """(kind, host, seed): the share of each host in all pages that rules allow (trust) or block (distrust)."""
    url = text_of(url_col)
    hosts = pages.select(host_of(url).alias("host"), matched(host_of(url), path_of(url), rules, lambda r: r.verdict).alias("verdict"))
    counts = hosts.where("verdict IS NOT NULL").groupBy("host", "verdict").agg(F.count(F.lit(1)).alias("pages"))
    counts = counts.select(F.when(F.col("verdict") == ALLOW, "trust").otherwise("distrust").alias("kind"), "host", "pages")
    totals = counts.groupBy("kind").agg(F.sum("pages").alias("all_pages"))  # at most two rows
    return counts.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("pages") / F.col("all_pages")).alias("seed"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust): personalised PageRank of trust along the edges, of distrust against them.

    Both start at their seeds and return there with probability 1 - ``damping``, and
    from hosts without further edges. Each round is a join of the ranks with the
    edges and a sum combined map-side; ranks are written to the shared folder. It
    ends when the ranks of both kinds move by no more than ``tolerance`` in sum and
    no host is reached for the first time, or earlier after a caller's ``rounds``.
    Ranks that have not settled after ``MOST_ROUNDS`` are an error.
    """
    ways = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "weight").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "weight")
    )
    ways, seeds = saved(ways, "ways"), saved(seeds, "seeds")
    files = max(1, (ways.count() + seeds.count()) // ROWS_PER_FILE)  # of each step, whatever the number of shuffle partitions
    out = ways.groupBy("kind", "host").agg(F.sum("weight").alias("out"))
    ways = saved(ways.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("weight") / F.col("out")).alias("share")).coalesce(files), "shares")
    seeds = seeds.coalesce(files)
    ranks = seeds.withColumnRenamed("seed", "rank")
    for _ in range(MOST_ROUNDS if rounds is None else rounds):
        moved = ranks.join(ways, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        moved = saved(moved.coalesce(files), "moved")
        kept = {r.kind: r.kept for r in moved.groupBy("kind").agg(F.sum("got").alias("kept")).collect()}  # at most two rows
        back = F.when(F.col("kind") == "trust", F.lit(1 - damping * kept.get("trust", 0.0))).otherwise(F.lit(1 - damping * kept.get("distrust", 0.0)))
        none = F.lit(None).cast("double")
        new = seeds.select("kind", "host", (back * F.col("seed")).alias("rank"), none.alias("was")).unionByName(
            moved.select("kind", "host", (damping * F.col("got")).alias("rank"), none.alias("was"))
        ).unionByName(ranks.select("kind", "host", none.alias("rank"), F.col("rank").alias("was")))
        new = saved(new.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was")).coalesce(files), "ranks")
        moves = new.agg(F.sum(F.abs(F.col("rank") - F.coalesce("was", F.lit(0.0)))).alias("change"), F.count_if(F.col("was").isNull()).alias("reached")).first()
        ranks = new.drop("was")
        if moves.change is None or moves.change <= tolerance and not moves.reached:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"ranks of hosts have not settled in {MOST_ROUNDS} rounds: they still move by {moves.change}, {moves.reached} hosts are new")
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0))
    return ranks.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))


def judge(
    pages: DataFrame, rules: list[Rule], threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Per page: (page_id, host, path, rule, verdict, trust, distrust, reached).

    The longest fitting rule decides. Elsewhere a host is allowed if its trust is at
    least ``threshold`` of its trust and distrust together, each as a share of all;
    a host that neither reaches is allowed; ``reached`` tells it apart.

    ``rules`` are a policy of a caller, read as one expression per page. A null url
    and one without "://" have an empty host and path, fit no rule and are allowed.
    Null html has no links. Repeated rows are judged alike; an empty table gives an
    empty result; other columns are not read. Host ranks are joined by host: a host
    with a third of the pages is one row there, and Spark splits its pages.
    """
    scores = saved(spread(host_edges(pages, url_col, html_col), seeds_of(pages, rules, url_col)), "host-scores")
    url = text_of(url_col)
    rows = pages.select(col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumns({
        "rule": matched(F.col("host"), F.col("path"), rules, lambda r: r.text), "by_rule": matched(F.col("host"), F.col("path"), rules, lambda r: r.verdict),
    })
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_graph = F.when(trust >= threshold * (trust + distrust), ALLOW).otherwise(BLOCK)
    return rows.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", by_graph).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"),
        (trust + distrust > 0).alias("reached"),
    )
