"""URL filter: rules on hosts and paths, and trust that spreads over links between hosts.

Pages that no rule judges are judged by their host: trust flows from hosts with allowed pages along the links, distrust
flows from hosts with blocked pages against them (who links to the blocked is suspect), both as personalised PageRank.
Everything is DataFrame expressions, so it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host/path prefix): the rules of the query.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


#: Rank that may still be on its way, as a share of all seeds' rank, when rounds end.
LEFT = 1e-9


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null. ``rules`` is a short list that is part of the plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: len(r[1])):
        owner, slash, rest = text.partition("/")
        fits = ((host == owner) | host.endswith("." + owner)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links between different hosts; a relative link stays on its host and is left out."""
    link = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?([a-z][a-z0-9+.-]*://[^\s"'<>]*)"""), F.lit(1)))
    return (pages.select(host_of(F.col("url")).alias("src"), link.alias("link"))
            .select("src", host_of(F.col("link")).alias("dst")).where("src <> dst and src <> '' and dst <> ''")
            .groupBy("src", "dst").agg(F.count("*").alias("n")))


def spread(seeds: DataFrame, edges: DataFrame, damping: float, rounds: int | None) -> DataFrame:
    """``host, rank`` of personalised PageRank from ``host, seed`` over ``src, dst, n``, after ``rounds`` or, without that,
    when every host that can be reached has rank and at most ``LEFT`` of it is still on its way. Rank that reaches a host
    without links ends there. A host with a third of all links is summed up before it is shuffled."""
    share = edges.join(edges.groupBy("src").agg(F.sum("n").alias("out")), "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share"))
    rank = seeds.where("seed > 0").select("host", ((1 - damping) * F.col("seed")).alias("rank"))
    start = rank
    known = total = None
    done = 0
    while rounds is None or done < rounds:
        moved = (share.join(rank, share["src"] == rank["host"]).groupBy(F.col("dst").alias("host"))
                 .agg((damping * F.sum(F.col("share") * F.col("rank"))).alias("rank")))
        rank = cut(start.unionByName(moved).groupBy("host").agg(F.sum("rank").alias("rank")))
        done += 1
        if rounds is None:
            # Rank only grows, so what a round added bounds what the next ones add.
            before, (known, total) = (known, total), rank.agg(F.count("*"), F.coalesce(F.sum("rank"), F.lit(0.0))).first()
            left = total - (before[1] or 0.0)
            if known == before[0] and (left * damping <= (1 - damping) * LEFT * total or damping**done <= LEFT):
                break
    return rank


def host_scores(judged: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int | None = None) -> DataFrame:
    """``host, trust, distrust`` from pages with ``host, verdict`` (null: no rule). A host's seed is the share of its
    pages that rules allow or block."""
    seeds = cut(judged.where("host <> ''").groupBy("host").agg(
        F.avg(F.expr("if(verdict = 'allow', 1D, 0D)")).alias("good"), F.avg(F.expr("if(verdict = 'block', 1D, 0D)")).alias("bad")))
    edges = cut(edges)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    trust = spread(seeds.select("host", F.col("good").alias("seed")), edges, damping, rounds)
    distrust = spread(seeds.select("host", F.col("bad").alias("seed")), back, damping, rounds)
    return trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full").na.fill(0.0)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, ratio: float = 1.0, rounds: int | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every row of ``page_id, url, html``.

    The longest rule that fits decides; else the host is blocked if its distrust is more than ``ratio`` times its trust.
    A null url or one without ``://`` has an empty host and path, meets no rule and no host, and is allowed. Null html has
    no links. Repeated rows are judged alike, an empty table gives no rows, other columns are ignored.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    scores = host_scores(judged, host_edges(pages), rounds=rounds)
    method = F.when(F.coalesce("distrust", F.lit(0.0)) > ratio * F.coalesce("trust", F.lit(0.0)), "block").otherwise("allow")
    return judged.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: verdict of every page."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def sql(rules: list[tuple[str, str]] = RULES, damping: float = 0.85, rounds: int = 8) -> str:
    """The same in SQL, its rounds of rank written out one after the other."""
    lower = lambda e: f"translate({e}, '{UPPER}', '{LOWER}')"
    host = lambda e: lower(f"regexp_extract({e}, '(?s)^.*?://([^/?#]*)', 1)")
    cases = []
    for word, text in sorted(rules, key=lambda r: -len(r[1])):
        owner, slash, rest = text.partition("/")
        cases.append((f"(host = '{owner}' OR ends_with(host, '.{owner}')) AND starts_with(path, '{slash + rest}')", text, word))
    pick = lambda k: "CASE " + " ".join(f"WHEN {c[0]} THEN '{c[k]}'" for c in cases) + " END"
    steps = []
    for name, seed, src, dst in (("t", "good", "src", "dst"), ("u", "bad", "dst", "src")):
        steps.append(f"{name}_out AS (SELECT {src} AS a, sum(n) AS total FROM edges GROUP BY 1)")
        steps.append(f"{name}0 AS (SELECT host, {1 - damping} * {seed} AS r FROM seeds)")
        for k in range(rounds):
            steps.append(f"""{name}{k + 1} AS (SELECT host, sum(r) AS r FROM (SELECT * FROM {name}0 UNION ALL SELECT {dst}, {damping} * sum(n / total * r)
              FROM edges JOIN {name}_out ON {src} = a JOIN {name}{k} ON host = {src} GROUP BY 1) GROUP BY host)""")
    return f"""WITH p AS (SELECT page_id, {host("coalesce(url, '')")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, coalesce(html, '') AS html FROM pages),
      j AS (SELECT page_id, host, path, {pick(1)} AS rule, {pick(2)} AS word FROM p),
      l AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']?([a-z][a-z0-9+.-]*://[^\\s"''<>]*)', 1)) AS link FROM p),
      edges AS (SELECT src, dst, count(*) AS n FROM (SELECT src, {host('link')} AS dst FROM l) WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY 1, 2),
      seeds AS (SELECT host, avg(CASE WHEN word = 'allow' THEN 1.0 ELSE 0.0 END) AS good, avg(CASE WHEN word = 'block' THEN 1.0 ELSE 0.0 END) AS bad FROM j WHERE host <> '' GROUP BY host),
      {", ".join(steps)}
      SELECT page_id, j.host, path, rule, coalesce(word, CASE WHEN coalesce(u.r, 0) > coalesce(t.r, 0) THEN 'block' ELSE 'allow' END) AS verdict
      FROM j LEFT JOIN t{rounds} t ON t.host = j.host LEFT JOIN u{rounds} u ON u.host = j.host"""


QUERIES = {"op7_url_filters": query}
ORACLES = {"op7_url_filters": sql()}
