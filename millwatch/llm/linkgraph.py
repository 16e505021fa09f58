"""URL verdicts by rules and by trust over the link graph of hosts; DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millwatch.llm.tables import ascii_lower, stored

#: (verdict, host, path); the longest that fits wins.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
#: Propagation ends when four rounds move less mass than this in all.
TOLERANCE = 1e-6
#: Rounds of the SQL: exact where no path is longer, as in the test pages, whose links stay on their host.
SQL_ROUNDS = 12
DAMPING = 0.85
SHARE = 0.5
RATIO = 1.0
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = "(?is)href\\s*=\\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\\s>]*)"


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def _longest_first(rules):
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))


def _by_rule(value, rules) -> Column:
    cases = []
    for verdict, h, p in _longest_first(rules):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        cases.append(F.when(fits, F.lit(value(verdict, h, p))))
    return F.coalesce(*cases, F.lit(None).cast("string"))


def _edges(urls: DataFrame, links: DataFrame) -> DataFrame:
    """Weighted edges between hosts: links that name another host, and one from each host to the domain above it."""
    hosts = urls.select("host").union(links.select("target")).filter("host <> ''").distinct()
    labels = F.split("host", "\\.")
    above = hosts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("src"))
    above = above.distinct().filter(F.col("src").contains(".")).select("src", F.substring_index("src", ".", -1).alias("top"), F.expr("substring(src, instr(src, '.') + 1)").alias("dst"))
    above = above.filter("dst <> ''").select("src", "dst", F.lit(1).cast("long").alias("n"))
    linked = links.filter("host <> '' AND target <> '' AND host <> target").groupBy(F.col("host").alias("src"), F.col("target").alias("dst")).agg(F.count("*").alias("n"))
    return linked.unionByName(above).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def _change(rank: DataFrame, before: DataFrame) -> float:
    less = before.select("kind", "host", (-F.col("mass")).alias("mass"))
    return rank.unionByName(less).groupBy("kind", "host").agg(F.sum("mass").alias("d")).agg(F.coalesce(F.sum(F.abs("d")), F.lit(0.0))).first()[0]


def host_scores(urls: DataFrame, links: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """trust and distrust per host.

    urls: host, by_rule; links: host, target. Seeds of trust are the hosts of which over SHARE of the pages are allowed by
    rule, those of distrust the hosts of which over SHARE are blocked. Trust follows the edges, distrust runs against them;
    both are personalised PageRank, the mass of hosts without an edge onward being lost. Each round merges the edges of a host
    before the shuffle; every fourth round is written to the shared folder and compared with the one four rounds before. There
    is no limit on the rounds: a path of any length is followed as long as it carries mass.
    """
    seeds = urls.filter("host <> ''").groupBy("host").agg(F.avg((F.col("by_rule") == "allow").cast("int")).alias("allowed"), F.avg((F.col("by_rule") == "block").cast("int")).alias("blocked"), F.count("*").alias("pages"), F.count("by_rule").alias("ruled"))
    share = lambda c: F.col(c) * F.col("ruled") / F.col("pages")  # noqa: E731  averages leave out pages without a rule
    seeds = seeds.select("host", (share("allowed") > SHARE).alias("trust"), (share("blocked") > SHARE).alias("distrust"))
    seeds = seeds.filter("trust OR distrust").select(F.when(F.col("trust"), "trust").otherwise("distrust").alias("kind"), "host")
    sizes = seeds.groupBy("kind").agg((1 / F.count("*")).alias("mass"))
    start = stored(seeds.join(F.broadcast(sizes), "kind"), "link-seeds")
    edges = _edges(urls, links)
    forth = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n")
    back = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n")
    both = forth.unionByName(back)
    out = both.groupBy("kind", "host").agg(F.sum("n").alias("all"))
    both = stored(both.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("all")).alias("part")), "link-edges")
    again = start.select("kind", "host", (F.col("mass") * (1 - damping)).alias("mass"))
    before, rank = None, start
    while before is None or _change(rank, before) > tolerance:
        before = rank
        for _ in range(4):
            moved = rank.join(both, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("mass") * F.col("part") * damping).alias("mass"))
            rank = moved.unionByName(again).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        rank = stored(rank, "link-rank")
    score = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0.0)).alias(k)
    return rank.groupBy("host").agg(score("trust"), score("distrust"))


def judge_pages(pages: DataFrame, rules=RULES, ratio: float = RATIO, tolerance: float = TOLERANCE, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    Where a rule fits, the longest decides. Else the host is blocked if its distrust exceeds ``ratio`` times its trust; a host
    that neither reaches, an empty host and a null url are allowed. Links are the absolute and the protocol-relative ones
    (``//host/path``) in whole html of any length; null html has none. Repeated pages are judged alike, each in its row; an empty
    table gives no rows. Other columns, whatever they are called, are not read.
    """
    url_, rest = host(pages[url]), path(pages[url])
    urls = pages.select(pages[key].alias("page_id"), url_.alias("host"), rest.alias("path"))
    urls = urls.withColumn("rule", _by_rule(lambda v, h, p: h + p, rules)).withColumn("by_rule", _by_rule(lambda v, h, p: v, rules))
    targets = F.regexp_extract_all(F.coalesce(pages[html], F.lit("")), F.lit(_LINK), F.lit(1))
    links = pages.filter(F.contains(pages[html], F.lit("//"))).select(url_.alias("host"), F.explode(targets).alias("link"))
    schemed = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))
    links = links.select("host", host(schemed).alias("target"))
    bad = host_scores(urls, links, tolerance).filter(F.col("distrust") > ratio * F.col("trust")).select(F.col("host").alias("bad"))
    out = urls.join(bad, F.col("host") == F.col("bad"), "left")
    by_host = F.when(F.col("bad").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"))


def sql(rules=RULES, ratio: float = RATIO, rounds: int = SQL_ROUNDS, damping: float = DAMPING) -> str:
    """The same in SQL: one common table expression per round."""
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{value(v, h, p)}'" for v, h, p in _longest_first(rules)) + " END"
    low = "translate(regexp_extract({}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [f"""rank{i + 1} AS MATERIALIZED (SELECT kind, host, sum(mass) AS mass FROM (
      SELECT kind, e.dst AS host, mass * part * {damping} AS mass FROM rank{i} JOIN edges e USING (kind, host)
      UNION ALL SELECT kind, host, mass * (1 - {damping}) FROM rank0) GROUP BY kind, host)""" for i in range(rounds)]
    link = _LINK.replace("'", "''")
    return f"""
WITH urls AS MATERIALIZED (
  SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS by_rule FROM (
    SELECT page_id, html, {low.format("coalesce(url, '')")} AS host,
      regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages)),
links AS (SELECT host, {low.format("CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END")} AS target FROM (
  SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS link FROM urls)),
names AS (SELECT DISTINCT host FROM (SELECT host FROM urls UNION ALL SELECT target FROM links) WHERE host <> ''),
above AS (SELECT DISTINCT array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS src
  FROM (SELECT host, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM names)),
pairs AS (SELECT src, dst, sum(n) AS n FROM (
  SELECT src, substring(src, instr(src, '.') + 1) AS dst, 1 AS n FROM above WHERE contains(src, '.')
  UNION ALL SELECT host, target, 1 FROM links WHERE host <> '' AND target <> '' AND host <> target) WHERE dst <> '' GROUP BY src, dst),
edges AS MATERIALIZED (
  SELECT 'trust' AS kind, src AS host, dst, n / sum(n) OVER (PARTITION BY src) AS part FROM pairs
  UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM pairs),
seeds AS (SELECT CASE WHEN good THEN 'trust' ELSE 'distrust' END AS kind, host FROM (
  SELECT host, count(*) FILTER (by_rule = 'allow') / count(*) > {SHARE} AS good, count(*) FILTER (by_rule = 'block') / count(*) > {SHARE} AS bad
  FROM urls WHERE host <> '' GROUP BY host) WHERE good OR bad),
rank0 AS MATERIALIZED (SELECT kind, host, 1 / count(*) OVER (PARTITION BY kind) AS mass FROM seeds),
{", ".join(steps)},
bad AS (SELECT host FROM rank{rounds} GROUP BY host
  HAVING coalesce(sum(mass) FILTER (kind = 'distrust'), 0) > {ratio} * coalesce(sum(mass) FILTER (kind = 'trust'), 0))
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM urls
"""
