"""URL filters: host and path rules, and trust that spreads over links between hosts.

Personalised PageRank carries trust along links from trusted hosts, and distrust against links from blocked ones: who
links to a distrusted host is distrusted. A host is trusted if rules allow more of its pages than they block, blocked if
they block at least half of all its pages; such pages are its weight as a seed. A host is blocked if distrust is more than
its threshold's share of the two. Rules decide first, the longest that fits; the host's verdict holds for other URLs.

A url that is null or lacks "://" has an empty host and path; a null page has no links. Links of a page to its own host
carry nothing. Hosts that neither trust nor distrust reaches are allowed. Repeated rows count as often as they come.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.shared import forget, written

#: Rules: verdict, host, path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
DAMPING, SETTLED = 0.85, 1e-6
#: A round moves both vectors by at most 4 * DAMPING ** rounds in sum, which is below SETTLED after 94.
ROUNDS = 100
THRESHOLD = 0.5
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def host_of(url) -> F.Column:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(host, string.ascii_uppercase, string.ascii_lowercase)).otherwise("")


def path_of(url) -> F.Column:
    """Path: what follows the host up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"(?s)^[^/?#]*(.*)$", 1)
    return F.when(at > 0, F.regexp_extract(rest, r"^[^?#]*", 0)).otherwise("")


def fitting(host, path, rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest rule that fits (as host and path, null if none does) and its verdict."""
    fits = [(F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.lit(f"{h}{p}")), F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.lit(v))) for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    return F.coalesce(*(r for r, _ in fits)), F.coalesce(*(v for _, v in fits))


def host_links(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, n: links between different hosts, summed before they are shuffled. A link counts if it names a host."""
    targets = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1))
    full = F.filter(targets, lambda t: t.rlike("^([A-Za-z][A-Za-z0-9+.-]*:)?//"))
    rows = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(full).alias("t"))
    named = rows.select("src", host_of(F.when(F.col("t").startswith("//"), F.concat(F.lit("http:"), "t")).otherwise(F.col("t"))).alias("dst"))
    return named.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def ranks(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """links: src, dst, n. seeds: host, good, bad (weights). Returns host, trust, distrust for all hosts they reach.

    Each round is written in the shared folder. Mass at hosts without a way on goes back to the seeds. Rounds end when
    the vectors move by less than SETTLED; only such sums reach the driver."""
    spark = links.sparkSession
    sums = seeds.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    share = lambda c, s: (F.col(c) / F.lit(float(s))) if s else F.lit(0.0)
    seeds = written(seeds.select("host", share("good", sums.g).alias("p"), share("bad", sums.b).alias("q")), "seeds")
    total = {c: links.groupBy(c).agg(F.sum("n").alias(f"{c}_n")) for c in ("src", "dst")}
    ways = written(links.join(total["src"], "src").join(total["dst"], "dst").select("src", "dst", (F.col("n") / F.col("src_n")).alias("on"), (F.col("n") / F.col("dst_n")).alias("back")), "ways")
    now = written(seeds.select("host", F.col("p").alias("trust"), F.col("q").alias("distrust")), "ranks")
    for _ in range(ROUNDS):
        on = ways.join(now.select(F.col("host").alias("src"), "trust"), "src").select(F.col("dst").alias("host"), (F.col("trust") * F.col("on")).alias("t"), F.lit(0.0).alias("d"))
        back = ways.join(now.select(F.col("host").alias("dst"), "distrust"), "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("back")).alias("d"))
        moved = written(on.unionByName(back).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "moved")
        mass = moved.agg(F.coalesce(F.sum("t"), F.lit(0.0)).alias("t"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("d")).first()
        rank = lambda seed, got, m: (1 - DAMPING * m) * F.coalesce(F.col(seed), F.lit(0.0)) + DAMPING * F.coalesce(F.col(got), F.lit(0.0))
        new = written(seeds.join(moved, "host", "full").select("host", rank("p", "t", mass.t).alias("trust"), rank("q", "d", mass.d).alias("distrust")), "ranks")
        old = now.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
        gap = lambda a, b: F.abs(F.coalesce(F.col(a), F.lit(0.0)) - F.coalesce(F.col(b), F.lit(0.0)))
        change = new.join(old, "host", "full").agg(F.coalesce(F.sum(gap("trust", "t") + gap("distrust", "d")), F.lit(0.0))).first()[0]
        forget(spark, moved)
        forget(spark, now)
        now = new
        if change < SETTLED:
            return now
    raise RuntimeError(f"ranks still move by {change} after {ROUNDS} rounds")


def judged(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, thresholds: DataFrame | None = None) -> DataFrame:
    """Per row of pages: id, host, path, rule, verdict, trust, distrust and distrust_share (null where neither reaches).

    thresholds: host, threshold for hosts whose share differs from THRESHOLD."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("rule_verdict", verdict)
    counts = rows.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rule_verdict") == "allow").alias("good"), F.count_if(F.col("rule_verdict") == "block").alias("bad"))
    counts = counts.select("host", F.when(F.col("good") > F.col("bad"), F.col("good")).otherwise(0).alias("good"), F.when(2 * F.col("bad") >= F.col("n"), F.col("bad")).otherwise(0).alias("bad"))
    seeds = counts.where("good > 0 or bad > 0")
    got = ranks(host_links(pages, url_col=url_col, html_col=html_col), seeds)
    share = F.round(F.col("distrust") / (F.col("trust") + F.col("distrust")), 9)
    scores = got.select("host", F.round("trust", 12).alias("trust"), F.round("distrust", 12).alias("distrust"), share.alias("distrust_share"))
    limit = F.lit(THRESHOLD)
    if thresholds is not None:
        scores = scores.join(thresholds.select("host", F.col("threshold").alias("_limit")), "host", "left")
        limit = F.coalesce(F.col("_limit"), limit)
    scores = scores.withColumn("host_verdict", F.when(F.col("distrust_share") > limit, "block").otherwise("allow"))
    out = rows.join(scores, "host", "left")
    return out.select(id_col, "host", "path", "rule", F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"), "trust", "distrust", "distrust_share")


def judged_sql(rules=RULES) -> str:
    """DuckDB SQL of judged() over the table of pages. The recursion makes one round of both vectors at a time, with the sum by
    which they have moved, and ends as ranks() does."""
    lower = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    rest = "substr({0}, strpos({0}, '://') + 3)"
    host = lambda c: f"CASE WHEN strpos({c}, '://') > 0 THEN {lower.format(f"regexp_extract({rest.format(c)}, '^[^/?#]*')")} ELSE '' END"
    path = f"CASE WHEN strpos(url, '://') > 0 THEN regexp_extract({rest.format('url')}, '^[^/?#]*([^?#]*)', 1) ELSE '' END"
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in ordered) + " END"
    link = LINK.replace("'", "''")
    rank = lambda seed, got: f"(1 - {DAMPING}::DOUBLE * sum(coalesce(m.{got}, 0)) OVER ()) * coalesce({seed}, 0) + {DAMPING}::DOUBLE * coalesce(m.{got}, 0)"
    return f"""WITH RECURSIVE
    rows AS (SELECT *, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS decided FROM (SELECT page_id, coalesce({host('url')}, '') AS host, coalesce({path}, '') AS path FROM pages)),
    counts AS (SELECT host, count(*) AS n, count(*) FILTER (decided = 'allow') AS good, count(*) FILTER (decided = 'block') AS bad FROM rows WHERE host <> '' GROUP BY 1),
    weights AS (SELECT host, CASE WHEN good > bad THEN good ELSE 0 END AS good, CASE WHEN 2 * bad >= n THEN bad ELSE 0 END AS bad FROM counts),
    seeds AS (SELECT host, coalesce(good / nullif((SELECT sum(good) FROM weights), 0), 0)::DOUBLE AS p, coalesce(bad / nullif((SELECT sum(bad) FROM weights), 0), 0)::DOUBLE AS q FROM weights WHERE good > 0 OR bad > 0),
    targets AS (SELECT {host('url')} AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS t FROM pages),
    links AS (SELECT src, dst, count(*) AS n FROM (SELECT src, {host("CASE WHEN starts_with(t, '//') THEN 'http:' || t ELSE t END")} AS dst FROM targets WHERE regexp_matches(t, '^([A-Za-z][A-Za-z0-9+.-]*:)?//')) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
    ways AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS go, n / sum(n) OVER (PARTITION BY dst) AS back FROM links),
    ranks AS (
      SELECT 0 AS i, host, p AS t, q AS d, 1e9::DOUBLE AS change FROM seeds
      UNION ALL
      SELECT i, host, t, d, sum(abs(t - t0) + abs(d - d0)) OVER ()
      FROM (SELECT a.i + 1 AS i, coalesce(s.host, m.host, o.host) AS host, {rank('p', 't')} AS t, {rank('q', 'd')} AS d, coalesce(o.t, 0) AS t0, coalesce(o.d, 0) AS d0
            FROM (SELECT max(i) AS i FROM ranks WHERE change >= {SETTLED} HAVING count(*) > 0) a, seeds s
            FULL JOIN (SELECT host, sum(t) AS t, sum(d) AS d FROM (SELECT w.dst AS host, r.t * go AS t, 0.0::DOUBLE AS d FROM ranks r JOIN ways w ON w.src = r.host WHERE change >= {SETTLED} UNION ALL SELECT w.src, 0.0, r.d * back FROM ranks r JOIN ways w ON w.dst = r.host WHERE change >= {SETTLED}) GROUP BY 1) m ON m.host = s.host
            FULL JOIN (SELECT * FROM ranks WHERE change >= {SETTLED}) o ON o.host = coalesce(s.host, m.host))),
    settled AS (SELECT host, round(t, 12) AS trust, round(d, 12) AS distrust, round(CASE WHEN t + d > 0 THEN d / (t + d) END, 9) AS distrust_share FROM ranks WHERE i = (SELECT max(i) FROM ranks))
    SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN distrust_share > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, trust, distrust, distrust_share FROM rows LEFT JOIN settled USING (host)"""
