"""URL filtering by host rules and a tree of path templates.

A rule (host, path) fits its host and all subdomains when the path starts with the rule's; the longest one
decides. Pages that a rule decides are the labelled ones; the others are judged by templates:

* Generalise: a path segment with a digit, an escape or more than ``LONG`` characters becomes ``*``;
  everything below ``DEPTH`` segments becomes ``**``.
* Merge: level by level, a literal segment becomes ``*`` too unless its labelled block rate differs from
  that of all its siblings (same host, same template above) by a two-sided test at ``CRITICAL``.
* Reject: per host and template, blocked over labelled pages is smoothed by ``WEIGHT`` pages at the rate of
  the same template under the host's domain (its last two labels), that by the rate of all labelled pages.
  A template whose smoothed rate is ``LIMIT`` or more is blocked.

Pages are counted per host and generalised path before anything is joined, so a hot host or template is
as many rows as it has templates. Everything is DataFrame code; a level is staged before the next.

Defined results: a null url, or one without ``://``, has an empty host and path; rows that repeat a page
are judged and counted one by one; a null ``page_id`` is judged like any other; without labels the rate is
one half, which blocks; an empty table gives an empty result; other columns are not read.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.base import query, table
from larder.session import stage

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
LONG, DEPTH = 40, 4
CRITICAL = 3.84        # of a squared normal deviate, 5 %
WEIGHT, LIMIT = 4.0, 0.5


def lowered(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path of every url."""
    url = F.coalesce("url", F.lit(""))
    return pages.select("page_id", lowered(F.regexp_extract(url, "://([^/?#]*)", 1)).alias("host"),
                        F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1).alias("path"))


def ruled(urls: DataFrame, rules=RULES) -> DataFrame:
    """With the longest fitting ``rule`` and its ``label`` (allow or block), null where none fits."""
    rule, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, label = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(label)
    return urls.withColumns({"rule": rule, "label": label})


def shaped(urls: DataFrame) -> DataFrame:
    """With the array ``shape`` of path segments, variable ones as ``*``."""
    parts = F.split("path", "/")
    general = F.transform(parts, lambda s: F.when(s.rlike("[0-9%=]") | (F.length(s) > LONG), "*").otherwise(s))
    cut = F.when(F.size(general) > DEPTH + 1, F.concat(F.slice(general, 1, DEPTH + 1), F.array(F.lit("**"))))
    return urls.withColumn("shape", cut.otherwise(general))


def templates(shapes: DataFrame) -> DataFrame:
    """``shapes`` (host, shape, n, blocked) with the ``template`` of each after merging similar branches."""
    out = shapes.withColumn("template", F.lit(""))
    for level in range(1, DEPTH + 3):
        out = stage(out.withColumn("part", F.get("shape", F.lit(level - 1))), "url-level")
        sums = F.sum("n").cast("double"), F.sum("blocked").cast("double")
        parts = out.groupBy("host", "template", "part").agg(sums[0].alias("n"), sums[1].alias("b"))
        whole = out.groupBy("host", "template").agg(sums[0].alias("all_n"), sums[1].alias("all_b"))
        gap = F.col("b") * F.col("all_n") - F.col("all_b") * F.col("n")
        spread = F.col("all_b") * (F.col("all_n") - F.col("all_b")) * F.col("n") * (F.col("all_n") - F.col("n"))
        # part <=> part joins the paths that end above this level.
        differs = (gap * gap * F.col("all_n") > CRITICAL * spread)
        literal = parts.join(whole, ["host", "template"]).where(differs).select(
            "host", "template", "part", F.lit(True).alias("literal"))
        segment = F.when(F.col("part").isNull(), "").when(
            F.col("literal") | F.col("part").isin("", "**"), F.concat(F.lit("/"), "part")).otherwise("/*")
        out = out.join(literal, ["host", "template", "part"], "left").select(
            "host", "shape", "n", "blocked", F.concat("template", segment).alias("template"))
    return out


def purity(placed: DataFrame) -> DataFrame:
    """(host, shape, rejected) by the smoothed block rate of each host's template."""
    counts = placed.groupBy("host", "template").agg(F.sum("n").cast("double").alias("n"),
                                                    F.sum("blocked").cast("double").alias("b"))
    labels = F.split("host", r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    counts = counts.withColumn("domain", domain)
    total = counts.agg(((F.coalesce(F.sum("b"), F.lit(0.0)) + 1.0) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2.0)).alias("p"))
    above = counts.groupBy("domain", "template").agg(F.sum("n").alias("dn"), F.sum("b").alias("db"))
    base = above.crossJoin(F.broadcast(total)).select(  # one row
        "domain", "template", ((F.col("db") + WEIGHT * F.col("p")) / (F.col("dn") + WEIGHT)).alias("dp"))
    rate = (F.col("b") + WEIGHT * F.col("dp")) / (F.col("n") + WEIGHT)
    judged = counts.join(base, ["domain", "template"]).select("host", "template", (rate >= LIMIT).alias("rejected"))
    return placed.select("host", "shape", "template").join(judged, ["host", "template"]).select("host", "shape", "rejected")


def filtered(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    urls = shaped(ruled(parsed(pages), rules))
    shapes = urls.groupBy("host", "shape").agg(
        F.count("label").alias("n"), F.count_if(F.col("label") == "block").alias("blocked"))
    judged = purity(stage(templates(shapes), "url-templates"))
    return urls.join(judged, ["host", "shape"], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("label", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"))


def _sql() -> str:
    """The same in DuckDB SQL, one block of CTEs per level."""
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in longest)
    label = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in longest)
    parts = [rf"""
    u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    r AS (SELECT *, CASE {rule} END AS rule, CASE {label} END AS label,
                 list_transform(string_split(path, '/'), lambda s: CASE WHEN regexp_matches(s, '[0-9%=]')
                     OR length(s) > {LONG} THEN '*' ELSE s END) AS general FROM u),
    s AS (SELECT *, CASE WHEN len(general) > {DEPTH + 1} THEN list_append(general[1:{DEPTH + 1}], '**')
                 ELSE general END AS shape FROM r),
    t0 AS (SELECT host, shape, count(label) AS n, count(*) FILTER (label = 'block') AS blocked, '' AS template
           FROM s GROUP BY host, shape)"""]
    for k in range(1, DEPTH + 3):
        parts.append(f"""
    a{k} AS (SELECT *, shape[{k}] AS part FROM t{k - 1}),
    b{k} AS (SELECT *, sum(n) OVER w AS pn, sum(blocked) OVER w AS pb, sum(n) OVER v AS an, sum(blocked) OVER v AS ab
             FROM a{k} WINDOW w AS (PARTITION BY host, template, part), v AS (PARTITION BY host, template)),
    t{k} AS (SELECT host, shape, n, blocked, template || CASE WHEN part IS NULL THEN ''
             WHEN part IN ('', '**') OR (pb::DOUBLE * an - ab::DOUBLE * pn) * (pb::DOUBLE * an - ab::DOUBLE * pn) * an
                  > {CRITICAL} * (ab::DOUBLE * (an::DOUBLE - ab) * pn * (an::DOUBLE - pn)) THEN '/' || part
             ELSE '/*' END AS template FROM b{k})""")
    parts.append(f"""
    c AS (SELECT host, template, sum(n)::DOUBLE AS n, sum(blocked)::DOUBLE AS b,
                 array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM t{DEPTH + 2} GROUP BY host, template),
    g AS (SELECT (coalesce(sum(b), 0) + 1) / (coalesce(sum(n), 0) + 2) AS p FROM c),
    d AS (SELECT domain, template, (sum(b) + {WEIGHT} * any_value(p)) / (sum(n) + {WEIGHT}) AS dp
          FROM c, g GROUP BY domain, template),
    j AS (SELECT host, template, (b + {WEIGHT} * dp) / (n + {WEIGHT}) >= {LIMIT} AS rejected FROM c JOIN d USING (domain, template)),
    x AS (SELECT t.host, t.shape, rejected FROM t{DEPTH + 2} t JOIN j USING (host, template))""")
    return "WITH" + ",".join(parts) + """
    SELECT page_id, s.host, path, rule, coalesce(label, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict
    FROM s JOIN x ON s.host = x.host AND s.shape = x.shape"""


@query("op9_url_filters", oracle=_sql())
def op9_url_filters(spark, sf_dir):
    return filtered(table(spark, sf_dir, "pages"))
