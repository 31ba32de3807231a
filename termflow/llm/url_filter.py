"""URL filter: fixed rules first, then a learned path-template tree per host.

DataFrame functions only. The tree is grown level by level from counts: under each (host, template so
far) a segment stays literal if it has SUPPORT urls and becomes the wildcard `*` otherwise, so ids, slugs
and dates collapse, while every section that can be judged is looked at, however many its siblings are and
however deep it lies. Urls whose node has fewer than SUPPORT urls that go on can't gain another literal:
their remaining segments are wildcards and they leave the loop, which ends when no url is left.

Then branches are merged inside the tree, the deepest level first: of the branches that differ in one
literal only, those whose labelled bad rate can't be told apart from the others' (two-proportion z-test
against the rest of the pool) become one branch, with `=` for that literal, and share their evidence. A
branch is rejected if its bad share, smoothed towards its host's and that towards all hosts', is over REJECT.

Sums over a pool, a branch or a host are aggregates joined back, so no task holds a host's templates; sides
are broadcast only if their measured bytes are few.

Defined results: a null url or one without `://` has an empty host and path and is judged by the method
as host ``; without any label everything is allowed; repeated urls are judged alike; of rules that fit the
longest wins (two of equal length never fit one url, as host and path determine them); a null page_id stays
null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termflow.llm.common import cut, small_side, table

#: Verdict, host and path prefix of the contract's rules.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Least urls of a literal segment, and levels that the SQL writes out (the given urls have two).
SUPPORT, SQL_LEVELS = 20, 6
#: Weight of the prior, z below which branches merge, and the bad share that rejects.
PRIOR, MERGE_Z, REJECT = 10.0, 1.96, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url as the contract cuts them."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def grow(pages: DataFrame) -> DataFrame:
    """`pages` (host, path, ...) with its `template`."""
    go = cut(pages.withColumns({"_segs": F.array_remove(F.split("path", "/"), ""), "template": F.lit("")}))
    done: list[DataFrame] = []
    level = 0
    while True:
        done.append(go.filter(F.size("_segs") <= level))
        go = go.filter(F.size("_segs") > level).withColumn("_seg", F.get("_segs", F.lit(level)))
        n = go.groupBy("host", "template", "_seg").agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT)
        literal = cut(n.select(F.col("host").alias("_h"), F.col("template").alias("_t"), F.col("_seg").alias("_s")))
        go = go.join(small_side(literal), (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")) & (F.col("_seg") == F.col("_s")), "left")
        go = cut(go.withColumn("template", F.concat("template", F.lit("/"), F.coalesce("_s", F.lit("*")))).drop("_h", "_t", "_s", "_seg"))
        level += 1
        nodes = go.filter(F.size("_segs") > level).groupBy("host", "template").agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT)
        nodes = cut(nodes.select(F.col("host").alias("_h"), F.col("template").alias("_t")))
        at = (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t"))
        rest = F.array_join(F.array_repeat(F.lit("/*"), F.size("_segs") - level), "")
        done.append(go.join(small_side(nodes), at, "left_anti").withColumn("template", F.concat("template", rest)))
        if nodes.isEmpty():
            return reduce(DataFrame.unionByName, done).drop("_segs")
        go = cut(go.join(small_side(nodes), at, "left_semi"))


def with_sums(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`df` with the sums of n and b over its rows of equal `keys`."""
    sums = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sum("n").alias(f"{name}_n"), F.sum("b").alias(f"{name}_b"))
    same = reduce(Column.__and__, [F.col(k) == F.col(f"_{k}") for k in keys])
    return df.join(small_side(cut(sums)), same).drop(*[f"_{k}" for k in keys])


def judged_templates(labelled: DataFrame) -> DataFrame:
    """From one row per url (host, template, bad: 1, 0 or null if unlabelled): host, template, branch, bad_share, rejected."""
    t = cut(labelled.groupBy("host", "template").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")).withColumn("branch", F.col("template")))
    depth, all_n, all_b = t.agg(F.max(F.size(F.split("template", "/")) - 1), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    for level in range(depth or 0, 0, -1):
        segs = F.split("branch", "/")
        own = F.get(segs, F.lit(level))
        pool = F.array_join(F.concat(F.slice(segs, F.lit(1), F.lit(level)), F.array(F.lit("=")), F.slice(segs, F.lit(level + 2), F.size(segs))), "/")
        t = t.withColumn("pool", F.when(own.isNotNull() & ~own.isin("*", "="), pool).otherwise(F.col("branch")))
        if t.filter("pool <> branch").isEmpty():
            continue
        t = with_sums(with_sums(t, ["host", "branch"], "own"), ["host", "pool"], "pool")
        # z of the branch against the rest of its pool, squared and without division by zero
        near = F.expr(f"CASE WHEN own_n = 0 OR pool_n = own_n OR pool_b = 0 OR pool_b = pool_n THEN true ELSE pow(cast(own_b AS double) / own_n - cast(pool_b - own_b AS double) / (pool_n - own_n), 2) < {MERGE_Z * MERGE_Z} * (cast(pool_b AS double) / pool_n) * (1 - cast(pool_b AS double) / pool_n) * (1.0D / own_n + 1.0D / (pool_n - own_n)) END")
        t = cut(t.select("host", "template", "n", "b", F.when(near, F.col("pool")).otherwise(F.col("branch")).alias("branch")))
    t = with_sums(with_sums(t, ["host"], "host"), ["host", "branch"], "branch")
    overall = f"({all_b} / ({all_n} + 1.0D))"
    share = F.expr(f"(branch_b + {PRIOR}D * ((host_b + {PRIOR}D * {overall}) / (host_n + {PRIOR}D))) / (branch_n + {PRIOR}D)")
    return t.select("host", "template", "branch", share.alias("bad_share"), (share > REJECT).alias("rejected"))


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Verdict of every page; labels has (doc_id, quality), and a url's last number names the document it was made from."""
    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"))
    df = df.select("*", rule.alias("rule"), verdict.alias("_verdict"), F.expr("try_cast(regexp_extract(path, '([0-9]+)[^/0-9]*/?$', 1) AS bigint)").alias("_made_from"))
    df = cut(grow(df))
    bad = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((1 - F.min("quality")).alias("bad"))
    templates = judged_templates(df.join(bad, df["_made_from"] == bad["doc_id"], "left").select("host", "template", "bad"))
    templates = cut(templates.select(F.col("host").alias("_h"), F.col("template").alias("_t"), "branch", "bad_share", "rejected"))
    df = df.join(small_side(templates), (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")), "left")
    own = F.when(F.col("rejected"), "block").otherwise("allow")
    return df.select("page_id", "host", "path", "rule", F.coalesce("_verdict", own).alias("verdict"), "template", "branch")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _sql() -> str:
    """DuckDB SQL of the query."""
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, what) for what, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    case = lambda k: "CASE " + " ".join(f"WHEN {x[0]} THEN '{x[k]}'" for x in fits) + " END"
    grown = ["g0 AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs, '' AS template FROM p)"]
    for k in range(SQL_LEVELS):
        grown += [
            f"l{k} AS (SELECT host, template, segs[{k + 1}] AS seg FROM g{k} WHERE len(segs) > {k} GROUP BY ALL HAVING count(*) >= {SUPPORT})",
            f"g{k + 1} AS (SELECT g.* EXCLUDE (template), CASE WHEN len(segs) <= {k} THEN g.template ELSE g.template || '/' || coalesce(l.seg, '*') END AS template "
            f"FROM g{k} g LEFT JOIN l{k} l ON g.host = l.host AND g.template = l.template AND g.segs[{k + 1}] = l.seg)",
        ]
    merged = [f"m{SQL_LEVELS} AS (SELECT *, template AS branch FROM t)"]
    for k in range(SQL_LEVELS - 1, -1, -1):  # the literal at place k + 1
        seg = f"string_split(branch, '/')[{k + 2}]"
        pool = f"array_to_string(list_concat(string_split(branch, '/')[:{k + 1}], ['='], string_split(branch, '/')[{k + 3}:]), '/')"
        merged += [
            f"s{k} AS (SELECT *, sum(n) OVER o AS own_n, sum(b) OVER o AS own_b, sum(n) OVER q AS pool_n, sum(b) OVER q AS pool_b FROM "
            f"(SELECT *, CASE WHEN coalesce({seg}, '') IN ('', '*', '=') THEN branch ELSE {pool} END AS pool FROM m{k + 1}) WINDOW o AS (PARTITION BY host, branch), q AS (PARTITION BY host, pool))",
            f"m{k} AS (SELECT host, template, n, b, CASE WHEN CASE WHEN own_n = 0 OR pool_n = own_n OR pool_b = 0 OR pool_b = pool_n THEN true ELSE pow(own_b::DOUBLE / own_n - (pool_b - own_b)::DOUBLE / (pool_n - own_n), 2) "
            f"< {MERGE_Z * MERGE_Z} * (pool_b::DOUBLE / pool_n) * (1 - pool_b::DOUBLE / pool_n) * (1.0 / own_n + 1.0 / (pool_n - own_n)) END THEN pool ELSE branch END AS branch FROM s{k})",
        ]
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
p AS (SELECT *, {case(1)} AS rule, {case(2)} AS fixed, try_cast(regexp_extract(path, '([0-9]+)[^/0-9]*/?$', 1) AS BIGINT) AS made_from FROM h),
{", ".join(grown)},
g AS (SELECT * EXCLUDE (template), template || repeat('/*', greatest(len(segs) - {SQL_LEVELS}, 0)) AS template FROM g{SQL_LEVELS}),
bad AS (SELECT doc_id, 1 - min(quality) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
t AS (SELECT host, template, count(bad) AS n, coalesce(sum(bad), 0) AS b FROM g LEFT JOIN bad ON made_from = doc_id GROUP BY host, template),
{", ".join(merged)},
v AS (SELECT host, template, branch, (sum(b) OVER w + {PRIOR} * ((sum(b) OVER h + {PRIOR} * (sum(b) OVER () / (sum(n) OVER () + 1.0))) / (sum(n) OVER h + {PRIOR}))) / (sum(n) OVER w + {PRIOR}) > {REJECT} AS rejected
      FROM m0 WINDOW w AS (PARTITION BY host, branch), h AS (PARTITION BY host))
SELECT page_id, g.host, path, rule, coalesce(fixed, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, g.template, branch FROM g JOIN v ON g.host = v.host AND g.template = v.template
"""


SQL = _sql()
