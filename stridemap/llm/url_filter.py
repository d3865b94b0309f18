"""URL filter by a path-template tree, in DataFrame expressions only.

A URL is cut into host and path. Explicit rules decide first (longest fitting rule). For the rest, each host has a tree of
path templates, whose labels are the URLs that a rule decides:

1.  Segments with digits become a wildcard (a file ending stays), and so do the children of a node that take almost as
    many values as there are URLs below it.
2.  From the deepest level up, sibling branches are merged with the largest of them if they are like it: the counts of what follows below the two agree by
    a chi-square test, and so do their labels, if both have any. What is left is held against the largest that is left, for LEADERS branches of
    each node. So a branch without labels joins one that is built and used like it.
3.  A template's purity is its share of blocked labels, smoothed by A labels of its parent's purity, whose own is smoothed towards its parent's, and so on up
    to the host and PRIOR. So what has no labels has the purity of the next branch above that has some. A template is rejected from REJECT on.

Counts are made per host and raw path shape with map-side aggregation, so a host with a third of all URLs is summed before it
moves; trees are built on these counts by sums and joins. The verdicts go back to the URLs by a join on host and shape, which Spark
splits if one shape is hot.

Defined results: a null URL or one without ``://`` has empty host and path, fits no rule and is allowed. Rules of equal length that
both fit: the first by its string. Repeated rows and null ids get a row each. Long URLs are read whole; segments
after DEPTH are one tail, which is a wildcard. Without any label all purities are PRIOR. An empty table gives no rows. Extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from stridemap.runtime import BROADCAST_BYTES, materialize

#: Segments of a path that the tree tells apart; least distinct children of a variable node.
DEPTH, VARIED = 4, 8
#: Rounds of leaders that run in any case; more follow while a node has several branches left.
LEADERS = 2
#: Weight of the parent's purity; purity without labels; purity from which a template is rejected.
A, PRIOR, REJECT = 4.0, 0.5, 0.75
#: Critical values at 5 %: of chi-square with one degree of freedom, and of the normal distribution on one side. What rounding may add to a sum.
CRITICAL, NORMAL, ROUNDING = 3.84, 1.6449, 1e-6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict)
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(u, instr(u, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(string, verdict) of the longest rule that fits; null without one. The rules are a parameter, so one expression holds them."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(ordered):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """The path's segments as an array of DEPTH + 1 at most: digits generalised, the tail as one wildcard."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    general = F.transform(
        parts, lambda s: F.when(s.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z]+)$", 1))).otherwise(s)
    )
    return F.when(F.size(general) > DEPTH, F.concat(F.slice(general, 1, DEPTH), F.array(F.lit("**")))).otherwise(general)


def few_bytes(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, a table just written, with a broadcast hint if its rows, whose ``keys`` are strings or arrays of them, were summed to less than BROADCAST_BYTES."""
    texts = [F.array_join(k, "/") if isinstance(df.schema[k].dataType, ArrayType) else F.col(k) for k in keys]
    total = df.agg(F.sum(sum((F.octet_length(t) for t in texts), F.lit(64 + 24 * (DEPTH + 1))))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def templates(counts: DataFrame) -> DataFrame:
    """(host, raw shape, n, labelled, blocked) -> (host, raw, template): nodes with very many children become wildcards.

    The nodes of a depth are written before they are joined, so the plan grows by one join a depth instead of twofold.
    """
    out = counts.withColumn("template", F.col("raw"))
    for d in range(1, DEPTH + 1):
        node = F.slice("template", 1, d - 1)
        has = F.size("template") >= d
        here = out.where(has).groupBy("host", node.alias("node"), F.col("template")[d - 1].alias("child")).agg(F.sum("n").alias("n"))
        # An exact count of children by counting grouped rows; no distinct sets are collected.
        varied = here.groupBy("host", "node").agg(F.count("*").alias("children"), F.sum("n").alias("total"))
        varied = varied.where((F.col("children") >= VARIED) & (F.col("children") * 2 > F.col("total"))).select("host", "node", F.lit(True).alias("varied"))
        varied = few_bytes(materialize(varied, f"varied-{d}", few=True), "host", "node")
        out = out.withColumn("node", node).join(varied, ["host", "node"], "left")
        wild = F.concat(node, F.array(F.lit("*")), F.slice(F.col("template"), d + 1, DEPTH + 1))
        out = out.withColumn("template", F.when(has & F.col("varied"), wild).otherwise(F.col("template"))).drop("node", "varied")
    return out


def merged(shaped: DataFrame) -> DataFrame:
    """(host, raw, template, n, labelled, blocked) with like sibling branches under the name of the largest, from the deepest level up."""
    for d in range(DEPTH, 0, -1):
        out = shaped.withColumns({"node": F.slice("template", 1, d - 1), "child": F.get("template", F.lit(d - 1)), "tail": F.slice("template", d + 1, DEPTH + 1)})
        cells = out.where(F.size("template") >= d).groupBy("host", "node", "child", "tail").agg(
            F.sum("n").cast("double").alias("n"), F.sum("labelled").cast("double").alias("l"), F.sum("blocked").cast("double").alias("b")
        )
        cells = materialize(cells, f"cells-{d}", few=True)
        k = 0
        while k < LEADERS or several_left(cells):
            like = materialize(like_leaders(cells), f"like-{d}-{k}", few=True)
            out = out.join(like, ["host", "node", "child"], "left")
            wild = F.concat("node", F.array(F.concat(F.lit("~"), F.col("leader"))), "tail")
            out = out.withColumn("template", F.when(F.col("several"), wild).otherwise(F.col("template"))).drop("leader", "several")
            cells = cells.join(like.select("host", "node", "child"), ["host", "node", "child"], "left_anti")
            k += 1
            if k >= LEADERS:  # plans must not grow with the rounds
                cells = materialize(cells, f"left-{d}-{k}", few=True)
            if k > LEADERS:
                out = materialize(out, f"named-{d}-{k}", few=True)
        shaped = materialize(out.drop("node", "child", "tail"), f"merged-{d}", few=True)
    return shaped


def several_left(cells: DataFrame) -> bool:
    """Whether a node has two branches that no leader took."""
    return not cells.groupBy("host", "node").agg((F.min("child") < F.max("child")).alias("two")).where("two").isEmpty()


def like_leaders(cells: DataFrame) -> DataFrame:
    """(host, node, child, leader, several) of the branches that are like the largest of their node, itself among them.

    The statistic is that of two samples of sizes Nc and Nl, the sum over what follows below of (sqrt(Nl / Nc) c - sqrt(Nc / Nl) l)^2 / (c + l), of which
    what is below the leader alone is summed by its complement. Its ratio of sizes is taken out of the sum, so one aggregation finds all that a branch needs.
    """
    sums = cells.groupBy("host", "node", "child").agg(*(F.sum(c).alias(c) for c in ("n", "l", "b")), F.count("*").alias("tails"))
    top = sums.groupBy("host", "node").agg(F.max(F.struct("n", "child", "l", "b", "tails")).alias("top"))
    beside = cells.join(top, ["host", "node"])
    own = beside.where(F.col("child") == F.col("top.child")).select("host", "node", "tail", F.col("n").alias("other"))
    both = beside.join(own, ["host", "node", "tail"], "left").fillna(0.0, ["other"])
    c, o = F.col("n"), F.col("other")
    rows = both.groupBy("host", "node", "child").agg(
        *(F.sum(x).alias(x) for x in ("n", "l", "b")), F.count("*").alias("tails"), F.max("top").alias("top"), F.sum("other").alias("met"),
        F.count(F.when(o > 0, 1)).alias("common"), F.sum(c * c / (c + o)).alias("cc"), F.sum(c * o / (c + o)).alias("co"), F.sum(o * o / (c + o)).alias("oo"),
    )
    ratio = F.col("top.n") / F.col("n")
    chi = ratio * F.col("cc") - 2.0 * F.col("co") + F.col("oo") / ratio + (F.col("top.n") - F.col("met")) / ratio
    df = (F.col("tails") + F.col("top.tails") - F.col("common") - 1).cast("double")
    spread = 2.0 / (9.0 * df)
    critical = F.when(df > 0, df * F.pow(1.0 - spread + NORMAL * F.sqrt(spread), F.lit(3.0))).otherwise(F.lit(0.0))
    rate = (F.col("b") + F.col("top.b") + 1.0) / (F.col("l") + F.col("top.l") + 2.0)
    off = F.col("b") - F.col("l") * rate
    agree = (F.col("l") == 0) | (F.col("top.l") == 0) | (off * off < CRITICAL * F.col("l") * rate * (1.0 - rate))
    like = rows.where((F.col("child") == F.col("top.child")) | ((chi <= critical + ROUNDING) & agree)).select("host", "node", "child", F.col("top.child").alias("leader"))
    counts = like.groupBy("host", "node").agg((F.count("*") > 1).alias("several"))
    return like.join(counts, ["host", "node"])


def judge(shaped: DataFrame) -> DataFrame:
    """(host, template, purity) of each template, smoothed towards the branches above it.

    Each template meets the sums of its branches, DEPTH + 2 at most, and folds them from the host down.
    """
    rows = shaped.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    above = F.explode(F.sequence(F.lit(0), F.size("template"))).alias("d")
    branches = rows.select("host", "template", "labelled", "blocked", above).withColumn("node", F.expr("slice(template, 1, d)"))
    sums = branches.groupBy("host", "node").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    sums = few_bytes(materialize(sums, "branches", few=True), "host", "node")
    steps = branches.join(sums, ["host", "node"]).groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("d", "l", "b"))).alias("steps"))
    purity = F.aggregate("steps", F.lit(PRIOR), lambda p, s: (s["b"] + A * p) / (s["l"] + A))
    return steps.select("host", "template", purity.alias("purity"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", hidden: Column | None = None) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, purity (of its template, also where a rule decides).

    ``hidden``: rows for which this holds are no labels; for tests of what the tree says about them.
    """
    hide = F.lit(False) if hidden is None else F.coalesce(hidden, F.lit(False))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("u"), hide.alias("hide"))
    host, path = host_and_path(F.col("u"))
    rows = rows.select("id", host.alias("host"), path.alias("path"), "hide")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), shape(F.col("path")).alias("raw"), "hide")
    label = F.when(~F.col("hide"), F.col("by_rule"))
    counts = rows.groupBy("host", "raw").agg(F.count("*").alias("n"), F.count(label).alias("labelled"), F.count(F.when(label == "block", 1)).alias("blocked"))
    shaped = merged(materialize(templates(materialize(counts, "shapes", few=True)), "templates", few=True))
    verdicts = shaped.join(judge(shaped), ["host", "template"]).select(F.col("host").alias("h"), F.col("raw").alias("r"), "purity")
    verdicts = materialize(verdicts, "verdicts", few=True)
    verdicts = few_bytes(verdicts, "h", "r")
    out = rows.join(verdicts, (F.col("host") == F.col("h")) & (F.col("raw") == F.col("r")))
    by_method = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), "purity")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def _rule_case(column: int) -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", (h + p, v)[column]) for h, p, v in ordered]
    return "CASE " + " ".join(f"WHEN {cond} THEN '{value}'" for cond, value in fits) + " END"


def _level(d: int) -> str:
    """One depth of the tree: nodes with very many children get a wildcard."""
    return f"""
here{d} AS (SELECT host, template[1:{d - 1}] AS node, template[{d}] AS child, sum(n) AS n FROM t{d - 1} WHERE len(template) >= {d} GROUP BY 1, 2, 3),
varied{d} AS (SELECT host, node FROM here{d} GROUP BY 1, 2 HAVING count(*) >= {VARIED} AND count(*) * 2 > sum(n)),
t{d} AS (SELECT t.host, raw, n, labelled, blocked,
  CASE WHEN len(template) >= {d} AND v.host IS NOT NULL THEN template[1:{d - 1}] || ['*'] || template[{d + 1}:] ELSE template END AS template
  FROM t{d - 1} t LEFT JOIN varied{d} v ON t.host = v.host AND template[1:{d - 1}] = v.node)"""


def _like(d: int, k: int) -> str:
    """The branches of one depth that are like the largest one of those left: (host, node, child, leader, several)."""
    i = f"{d}_{k}"
    return f"""
sum{i} AS (SELECT host, node, child, sum(n) AS n, sum(l) AS l, sum(b) AS b, count(*) AS tails FROM cell{i} GROUP BY ALL),
top{i} AS (SELECT host, node, max({{'n': n, 'child': child, 'l': l, 'b': b, 'tails': tails}}) AS top FROM sum{i} GROUP BY ALL),
own{i} AS (SELECT c.host, c.node, tail, n AS other FROM cell{i} c JOIN top{i} t ON c.host = t.host AND c.node = t.node AND c.child = t.top.child),
term{i} AS (SELECT c.host, c.node, c.child, c.n AS c, coalesce(other, 0) AS o, t.top.n / s.n AS ratio FROM cell{i} c
  LEFT JOIN own{i} o ON c.host = o.host AND c.node = o.node AND c.tail = o.tail JOIN sum{i} s ON c.host = s.host AND c.node = s.node AND c.child = s.child
  JOIN top{i} t ON c.host = t.host AND c.node = t.node),
chi{i} AS (SELECT host, node, child, sum((ratio * c * c - 2 * c * o + o * o / ratio) / (c + o)) AS chi, sum(o) AS met, count(*) FILTER (o > 0) AS common
  FROM term{i} GROUP BY ALL),
test{i} AS (SELECT s.*, t.top, chi + s.n / t.top.n * (t.top.n - met) AS chi, (s.tails + t.top.tails - common - 1)::DOUBLE AS df,
  (s.b + t.top.b + 1) / (s.l + t.top.l + 2) AS rate FROM sum{i} s JOIN top{i} t ON s.host = t.host AND s.node = t.node
  JOIN chi{i} c ON s.host = c.host AND s.node = c.node AND s.child = c.child),
like{i} AS (SELECT host, node, child, top.child AS leader, count(*) OVER (PARTITION BY host, node) > 1 AS several FROM test{i} WHERE child = top.child OR
  (chi <= CASE WHEN df > 0 THEN df * power(1 - 2.0::DOUBLE / (9 * df) + {NORMAL}::DOUBLE * sqrt(2.0::DOUBLE / (9 * df)), 3) ELSE 0 END + {ROUNDING}::DOUBLE
   AND (l = 0 OR top.l = 0 OR (b - l * rate) * (b - l * rate) < {CRITICAL}::DOUBLE * l * rate * (1 - rate)))),
cell{d}_{k + 1} AS (SELECT * FROM cell{i} c WHERE NOT EXISTS (FROM like{i} x WHERE c.host = x.host AND c.node = x.node AND c.child = x.child))"""


def _merge(d: int) -> str:
    """One depth, from the deepest up: like branches get one name. ``m{DEPTH + 1}`` is the table before."""
    named = " ".join(f"WHEN x{k}.several THEN r.node || ['~' || x{k}.leader] || tail" for k in range(LEADERS))
    joins = " ".join(f"LEFT JOIN like{d}_{k} x{k} ON r.host = x{k}.host AND r.node = x{k}.node AND r.child = x{k}.child" for k in range(LEADERS))
    return f"""
r{d} AS (SELECT *, template[1:{d - 1}] AS node, template[{d}] AS child, template[{d + 1}:] AS tail FROM m{d + 1}),
cell{d}_0 AS (SELECT host, node, child, tail, sum(n)::DOUBLE AS n, sum(labelled)::DOUBLE AS l, sum(blocked)::DOUBLE AS b FROM r{d} WHERE len(template) >= {d} GROUP BY ALL),
{",".join(_like(d, k) for k in range(LEADERS))},
m{d} AS (SELECT r.host, raw, n, labelled, blocked, CASE {named} ELSE template END AS template FROM r{d} r {joins})"""


def _smooth(d: int) -> str:
    """Purity of the branches of depth d; ``q0`` starts from the prior."""
    return f"""
s{d} AS (SELECT host, template[1:{d}] AS node, sum(l) AS sl, sum(b) AS sb FROM q{d} WHERE len(template) >= {d} GROUP BY ALL),
q{d + 1} AS (SELECT q.host, template, l, b, CASE WHEN len(template) >= {d} THEN (sb + {A}::DOUBLE * purity) / (sl + {A}::DOUBLE) ELSE purity END AS purity
  FROM q{d} q LEFT JOIN s{d} s ON s.host = q.host AND s.node = q.template[1:{d}])"""


OP8_SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
g AS (SELECT *, {_rule_case(0)} AS rule, {_rule_case(1)} AS by_rule,
  [CASE WHEN regexp_matches(x, '[0-9]') THEN '*' || regexp_extract(x, '(\\.[A-Za-z]+)$', 1) ELSE x END
   FOR x IN string_split(path, '/') IF x <> ''] AS parts FROM s),
u AS (SELECT *, CASE WHEN len(parts) > {DEPTH} THEN parts[1:{DEPTH}] || ['**'] ELSE parts END AS raw FROM g),
t0 AS (SELECT host, raw, count(*) AS n, count(by_rule) AS labelled, count(*) FILTER (by_rule = 'block') AS blocked, raw AS template
  FROM u GROUP BY host, raw),{",".join(_level(d) for d in range(1, DEPTH + 1))},
m{DEPTH + 1} AS (SELECT * FROM t{DEPTH}),{",".join(_merge(d) for d in range(DEPTH, 0, -1))},
q0 AS (SELECT host, template, sum(labelled)::DOUBLE AS l, sum(blocked)::DOUBLE AS b, {PRIOR}::DOUBLE AS purity FROM m1 GROUP BY host, template),{",".join(_smooth(d) for d in range(DEPTH + 2))}
SELECT page_id, u.host, path, rule, coalesce(by_rule, CASE WHEN purity >= {REJECT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, purity
FROM u JOIN m1 t ON u.host = t.host AND u.raw = t.raw JOIN q{DEPTH + 2} w ON w.host = t.host AND w.template = t.template
"""
