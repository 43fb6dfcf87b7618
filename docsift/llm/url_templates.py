"""URL verdicts: fixed host/path rules first, then templates learned per host from the URLs that rules decide.

Per host, paths form a tree, one level per segment.  Runs of digits are `#`;
segments with fewer than `min_rows` pages under their parent fold into one
wildcard `?`; sibling branches that are statistically alike become one branch
(named by their least segment and their number, as `de?2`): their share of
blocked pages lies on the same side of their parent's by a `z` test, and the
same quarter of their pages ends there.  Branches without labelled pages only
join each other.  A template (host and leaf) is rejected if its labelled purity
(blocked + smooth * prior) / (labelled + smooth) reaches `purity`; prior is the
blocked share of all labelled pages.  Templates without labelled pages are
allowed, so the method never blocks on no evidence.

The tree is built on distinct (host, path shape) rows with counts, a level at a
time, by aggregations and joins on (host, node, segment); a host, node or shape
that holds most rows is spread by `join_counted`.  Segments past `depth` are one
wildcard `??` (`?` and `#` cannot occur in a path).

A null url, or one without `://`, has an empty host and path and no rule.  Equal
and null page ids are rows like others; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm.tables import join_counted
from docsift.session import cut_lineage

MIN_ROWS, Z, SMOOTH, PURITY, DEPTH = 5, 2, 2, 80, 8
Rule = tuple[str, str]                                   # (verdict, "host/path")
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path) of a url."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(url, _URL, 1), upper, upper.lower()), F.regexp_extract(url, _URL, 2)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; equally long: the longer host, then as listed."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    ranked = sorted(enumerate(rules), key=lambda r: (-len(r[1][1]), -r[1][1].index("/"), r[0]))
    for _, (verdict, text) in reversed(ranked):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shapes(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, shape, tokens, n, labelled, blocked): distinct path shapes with their pages."""
    n = pages.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("rule").alias("labelled"),
        F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"))
    all_tokens = F.split(F.expr("substring(shape, 2)"), "/", -1)
    tokens = F.when(F.col("shape") == "", F.array().cast("array<string>")).when(
        F.size(all_tokens) > depth, F.concat(F.slice(all_tokens, 1, depth), F.array(F.lit("??")))).otherwise(all_tokens)
    return n.withColumn("tokens", tokens)


def level(paths: DataFrame, d: int, min_rows: int = MIN_ROWS, z: int = Z) -> DataFrame:
    """`paths` (a table) with `node` extended by the branch of token `d`; shorter paths keep theirs."""
    here = paths.filter(F.size("tokens") > d).withColumn("token", F.col("tokens")[d])
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked", "ends")]
    child = here.withColumn("ends", F.when(F.size("tokens") == d + 1, F.col("n")).otherwise(0)).groupBy(
        "host", "node", "token").agg(*sums, F.count(F.lit(1)).alias("paths"))
    child = cut_lineage(child.withColumn("branch", F.when(F.col("n") >= min_rows, F.col("token")).otherwise("?")))
    branch = cut_lineage(child.groupBy("host", "node", "branch").agg(*sums, F.count(F.lit(1)).alias("children")))
    parent = branch.groupBy("host", "node").agg(
        F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"),
        F.count(F.lit(1)).alias("branches"))
    seen, blocked, all_seen, all_blocked = (F.col(c).cast("double") for c in (
        "labelled", "blocked", "all_labelled", "all_blocked"))
    off = blocked * all_seen - all_blocked * seen         # times the number of labelled pages squared, below
    side = (F.when(seen == 0, "none").when(off * off <= z * z * seen * all_blocked * (all_seen - all_blocked), "alike")
            .when(off > 0, "above").otherwise("below"))
    judged = cut_lineage(join_counted(branch, parent, ["host", "node"], "branches").select(
        "host", "node", "branch", "children", F.when(F.col("branch") == "?", "?").otherwise(side).alias("side"),
        F.expr("(8 * ends + n) div (2 * n)").alias("quarter")))
    kind = ["host", "node", "side", "quarter"]
    group = judged.groupBy(*kind).agg(F.min("branch").alias("first"), F.count(F.lit(1)).alias("members"))
    group = group.select(*kind, "members", F.when(F.col("members") == 1, F.col("first")).otherwise(
        F.concat("first", F.lit("?"), F.col("members").cast("string"))).alias("label"))
    named = join_counted(judged, group, kind, "members").select("host", "node", "branch", "children", "label")
    of_token = join_counted(child, named, ["host", "node", "branch"], "children").select(
        "host", "node", "token", "paths", "label")
    grown = join_counted(cut_lineage(here), of_token, ["host", "node", "token"], "paths")
    longer = grown.withColumn("node", F.concat("node", F.lit("/"), F.col("label"))).select(*paths.columns)
    return cut_lineage(longer.unionByName(paths.filter(F.size("tokens") <= d)))


def templates(paths: DataFrame, min_rows: int = MIN_ROWS, z: int = Z, smooth: int = SMOOTH,
              purity: int = PURITY) -> DataFrame:
    """(host, shape, n, template, judged) of a `shapes` table."""
    paths = cut_lineage(paths.withColumn("node", F.lit("")))
    most = paths.agg(F.max(F.size("tokens"))).first()[0] or 0        # at most depth + 1
    for d in range(most):
        paths = level(paths, d, min_rows, z)
    leaf = cut_lineage(paths.groupBy("host", "node").agg(
        F.sum("labelled").alias("leaf_labelled"), F.sum("blocked").alias("leaf_blocked"),
        F.count(F.lit(1)).alias("shapes")))
    seen, blocked = (x or 0 for x in leaf.agg(F.sum("leaf_labelled"), F.sum("leaf_blocked")).first())
    own, bad = F.col("leaf_labelled").cast("double"), F.col("leaf_blocked").cast("double")
    reject = (own > 0) & (100.0 * (bad * float(seen) + float(smooth * blocked))
                          >= float(purity) * (own + float(smooth)) * float(seen))
    leaf = leaf.select("host", "node", "shapes", F.when(reject, "block").otherwise("allow").alias("judged"))
    return join_counted(paths.select("host", "shape", "n", "node"), leaf, ["host", "node"], "shapes").select(
        "host", "shape", "n", F.concat("host", "node").alias("template"), "judged")


def url_verdicts(pages: DataFrame, rules: Sequence[Rule], min_rows: int = MIN_ROWS, z: int = Z, smooth: int = SMOOTH,
                 purity: int = PURITY, depth: int = DEPTH) -> DataFrame:
    """One row per page: host, path, rule that fits, verdict, and its template."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn(
        "_rule", rule_of(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("ruled"),
        F.regexp_replace("path", "[0-9]+", "#").alias("shape"))
    rows = cut_lineage(rows)
    learned = templates(shapes(rows, depth), min_rows, z, smooth, purity)
    return join_counted(rows, learned, ["host", "shape"], "n").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "judged").alias("verdict"), "template")
