"""URL filter by a tree of path templates per host.

Explicit rules (a short list of host, path and verdict) come first: a rule fits its host and all
subdomains if the path starts with the rule's; the longest wins. Pages that a rule judges are the
labelled pages of the method; labels from elsewhere can be given as a column instead.

For the rest, the paths of a host form a tree. Runs of digits in a segment become `{n}`. Where the
children of a node take too many different values for their number, they become one wildcard.
Then the tree is judged from the root down. A node's purity is the share of blocked pages among
its labelled ones, smoothed towards the purity of its parent. Children whose labels do not differ
from what the parent's purity lets expect, by a test of proportions, are merged into one branch, which is
judged together; the others stay apart. A page is blocked if the purity of its template's branch
reaches the threshold.

Pages are counted per host and shape first, so the tree is built on few rows, and every step is a
grouped sum that is added up before it is shuffled. Verdicts go back to the pages by host and
shape; a host with a third of all pages makes that join uneven, which adaptive execution splits.

Edge cases: a null url and one without `://` have an empty host and path, and are judged as a
host of that name. With a `depth`, deeper paths are judged by their first segments; without one, level
by level to their last; a path that is alone in its branch is followed to its end at once, however long. Paths of fewer than three segments end as a branch of their own down to the
third level. Without labels nothing is blocked. Rows are judged one by one; input columns stay, one that has the name
of a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.llm.rows import give_back, hold
from critiq.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels of the tree that every path goes through; those of a call without `depth=None` in all.
DEPTH = 3
#: Children become a wildcard if they take more values than this, each on fewer pages than that.
MOST_VALUES, FEWEST_PAGES = 20, 3
#: Labelled pages that the parent's purity counts for.
PRIOR = 4.0
#: Standard deviations by which a branch must differ from its parent to stand alone.
APART = 2.0
THRESHOLD = 0.8
RESULTS = ["host", "path", "rule", "template", "purity", "verdict"]


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and the paths that start with `path`."""

    host: str
    path: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        of_host = (host == self.host) | host.endswith("." + self.host)
        return of_host & path.startswith(self.path)


RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without `://`."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judged_by(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The rule that fits (as host and path) and its verdict; the longest, or of equals the longer host."""
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r.verdict))
    none = F.lit(None).cast("string")
    name = reduce(lambda rest, r: F.when(r.fits(host, path), r.host + r.path).otherwise(rest), reversed(ordered), none)
    verdict = reduce(lambda rest, r: F.when(r.fits(host, path), r.verdict).otherwise(rest), reversed(ordered), none)
    return name, verdict


def _segments(path: Column, depth: int | None) -> Column:
    """The segments of a path with digits generalised, or the first ones of them."""
    parts = F.array_remove(F.split(path, "/"), "")
    parts = parts if depth is None else F.slice(parts, 1, depth)
    return F.transform(parts, lambda part: F.regexp_replace(part, "[0-9]+", "{n}"))


def shapes_of(pages: DataFrame) -> DataFrame:
    """(host, segments, pages, labelled, blocked) from host, segments and label (1 blocked, 0 allowed, or null)."""
    return pages.groupBy("host", "segments").agg(
        F.count("*").alias("pages"),
        F.count("label").alias("labelled"),
        F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"),
    )


def template_purity(shapes: DataFrame, depth: int | None = None) -> DataFrame:
    """(host, segments, template, purity) of every shape."""
    every = DEPTH if depth is None else depth
    deepest = shapes.agg(F.max(F.size("segments"))).first()[0] or 0
    levels = max(every, deepest) if depth is None else depth
    results, ended = ["host", "segments", "template", "purity"], []
    total = shapes.agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).first()
    overall = total["blocked"] / total["labelled"] if total["labelled"] else 0.0

    of_host = shapes.groupBy("host").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
    purity = (F.col("b") + PRIOR * overall) / (F.col("n") + PRIOR)
    tree = shapes.join(of_host.select("host", purity.alias("purity")), "host")
    tree = written(tree.withColumn("template", F.lit("")), "url-tree")
    for k in range(levels):
        if k >= every:
            ended.append(tree.where(F.size("segments") <= k).select(*results))
            tree, alone = _one_path_left(tree.where(F.size("segments") > k), k)
            ended.append(alone.select(*results))
            if tree.isEmpty():
                break
        step, above = "step", ["host", "template"]
        tree = tree.withColumn(step, F.get("segments", F.lit(k)))
        values = tree.where(F.col(step).isNotNull()).groupBy(*above, step).agg(F.sum("pages").alias("n"))
        wide = values.groupBy(*above).agg(F.count("*").alias("values"), F.sum("n").alias("n"))
        many = (F.col("values") > MOST_VALUES) & (F.col("n") < FEWEST_PAGES * F.col("values"))
        tree = tree.join(wide.select(*above, many.alias("many")), above, "left")
        own = F.when(F.col(step).isNull(), "").when(F.col("many"), "/*").otherwise(F.concat(F.lit("/"), step))
        tree = written(tree.withColumn("branch", F.concat("template", own)).drop("many"), "url-tree")

        sums = tree.groupBy(*above, "branch", "purity").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
        expected = F.col("n") * F.col("purity")
        spread = F.sqrt(F.col("n") * F.col("purity") * (1.0 - F.col("purity")))
        alike = F.abs(F.col("b") - expected) <= APART * spread
        sums = written(sums.withColumn("alike", (F.col("n") == 0) | alike), "url-branches")
        merged = sums.where("alike").groupBy(*above).agg(F.sum("n").alias("n_alike"), F.sum("b").alias("b_alike"))
        sums = sums.join(merged, above, "left")
        n = F.when(F.col("alike"), F.col("n_alike")).otherwise(F.col("n"))
        b = F.when(F.col("alike"), F.col("b_alike")).otherwise(F.col("b"))
        below = (b + PRIOR * F.col("purity")) / (n + PRIOR)
        tree = tree.drop("purity").join(sums.select(*above, "branch", below.alias("purity")), [*above, "branch"])
        tree = written(tree.drop("template").withColumnRenamed("branch", "template").drop(step), "url-tree")
    return reduce(DataFrame.unionByName, ended, tree.select(*results))


def _one_path_left(tree: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The paths that still share their branch with others, and those that go on alone, judged to their end.

    Below a branch with one path every level has one child, so its purity follows level by level within the row.
    """
    above = ["host", "template"]
    paths = tree.groupBy(*above).agg(F.count("*").alias("paths"))
    tree = written(tree.join(paths, above), "url-tree")
    rest = F.slice("segments", k + 1, F.size("segments"))
    purity = F.aggregate(rest, F.col("purity"), lambda p, _: (F.col("blocked") + PRIOR * p) / (F.col("labelled") + PRIOR))
    template = F.concat("template", F.lit("/"), F.array_join(rest, "/"))
    alone = tree.where("paths = 1").withColumns({"purity": purity, "template": template})
    return tree.where("paths > 1").drop("paths"), alone


def judge_urls(
    pages: DataFrame,
    rules: list[Rule] = RULES,
    url_col: str = "url",
    label: Column | None = None,
    depth: int | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """All rows and columns of `pages` with host, path, rule, template, purity and verdict.

    `label` is an integer column of `pages` (1 for bad pages, 0 for good ones, else null); without
    it the rules' verdicts are the labels. `template` and `purity` are those of the method, also
    where a rule decides. With `depth=None` paths are judged down to their last segment.
    """
    host, path = host_and_path(F.col(url_col))
    held = hold(pages, host=host, path=path, given=F.lit(None).cast("int") if label is None else label)
    name, verdict = judged_by(rules, F.col("host"), F.col("path"))
    held = held.withColumns({"rule": name, "by_rule": verdict, "segments": _segments(F.col("path"), depth)})
    by_rule = F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0)
    labelled = held.select("host", "segments", (by_rule if label is None else F.col("given")).alias("label"))
    shapes = written(shapes_of(labelled), "url-shapes")
    templates = template_purity(shapes, depth)
    keys = [held[n] == templates[n] for n in ("host", "segments")]
    found = held.join(templates.hint("merge"), keys, "left").drop(templates["host"], templates["segments"])
    method = F.when(F.col("purity") >= threshold, "block").otherwise("allow")
    return give_back(found.withColumn("verdict", F.coalesce("by_rule", method)), pages, RESULTS)
