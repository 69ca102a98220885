"""URL filters: rules first, then a path-template tree learned per host.

A host's paths form a tree, one level for each segment. At each node, a child whose block rate
differs significantly from that of its siblings together is a branch of its own; such branches merge
while their rates do not differ. The other labelled children are one branch, the unlabelled ones
another, so no labels judge a different segment without labels. Only where a node has
``LEAST_VARIABLE`` or more different segments of fewer than ``LEAST_LITERAL`` urls (ids, slugs) is the
position variable: those of them that do not differ are the wildcard ``*`` and share their labels. A
branch is written ``{a|b}``, beyond ``NAMED`` members with its first ones and their number. A template
is rejected if its smoothed labelled purity, (blocked + ALPHA * PRIOR) / (labelled + ALPHA), is over
``REJECT``. Labels are the rules' verdicts unless the caller gives a column of its own.

The tree is built level by level from grouped counts of distinct paths. Neither the size of a segment
nor the number of branches of a node is capped: nodes are summed by aggregation, and branches are
merged in one sorted pass that holds one row at a time.

Defined results: a null url or one without :// has host and path '' (no rule fits, and its template
is judged like any other); beyond ``DEPTH`` segments only
nodes whose labels could still differ grow, and the rest of a path counts as one ``**``; repeated rows count as
often as they occur; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialize
from .wrappers import url_host

#: (verdict, rule); a rule is a host suffix and a path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Levels that every branch has; further ones grow where labels could differ.
DEPTH = 5
LEAST_LITERAL = 3
#: So many different segments of fewer than LEAST_LITERAL urls make a position variable.
LEAST_VARIABLE = 8
NAMED = 8
ALPHA = 2.0
PRIOR = 0.25
REJECT = 0.5
#: Two rates differ if they are so many standard errors apart (the root of the likelihood ratio).
DIFFER = 1.96


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end; '' where there is no ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        name, slash, rest = r.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = rule.when(fits, F.lit(r)), verdict.when(fits, F.lit(v))
    return rule, verdict


def _likelihood(blocked: Column, labelled: Column) -> Column:
    """Log-likelihood of so many blocked of so many labelled at their own rate."""

    def f(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))

    return f(blocked) + f(labelled - blocked) - f(labelled)


def _differ(b1: int, l1: int, b2: int, l2: int) -> bool:
    """Whether two rates differ, by their likelihood ratio."""

    def f(b: int, n: int) -> float:
        return sum(x * log(x) for x in (b, n - b) if x) - (n * log(n) if n else 0.0)

    return 2 * (f(b1, l1) + f(b2, l2) - f(b1 + b2, l1 + l2)) > DIFFER**2


def _merge_branches(differing: DataFrame) -> DataFrame:
    """host, prefix, segment, cluster: siblings in order of block rate join the last cluster while they do not differ from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, cluster, b_sum, l_sum = None, 0, 0, 0
        for batch in batches:
            out = []
            for host, prefix, blocked, labelled in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
                if (host, prefix) != node:
                    node, cluster, b_sum, l_sum = (host, prefix), 0, 0, 0
                elif _differ(blocked, labelled, b_sum, l_sum):
                    cluster, b_sum, l_sum = cluster + 1, 0, 0
                b_sum, l_sum = b_sum + blocked, l_sum + labelled
                out.append(str(cluster))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string())], names=["host", "prefix", "segment", "cluster"])

    slim = differing.select("host", "prefix", "segment", "blocked", "labelled")
    order = ["host", "prefix", F.col("blocked") / F.col("labelled"), F.desc("labelled"), "segment"]
    return arrow_map(slim.repartition("host", "prefix").sortWithinPartitions(*order), run, "host string, prefix string, segment string, cluster string")


def _branches(counts: DataFrame, least_literal: int) -> DataFrame:
    """host, prefix, segment, merged for the children of every node that are no wildcard."""
    b, n = F.col("blocked").cast("double"), F.col("labelled").cast("double")
    nodes = counts.groupBy("host", "prefix").agg(
        F.sum("labelled").cast("double").alias("all_l"),
        F.sum("blocked").cast("double").alias("all_b"),
        F.count_if(F.col("labelled") > 0).cast("double").alias("kids"),
        F.count_if(F.col("n") < least_literal).alias("rare"),
        F.coalesce(F.sum(F.try_divide(b * b, n)), F.lit(0.0)).alias("squares"),
    )
    all_b, all_l, kids = F.col("all_b"), F.col("all_l"), F.col("kids")
    ratio = 2 * (_likelihood(b, n) + _likelihood(all_b - b, all_l - n) - _likelihood(all_b, all_l))
    # The dispersion of the children's rates; one label each is never dispersed.
    spread = F.try_divide((F.col("squares") - all_b * all_b / all_l) * all_l * all_l, all_b * (all_l - all_b))
    uneven = F.coalesce(F.round(spread, 6) > (kids - 1) + DIFFER * F.sqrt(2 * (kids - 1)), F.lit(False))
    # Of many siblings some differ by chance, unless all of them together differ by more than that.
    limit = DIFFER**2 + F.when(uneven & (F.col("n") >= least_literal), F.lit(0.0)).otherwise(2 * F.log(F.greatest(kids, F.lit(1.0))))
    differs = (F.col("labelled") > 0) & (n < all_l) & (ratio > limit)
    variable = (F.col("n") < least_literal) & (F.col("rare") >= LEAST_VARIABLE)
    kind = F.when(differs, "differs").when(variable, "*").when(F.col("labelled") > 0, "labelled").otherwise("unlabelled")
    kinds = materialize(counts.join(nodes, ["host", "prefix"]).withColumn("cluster", kind).filter("cluster <> '*'").select(*counts.columns, "cluster"), "branches")
    clusters = kinds.filter("cluster <> 'differs'").select("host", "prefix", "segment", "cluster").unionByName(_merge_branches(kinds.filter("cluster = 'differs'")))
    clusters = materialize(clusters, "clusters")
    group = ["host", "prefix", "cluster"]
    place = F.row_number().over(Window.partitionBy(*group).orderBy("segment"))
    first = clusters.withColumn("place", place).groupBy(*group).agg(
        F.count(F.lit(1)).alias("members"), F.sort_array(F.collect_list(F.when(F.col("place") <= NAMED, F.col("segment")))).alias("names")
    )
    more = F.when(F.col("members") > NAMED, F.concat(F.lit("|+"), (F.col("members") - NAMED).cast("string"))).otherwise("")
    merged = F.when(F.col("members") > 1, F.concat(F.lit("{"), F.array_join("names", "|"), more, F.lit("}"))).otherwise(F.col("names")[0])
    return clusters.join(first.select(*group, merged.alias("merged")), group).select("host", "prefix", "segment", "merged")


def path_templates(paths: DataFrame, depth: int = DEPTH, least_literal: int = LEAST_LITERAL) -> DataFrame:
    """host, path, template for distinct (host, path) with counts n, labelled, blocked."""
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    at = materialize(paths.withColumn("segments", parts).withColumn("prefix", F.lit("")), "paths")
    k = 0
    while (at.agg(F.max(F.size("segments"))).first()[0] or 0) > k:
        if k >= depth:
            # No split of fewer or more uniform labels than these could be significant.
            sums = at.filter(F.size("segments") > k).groupBy("host", "prefix").agg(F.sum("labelled").cast("double").alias("l"), F.sum("blocked").cast("double").alias("b"))
            grows = sums.filter(-2 * _likelihood(F.col("b"), F.col("l")) > DIFFER**2).select("host", "prefix", F.lit(True).alias("grows"))
            ends = F.col("grows").isNull() & (F.size("segments") > k)
            at = materialize(
                at.join(grows, ["host", "prefix"], "left")
                .withColumn("ends", ends)
                .withColumn("prefix", F.when(F.col("ends"), F.concat("prefix", F.lit("/**"))).otherwise(F.col("prefix")))
                .withColumn("segments", F.when(F.col("ends"), F.slice("segments", 1, k)).otherwise(F.col("segments")))
                .drop("grows", "ends"),
                "paths",
            )
        here = at.filter(F.size("segments") > k).withColumn("segment", F.element_at("segments", k + 1))
        counts = here.groupBy("host", "prefix", "segment").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
        merged = _branches(materialize(counts, "counts"), least_literal)
        at = materialize(
            at.withColumn("segment", F.get("segments", F.lit(k)))
            .join(merged, ["host", "prefix", "segment"], "left")
            .withColumn("prefix", F.when(F.size("segments") > k, F.concat("prefix", F.lit("/"), F.coalesce("merged", F.lit("*")))).otherwise(F.col("prefix")))
            .drop("segment", "merged"),
            "paths",
        )
        k += 1
    return at.select("host", "path", F.col("prefix").alias("template"), "n", "labelled", "blocked")


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, label_col: str | None = None
) -> DataFrame:
    """id, host, path, rule, verdict, template, purity for every row.

    ``label_col`` names a column of 1 (block), 0 (allow) or null; without it rules label the urls.
    """
    url = F.col(url_col)
    slim = pages.select(F.col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path"), (F.col(label_col) if label_col else F.lit(None)).cast("int").alias("label"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = materialize(slim.withColumn("rule", rule).withColumn("ruled", verdict), "urls")
    label = F.col("label") if label_col else F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("int"))
    counts = (
        ruled.withColumn("label", label)
        .groupBy("host", "path")
        .agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"))
    )
    placed = materialize(path_templates(counts), "templates")
    purity = (F.sum("blocked") + ALPHA * PRIOR) / (F.sum("labelled") + ALPHA)
    judged = placed.groupBy("host", "template").agg(F.round(purity, 6).alias("purity"))
    found = ruled.join(placed.select("host", "path", "template"), ["host", "path"]).join(judged, ["host", "template"])
    return found.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(F.col("purity") > REJECT, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template",
        "purity",
    )
