"""URL verdicts by rules and by a tree of path templates per host; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from code_impact.llm.common import lower_ascii
from code_impact.session import cut_lineage

# Shapes that stand for a value and not for a place in the site: numbers, long hexadecimal strings, UUIDs.
VALUE = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{16,}|[0-9]+"


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (as text, host and path prefix) of (rule, verdict) that fits a URL, or null."""
    fits = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = rule.index("/")
        own = (host == rule[:at]) | host.endswith("." + rule[:at])
        fits = F.when(own & path.startswith(rule[at:]), F.lit(rule)).otherwise(fits)
    return fits


def _slots(path: Column) -> Column:
    """Segments of a path with values as '*'. A last '/' is a segment ''."""
    parts = F.split(F.regexp_replace(path, VALUE, "*"), "/", -1)
    return F.when(path.startswith("/"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def templates(counts: DataFrame, least_pages: int, least_labels: int) -> DataFrame:
    """Add ``template`` to counts (host, slots, n, labelled, bad): from the root down, children with few pages and few labels become '*'.

    A child stays literal if it has ``least_pages`` pages or ``least_labels`` labels, whatever its share of its node; whether
    its sisters are alike is left to the test on labels. Works on rows per host and path shape, not on pages. A round takes one
    level; rows of nodes too small to have a literal child are done with it, so the rounds follow the depth of the data.
    """
    rows, done, level = counts.withColumn("template", F.lit("")), None, 0
    enough = lambda pages, known: (F.col(pages) >= least_pages) | (F.col(known) >= least_labels)
    while True:
        rows = rows.withColumn("slot", F.get("slots", F.lit(level)))
        children = rows.where("slot IS NOT NULL").groupBy("host", "template", "slot").agg(F.sum("n").alias("own"), F.sum("labelled").alias("known"))
        kept = children.where(enough("own", "known")).select("host", "template", "slot", F.lit(True).alias("literal"))
        rows = rows.join(kept, ["host", "template", "slot"], "left")
        name = F.when(F.coalesce("literal", F.lit(False)), F.col("slot")).otherwise(F.lit("*"))
        rows = rows.withColumn("template", F.when(F.col("slot").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), name))).drop("slot", "literal")
        level += 1
        # Only nodes with enough pages or labels below them can have a literal child; elsewhere the rest are wildcards.
        nodes = rows.where(F.size("slots") > level).groupBy("host", "template").agg(F.sum("n").alias("below"), F.sum("labelled").alias("below_known"))
        nodes = nodes.where(enough("below", "below_known")).select("host", "template", F.lit(True).alias("open"))
        rows = rows.join(nodes, ["host", "template"], "left")
        rows = cut_lineage(rows.withColumn("open", F.coalesce("open", F.lit(False)) & (F.size("slots") > level)))
        rest = F.repeat(F.lit("/*"), F.greatest(F.size("slots") - level, F.lit(0)))
        closed = rows.where("NOT open").withColumn("template", F.concat("template", rest)).drop("open")
        done = closed if done is None else done.unionByName(closed)
        rows = rows.where("open").drop("open")
        if rows.isEmpty():
            return done


def judged(rows: DataFrame, z: float, weight: float, threshold: float) -> DataFrame:
    """(host, template, merged, purity, verdict) of templates by labels: similar sisters are merged, impure groups are blocked.

    Sisters differ in their last literal segment alone. In order of their smoothed share of bad labels, a sister joins the
    group before it unless its share differs by a two-proportion test at ``z`` from the group's pooled one or from that of the
    group's first sister. A group's share is smoothed with ``weight``
    labels of its host's share, which is smoothed with as many of the share of all labels.
    """
    all_ = rows.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled")).first()
    prior = (all_["bad"] + 1) / (all_["labelled"] + 2)
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    leaves = rows.groupBy("host", "template").agg(*sums)
    hosts = leaves.groupBy("host").agg(((F.sum("bad") + weight * prior) / (F.sum("labelled") + weight)).alias("host_share"))
    leaves = leaves.join(hosts, "host").withColumn("share", (F.col("bad") + weight * F.col("host_share")) / (F.col("labelled") + weight))
    # 'post-*' and 'item-*' are names too; only a segment that begins with '*' is a value.
    leaves = leaves.withColumn("parent", F.regexp_replace("template", r"/[^/*][^/]*((?:/\*[^/]*|/)*)$", r"/?$1"))
    # Sisters with the same counts have the same share: one row for all of them, so the sisters of a node are a short array.
    alike = ["host", "parent", "labelled", "bad"]
    kinds = leaves.groupBy(*alike).agg(F.first("share").alias("share"), F.count("*").alias("sisters"))

    def differs(p: Column, n: Column, q: Column, m: Column) -> Column:
        pooled = (p * n + q * m) / (n + m)
        return (p > q) & (p - q >= z * F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m)))

    def walked(acc: Column, k: Column) -> Column:
        """A kind of sister starts a group (its number goes to ``starts``) where it differs from the group so far or from its first."""
        size = k["labelled"] + weight
        new = acc["size"].isNull() | differs(k["share"], size, acc["sum"] / acc["size"], acc["size"]) | differs(k["share"], size, acc["first"], acc["first_size"])
        held = lambda c, value: F.when(new, value).otherwise(acc[c]).alias(c)
        return F.struct(
            (acc["at"] + 1).alias("at"),
            F.when(new, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"),
            (F.when(new, 0.0).otherwise(acc["sum"]) + k["share"] * size * k["sisters"]).alias("sum"),
            (F.when(new, 0.0).otherwise(acc["size"]) + size * k["sisters"]).alias("size"),
            held("first", k["share"]),
            held("first_size", size),
        )

    none = F.lit(None).cast("double")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"), none.alias("sum"), none.alias("size"), none.alias("first"), none.alias("first_size"))
    one = F.struct("share", F.col("labelled").cast("double").alias("labelled"), "bad", F.col("sisters").cast("double").alias("sisters"), F.col("labelled").alias("known"))
    nodes = kinds.groupBy("host", "parent").agg(F.sort_array(F.collect_list(one)).alias("ks"))
    nodes = nodes.withColumn("starts", F.aggregate("ks", begin, walked, lambda acc: acc["starts"]))
    kinds = nodes.select("host", "parent", "starts", F.posexplode("ks").alias("at", "k"))
    number = F.size(F.filter("starts", lambda at: at <= F.col("at")))
    kinds = kinds.select("host", "parent", F.col("k.known").alias("labelled"), "k.bad", F.concat_ws(" ", "parent", number.cast("string")).alias("merged"))
    leaves = leaves.join(kinds, alike)
    groups = leaves.groupBy("host", "merged").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"), F.first("host_share").alias("host_share"))
    purity = 1 - (F.col("bad") + weight * F.col("host_share")) / (F.col("labelled") + weight)
    groups = groups.select("host", "merged", purity.alias("purity"), F.when(1 - purity >= threshold, "block").otherwise("allow").alias("judgement"))
    return leaves.select("host", "template", "merged").join(groups, ["host", "merged"])


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    least_pages: int = 20,
    least_labels: int = 10,
    z: float = 1.64,
    weight: float = 10.0,
    threshold: float = 0.5,
) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity), one row per page. ``labels`` has (id, bad 0/1).

    The longest rule that fits decides; elsewhere the template of the URL does: 'block' if its smoothed share of bad labels reaches
    ``threshold``. Host and path of a null URL or one without '://' are empty; such URLs are a host of their own. Repeated
    pages are judged each and counted each; of several labels of an id the worst counts; labels without a page or value are left out.
    All pages and labels count; a host with a third of all pages is
    summed in the tasks before its rows meet.
    """
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = urls.withColumn("slots", _slots(F.col("path")))
    known = labels.where(F.col("bad").isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max("bad").alias("bad"))
    counts = (
        urls.join(known, "id", "left")
        .groupBy("host", "slots")
        .agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    )
    shapes = templates(cut_lineage(counts), least_pages, least_labels)
    verdicts = judged(shapes, z, weight, threshold)
    known_shapes = cut_lineage(shapes.select("host", "slots", "template").join(verdicts, ["host", "template"]))
    found = urls.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).join(known_shapes, ["host", "slots"], "left")
    ruled = F.lit(None).cast("string")
    for rule, verdict in rules:
        ruled = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(ruled)
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(ruled, "judgement").alias("verdict"), "template", "purity")
