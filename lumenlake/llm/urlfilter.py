"""URL filter by a tree of path templates for each host.

Digits and long hexadecimal runs of a path are variable by their look; level by level, a segment also becomes
a wildcard if its parent has many different children of few URLs each, or if its branch is statistically like its
siblings': by the labels, where both have enough of them, else by the shape of what follows. A template's purity is
the bad share of its labelled URLs, smoothed towards what its parent holds besides it, and so on up to the host, so
that a branch without labels is judged by what is known around it and no label counts twice. Templates of a purity of
``purity`` or more are rejected. A URL's label is a column of the caller's, else the verdict of a curated rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, UPPER.lower()), path


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does. rules: (verdict, host/path prefix);
    of equally long ones the one with the longer host, then the first in the list."""
    rule = verdict = F.lit(None).cast("string")
    ordered = sorted(enumerate(rules), key=lambda x: (-len(x[1][1]), -x[1][1].index("/"), x[0]))
    for _, (what, text) in reversed(ordered):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


SUMS = ("n", "labelled", "bad", "ends", "varies")


def smoothed(bad: Column, labelled: Column, prior: Column, strength: float) -> Column:
    return (bad + F.lit(strength) * prior) / (labelled + F.lit(strength))


def alike(least: int, z: float) -> Column:
    """Whether child (c_) and its siblings (p_ less c_) are alike: their bad shares if both have least labels, else
    the shares of URLs that end at this segment and that go on with a variable one, if both have least URLs."""

    def near(part: str, of: str) -> Column:
        c, n, p, m = F.col(f"c_{part}"), F.col(f"c_{of}"), F.col(f"p_{part}"), F.col(f"p_{of}")
        rate, rest = p / m, m - n
        error = F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.01)) * (1 / n + 1 / rest))
        return F.abs(c / n - (p - c) / rest) <= z * error

    enough = lambda of: (F.col(f"c_{of}") >= least) & (F.col(f"p_{of}") - F.col(f"c_{of}") >= least)
    shape = F.when(enough("n"), near("ends", "n") & near("varies", "n")).otherwise(False)
    return F.when(enough("labelled"), near("bad", "labelled")).otherwise(shape)


def along_chains(going: DataFrame) -> DataFrame:
    """going with template and level moved on to where the paths of each node part: what all of them share, which is
    what the first and the last of them share, is no choice and stays as it is."""
    node = ["host", "template"]
    ends = going.groupBy(*node).agg(F.min("segments").alias("_a"), F.max("segments").alias("_b"))
    same = F.zip_with("_a", "_b", lambda a, b: a.eqNullSafe(b))
    apart = F.array_position(same, F.lit(False))
    ends = ends.select(*node, F.when(apart > 0, apart - 1).otherwise(F.size("_a")).cast("int").alias("_to"))
    own = going.join(ends, node).withColumn("_more", F.slice("segments", F.col("level") + 1, F.greatest(F.col("_to") - F.col("level"), F.lit(0))))
    own = own.withColumn("template", F.when(F.size("_more") > 0, F.concat_ws("/", "template", F.array_join("_more", "/"))).otherwise(F.col("template")))
    return own.withColumn("level", F.greatest("level", "_to")).drop("_to", "_more")


def generalised(paths: DataFrame, fan: int, share: float, least: int, z: float, prior: float, strength: float) -> DataFrame:
    """paths(host, look, segments, n, labelled, bad) with ``template`` and ``purity``.

    One level at a time, from sums for each node; no group is ever gathered. A path that is alone below its node is
    done: its rest is kept as it is, and so is what all paths of a node share. So there are as many rounds as a path has
    branchings above it, whatever its depth; the driver sees whether any is left.
    """
    top = paths.groupBy("host").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    going = paths.join(top, "host").withColumns({"template": F.lit(""), "prior": F.lit(prior), "level": F.lit(0)})
    going = materialise(going, "level")
    done, node = [], ["host", "template"]
    while True:
        own = along_chains(going)
        after = F.get("segments", F.col("level") + 1)
        own = own.withColumn("_seg", F.get("segments", "level"))
        own = own.withColumn("ends", F.when(after.isNull(), F.col("n")).otherwise(0)).withColumn("varies", F.when(after.contains("#"), F.col("n")).otherwise(0))
        child = own.groupBy(*node, "_seg").agg(F.count(F.lit(1)).alias("c_paths"), *[F.sum(x).alias(f"c_{x}") for x in SUMS])
        parent = child.groupBy(*node).agg(F.sum("c_paths").alias("paths"), F.count("_seg").alias("children"), *[F.sum(F.when(F.col("_seg").isNotNull(), F.col(f"c_{x}"))).alias(f"p_{x}") for x in SUMS])
        both = child.where("_seg IS NOT NULL").join(parent, node)
        variable = (F.col("children") > fan) & (F.col("c_n") < share * F.col("p_n"))
        to = both.select(*node, "_seg", "c_labelled", "c_bad", F.when(F.col("paths") == 1, F.lit(None)).when(variable | alike(least, z), F.lit("*")).otherwise(F.col("_seg")).alias("_to"))
        to = materialise(to.where("_to IS NOT NULL"), "branches")
        sums = to.groupBy(*node, "_to").agg(F.sum("c_labelled").alias("_l"), F.sum("c_bad").alias("_b"))
        to = to.select(*node, "_seg", "_to").join(sums, [*node, "_to"])
        step = own.drop("ends", "varies").join(to, [*node, "_seg"], "left")
        on = F.col("_to").isNotNull()
        outside = smoothed(F.col("b") - F.col("_b"), F.col("l") - F.col("_l"), F.col("prior"), strength)
        new = {"prior": outside, "l": F.col("_l"), "b": F.col("_b")}
        step = step.withColumns({k: F.when(on, v).otherwise(F.col(k)) for k, v in new.items()})
        rest = F.concat_ws("/", F.col("template"), F.slice("segments", F.col("level") + 1, F.greatest(F.size("segments") - F.col("level"), F.lit(0))))
        rest = F.when(F.size("segments") > F.col("level"), rest).otherwise(F.col("template"))
        step = step.withColumn("template", F.when(on, F.concat("template", F.lit("/"), "_to")).otherwise(rest))
        step = materialise(step.withColumn("_on", on).withColumn("level", F.col("level") + 1).drop("_seg", "_to", "_l", "_b"), "level")
        done.append(step.where("NOT _on").drop("_on"))
        going = step.where("_on").drop("_on")
        if going.isEmpty():
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.withColumn("purity", smoothed(F.col("b"), F.col("l"), F.col("prior"), strength))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", label: Column | None = None, purity: float = 0.8, prior: float = 0.5, strength: float = 10.0, fan: int = 16, share: float = 0.05, least: int = 5, z: float = 1.96) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, template, template_purity.

    verdict is the rule's, else block where the template's purity reaches ``purity``, else allow. label: 1 bad, 0
    good; where it is null, what the rules say. strength: how many labels the surroundings weigh; the host's are
    prior. fan, share: more than fan children make those variable that have less than share
    of their parent's URLs. least, z: labels or URLs on both sides, and standard errors, of a test of likeness. A null
    url, or one without "://", has an empty host and path. Repeated rows count and stay; an empty table gives an
    empty one; other columns are left out, whatever their names.
    """
    host, path = host_and_path(F.col(url_col))
    label = F.lit(None) if label is None else label
    own = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), label.cast("int").alias("_label"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": rule, "_ruled": verdict})
    own = own.withColumn("_label", F.coalesce("_label", F.when(F.col("_ruled") == "block", 1).when(F.col("_ruled") == "allow", 0)))
    own = own.withColumn("look", F.regexp_replace(F.regexp_replace("path", "(?i)(?=[a-f]*[0-9])[0-9a-f]{8,}", "#"), "[0-9]+", "#"))
    paths = own.groupBy("host", "look").agg(F.count(F.lit(1)).alias("n"), F.count("_label").alias("labelled"), F.coalesce(F.sum("_label"), F.lit(0)).alias("bad"))
    paths = materialise(paths.withColumn("segments", F.filter(F.split("look", "/"), lambda x: x != "")), "paths")
    judged = generalised(paths, fan, share, least, z, prior, strength).select("host", "look", "template", F.col("purity").alias("template_purity"))
    out = own.join(judged, ["host", "look"])
    by_method = F.when(F.col("template_purity") >= purity, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_ruled", by_method).alias("verdict"), "template", "template_purity")
