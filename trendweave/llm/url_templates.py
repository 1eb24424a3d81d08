"""URL filter over a path-template tree, with DataFrame functions only.

A url is judged by the longest fitting rule; the rest by what the rules teach about templates.  Per host, the
path's segments form a tree, as deep as the paths are.  A segment stays literal where it is frequent below its
parent, else its digit runs become ``#`` where that shape is frequent, else it is ``*``; so a node has a bounded
number of children.  Each node counts the urls that rules label and those they block.  Branches are merged where
they are statistically alike: children of a node that differ from it to the same side and do not differ from their
common share count together, and from host to leaf, a branch whose blocked share does not differ from its
parent's goes by the parent's; another one gets its own share, smoothed towards its parent's.  A template whose
share of blocked urls comes to ``reject_purity`` is rejected.

A node is known by the combined hash of the segments down to it (64 bits, positions included).

Defined results: a null url or one without ``://`` has an empty host and path; empty segments are skipped;
repeated rows are judged alike and all returned; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runtime as R

Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
REST = r"substring(_url, instr(_url, '://') + 3)"


def host_of() -> Column:
    host = F.expr(rf"regexp_extract({REST}, r'^[^/?#]*', 0)")
    return F.when(F.expr("instr(_url, '://') > 0"), F.translate(host, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lit(""))


def path_of() -> Column:
    return F.when(F.expr("instr(_url, '://') > 0"), F.expr(rf"regexp_extract({REST}, r'^[^/?#]*([^?#]*)', 1)")).otherwise(F.lit(""))


def rule_of(rules: Sequence[Rule]) -> Column:
    """Struct (rule, says) of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [F.when(((F.col("_host") == h) | F.col("_host").endswith("." + h)) & F.col("_path").startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("says"))) for v, h, p in ordered]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,says:string>")


def differs(n: Column, b: Column, share: Column, z: float) -> Column:
    """Whether b of n is too far from a share to be chance."""
    return F.abs(b - n * share) > z * F.sqrt(n * share * (1.0 - share))


def _merged(counts: DataFrame, z: float) -> DataFrame:
    """The nodes with their counts, those of like siblings put together: a node has few children, so no group is large."""
    above = counts.select("_host", (F.col("_at") + 1).alias("_at"), F.col("_node").alias("_parent"), F.col("_labelled").alias("_n"), F.col("_blocked").alias("_b"))
    beside = counts.join(above, ["_host", "_at", "_parent"], "left")
    share = F.col("_b") / F.nullif(F.col("_n"), F.lit(0.0))
    apart = (F.col("_labelled") > 0) & differs(F.col("_labelled"), F.col("_blocked"), share, z)
    beside = beside.withColumn("_side", F.when(apart, F.when(F.col("_blocked") > F.col("_labelled") * share, 1).otherwise(-1)))
    sides = beside.where("_side is not null").groupBy("_host", "_at", "_parent", "_side").agg(F.sum("_labelled").alias("_all"), F.sum("_blocked").alias("_bad"))
    both = beside.join(sides, ["_host", "_at", "_parent", "_side"], "left")
    alike = F.coalesce(~differs(F.col("_labelled"), F.col("_blocked"), F.col("_bad") / F.col("_all"), z), F.lit(False))
    return both.select("_host", "_at", "_node", "_size", F.when(alike, F.col("_all")).otherwise(F.col("_labelled")).alias("_labelled"), F.when(alike, F.col("_bad")).otherwise(F.col("_blocked")).alias("_blocked"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = RULES, min_support: int = 5, min_share: float = 0.02, smoothing: float = 4.0, z: float = 1.96, reject_purity: float = 0.7) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, template, purity."""
    urls = pages.select(F.col(id_col).alias("_id"), F.coalesce(F.col(url_col), F.lit("")).alias("_url")).select("_id", host_of().alias("_host"), path_of().alias("_path"))
    segments = F.filter(F.split("_path", "/"), lambda s: s != "")
    staged = R.materialize(urls.select("*", rule_of(rules).alias("_rule"), segments.alias("_segs")).withColumn("_rid", F.monotonically_increasing_id()), "url-rows")
    down = Window.partitionBy("_rid").orderBy("_depth")
    deep = staged.select("_rid", "_host", F.col("_rule.says").alias("_says"), F.posexplode("_segs").alias("_depth", "_seg")).withColumn("_shape", F.regexp_replace("_seg", "[0-9]+", "#"))
    above = F.coalesce(F.bit_xor(F.xxhash64("_shape", "_depth")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    deep = deep.withColumn("_prefix", above)
    asked = deep.select("_rid", "_host", "_says", "_depth", "_seg", "_shape", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.concat_ws("/", F.lit(k), F.col("_depth").cast("string"), F.col("_prefix").cast("string"), v).alias("key")) for k, v in (("P", F.lit("")), ("S", F.col("_shape")), ("L", F.col("_seg")))])).alias("_ask"))
    asked = R.materialize(asked.select("_rid", "_host", "_says", "_depth", "_seg", "_shape", "_ask.kind", "_ask.key"), "url-segments")
    support = R.materialize(asked.groupBy("_host", "key").agg(F.count("*").alias("_n")), "url-support")
    answered = R.attach(asked, support, ["_host", "key"], "_n", asked.count(), "_rid")
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("_n")))
    known = answered.groupBy("_rid", "_host", "_says", "_depth", "_seg", "_shape").agg(of("P").alias("_p"), of("S").alias("_s"), of("L").alias("_l"))
    often = lambda c: (F.col(c) >= min_support) & (F.col(c) >= min_share * F.col("_p"))
    name = F.when(often("_l"), F.col("_seg")).when(often("_s"), F.col("_shape")).otherwise(F.lit("*"))
    named = R.materialize(known.select("_rid", "_host", "_says", "_depth", name.alias("_name")), "url-names")
    R.drop_tables(asked, support)
    paths = named.groupBy("_rid").agg(F.transform(F.sort_array(F.collect_list(F.struct("_depth", "_name"))), lambda s: s["_name"]).alias("_names"))
    pages_in = staged.join(paths, "_rid", "left").select("_rid", "_id", "_host", "_path", "_rule", F.coalesce("_names", F.array().cast("array<string>")).alias("_names"))
    pages_in = R.materialize(pages_in, "url-templates")
    below = named.withColumn("_node", F.bit_xor(F.xxhash64("_name", "_depth")).over(down.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_parent", F.coalesce(F.lag("_node").over(down), F.lit(0)))
    below = below.select("_rid", "_host", (F.col("_depth") + 1).alias("_at"), "_node", "_parent", "_says")
    roots = staged.select("_rid", "_host", F.lit(0).alias("_at"), F.lit(0).cast("long").alias("_node"), F.lit(None).cast("long").alias("_parent"), F.col("_rule.says").alias("_says"))
    nodes = R.materialize(roots.unionByName(below.select(roots.columns)), "url-nodes")
    R.drop_tables(staged, named)
    counts = nodes.groupBy("_host", "_at", "_node", "_parent").agg(F.count("*").alias("_size"), F.count("_says").cast("double").alias("_labelled"), F.count(F.when(F.col("_says") == "block", 1)).cast("double").alias("_blocked"))
    merged = R.materialize(_merged(R.materialize(counts, "url-counts"), z), "url-merged")
    placed = R.attach(nodes, merged, ["_host", "_at", "_node"], "_size", nodes.count(), "_rid")
    prior = pages_in.agg(((F.count(F.when(F.col("_rule.says") == "block", 1)) + 1) / (F.count("_rule") + 2)).alias("_prior"))
    lines = placed.groupBy("_rid").agg(F.sort_array(F.collect_list(F.struct("_at", "_labelled", "_blocked"))).alias("_line"))
    prior_value = float(prior.first()[0])

    def step(share: Column, x: Column) -> Column:
        n, b = x["_labelled"], x["_blocked"]
        return F.when((n > 0) & differs(n, b, share, z), (b + smoothing * share) / (n + smoothing)).otherwise(share)

    judged = lines.select("_rid", F.aggregate("_line", F.lit(prior_value), step).alias("_purity"))
    says = F.coalesce(F.col("_rule.says"), F.when(F.col("_purity") >= reject_purity, F.lit("block")).otherwise(F.lit("allow")))
    return pages_in.join(judged, "_rid").select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), says.alias("verdict"),
        F.concat(F.col("_host"), F.lit("/"), F.concat_ws("/", "_names")).alias("template"), F.col("_purity").alias("purity"),
    )
