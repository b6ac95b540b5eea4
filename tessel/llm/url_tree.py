"""URL filters: fixed rules first, then a path-template tree.

Templates: per host, each path segment is a node below the template of what comes before it.  Numbers, hexadecimal names, dates and long
mixed names are variable by their form; what is left is literal unless its node has over ``fan_out`` different
literals, which are then one wildcard.  Segments below ``depth`` are one tail.  At the end, sibling templates (equal but for the
last literal) whose labelled rates do not differ by a two-proportion test are merged and share their counts; one without labels stays at the overall rate.  A template is rejected when its
labelled purity, smoothed by ``prior_rows`` rows at the overall rate, reaches ``purity``.

Everything is counted over all rows by partial aggregation; the tables that are joined back hold nodes, not
rows, and the joins are salted, so a host with a third of all rows is split.

Rules (host, path): a rule fits its host and all subdomains if the path starts with the rule's; the longest fits best
(longest host, then longest path).

Defined results: a null URL or one without ``://`` has empty host and path; no rule fits it, and its template is judged like any other
(no labels: allowed); repeated rows count as often as they occur; an empty table gives an empty result; extra columns pass through, but those named template,
purity and rejected are replaced and one named parent goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import materialize

# The rules that op2's contract states.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SALT = 32
LOWER_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), *LOWER_AZ)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def form(seg: Column) -> Column:
    """A segment's variable form, or null for a literal."""
    bare = F.regexp_replace(seg, r"\.[A-Za-z0-9]{1,5}$", "")
    return (
        F.when(bare.rlike("^[0-9]+$"), F.lit("{n}"))
        .when(bare.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit("{date}"))
        .when(bare.rlike("^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.lit("{hex}"))
        .when((F.length(bare) > 24) | bare.rlike("^[A-Za-z_-]*[0-9]{3,}[A-Za-z0-9_-]*$"), F.lit("{id}"))
    )


def salted(rows: DataFrame, nodes: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Left join of a table of nodes, which is entered ``SALT`` times so that rows of one node meet it in as many tasks."""
    wide = nodes.withColumn("_ut_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_ut_salt", F.pmod(F.col(spread), F.lit(SALT)).cast("int")).join(wide, [*keys, "_ut_salt"], "left").drop("_ut_salt")


def templates(urls: DataFrame, depth: int = 6, fan_out: int = 16) -> DataFrame:
    """``urls`` (host, path and more) with ``template`` and ``parent`` (the template without its last literal)."""
    segs = F.filter(F.split(F.regexp_replace("path", "^/", ""), "/"), lambda s: s != "")
    r = urls.withColumn("_ut_h", F.xxhash64("host", "path")).withColumn("_ut_s", segs)
    r = r.withColumn("template", F.lit("")).withColumn("parent", F.lit(""))
    r = materialize(r)
    deepest = min(depth, r.agg(F.max(F.size("_ut_s"))).first()[0] or 0)
    for d in range(deepest):
        r = r.withColumn("_ut_x", F.when(F.size("_ut_s") > d, F.element_at("_ut_s", d + 1))).withColumn("_ut_f", form(F.col("_ut_x")))
        literal = F.col("_ut_x").isNotNull() & F.col("_ut_f").isNull()
        names = r.where(literal).groupBy("host", "template", "_ut_x").agg(F.count(F.lit(1)).alias("c"))
        wide = names.groupBy("host", "template").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > fan_out).select("host", "template", F.lit(True).alias("_ut_wide"))
        r = salted(r, wide, ["host", "template"], "_ut_h")
        part = F.when(F.col("_ut_wide") & literal, F.lit("*")).otherwise(F.coalesce("_ut_f", "_ut_x"))
        r = r.withColumn("_ut_part", part).drop("_ut_wide")
        told = F.col("_ut_part").isNotNull()
        lit = told & literal & (F.col("_ut_part") != "*")
        r = r.withColumn("parent", F.when(told, F.concat(F.when(lit, F.col("template")).otherwise(F.col("parent")), F.lit("/"), F.when(lit, F.lit("?")).otherwise(F.col("_ut_part")))).otherwise(F.col("parent")))
        r = r.withColumn("template", F.when(told, F.concat("template", F.lit("/"), "_ut_part")).otherwise(F.col("template"))).drop("_ut_x", "_ut_f", "_ut_part")
    tail = F.size("_ut_s") > depth
    return r.withColumn("template", F.when(tail, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))).withColumn("parent", F.when(tail, F.concat("parent", F.lit("/**"))).otherwise(F.col("parent"))).drop("_ut_s")


def judge(urls: DataFrame, depth: int = 6, fan_out: int = 16, purity: float = 0.8, prior_rows: float = 4.0, alike: float = 1.96) -> DataFrame:
    """``urls`` (host, path, bad: 1, 0 or null where unlabelled) with template, purity and rejected."""
    r = materialize(templates(urls.drop("template", "parent", "purity", "rejected"), depth, fan_out))
    t = r.groupBy("host", "template", "parent").agg(F.count("bad").alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("b"))
    rate = r.agg(F.avg("bad").alias("rate")).first()["rate"]
    rate = 0.0 if rate is None else float(rate)
    kin = t.groupBy("host", "parent").agg(F.sum("n").alias("kn"), F.sum("b").alias("kb"))
    t = t.join(kin, ["host", "parent"])
    p = F.when(F.col("kn") > 0, F.col("kb") / F.col("kn")).otherwise(0.0)
    noise = F.sqrt(p * (1 - p) * F.when(F.col("n") > 0, 1 / F.col("n")).otherwise(0.0))
    merged = (F.col("n") > 0) & (F.abs(F.col("b") / F.greatest("n", F.lit(1)) - p) <= alike * noise)
    n, b = F.when(merged, F.col("kn")).otherwise(F.col("n")), F.when(merged, F.col("kb")).otherwise(F.col("b"))
    t = t.select("host", "template", ((b + prior_rows * rate) / (n + prior_rows)).alias("purity"))
    t = t.withColumn("rejected", F.col("purity") >= purity)
    return salted(r.drop("parent"), t, ["host", "template"], "_ut_h").drop("_ut_h")


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    """The labelled rows are those that a rule judges; the tree judges the rest."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    u = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    u = u.withColumn("rule", rule).withColumn("_verdict", verdict).withColumn("bad", F.when(F.col("_verdict") == "block", 1).when(F.col("_verdict") == "allow", 0))
    j = judge(u)
    return j.select("page_id", "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), "template", "purity")
