"""URL rules by a sort-merge range join: rules are intervals of canonical keys, a sorted sweep meets each url with the innermost active rule. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Iterable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, written

DEFAULT = "allow"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def _key(rhost: Column, path: Column) -> Column:
    """Canonical key: reversed host, a separator below every character of a url, path; bytes order as the sweep does."""
    return F.concat(rhost, F.lit("\x01"), path).cast("binary")


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(action, host, path) triples as a table; of equal hosts and paths with both actions ``block`` stays."""
    rows = [F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("action", "host", "path"), rule, strict=True)]) for rule in rules]
    kind = "array<struct<action:string,host:string,path:string>>"
    return spark.range(1).select(F.inline(F.array(*rows).cast(kind)))


def boundaries(rules: DataFrame) -> DataFrame:
    """(rhost, key, rule): from ``key`` on, ``rule`` is on top of the stack of active rules of that host; null when the stack is empty.

    A rule's interval starts at its prefix and ends before prefix + 0xFF, a byte that UTF-8 lacks.
    At its end the stack falls back to the rule around it, the longest other rule that is a prefix.
    """
    r = rules.select(
        "action", F.translate("host", ascii_uppercase, ascii_lowercase).alias("host"), F.coalesce("path", F.lit("")).alias("path")
    ).where("action is not null and host is not null")
    r = r.groupBy("host", "path").agg(F.max("action").alias("action")).withColumn("rhost", _reversed(F.split("host", r"\.")))
    rule = F.struct(
        F.length(F.concat("host", "path")).alias("length"), F.length("host").alias("host_length"), F.concat("host", "path").alias("rule"), F.col("action").alias("verdict")
    )
    r = r.select("rhost", "path", rule.alias("rule"))
    shorter = F.when(F.length("path") > 0, F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda n: F.left(F.col("path"), n)))
    around = r.select("rhost", "path", F.explode(shorter).alias("p")).join(r.select("rhost", F.col("path").alias("p"), F.col("rule").alias("outer")), ["rhost", "p"])
    around = around.groupBy("rhost", "path").agg(F.max_by("outer", F.length("p")).alias("outer"))
    r = r.join(around, ["rhost", "path"], "left")
    begin = _key(F.col("rhost"), F.col("path"))
    none = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("length", "int"), ("host_length", "int"), ("rule", "string"), ("verdict", "string"))])
    end = F.concat(begin, F.unhex(F.lit("FF")))
    return r.select("rhost", begin.alias("key"), "rule").unionByName(r.select("rhost", end.alias("key"), F.coalesce("outer", none).alias("rule")))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (host + path, or null) and verdict of every row.

    A rule fits its host and all subdomains if the path starts with its path; the longest (host and
    path together, then host) wins. So a url is a point on the line of each of its host's suffixes
    that rules name, and each line is swept once, in key order. A line with many of the points is dealt
    to several tasks, with its boundaries copied to each. Null urls and urls without ``://`` have an
    empty host and path and get ``default``. Repeated rows come back as often as they went in. Other
    columns of ``pages`` are ignored. Without rules every row gets ``default``.
    """
    spark = pages.sparkSession
    base = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url")).groupBy("page_id", "url").agg(F.count("*").alias("times"))
    parts = base.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: _reversed(F.slice(labels, n, F.size(labels))))
    bounds = boundaries(rules)
    hosts = bounds.select("rhost").distinct()
    points = parts.select("page_id", "url", "path", F.explode(suffixes).alias("rhost")).join(hosts, "rhost", "left_semi")
    # a line with a share of all points gets that share of the tasks
    counts = written(points.groupBy("rhost").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 1
    lanes = counts.select("rhost", F.ceil(F.col("n") * (2 * partitions(spark)) / total).cast("int").alias("lanes"))
    points = points.join(lanes, "rhost").withColumn("lane", F.pmod(F.xxhash64("page_id", "url"), F.col("lanes")).cast("int"))
    marks = bounds.join(lanes, "rhost").select("rhost", "key", "rule", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"))
    line = points.select("rhost", "lane", _key(F.col("rhost"), F.col("path")).alias("key"), F.lit(1).alias("kind"), "page_id", "url", F.lit(None).cast(bounds.schema["rule"].dataType).alias("rule"))
    line = line.unionByName(marks.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    sweep = Window.partitionBy("rhost", "lane").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = line.withColumn("rule", F.last("rule", True).over(sweep)).where("kind = 1 and rule.rule is not null")
    all_rows = base.select("page_id", "url", "times").unionByName(met.select("page_id", "url", "rule"), allowMissingColumns=True)
    best = all_rows.groupBy("page_id", "url").agg(F.max("times").alias("times"), F.max("rule").alias("rule"))
    best = best.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return best.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("rule.rule").alias("rule"), F.coalesce("rule.verdict", F.lit(default)).alias("verdict"))
