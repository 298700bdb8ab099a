"""URL filters: a sort-merge range join between canonical url keys and prefix rules.

A rule (host, path, verdict) fits a url whose host is the rule's host or a subdomain of it and whose
path starts with the rule's path. The longest fitting rule wins.

Every url is asked once for each of its ancestor hosts ("a.b.org": itself, "b.org" and "org"), under
the key (labels reversed, path). With the host part fixed, the rules' path prefixes are intervals of
the sorted keys, and any two of them nest or are disjoint. One sorted sweep for each reversed host
therefore decides all urls: the sweep carries the stack of rules that were open at the last rule
start; at a url it drops the entries whose interval has ended and takes the deepest that is left.

Everything is built-in expressions. The state of the sweep is one stack, so no group is collected;
hosts with many urls are cut into salted sweeps, and only that host's rules are repeated for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: Rules of the registered query: (host, path, verdict).
DEFAULT_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.coalesce(at, F.lit(0)) > 0, host).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    at = F.instr(url, "://")
    path = F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(at, F.lit(0)) > 0, path).otherwise(F.lit(""))


def reversed_host(host: Column) -> Column:
    """The canonical form of a host: its labels from the last to the first."""
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def rules_frame(spark: SparkSession, rules: tuple = DEFAULT_RULES) -> DataFrame:
    """Rules as a table (rule_host, rule_path, verdict). For a list of any length, pass a stored table instead."""
    if not rules:
        return spark.range(0).selectExpr("'' AS rule_host", "'' AS rule_path", "'' AS verdict")
    names = ("rule_host", "rule_path", "verdict")
    every = F.array(*[F.struct(*[F.lit(value).alias(name) for name, value in zip(names, rule)]) for rule in rules])
    return spark.range(1).select(F.explode(every).alias("rule")).select("rule.*")


def _stacks(rules: DataFrame) -> DataFrame:
    """One row for each rule start: (key_host, path, stack), the stack from the outermost rule to this one.

    Of rules with the same host and path the least verdict counts (block after allow). Rules without
    a host, a path or a verdict fit nothing.
    """
    entry = F.struct("rule_path", "rule_host", "verdict")
    sorted_rules = (
        rules.where("rule_host IS NOT NULL AND rule_path IS NOT NULL AND verdict IS NOT NULL AND rule_host <> ''")
        .withColumn("rule_host", F.translate("rule_host", UPPER, LOWER))
        .groupBy("rule_host", "rule_path")
        .agg(F.min("verdict").alias("verdict"))
        .groupBy("rule_host")
        .agg(F.sort_array(F.collect_list(entry)).alias("rules"))
    )
    empty = F.expr("CAST(array() AS array<struct<rule_path:string,rule_host:string,verdict:string>>)")
    none = F.expr("CAST(array() AS array<array<struct<rule_path:string,rule_host:string,verdict:string>>>)")

    def step(state: Column, rule: Column) -> Column:
        kept = F.filter(state["open"], lambda r: F.startswith(rule["rule_path"], r["rule_path"]))
        opened = F.concat(kept, F.array(rule))
        return F.struct(opened.alias("open"), F.concat(state["all"], F.array(opened)).alias("all"))

    swept = F.aggregate("rules", F.struct(empty.alias("open"), none.alias("all")), step, lambda s: s["all"])
    return (
        sorted_rules.select(reversed_host(F.col("rule_host")).alias("key_host"), F.explode(swept).alias("stack"))
        .withColumn("path", F.element_at("stack", -1)["rule_path"])
        .select("key_host", "path", "stack")
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, default_verdict: str = "allow", sweep_rows: int = 50_000
) -> DataFrame:
    """Judge every row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    ``rule`` is host and path of the longest fitting rule, else null with ``default_verdict``. "Longest"
    counts the characters of host and path; of equally long ones the greater (host, path) wins.
    ``sweep_rows``: urls of one host that one sweep takes before the host gets another salt.

    Null urls and urls without ``://`` have an empty host and path and fit no rule. Repeated rows and
    null ids come back as often as they came. Empty tables give an empty result; an empty rule table
    gives every url the default. Other columns of ``pages``, whatever their names, are ignored.
    """
    rows = pages.select(
        F.col("page_id"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")
    )
    starts = _stacks(rules)
    depth = starts.agg(F.max(F.size(F.split("key_host", r"\."))).alias("depth"))
    # keys: one for each ancestor host that can be a rule's host at all, with its urls counted beforehand
    ancestors = F.expr(
        "transform(sequence(1, least(size(labels), depth)), i -> array_join(slice(labels, 1, i), '.'))"
    )
    keyed = (
        rows.where("host <> ''")
        .withColumn("labels", F.reverse(F.split("host", r"\.")))
        .crossJoin(F.broadcast(depth))
        .where("depth IS NOT NULL")
        .select("page_id", "host", "path", F.explode(ancestors).alias("key_host"))
    )
    rule_hosts = starts.select("key_host").distinct()
    counts = keyed.groupBy("key_host").agg(F.count(F.lit(1)).alias("n_urls"))
    salted_hosts = rule_hosts.join(counts, "key_host").select(
        "key_host", (F.col("n_urls") / F.lit(sweep_rows) + 1).cast("int").alias("n_salts")
    )
    probes = keyed.join(salted_hosts, "key_host").select(
        "key_host",
        F.pmod(F.xxhash64("page_id", "path", "host"), F.col("n_salts")).cast("int").alias("salt"),
        "path",
        F.lit(1).alias("kind"),
        F.lit(None).cast("array<struct<rule_path:string,rule_host:string,verdict:string>>").alias("stack"),
        "page_id",
        "host",
    )
    opened = starts.join(salted_hosts, "key_host").select(
        "key_host",
        F.explode(F.expr("sequence(0, n_salts - 1)")).alias("salt"),
        "path",
        F.lit(0).alias("kind"),
        "stack",
        F.lit(None).cast(rows.schema["page_id"].dataType).alias("page_id"),
        F.lit(None).cast("string").alias("host"),
    )
    sweep = W.partitionBy("key_host", "salt").orderBy("path", "kind").rowsBetween(W.unboundedPreceding, 0)
    found = (
        probes.unionByName(opened)
        .withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
        .where("kind = 1 AND open IS NOT NULL")
        .withColumn("hit", F.expr("try_element_at(filter(open, r -> startswith(path, r.rule_path)), -1)"))
        .where("hit IS NOT NULL")
        .select(
            "page_id",
            "host",
            "path",
            F.struct(
                F.length(F.concat("hit.rule_host", "hit.rule_path")).alias("size"),
                F.col("hit.rule_host").alias("rule_host"),
                F.col("hit.rule_path").alias("rule_path"),
                F.col("hit.verdict").alias("verdict"),
            ).alias("best"),
            F.lit(0).cast("long").alias("copies"),
        )
    )
    every = rows.select(
        "page_id", "host", "path", F.lit(None).cast(found.schema["best"].dataType).alias("best"), F.lit(1).cast("long").alias("copies")
    )
    decided = (
        every.unionByName(found)
        .groupBy("page_id", "host", "path")
        .agg(F.max("best").alias("best"), F.sum("copies").alias("copies"))
    )
    return decided.select(
        "page_id",
        "host",
        "path",
        F.concat("best.rule_host", "best.rule_path").alias("rule"),
        F.coalesce("best.verdict", F.lit(default_verdict)).alias("verdict"),
        F.explode(F.expr("sequence(1L, copies)")).alias("copy"),
    ).drop("copy")
