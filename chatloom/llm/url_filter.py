"""URL rules by a sort-merge range join.

With the labels of a host turned round ("www.example.com" becomes "com.example.www.") the hosts that a rule covers are
those whose key begins with the rule's key: an interval of the sorted keys. So are the paths below a rule's path.
Intervals of prefixes are nested or apart, never crossing. Rules and points are therefore sorted together and swept once;
the innermost open interval is the top of a stack that a rule's start pushes and its end pops. The stack is carried by
the events: a start brings its own stack, an end the stack below it.

A rule bounds host and path independently, so there are two sweeps: distinct hosts through the rules' hosts, then
(rule host, path) through the rules of that host. A sweep runs in sorted ranges side by side; the stack with which a range
begins is the last one of the ranges before, one row for each range. Copies of a host or url combine before any sweep.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.operators.ranking import in_ranges

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, POINT, END = 0, 1, 2


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host lower-cased after the first "://", the path up to "?" or "#"; both empty without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def host_key(host: Column) -> Column:
    """Labels turned round, each followed by a dot, so that a prefix ends at a label's end only."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _nested(prefixes: DataFrame, cuts: Column) -> DataFrame:
    """(prefix, stack): for each distinct prefix its own enclosing prefixes and itself, shortest first.

    ``cuts`` lists the lengths at which a prefix may begin another; joining them with the table finds those that do.
    """
    shorter = prefixes.select("prefix", F.explode(cuts).alias("_n")).select("prefix", F.expr("left(prefix, _n)").alias("_part"))
    known = prefixes.select(F.col("prefix").alias("_part"))
    return (
        shorter.join(known, "_part")
        .groupBy("prefix")
        .agg(F.array_sort(F.collect_set("_part")).alias("stack"))  # by length, as each begins the next
    )


def sweep(points: DataFrame, nested: DataFrame, name: str) -> DataFrame:
    """Rows of ``points`` (with ``prefix``, the key to look up) and ``stack``: the enclosing prefixes, shortest first.

    Keys are compared as bytes, where 0xFF stands behind every text that begins with the prefix.
    """
    key = F.encode("prefix", "UTF-8")
    extra = [c for c in points.columns if c != "prefix"]
    starts = nested.select(key.alias("_at"), F.lit(START).alias("_kind"), "stack")
    ends = nested.select(
        F.concat(key, F.unhex(F.lit("FF"))).alias("_at"), F.lit(END).alias("_kind"), F.slice("stack", F.lit(1), F.size("stack") - 1).alias("stack")
    )
    looked_up = points.select(
        key.alias("_at"), F.lit(POINT).alias("_kind"), F.lit(None).cast("array<string>").alias("stack"), F.struct("prefix", *extra).alias("_row")
    )
    rules = starts.unionByName(ends).withColumn("_row", F.lit(None).cast(looked_up.schema["_row"].dataType))
    events = in_ranges(looked_up.unionByName(rules), [F.col("_at"), F.col("_kind"), F.xxhash64("_row")], name)

    inside = Window.partitionBy("_range").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    closing = events.groupBy("_range").agg(F.max_by("stack", F.when(F.col("stack").isNotNull(), F.struct("_at", "_kind"))).alias("_last"))
    opening = closing.select("_range", F.last("_last", ignorenulls=True).over(before).alias("_open"))
    swept = events.withColumn("stack", F.last("stack", ignorenulls=True).over(inside))
    return (
        swept.filter(F.col("_kind") == POINT)
        .join(F.broadcast(opening), "_range")  # one row for each range
        .select("_row.*", F.coalesce("stack", "_open").alias("stack"))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All columns of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules``: (host, path, verdict), any number of them; hosts are lower-cased. A rule fits its host and all subdomains
    if the url's path begins with the rule's; of the rules that fit the longest (host and path together, then host) wins.
    ``rule`` is its host and path, NULL where none fits: then ``verdict`` is ``default``. Equal rules count once; if they
    disagree, "block" wins. NULL urls and urls without "://" have empty host and path and match no rule, as an empty
    host has none. Empty tables are fine on either side; columns of ``pages`` with the names of the new ones are replaced.
    """
    made = ("host", "path", "rule", "verdict")
    host, path = url_parts(F.col(f"`{url}`"))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_in"), host.alias("host"), path.alias("path"))
    judged = rules.select(lower_ascii(F.col("host")).alias("_rule_host"), F.coalesce("path", F.lit("")).alias("_rule_path"), "verdict")
    judged = judged.filter(F.length("_rule_host") > 0).groupBy("_rule_host", "_rule_path").agg(F.max("verdict").alias("_verdict"))
    judged = judged.withColumn("_host_key", host_key(F.col("_rule_host")))

    # the rules' hosts around each distinct host
    rule_hosts = judged.select(F.col("_host_key").alias("prefix")).distinct()
    by_label = _nested(rule_hosts, _label_ends(F.col("prefix")))
    urls = rows.select("host", "path").distinct()
    hosts = urls.select("host").distinct().filter(F.length("host") > 0).select("host", host_key(F.col("host")).alias("prefix"))
    covered = sweep(hosts, by_label, "hosts").filter(F.size("stack") > 0).select("host", F.explode("stack").alias("_host_key"))

    # below each of them, the rule's path that encloses the url's
    rule_keys = judged.select(_path_key(F.col("_host_key"), F.col("_rule_path")).alias("prefix"), "_rule_host", "_rule_path", "_verdict")
    by_path = _nested(
        judged.select(_path_key(F.col("_host_key"), F.col("_rule_path")).alias("prefix"), F.length("_host_key").alias("_h")).distinct(),
        F.sequence(F.col("_h") + 1, F.length("prefix")),
    )
    paths = urls.join(covered, "host").select("host", "path", _path_key(F.col("_host_key"), F.col("path")).alias("prefix"))
    found = sweep(paths, by_path, "paths").filter(F.size("stack") > 0)
    found = found.select("host", "path", F.try_element_at("stack", F.lit(-1)).alias("prefix")).join(rule_keys, "prefix")
    length = F.struct(F.length("_rule_host") + F.length("_rule_path"), F.length("_rule_host"))
    rule = F.struct(F.concat("_rule_host", "_rule_path").alias("rule"), F.col("_verdict").alias("verdict"))
    best = found.groupBy("host", "path").agg(F.max_by(rule, length).alias("_best"))
    return rows.join(best, ["host", "path"], "left").select(
        *[F.col("_in").getField(c).alias(c) for c in pages.columns if c not in made],
        "host",
        "path",
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )


def _path_key(host: Column, path: Column) -> Column:
    """A slash parts host and path: it is in no host, so no path key of one host begins that of another."""
    return F.concat(host, F.lit("/"), path)


def _label_ends(key: Column) -> Column:
    """Lengths of a host key up to each of its dots."""
    labels = F.split(key, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels) - 1),
        lambda i: (F.aggregate(F.slice(labels, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)) + i).cast("int"),
    )


def rules_table(spark, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows as literals of a plan."""
    made = [F.struct(*[F.lit(x).alias(c) for c, x in zip(("host", "path", "verdict"), rule)]) for rule in rules]
    empty = F.array().cast("array<struct<host: string, path: string, verdict: string>>")
    return spark.range(1).select(F.inline(F.array(*made) if made else empty))
