"""URL filter: expressions of host suffixes and path prefixes, joined to rules on short hash prefixes.

A rule is a host and a path, such as ``example.net/en/``. It fits the host and all its
subdomains if the URL's path starts with the rule's path. The longest rule wins; of equally long ones the one with the
longer host, then blocking before allowing.

A rule is known by the hash of its host and its path up to the last slash. A URL is expanded into the
same kind of expression: every suffix of its host at a dot, with every prefix of its path
that ends with a slash, and with no path. Only as many labels and slashes as some rule has are expanded;
more cannot fit. The expressions meet the rules in an equi join on the first eight
hexadecimal digits of a SHA-256; the few that meet are confirmed by the whole digest
and by the rest of the rule's path, and one row per fitting URL goes back to the pages. URLs that no rule
fits leave the work at the first join.

Rules are broadcast when they are few (``skew.broadcast_checked``); beyond that both sides are shuffled,
and a very common host's partition can be split. Defined results: a null URL, or one without ``://``, has an empty
host and path; with no fitting rule the verdict is ``default`` (allow) and the rule is null; repeated pages
count each; empty tables of pages or rules work; only id and URL are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgold.operators.skew import broadcast_checked, lookup_join

ALLOW, BLOCK = "allow", "block"
#: Host and path of a URL: what follows the first ``://``.
AFTER_SCHEME = r"://([^/?#]*)([^?#]*)"
PREFIX_DIGITS = 8


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, AFTER_SCHEME, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, AFTER_SCHEME, 2), F.lit(""))


def digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def short(expression: Column) -> Column:
    """The short prefix of an expression's hash."""
    return F.substring(digest(expression), 1, PREFIX_DIGITS)


def rule_index(rules: DataFrame) -> DataFrame:
    """``rules`` (rule, verdict) by the hash of the expression that URLs they fit expand to."""
    rule = F.col("rule")
    host = lower_ascii(F.substring_index(rule, "/", 1))
    path = F.substr(rule, F.length(F.substring_index(rule, "/", 1)) + 1)
    parts = rules.where(rule.isNotNull()).select(
        rule, F.col("verdict"), host.alias("rule_host"), path.alias("rule_path")
    )
    # Up to the last slash; a rule without a slash has no path.
    tail = F.when(F.col("rule_path") == "", 0).otherwise(F.length(F.substring_index("rule_path", "/", -1)))
    anchor = F.concat("rule_host", F.substr("rule_path", F.lit(1), F.length("rule_path") - tail))
    return parts.select(
        "*",
        digest(anchor).alias("rule_digest"),
        short(anchor).alias("prefix"),
        F.size(F.split("rule_host", r"\.")).alias("labels"),
        (F.size(F.split("rule_path", "/")) - 1).alias("slashes"),
    )


def expressions(host: Column, path: Column, labels: int, slashes: int) -> Column:
    """Host suffixes of up to ``labels`` labels, each with every path prefix of up to ``slashes`` slashes."""
    names, steps = F.split(host, r"\."), F.split(path, "/")
    count = F.size(names)
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), count - labels + 1), count),
        lambda i: F.array_join(F.slice(names, i, count - i + 1), "."),
    )
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.lit(slashes), F.size(steps) - 1)),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, F.lit(1), k), "/"), F.lit("/"))),
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge(
    pages: DataFrame, rules: DataFrame, default: str = ALLOW, key: str = "page_id", url: str = "url"
) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, the ``rule`` that decides, and the ``verdict``.

    ``rules`` has the columns ``rule`` and ``verdict``.
    """
    targets = pages.select(
        F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    )
    index = rule_index(rules)
    most = index.agg(F.max("labels").alias("labels"), F.max("slashes").alias("slashes")).first()
    if most["labels"] is None:
        return targets.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    expanded = expressions(F.col("host"), F.col("path"), most["labels"], most["slashes"])
    asked = targets.select("host", "path", F.explode(expanded).alias("expression"))
    met = lookup_join(
        asked.withColumn("prefix", short(F.col("expression"))),
        broadcast_checked(index.drop("labels", "slashes")),
        ["prefix"],
        "inner",
    )
    fits = (F.col("rule_digest") == digest(F.col("expression"))) & F.startswith("path", F.col("rule_path"))
    order = F.struct(
        F.length("rule").alias("n"),
        F.length("rule_host").alias("h"),
        (F.col("verdict") == BLOCK).alias("b"),
        "rule",
        "verdict",
    )
    decided = met.where(fits).groupBy("host", "path").agg(F.max(order).alias("best"))
    return lookup_join(targets, decided, ["host", "path"]).select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
