"""URL allow and block rules by a sorted sweep over canonical keys.

A host's labels are reversed and closed with a separator, then the path follows, so every rule is
a key prefix, that is an interval of keys, and intervals are nested or apart. URLs and interval
ends are put in key order; the rule on top of the stack of open intervals is the one that the
last interval end before a URL leaves there. A URL stands once for each of its host's suffixes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerband.llm.common import narrow, quoted
from peerband.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"


def split_url(url) -> tuple:
    """(host, path): host between the first ``://`` and ``/``, ``?``, ``#`` or the end, with A-Z
    lower-cased; path from there to ``?``, ``#`` or the end; both empty without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER)
    return host, F.regexp_extract(url, PATH, 1)


def _key(labels, path):
    """Reversed labels, each closed by a dot, a separator below all text, the path; as bytes."""
    # A label holds no dot, and no byte of UTF-8 text equals the 0xFF that closes an interval.
    host = F.concat(F.array_join(F.reverse(labels), "."), F.lit(".\x01"))
    return F.encode(F.concat(host, path), "UTF-8")


def _labels(host):
    return F.split(host, r"\.", -1)


def rule_events(rules: DataFrame) -> DataFrame:
    """Both ends of each rule's interval and the rule on top of the stack from there on.

    ``rules`` (host, path, verdict). Repeated rules count once, ``block`` before ``allow``. The
    enclosing rule is the longest proper prefix of the path among rules of the same host.
    """
    base = (
        rules.select(
            F.translate(F.col("host"), UPPER, LOWER).alias("host"),
            F.coalesce("path", F.lit("")).alias("path"),
            "verdict",
        )
        .where("host is not null and host <> ''")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
    )
    shorter = (
        base.where("path <> ''")
        .select(
            "host",
            "path",
            F.explode(
                F.transform(
                    F.sequence(F.lit(0), F.length("path") - 1),
                    lambda n: F.substring(F.col("path"), F.lit(1), n),
                )
            ).alias("outer"),
        )
        .join(base.select("host", F.col("path").alias("outer"), F.col("verdict").alias("over")),
              ["host", "outer"])
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("host", F.col("outer").alias("path"),
                               F.col("over").alias("verdict")), F.length("outer")).alias("parent"))
    )
    ends = base.join(shorter, ["host", "path"], "left")
    own = F.struct("host", "path", "verdict")
    none = F.struct(F.lit("").alias("host"), F.lit("").alias("path"), F.lit("").alias("verdict"))
    key = _key(_labels(F.col("host")), F.col("path"))
    return ends.select(
        F.explode(
            F.array(
                F.struct(key.alias("key"), own.alias("top")),
                F.struct(
                    F.concat(key, F.lit(b"\xff")).alias("key"),
                    F.coalesce("parent", none).alias("top"),
                ),
            )
        ).alias("e")
    ).select("e.key", "e.top")


def match_urls(urls: DataFrame, rules: DataFrame, id_col: str, url_col: str,
               default: str = "allow") -> DataFrame:
    """One row per row of ``urls``: id, host, path, rule (host + path, or null), verdict.

    A rule fits its host and all subdomains when the path starts with the rule's path. The longest
    rule wins, counted over host and path; the longer host wins a tie. Null or malformed URLs have
    an empty host, which no rule fits; they get ``default``. Ids may be null or repeated; other
    columns are ignored. Keys are range partitioned with the row as last key, so that a URL or a
    host that holds a third of all rows is still dealt to many tasks.
    """
    host, path = split_url(F.col("url"))
    base = stage(
        narrow(urls, id=id_col, url=url_col).select(
            F.monotonically_increasing_id().alias("row"), "id",
            host.alias("host"), path.alias("path"),
        ),
        "urls",
    )
    events = rule_events(rules)
    deepest = rules.agg(F.max(F.size(_labels(F.col("host"))))).first()[0] or 0
    labels = _labels(F.col("host"))
    suffixes = F.explode(
        F.transform(
            F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(deepest, 1)))),
            lambda n: F.slice(labels, -n, n),
        )
    )
    keys = base.where("host <> ''").select("row", "path", suffixes.alias("suffix")).select(
        _key(F.col("suffix"), F.col("path")).alias("key"), "row"
    )
    top_type = events.schema["top"].dataType
    points = events.select("key", F.lit(0).alias("kind"), "top", F.lit(-1).cast("long").alias("row"))
    points = points.union(keys.select("key", F.lit(1), F.lit(None).cast(top_type), "row"))
    ordered = stage(
        points.repartitionByRange("key", "kind", F.xxhash64("row")).withColumn(
            "part", F.spark_partition_id()
        ),
        "sweep",
    )
    # What each part leaves open, carried over to the next: one row for each part.
    left = ordered.where("kind = 0").groupBy("part").agg(F.max_by("top", "key").alias("top"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        ordered.select("part").distinct().join(left, "part", "left")
        .select("part", F.last("top", ignorenulls=True).over(before).alias("open"))
    )
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    stabbed = (
        ordered.withColumn("top", F.last("top", ignorenulls=True).over(sweep))
        .where("kind = 1")
        .join(carry, "part")
        .select("row", F.coalesce("top", "open").alias("top"))
        .where("top.host <> ''")
    )
    winners = stabbed.groupBy("row").agg(
        F.max_by(
            "top",
            F.struct(F.length("top.host") + F.length("top.path"), F.length("top.host")),
        ).alias("top")
    )
    return base.join(winners, "row", "left").select(
        "id", "host", "path",
        F.concat("top.host", "top.path").alias("rule"),
        F.coalesce("top.verdict", F.lit(default)).alias("verdict"),
    )
