"""Request paths: ``prefix group/key``, and the status a server answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = "/_cache/"  # the path that peers ask under; a parameter of everything below


def parse_path(path: Column, prefix: str = "/") -> tuple[Column, Column]:
    """Group and key of a path; null without the prefix, or without two parts."""
    rest = F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30))
    parts = F.split(rest, "/", 2)
    both = F.size(parts) == 2
    return F.when(both, parts[0]), F.when(both, parts[1])


def url_key(group: Column, key: Column) -> Column:
    """The escaped path a client asks for."""
    return F.concat(F.lit(PREFIX), F.url_encode(group), F.lit("/"), F.url_encode(key))


def route(requests: DataFrame, groups: DataFrame, source: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """``requests`` (method, path) with group, key, status, action.

    400 for a foreign prefix or fewer than two parts, 404 for an unknown group,
    200 for a removal (DELETE), and for anything else a read: 200 if the key is
    not empty and the source has it, else 500.
    """
    group, key = parse_path(F.col("path"), prefix)
    parsed = requests.withColumns({"group": group, "key": key})
    known = groups.select(F.col("group"), F.lit(True).alias("_known")).distinct()
    there = source.select("group", "key", F.lit(True).alias("_there")).distinct()
    joined = parsed.join(F.broadcast(known), "group", "left").join(there, ["group", "key"], "left")
    removes = F.col("method") == "DELETE"
    status = (
        F.when(F.col("group").isNull(), 400)
        .when(F.col("_known").isNull(), 404)
        .when(removes | ((F.col("key") != "") & F.col("_there").isNotNull()), 200)
        .otherwise(500)
    )
    return joined.select(*requests.columns, "group", "key", status.alias("status"), F.when(removes, "remove").otherwise("read").alias("action"))
