"""What payloads hold: paths, counts, nulls and types, and how a mapping fits them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stash

# Names of the types of JSON values by the types that they are read as.
KINDS = {"VOID": "null", "STRING": "string", "BOOLEAN": "boolean", "BIGINT": "integer", "OBJECT": "object", "ARRAY": "array"}


def _kind(value: Column) -> Column:
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    known = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.coalesce(known[name], F.lit("number"))


def payload_profile(df: DataFrame, payload: str) -> DataFrame:
    """``path, n, n_null, null_share, types`` over all rows: nested keys with dots, elements of arrays as ``[]``.

    Payloads are opened level by level: what a level holds is counted, and only its objects and arrays go on, so each value is parsed
    once. Payloads that aren't objects hold nothing.
    """
    top = df.select(F.explode(F.from_json(payload, "map<string,variant>")).alias("path", "value"))
    rows, levels = top.select("path", "value", _kind(F.col("value")).alias("kind")), []
    while True:
        rows = stash(rows, "profile")
        levels.append(rows.groupBy("path", "kind").agg(F.count("*").alias("n")))
        inner = rows.where("kind IN ('object', 'array')")
        if inner.isEmpty():
            break
        keys = inner.where("kind = 'object'").select("path", F.explode(F.col("value").try_cast("map<string,variant>")).alias("key", "value"))
        items = inner.where("kind = 'array'").select(F.concat("path", F.lit("[]")).alias("path"), F.explode(F.col("value").try_cast("array<variant>")).alias("value"))
        opened = keys.select(F.concat_ws(".", "path", "key").alias("path"), "value").unionByName(items)
        rows = opened.select("path", "value", _kind(F.col("value")).alias("kind"))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    told = found.groupBy("path").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("kind") == "null", F.col("n"))), F.lit(0)).alias("n_null"), F.sort_array(F.collect_set("kind")).alias("types")
    )
    return told.withColumn("null_share", F.col("n_null") / F.col("n"))


def gap_report(profile: DataFrame, mapped: list[str]) -> DataFrame:
    """``field, status, overall``: each top-level key of a profile or a mapping's source paths is matching, missing in the payloads or extra;
    overall ``match`` without gaps, ``partial`` with no more gaps than matches, else ``mismatch``."""
    spark = profile.sparkSession
    tops = sorted({p.split(".")[0].split("[")[0] for p in mapped} - {""})
    ours = spark.createDataFrame([(t,) for t in tops], "field string").withColumn("mapped", F.lit(True))
    theirs = profile.select(F.regexp_extract("path", r"^[^.\[]+", 0).alias("field")).distinct().withColumn("there", F.lit(True))
    both = ours.join(theirs, "field", "full_outer")
    status = F.when(F.col("mapped").isNull(), "extra").when(F.col("there").isNull(), "missing").otherwise("matching")
    told = both.select("field", status.alias("status"))
    gaps, hits = F.count_if(F.col("status") != "matching"), F.count_if(F.col("status") == "matching")
    overall = told.agg(F.when(gaps == 0, "match").when((hits > 0) & (gaps <= hits), "partial").otherwise("mismatch").alias("overall"))  # a row
    return told.crossJoin(F.broadcast(overall))
