"""First value of a key inside JSON, by given paths or at any depth.

Null text, text that is no JSON and documents without the key give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Added to the place of a member that is searched, so that the keys of an object itself come before all inside it.
_INSIDE = 1 << 30


def nested_first(json: str, *paths: str) -> Column:
    """JSON text of the first path (``$.a.b``) that is present, also if its value is null; null if none is."""
    v = F.try_parse_json(F.col(json))
    return F.coalesce(*[F.to_json(F.try_variant_get(v, p, "variant")) for p in paths])


def deep_first(df: DataFrame, key: str, json: str, names: list[str]) -> DataFrame:
    """(key, depth, value): the first value under one of ``names``, any case, in each document; as JSON text.

    ``key`` tells documents apart; rows that share it, null too, are one set of
    documents, of which the first value by JSON text counts.  An object's own keys
    come before what is inside its members; keys by name, entries by place.  An
    object whose first such key holds null gives nothing, and nothing inside it is
    searched.  ``depth`` counts steps from the document, 1 for its own keys; both
    are null where nothing is found.

    All documents go down one level at a time; a level is written before the next.
    """
    wanted = F.lower(F.col("_key")).isin([n.lower() for n in names])
    docs = df.select(F.col(key).alias("_id"), F.col(json).alias("_doc"))
    front = docs.select("_id", "_doc", F.array().cast("array<int>").alias("_path"), F.try_parse_json("_doc").alias("_v"))
    # Every document has a row without a place, so that those without a hit stay.
    hits = docs.select("_id", "_doc", F.lit(None).cast("array<int>").alias("_path"), F.lit(None).cast("string").alias("_value"))
    while True:
        tvf = front.sparkSession.tvf.variant_explode(F.col("_v").outer())
        inside = front.lateralJoin(tvf).select("_id", "_doc", "_path", F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_value"))
        found = F.coalesce(wanted, F.lit(False))
        step = F.concat("_path", F.array(F.when(found, F.col("_pos")).otherwise(F.col("_pos") + _INSIDE)))
        level = written(inside.select("_id", "_doc", step.alias("_path"), found.alias("_found"), "_value"), "levels")
        # A found value is the answer or stops the search; it is not searched itself.
        null = F.is_variant_null("_value")
        own = level.filter("_found").select("_id", "_doc", "_path", F.when(~null, F.to_json("_value")).alias("_value"))
        hits = hits.unionByName(own)
        front = level.filter(~F.col("_found") & F.schema_of_variant("_value").rlike("^(OBJECT|ARRAY)")).select("_id", "_doc", "_path", F.col("_value").alias("_v"))
        if front.isEmpty():
            break
    by = hits.groupBy("_id", "_doc").agg(F.collect_list(F.when(F.col("_path").isNotNull(), F.struct(F.col("_path").alias("path"), F.col("_value").alias("value")))).alias("_hits"))

    def stopped(h: Column) -> Column:
        within = lambda n: F.slice(h["path"], F.lit(1), F.size(n["path"]) - 1) == F.slice(n["path"], F.lit(1), F.size(n["path"]) - 1)
        return F.exists("_hits", lambda n: n["value"].isNull() & (n["path"] < h["path"]) & within(n))

    best = by.select("_id", "_doc", F.array_min(F.filter("_hits", lambda h: h["value"].isNotNull() & ~stopped(h))).alias("_best"))
    first = F.min_by(F.struct(F.size("_best.path").alias("depth"), F.col("_best.value").alias("value")), F.when(F.col("_best").isNotNull(), F.col("_doc"))).alias("_at")
    return best.groupBy(F.col("_id").alias(key)).agg(first).select(key, "_at.depth", "_at.value")
