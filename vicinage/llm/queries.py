"""Queries of the operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe_stream, centroids
from . import decontaminate as dc
from . import language, toxicity, url_rules
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_join
from .line_dedup import MIN_SITES, line_dedup
from .packing import pack
from .sharding import assign_shards
from .suffix_dedup import suffix_dedup

SHARDS = 8
CLUSTERS, ROUNDS, COMPONENTS = 8, 10, 64


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = assign_shards(_table(spark, sf_dir, "documents"), SHARDS)
    return got.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, listed rule and verdict of every page.

    A page's label is that of the document whose id stands in its url as a whole
    path word (a suffix like ``.html`` may follow); null labels are none.
    """
    pages, labels = _table(spark, sf_dir, "pages").select("page_id", "url"), _table(spark, sf_dir, "labels")
    poor = labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_did")).agg((F.min("quality") == 0).alias("_poor"))
    number = F.try_to_number(F.regexp_extract(url_rules.host_path(F.col("url"))[1], r"/(\d{1,18})(?:[./]|$)", 1), F.lit("9" * 18)).cast("long")
    rules, fallback = url_rules.mine(pages.withColumn("_number", number).join(poor, F.col("_number") == F.col("_did")), "url", F.col("_poor"))
    return url_rules.judge(pages, rules, fallback).withColumnRenamed("id", "page_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.filter(_remainder(3) != 1))
    got = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return got.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "worst")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exact_dedup(_table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.coalesce(F.col("id") == F.col("keep"), F.col("keep").isNull()).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents")).drop("kept").withColumnRenamed("id", "doc_id")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dc.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return got.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "start", "length", "matches")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents")).drop("th").withColumnRenamed("id", "doc_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return got.withColumnRenamed("id", "doc_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return got.select("doc_id", "n_lines", "n_removed", F.coalesce("text", F.lit("")).alias("kept_text"))


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.learn(docs.filter(_remainder(4) != 2))
    got = language.identify(docs, model)
    return got.withColumnRenamed("id", "doc_id").select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "langs", "proportions")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every whole text between two public tokenizers; texts without tokens have zeros and an empty digest."""
    import public_tokenizers

    got, _ = alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return got.withColumnRenamed("id", "doc_id")


def op12_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final cluster of every whole vector of 64 components; vectors with gaps or of another length have no row."""
    rows, found = centroids.cluster(_table(spark, sf_dir, "embeddings"), CLUSTERS, ROUNDS, components=COMPONENTS)
    # One row a centroid, so it may be sent to all.
    each = found.select("cluster", F.col("inertia").alias("cluster_inertia"), centroids.digest("centroid").alias("centroid_sha256"), "members")
    total = found.agg(F.sum("inertia").alias("inertia"))
    return rows.join(F.broadcast(each.crossJoin(total)), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", F.col("members").alias("cluster_size"))


def op13_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, and the text that they decode to; a null text has none and decodes to an empty one."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = bpe_stream.decode(bpe_stream.encode(_table(spark, sf_dir, "documents"), path), path)
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return got.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_packing": op4_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_jump_sharding": op6_jump_sharding,
    "op7_url_rules": op7_url_rules,
    "op8_toxicity": op8_toxicity,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
    "op11_token_alignment": op11_token_alignment,
    "op12_annulus_clusters": op12_annulus_clusters,
    "op13_bpe_stream": op13_bpe_stream,
}


def _crc_table() -> list[int]:
    out = []
    for v in range(256):
        for _ in range(8):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        out.append(v)
    return out


def _clusters_sql() -> str:
    """Rounds one after the other: each assigns every vector and floors the means of the members."""

    def assigned(name: str, of: str) -> str:
        square = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        return f"""{name} AS MATERIALIZED (SELECT n, i, vec_id, x, distance FROM (
  SELECT v.n, v.vec_id, v.x, c.i, ({square})::BIGINT AS distance FROM v, {of} c) QUALIFY row_number() OVER (PARTITION BY n ORDER BY distance, i) = 1)"""

    steps = [f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS i, x FROM (SELECT x, sha256('3:' || vec_id::VARCHAR) AS h FROM v) ORDER BY h, x LIMIT {CLUSTERS})"""]
    for r in range(ROUNDS):
        steps.append(assigned(f"a{r}", f"c{r}"))
        steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.i, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT i, list((s - ((s % k) + k) % k) // k ORDER BY j) AS x FROM (
      SELECT i, j, sum(x)::BIGINT AS s, count(*) AS k FROM (SELECT i, unnest(x) AS x, generate_subscripts(x, 1) AS j FROM a{r}) GROUP BY i, j) GROUP BY i) m USING (i))""")
    steps.append(assigned("z", f"c{ROUNDS}"))
    return ",\n".join(steps) + f"""
SELECT vec_id, i::INT AS cluster, distance, sum(distance) OVER (PARTITION BY i)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256, count(*) OVER (PARTITION BY i) AS cluster_size
FROM z JOIN c{ROUNDS} c USING (i)"""


ORACLE = {
    "op12_annulus_clusters": _clusters_sql(),
    "op5_line_dedup": f"""
WITH l AS (
  SELECT doc_id, coalesce(source, chr(0)) AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
b AS (SELECT line, min(doc_id) AS first FROM l WHERE trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
j AS (SELECT l.doc_id, l.pos, l.line, b.first IS NOT NULL AND b.first <> l.doc_id AS gone FROM l LEFT JOIN b USING (line))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept_text
FROM j GROUP BY doc_id
""",
    "op6_jump_sharding": f"""
WITH RECURSIVE crc AS (SELECT [{", ".join(map(str, _crc_table()))}]::UBIGINT[] AS t),
d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS raw FROM documents),
s AS (
  SELECT doc_id, len(raw) + 1 AS size,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(raw, lambda x: ((instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1)::UBIGINT)),
             lambda c, x: xor(c >> 8, t[((xor(c, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM d, crc),
jump(doc_id, shards, shard, ahead, key) AS (
  SELECT DISTINCT doc_id, n, -1::BIGINT, 0::BIGINT, ((doc_id::HUGEINT + 18446744073709551616) % 18446744073709551616)::UHUGEINT FROM documents, (VALUES ({SHARDS}), ({SHARDS + 1})) v(n)
  UNION ALL
  SELECT doc_id, shards, ahead, floor((ahead + 1) * (2147483648.0::DOUBLE / ((next // 8589934592)::DOUBLE + 1.0::DOUBLE)))::BIGINT, next
  FROM (SELECT *, (key * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS next FROM jump WHERE ahead < shards)),
ended AS (SELECT doc_id, shards, shard FROM jump WHERE ahead >= shards)
SELECT doc_id, size, text_crc32, 'key' AS law, a.shard::INT AS shard, row_number() OVER (PARTITION BY a.shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, g.shard::INT AS grown_shard
FROM s JOIN ended a USING (doc_id) JOIN ended g USING (doc_id) WHERE a.shards = {SHARDS} AND g.shards = {SHARDS + 1}
""",
    "op9_exact_dedup": """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""",
}
