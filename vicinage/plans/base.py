"""The tables that queries start from, in Spark and in SQL, and the register of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.neighbours import legal_neighbours, matched_random
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DOMAIN, K = "random-neighbours", 10


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query under its inventory name, with its SQL if SQL can express it."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def rows(spark: SparkSession, d: str) -> DataFrame:
    """Lineitems as rows; order, customer, market segment and customer key modulo 6 are case, lineage, family and fold."""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").cast("long").alias("row_id"), F.col("l_quantity").alias("y"), F.col("l_tax").alias("n"), F.col("l_discount").alias("b"), F.col("l_returnflag").alias("flag"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("lineage"))
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("lineage"), F.col("c_mktsegment").alias("family"))
    return line.join(orders, "case_id").join(cust, "lineage").withColumn("fold", F.col("lineage") % 6)


ROWS = """rows AS (
  SELECT l_orderkey AS case_id, l_linenumber::BIGINT AS row_id, o_custkey AS lineage, c_mktsegment AS family, o_custkey % 6 AS fold,
         l_quantity AS y, l_tax AS n, l_discount AS b, l_returnflag AS flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
cases AS (SELECT fold, family, lineage, case_id, avg(y) AS y, avg(n) AS n, avg(b) AS b, count(*) AS k FROM rows GROUP BY ALL),
lins AS (SELECT fold, family, lineage, avg(y) AS y, avg(n) AS n, avg(b) AS b FROM cases GROUP BY ALL),
fams AS (SELECT fold, family, avg(y) AS y, avg(n) AS n, avg(b) AS b FROM lins GROUP BY ALL),
folds AS (SELECT fold, avg(y) AS y, avg(n) AS n, avg(b) AS b FROM fams GROUP BY ALL),
cells AS (SELECT fold, family, avg(y) AS y, avg(n) AS n, avg(b) AS b, count(*) AS cases FROM cases GROUP BY ALL)"""


def points(spark: SparkSession, d: str, dims: int = 64) -> DataFrame:
    """Embeddings as rows of cases of two and lineages of ten; the fold follows from the lineage."""
    lineage = F.floor(F.col("vec_id") / 10)
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.floor(F.col("vec_id") / 2).alias("case_id"), lineage.alias("lineage"), (F.col("label") % 4).cast("long").alias("family"), (lineage % 6).alias("fold"), (lineage % 3).alias("seed"),
        F.transform(F.slice("embedding", 1, dims), lambda v: v.cast("double")).alias("x"), F.col("label").cast("double").alias("y"),
    )


def points_sql(dims: int = 64, name: str = "pts") -> str:
    return f"""{name} AS (
  SELECT vec_id AS row_id, vec_id // 2 AS case_id, vec_id // 10 AS lineage, (label % 4)::BIGINT AS family, (vec_id // 10) % 6 AS fold, (vec_id // 10) % 3 AS seed,
         embedding[1:{dims}]::DOUBLE[] AS x, label::DOUBLE AS y FROM embeddings)"""


def _keyed(p: DataFrame) -> DataFrame:
    # Neighbours come from other folds, and so from other lineages.
    return p.select("row_id", "case_id", F.col("fold").alias("lineage"), "seed", "x")


def neighbours(p: DataFrame, k: int = K) -> DataFrame:
    both = _keyed(p)
    return legal_neighbours(both, both, k)


def randoms(p: DataFrame, k: int = K, extension: int = 0) -> DataFrame:
    return matched_random(_keyed(p), _keyed(p), k, DOMAIN, extension)


_LEGAL = "q.case_id <> t.case_id AND q.fold <> t.fold AND (q.seed = 0 OR q.seed <> t.seed)"


def knn_sql(k: int = K, source: str = "pts", name: str = "knn") -> str:
    return f"""{name} AS (
  SELECT q.row_id AS query, row_number() OVER (PARTITION BY q.row_id ORDER BY list_distance(q.x, t.x), t.case_id, t.row_id) AS rank,
         t.row_id AS neighbour, list_distance(q.x, t.x) AS distance
  FROM {source} q JOIN {source} t ON {_LEGAL} QUALIFY rank <= {k})"""


def _random_part(name: str, k: int, source: str, domain: str, but: str = "") -> str:
    at = f"(('0x' || substr(sha256(concat_ws('|', '{domain}', row_id::VARCHAR, i::VARCHAR)), 1, 12))::BIGINT % (SELECT count(*) FROM {source}))"
    return f"""{name}_at AS MATERIALIZED (SELECT *, {at} AS number FROM {source} CROSS JOIN range(512) a(i)),
{name}_of AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS number FROM {source}),
{name} AS (
  SELECT query, row_number() OVER (PARTITION BY query ORDER BY i) AS rank, comparator FROM (
    SELECT q.row_id AS query, t.row_id AS comparator, min(q.i) AS i FROM {name}_at q JOIN {name}_of t USING (number) WHERE {_LEGAL} GROUP BY ALL) c {but} QUALIFY rank <= {k})"""


def random_sql(k: int = K, source: str = "pts", name: str = "rnd") -> str:
    """Enough candidates for the test tables: the first k that are legal and different."""
    return _random_part(name, k, source, DOMAIN)


def extended_sql(k: int = K, more: int = 10, source: str = "pts", name: str = "rnd") -> str:
    but = f"WHERE NOT EXISTS (SELECT 1 FROM {name}_first f WHERE f.query = c.query AND f.comparator = c.comparator)"
    return f"{_random_part(name + '_first', k, source, DOMAIN)}, {_random_part(name + '_more', more, source, DOMAIN + '-extension', but)}, {name} AS (SELECT * FROM {name}_first UNION ALL SELECT query, rank + {k}, comparator FROM {name}_more)"


def edge_targets(p: DataFrame, k: int = K, drawn: DataFrame | None = None) -> DataFrame:
    """(query, fold, family, lineage, case_id, n, b): mean squared target difference to neighbours and to random rows, drawn here or before."""
    y = p.select(F.col("row_id").alias("other"), F.col("y").alias("oy"))
    base = p.select(F.col("row_id").alias("query"), "fold", "family", "lineage", "case_id", "y")

    def mean(edges: DataFrame, other: str, out: str) -> DataFrame:
        # Written edges are several times the size of their file, which Spark takes for theirs; they are not to be broadcast.
        e = edges.withColumnRenamed(other, "other").hint("merge").join(y, "other").join(base.select("query", "y"), "query")
        return e.groupBy("query").agg(F.avg((F.col("oy") - F.col("y")) * (F.col("oy") - F.col("y"))).alias(out))

    return base.join(mean(neighbours(p, k), "neighbour", "n"), "query").join(mean(randoms(p, k) if drawn is None else drawn, "comparator", "b"), "query").drop("y")


def edge_sql(k: int = K, source: str = "pts", name: str = "edge", suffix: str = "") -> str:
    return f"""{knn_sql(k, source, "knn" + suffix)}, {random_sql(k, source, "rnd" + suffix)},
{name} AS (
  SELECT query, p.fold, p.family, p.lineage, p.case_id, n, b FROM {source} p
  JOIN (SELECT query, avg((t.y - q.y) ** 2) AS n FROM knn{suffix} JOIN {source} t ON t.row_id = neighbour JOIN {source} q ON q.row_id = query GROUP BY query) ON query = p.row_id
  JOIN (SELECT query AS rq, avg((t.y - q.y) ** 2) AS b FROM rnd{suffix} JOIN {source} t ON t.row_id = comparator JOIN {source} q ON q.row_id = query GROUP BY query) ON rq = p.row_id)"""


def w_sql(source: str, name: str, values: str = "n, b") -> str:
    """Balanced means of ``values`` over case, lineage, family and fold."""
    v = [x.strip() for x in values.split(",")]
    mean = ", ".join(f"avg({x}) AS {x}" for x in v)
    out = f"(SELECT fold, family, lineage, case_id, {mean} FROM {source} GROUP BY ALL)"
    for keys in ("fold, family, lineage,", "fold, family,", "fold,", ""):
        out = f"(SELECT {keys} {mean} FROM {out} {'GROUP BY ALL' if keys else ''})"
    return f"{name} AS (SELECT * FROM {out})"
