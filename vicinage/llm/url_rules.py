"""URL filters: a fixed rule list first, then association rules over URL tokens.

Spark's FP-growth mines token combinations of labelled URLs together with their
label.  Poor pages are few, so a rule "tokens => label" is judged by its balanced
confidence: its share of a label among pages with the tokens if both labels were
equally frequent.  Rules are pruned by a count of pages, by balanced confidence,
by how far they stand from the label's base rate (standard errors), and where
some of their tokens alone are as confident.  Those that remain are put in an
inverted index under the rarest of their tokens; a page is looked up by its own
tokens, and a rule holds if the page has all of the rule's tokens.  The most
confident rule that holds decides (then the better supported, then the one with
more tokens); without one, the more frequent label does.

Only DataFrame functions and Spark ML run here.  Nulls: a null url has no tokens,
host and path are empty.  Repeated rows are judged alike.  Empty tables give
empty results; without labels every page is allowed.  Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: Pages of one label that a rule rests on at least, whatever the size of the input; its balanced confidence; its distance
#: from the base rate in standard errors.
MIN_COUNT = 10
MIN_CONFIDENCE = 0.6
MIN_ERRORS = 2.0
ALLOW, BLOCK = "allow", "block"
#: (rule, verdict): host, then path.
RULES = (("org/", ALLOW), ("example.org/es/", BLOCK), ("example.org/en/1", BLOCK), ("com/fr/", ALLOW), ("com/de/", BLOCK))
_LABEL = "label="


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return _lower(F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule of a list that fits host and path, and its verdict; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{tail}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _joined(words: Column, most: int) -> Column:
    """The first ``most`` elements, and all others as one."""
    rest = F.array_join(F.slice(words, most + 1, F.greatest(F.size(words), F.lit(1))), "/")
    return F.when(F.size(words) > most, F.concat(F.slice(words, 1, most), F.array(F.concat(F.lit("+"), rest)))).otherwise(words)


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels by place from the end, path words, numbers as such, query keys, fragment.

    A URL of any length has a dozen tokens at most: host labels and path words
    from the fourth on are one token together, and so are the query's keys.
    """
    host, path = host_path(url)
    labels = _joined(F.reverse(F.split(host, r"\.")), 3)
    named = F.transform(labels, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit("="), x))
    words = F.filter(F.split(path, "/"), lambda x: x != "")
    paths = F.transform(_joined(F.transform(words, lambda x: F.regexp_replace(F.lower(x), r"\d+", "#")), 3), lambda x: F.concat(F.lit("path="), x))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.substring_index(x, "=", 1))))
    keys = F.when(F.size(keys) > 0, F.array(F.concat(F.lit("keys="), F.array_join(keys, "&")))).otherwise(F.array().cast("array<string>"))
    scheme = F.array(F.concat(F.lit("scheme="), F.lower(F.substring_index(url, "://", 1))))
    mark = F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.when(url.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(scheme, named, paths, keys, mark)))


def mine(labelled: DataFrame, url_col: str, bad: Column, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, min_errors: float = MIN_ERRORS) -> tuple[DataFrame, str]:
    """(rules, fallback): antecedent, verdict, balanced confidence, support, size and key token; and the verdict of pages that none fits.

    A null label is no label.  Where one label is missing there are no rules.
    """
    rows = labelled.filter(bad.isNotNull()).select(tokens(F.col(url_col)).alias("t"), F.when(bad, BLOCK).otherwise(ALLOW).alias("v"))
    rows = materialize(rows.select(F.concat("t", F.array(F.concat(F.lit(_LABEL), "v"))).alias("items"), "v"), "transactions")
    found = {r["v"]: r["n"] for r in rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()}
    fallback = BLOCK if found.get(BLOCK, 0) > found.get(ALLOW, 0) else ALLOW
    schema = "antecedent array<string>, verdict string, confidence double, support double, size int, key string"
    if len(found) < 2:
        return rows.sparkSession.createDataFrame([], schema), fallback
    total = sum(found.values())
    # The threshold is a count, so rare hosts get rules however large the input is.
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, min_count / total), minConfidence=0.0).fit(rows.select("items"))
    sets = materialize(model.freqItemsets.select(F.sort_array(F.filter("items", lambda x: ~x.startswith(_LABEL))).alias("antecedent"), F.filter("items", lambda x: x.startswith(_LABEL)).alias("label"), "freq"), "itemsets")
    held = sets.filter((F.size("label") == 0) & (F.size("antecedent") > 0)).select("antecedent", F.col("freq").alias("pages"))
    with_label = sets.filter((F.size("label") == 1) & (F.size("antecedent") > 0)).select("antecedent", F.substring(F.col("label")[0], len(_LABEL) + 1, 100).alias("v"), "freq")
    # Sets that are rare with one label are not counted with it: what the other label lacks is theirs.
    seen = held.join(with_label.groupBy("antecedent").agg(*[F.max(F.when(F.col("v") == v, F.col("freq"))).alias(v) for v in (ALLOW, BLOCK)]), "antecedent")
    known = seen.select("antecedent", "pages", F.coalesce(F.col(BLOCK), F.when(F.col(ALLOW).isNotNull(), F.col("pages") - F.col(ALLOW))).alias("bad"))
    base = found[BLOCK] / total
    rate = F.col("bad") / F.col("pages")
    odds = (rate / base) / (rate / base + (1 - rate) / (1 - base))
    off = (rate - base) / F.sqrt(F.lit(base * (1 - base)) / F.col("pages"))
    rules = known.select("antecedent", F.when(rate > base, BLOCK).otherwise(ALLOW).alias("verdict"), F.greatest(odds, 1 - odds).alias("confidence"), (F.col("pages") / total).alias("support"), F.abs(off).alias("errors"))
    rules = rules.filter((F.col("confidence") >= min_confidence) & (F.col("errors") >= min_errors)).drop("errors").withColumn("size", F.size("antecedent"))
    singles = materialize(held.filter(F.size("antecedent") == 1).select(F.col("antecedent")[0].alias("token"), "pages"), "token_counts")
    each = rules.select("*", F.explode("antecedent").alias("token")).join(singles, "token")
    keyed = materialize(each.groupBy("antecedent", "verdict", "confidence", "support", "size").agg(F.min_by("token", F.struct("pages", "token")).alias("key")), "rules")
    less = keyed.select(F.col("antecedent").alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("c"), F.col("size").alias("n"), "key")
    no_better = keyed.drop("key").select("*", F.explode("antecedent").alias("key")).join(less, "key").filter((F.col("v") == F.col("verdict")) & (F.col("n") < F.col("size")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("part", "antecedent")) == 0))
    rules = keyed.join(no_better.select("antecedent", "verdict").distinct(), ["antecedent", "verdict"], "left_anti")
    return materialize(rules.select("antecedent", "verdict", "confidence", "support", "size", "key"), "rule_index"), fallback


def judge(pages: DataFrame, rules: DataFrame, fallback: str, id_col: str = "page_id", url_col: str = "url", fixed: tuple = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, mined) per row; ``mined`` is the antecedent of the rule that decided, else null."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url")).withColumn("t", F.sort_array(tokens(F.col("url"))))
    # Numbers are one token, so many URLs share their tokens: each set of tokens is looked up once.
    held = rows.select("t").distinct()
    near = held.select("t", F.explode("t").alias("key")).join(rules, "key").filter(F.size(F.array_except("antecedent", "t")) == 0)
    best = near.groupBy("t").agg(F.max_by(F.struct("verdict", "antecedent"), F.struct("confidence", "support", "size", "antecedent", "verdict")).alias("best"))
    best = materialize(best.select("t", F.col("best.verdict").alias("by_method"), F.col("best.antecedent").alias("mined")), "mined_verdicts")
    host, path = host_path(F.col("url"))
    rule, verdict = listed(F.col("host"), F.col("path"), fixed)
    out = rows.join(best, "t", "left").withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("listed", verdict)
    return out.select("id", "host", "path", "rule", F.coalesce("listed", "by_method", F.lit(fallback)).alias("verdict"), F.when(F.col("rule").isNull(), F.col("mined")).alias("mined"))
