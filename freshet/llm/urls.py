"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.split("/", 1)[1]


# The rules of the query's contract.
RULES = (UrlRule("allow", "org/"), UrlRule("block", "example.org/es/"), UrlRule("block", "example.org/en/1"), UrlRule("allow", "com/fr/"), UrlRule("block", "com/de/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["length", "depth", "digit_ratio", "entropy", "n_params", "n_labels", "n_hyphens", "path_length", "suffix_rate", "suffix_docs"]


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path; a null url or one without :// has both empty."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.select("page_id", "url", F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER).alias("host"), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1).alias("path"))


def rule_of(rules: tuple[UrlRule, ...]) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits; null where none does. Rules are a bounded list of the caller's."""
    fits = [
        F.when(((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path)), F.struct(F.lit(len(r.rule)).alias("size"), F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def with_features(parts: DataFrame) -> DataFrame:
    """Lexical features of the url; suffix is the host's last two labels."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    chars = F.split(url, "")
    share = F.transform(F.array_distinct(chars), lambda c: F.when(c == "", 0.0).otherwise(F.size(F.filter(chars, lambda d: d == c)) / n))
    return parts.select(
        "*",
        F.length(url).cast("double").alias("length"),
        F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double").alias("depth"),
        (F.length(F.regexp_replace(url, "[^0-9]", "")) / n).alias("digit_ratio"),
        F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0)).alias("entropy"),
        F.size(F.regexp_extract_all(url, F.lit("[?&][^=&#]+="), 0)).cast("double").alias("n_params"),
        F.size(F.split("host", r"\.")).cast("double").alias("n_labels"),
        (F.length(url) - F.length(F.replace(url, F.lit("-"), F.lit("")))).cast("double").alias("n_hyphens"),
        F.length("path").cast("double").alias("path_length"),
        F.substring_index("host", ".", -2).alias("suffix"),
    )


def _with_suffixes(rows: DataFrame, stats: DataFrame, prior: float, own: Column | None = None) -> DataFrame:
    """Rows with suffix_rate and suffix_docs from stats(suffix, n, s). A labelled row leaves out its ``own`` label, or the
    trees would learn to read it there and find nothing in new suffixes."""
    less = F.lit(0.0) if own is None else F.lit(1.0)
    n, s = F.coalesce("n", F.lit(0.0)) - less, F.coalesce("s", F.lit(0.0)) - (F.lit(0.0) if own is None else own)
    return rows.join(stats, "suffix", "left").withColumn("suffix_rate", (s + 5 * prior) / (n + 5)).withColumn("suffix_docs", F.log1p(n)).drop("n", "s")


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, labelled: DataFrame | None = None, sample: int = 20_000, trees: int = 10, depth: int = 4, seed: int = 7) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score for every row of ``pages(page_id, url)``.

    The trees are trained on ``labelled(url, label)`` (1: block; a url labelled both ways has the label of
    most of its rows, block at a tie), or without it
    on the urls that the rules decide. Suffix statistics are counted over all of those urls; the trees see the ``sample``
    distinct urls of smallest hash. With one class only (or none) the method allows all. Null and repeated urls and null
    ids are judged row by row; an empty table gives no rows.
    """
    rows = with_features(with_parts(pages)).withColumn("fit", rule_of(rules))
    if labelled is None:
        told = rows.where("fit is not null").select("url", (F.col("fit.verdict") == "block").cast("double").alias("label"))
    else:
        told = labelled.select("url", F.col("label").cast("double").alias("label")).where("label is not null")
    told = common.checkpoint(told.groupBy("url").agg((F.avg("label") >= 0.5).cast("double").alias("label")))
    known = with_features(with_parts(told.withColumn("page_id", F.lit(0)))).join(told.withColumnRenamed("url", "_url"), F.col("url").eqNullSafe(F.col("_url"))).drop("_url", "page_id")
    count = told.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    columns = ["page_id", "host", "path", F.col("fit.rule").alias("rule")]
    if not 0 < count[1] < count[0]:
        return rows.select(*columns, F.coalesce("fit.verdict", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("block_score"))
    prior = count[1] / count[0]
    stats = common.checkpoint(known.groupBy("suffix").agg(F.count("*").cast("double").alias("n"), F.sum("label").alias("s")))
    known = common.checkpoint(known.orderBy(F.xxhash64("url"), "url").limit(sample))  # the bounded sample for the trees
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed).fit(assembler.transform(_with_suffixes(known, stats, prior, F.col("label"))))
    scored = model.transform(assembler.transform(_with_suffixes(rows, stats, prior)))
    p = vector_to_array("probability")[1]
    return scored.select(*columns, F.coalesce("fit.verdict", F.when(p >= 0.5, "block").otherwise("allow")).alias("verdict"), p.alias("block_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
