"""The corpus pipeline: quality classifier, quality rules, near duplicates, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A
row without a doc_id is a document of its own; a doc_id names one text. A stage's result is written as Parquet in the shared folder of spark.checkpoint.dir and read again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relscope.checkpoint import cut, shared_folder
from relscope.llm import quality_classifier
from relscope.llm.ngram_join import near_duplicates
from relscope.llm.packing import pack
from relscope.llm.quality_rules import judge
from relscope.llm.queries import table, tokenizer
from relscope.llm.substring_dedup import dedup_substrings
from relscope.ship import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a column key: doc_id, and for each row without one a number of its own, that is no row's
    doc_id and above all of them (below, if there is no room above)."""
    docs = docs.select(*COLUMNS)
    n, low, high = docs.agg(F.count_if(F.col("doc_id").isNull()), F.min("doc_id"), F.max("doc_id")).first()
    named = docs.where("doc_id IS NOT NULL").withColumn("key", F.col("doc_id").cast("long"))
    if not n:
        return named
    first = 0 if high is None else high + 1 if high + n < 1 << 63 else low - n
    # written down, so that the numbers are the same each time they are read; then made contiguous
    rows = cut(docs.where("doc_id IS NULL").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    starts = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("start"))
    key = F.lit(first) + F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return named.unionByName(rows.join(F.broadcast(starts), part == F.col("part")).select(*COLUMNS, key.alias("key")))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the table labels, predicts to be good, judged row by row: rows
    may repeat or have no id; a null text counts as empty. An empty table gives an empty one."""
    ship(spark)
    scored = quality_classifier.score(docs, table(spark, sf_dir, "labels"), also=COLUMNS[1:])
    return scored.where("predicted = 1").select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their compression bands, judged row by row: rows may repeat or have no
    id. A null, empty or short text fails the base rules. An empty table gives an empty one."""
    ship(spark)
    return judge(docs, also=COLUMNS[1:]).where("kept").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest key, see _keyed) of each group of near duplicates: five words, Jaccard 0.8. Of rows
    that repeat a doc_id and a text, one stays."""
    ship(spark)
    docs = _keyed(docs)
    kept = near_duplicates(docs, doc_id="key", shingle=5, percent=80).where("doc_id = component_id")
    left = docs.join(kept.select(F.col("doc_id").alias("key")), "key", "left_semi")
    copies = Window.partitionBy("key", "text").orderBy("key")
    return left.withColumn("copy", F.row_number().over(copies)).where("copy = 1").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages of 50 or more that a document with a smaller key
    (see _keyed) holds; a text without such stays as it is, also a null or wordless one; one that loses
    all its words goes."""
    ship(spark)
    docs = _keyed(docs)
    found = dedup_substrings(docs, doc_id="key", window=50).where("n_removed > 0").select(F.col("doc_id").alias("key"), F.col("kept").alias("left"))
    found = found.groupBy("key").agg(F.first("left").alias("left"))  # repeated rows have the same words left
    rest = docs.join(found, "key", "left").where("left IS NULL OR left != ''")
    text = F.coalesce("left", "text")
    return rest.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("left").isNull(), F.col("n_chars")).otherwise(F.length(text)).cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences of all documents, with their ids. Each row is packed by itself, also a repeated one or one
    without an id; a null or empty text is one piece of the end token. An empty table gives no sequences."""
    ship(spark)
    return pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("near_duplicates", near), ("substring_dedup", substrings), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{root}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The classifier, the compression bands and the tokenizer are not expressible in SQL; tests use brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
