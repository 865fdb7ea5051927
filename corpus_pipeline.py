"""The corpus pipeline: documents through five operators, each stage written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents. Rows without an id, or with an id that other rows have too, are judged by their own text; only rows
equal in id and text count as one. A stage keeps an empty table empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwise.llm import decontam, minhash, packing, suffixes, toxicity
from bandwise.llm.common import written


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with `_key`, which only rows with equal id and text share: the id, or, for rows whose id is null or stands in
    several rows, a hash of id and text from 2 ** 62 on. Stages decide by it, so no row falls for another one's text."""
    ids = written(docs.groupBy("doc_id").agg(F.count("*").alias("_rows")).where("_rows > 1 and doc_id is not null").select("doc_id"))
    own = F.xxhash64(F.lit(7), "doc_id", F.coalesce("text", F.lit("\0"))).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    if ids.isEmpty():
        return docs.withColumn("_key", F.coalesce("doc_id", own))
    clash = docs.join(ids, "doc_id", "left_semi").select(*docs.columns, own.alias("_key"))
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns, F.coalesce("doc_id", own).alias("_key")).union(clash)


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    return keyed.join(gone.distinct(), "_key", "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It learns from the labelled documents of the stage's input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keyed = _keyed(docs)
    scores = toxicity.scored(keyed, toxicity.train(docs, labels), id_col="_key")
    return _without(keyed, scores.where("predicted = 1").select("_key")).drop("_key")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest key, and once if its row repeats. Near
    copies share 0.8 or more of their 5-word shingles: op2's SimHash links propose them, and MinHash keys those that 2 of 64
    bits do not reach. Rows without an id are nobody's copy and stay."""
    keyed = _keyed(docs).withColumn("_key", F.when(F.col("doc_id").isNotNull(), F.col("_key")))
    groups = written(minhash.near_copies(keyed, id_col="_key"))
    left = _without(keyed, groups.where("_key <> component_id").select("_key"))
    repeated = groups.where("_key is not null").groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select("_key")
    if not repeated.isEmpty():
        once = left.join(repeated, "_key", "left_semi").dropDuplicates(["_key"]).select(left.columns)
        left = left.join(repeated, "_key", "left_anti").select(left.columns).union(once)
    return left.select(docs.columns)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that already stand earlier go; broken characters at a cut go with them. No row is dropped;
    a null text becomes empty."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    counted = "n_chars" in docs.columns
    # as text at once: a second Python step behind it would hold a second worker for every task, and workers stay
    kept = suffixes.deduplicated(docs, carry=[*others, "n_chars"] if counted else others, as_text=True)
    length = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars") if counted else F.lit(None)).alias("n_chars")
    return kept.select(*[f"row.{c}" for c in others], F.col("kept").alias("text"), length).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = _keyed(docs)
    return _without(keyed, decontam.contaminated(keyed, benchmark, id_col="_key").select("_key")).drop("_key")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.best_fit(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("passages", cut_passages),
          ("decontamination", drop_contaminated), ("packing", pack)]
#: Hashes, a trained model and a tokenizer are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents; each reads what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
