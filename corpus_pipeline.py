"""A training-corpus pipeline over ``documents``: five operators of ``regiopanel.llm``, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared folder and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.

1. toxicity: documents scored 0.5 or more go. The model is learnt from the labels of documents in ``docs``.
2. line dedup: lines of recurring templates go; documents that consisted of such lines only go with them.
3. n-gram Jaccard join: of each component of near copies the smallest ``doc_id`` stays. Rows without an id stay.
4. mixing: the flattest mixture in which every document comes at least once and no source more than 1.5 times.
5. BPE: ids of each document, and digests of the ids and of the text decoded from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiopanel.llm import bpe, jaccard, lines, mixing, toxicity
from regiopanel.llm.queries import tokenizer
from regiopanel.llm.ship import ship
from regiopanel.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "score"
    while name in docs.columns:
        name += "_"
    return toxicity.score(docs, model, name=name).where(F.col(name) < 0.5).drop(name)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return lines.line_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    kept = jaccard.jaccard_join(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = materialize(kept, "kept-documents")
    # An id that has several rows keeps the smallest; the others, nearly all, needn't be grouped.
    several = materialize(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated-documents")
    rest = [c for c in docs.columns if c != "doc_id"]
    twice = docs.join(kept.join(several, "doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("row"))
    twice = twice.select(*["doc_id" if c == "doc_id" else F.col(f"row.`{c}`") for c in docs.columns])
    once = docs.join(kept.join(several, "doc_id", "left_anti"), "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    return once.unionByName(twice).unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs, evenness=None, repeats=mixing.REPEATS, keep_all=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.encode(docs, tokenizer("byte_bpe_50k.json"), decode=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_near_copies),
          ("mixing sources to target weights", mix_sources), ("BPE encoding and decoding", encode)]

#: The first stage is a fitted classifier, which SQL can't express; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
