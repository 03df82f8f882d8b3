"""The registered ``opN_<name>`` queries: each applies its operator to its whole table.

Tokenizer files are found by ``TOKENIZERS``, a folder; they are never copied.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiopanel.llm import ann, bpe, chat, counts, jaccard, lines, mixing, phrases, piecebpe, quality, search, tokenfile, toxicity
from regiopanel.llm.ship import ship


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    folder = os.environ.get("TOKENIZERS", "")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; SHA-256 of the ids and of the decoded text."""
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without recurring lines."""
    return lines.line_dedup(_table(spark, sf_dir, "documents"), counts=True)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat.chat(_table(spark, sf_dir, "conversations"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt outside the held-out fold."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word-piece tokens of every document."""
    return counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written in blocks and read back."""
    return tokenfile.token_file(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and repetition verdict of every document."""
    got = quality.quality(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "n_covered", "longest_repeat")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of each vector whose id is divisible by 20."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a mixture of as many tokens as there are, half way to equal weights, with epoch and position."""
    got = mixing.mix(_table(spark, sf_dir, "documents")).drop("mark")
    return got.withColumn("weight", F.round(F.col("weight") * 1000000) / 1000000)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and near-copy component of every document."""
    return jaccard.jaccard_join(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 collocations of each language with the highest scores."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 documents that match each benchmark item best."""
    return search.ranked_search(_table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the SentencePiece model; SHA-256 of the ids and of the decoded text."""
    return piecebpe.digests(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_line_dedup, op3_chat, op4_toxicity, op5_token_counts, op6_token_file, op7_quality,
                                      op8_nearest, op9_mixing, op10_jaccard, op11_collocations, op12_search, op13_sentencepiece)}
ORACLE = {"op2_line_dedup": lines.ORACLE, "op3_chat": chat.ORACLE, "op9_mixing": mixing.ORACLE, "op10_jaccard": jaccard.ORACLE,
          "op11_collocations": phrases.ORACLE, "op12_search": search.ORACLE}
