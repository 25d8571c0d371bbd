"""The corpus pipeline: quality rules, near copies, repeated passages, source mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to the shared folder and
reads again as the next stage's documents.  All but the last keep the columns of documents:

* quality: documents that fail the base rules or diverge from their language go;
* near_copies: of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles the one with the
  smallest id stays (three words and 0.9 are the contract of ``op5_ngram_jaccard`` only);
* repeats: words under passages that start in a document with a smaller id go, a document left empty with them;
* mixture: all documents in the order of the mixture of sources: with the target weights until a source runs out, then
  with those of the sources that are left;
* token_ids: byte-level BPE ids of each text and the bytes they decode to, with the text's ``position`` in the files of the
  stage before, the place in the mixture.

``ORACLE_SQL`` is None: divergence, the schedule and the merges have no SQL form; tests compare the stages
with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.bpe import digests, encode
from tidepanel.llm.mixing import in_file_order, whole_mixture
from tidepanel.llm.ngram_join import Setting, drop_near_copies
from tidepanel.llm.quality import keep
from tidepanel.llm.queries import vocabulary
from tidepanel.llm.substring import strip_repeats
from tidepanel.operators.staging import materialize

#: Near copies: shingles of five words, a similarity of 0.8 or more.
NEAR = Setting(width=5, percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, NEAR)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return strip_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return whole_mixture(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = in_file_order(docs, "position").withColumn("doc_id", F.struct("doc_id", "position"))
    return digests(encode(placed, *vocabulary())).select("doc_id.doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "doc_id.position")


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("mixture", mixture), ("token_ids", token_ids)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
