"""The corpus pipeline: five stages of the llm operators over ``documents``.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept and returns
documents with the same columns; the last returns the mix. ``run`` writes every stage's result to
the shared folder and reads it again, so a lost executor costs at most one stage.

Stages, in order:

1. ``toxicity``: documents whose predicted label is toxic go; learned from the labelled rows;
2. ``minhash_dedup``: of each component of near-duplicates the smallest document stays;
3. ``suffix_dedup``: bytes covered by a 200-byte string that also starts elsewhere are removed;
   ``n_chars`` follows the text; documents that had no such string pass unchanged;
4. ``decontaminate``: documents that hold a benchmark window of ten words go;
5. ``mixing``: documents are taken zero, one or two times to meet the source weights; the result
   holds the documents that the mix takes, with ``copies`` and ``taken``.

Null and empty texts pass stages 1 to 4 and are never taken by the mix; rows that repeat an id are
documents of their own; extra columns go through stages 1 to 4 untouched, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lureline.llm import decontaminate as decontamination
from lureline.llm import minhash_dedup as forest
from lureline.llm import mixing as budget
from lureline.llm import suffix_dedup as suffixes
from lureline.llm import toxicity as lexicon
from lureline.llm.common import table
from lureline.session import ensure_checkpoint_dir


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and the whole row as one struct, which no operator's column can clash with."""
    return docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4; documents predicted toxic go."""
    model = lexicon.fit(docs, table(spark, sf_dir, "labels"))
    return model.score(_packed(docs)).filter("predicted = 0").select("_row.*")


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9; one document of each group stays."""
    return forest.deduplicate(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8; repeated byte strings go from the texts."""
    done = suffixes.remove_repeats(docs, rest=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    new = {"doc_id": F.col("doc_id"), "text": text,
           "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long"))
           .otherwise(F.col("_rest.n_chars")) if "n_chars" in docs.columns else None}
    return done.select(*[(new[c] if c in new else F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3; documents that hold a benchmark window go."""
    found = decontamination.decontaminate(_packed(docs), table(spark, sf_dir, "benchmark"))
    return found.filter("not contaminated").select("_row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5; what the mix takes."""
    mixed = budget.mix(docs, keep=("text", "lang"))
    return mixed.filter("copies > 0").select(
        "doc_id", "text", "lang", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [("toxicity", toxicity), ("minhash_dedup", minhash_dedup), ("suffix_dedup", suffix_dedup),
          ("decontaminate", decontaminate), ("mixing", mixing)]

#: SQL can express neither the learned lexicon nor the forest; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
