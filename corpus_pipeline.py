"""The corpus pipeline: five stages over `documents`, each on all that the stage before it kept.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from draftmill.functions.shared import cleared, new_path
from draftmill.llm.common import table
from draftmill.llm.exact import drop_exact_copies
from draftmill.llm.mixing import mix_rows, mix_spans
from draftmill.llm.packing import pack
from draftmill.llm.queries import tokenizer_path
from draftmill.llm.near import drop_near_copies
from draftmill.llm.trees import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.3) go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space one stays: the longest, then the one with the smallest doc_id."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the document with the smallest doc_id stays. Covering
    tables over SimHash bits and over least hashes choose the candidates; whole sets judge them."""
    return drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    return mix_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, each with its token ids, sequence and offset. Sequences follow the mix; as files are not read in the order they
    were written in, the spans of the mix are worked out from the rows again."""
    return pack(mix_spans(docs), tokenizer_path("byte_bpe_50k.json"), span="span")


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("mixing", mixed), ("packing", packed)]

#: Classifier, fingerprints and tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stages write for themselves is removed when they end; their results stay until the application ends, as the rows of the last stage are
    read from them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        with cleared(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
