"""A corpus pipeline of five stages: toxicity, n-gram Jaccard join, benchmark decontamination, secret scans, best-fit packing.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame that is written and
reread as the next one's docs; all but the last return the columns of documents. SQL can
express neither the classifier nor the tokenizer, so ORACLE_SQL is None, and the stages
are tested against brute force on small tables (tests/llm/test_pipeline.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm import secret_scan
from tremorlake.llm.decontamination import leaks
from tremorlake.llm.exchange import Scratch
from tremorlake.llm.jaccard_join import jaccard_components
from tremorlake.llm.packing import pack
from tremorlake.llm.queries import table, vocabulary
from tremorlake.llm.toxicity import fit, score

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject."""
    model = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score(docs, model).where("not toxic").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similarity 0.75 join, the row with the smallest doc_id; one of rows given twice."""
    near = jaccard_components(docs.where("doc_id is not null")).where("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(near, "doc_id", "left_anti").select(*docs.columns)
    once = kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return once.unionByName(kept.where("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as it is or with other names, numbers or units."""
    held = leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(held, "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked; n_chars follows the text."""
    clean = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 1024 tokens."""
    return pack(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        after = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
