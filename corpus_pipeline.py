"""The corpus pipeline: quality rules, toxicity, near-duplicates, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of ``documents``.
Each stage's scratch tables are dropped when the next stage begins, by when its output has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlight.llm import decontamination, near_copies, packing, quality_rules, toxicity
from quadlight.llm.common import id_remainder, release, remove, scratch_path, staged, under_old_names, under_own_names
from quadlight.llm.queries import vocabulary

OWNER, STAGE_TABLES = "pipeline", "pipeline-stages"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality rules keep. Null and empty texts fail the rules; repeated rows are judged alike; extra
    columns of any name are kept; an empty table gives an empty one."""
    release(spark, OWNER)
    return quality_rules.keep_good(docs, owner=OWNER)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that score below 0.3. Null and empty texts score as texts of no words; rows of a null id are judged but not
    learnt from; repeated rows are judged alike; extra columns of any name are kept; an empty table gives an empty one."""
    release(spark, OWNER)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit_sample(docs.select("doc_id", "text"), labels, id_remainder(F.col("doc_id"), 4) != 2)
    inner, names = under_own_names(docs)
    own = {c: k for k, c in names.items()}
    scored = toxicity.score(inner, model, own["doc_id"], own["text"], keep=[k for k in names if k != own["doc_id"]])
    return under_old_names(scored.where(F.col("score") < 0.3), names)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, the first by doc_id, then by place; null ids come last. Null, empty and wordless texts
    are one group; repeated rows are copies; extra columns of any name are kept; an empty table gives an empty one.

    Rows are numbered and written with their numbers first: doc_id need not be distinct, and a number made anew could
    differ if executors come or go."""
    release(spark, OWNER)
    inner, names = under_own_names(docs)
    own = {c: k for k, c in names.items()}
    key, doc_id, text = "_number", own["doc_id"], own["text"]
    rows = staged(inner.withColumn(key, F.monotonically_increasing_id()), "numbered", OWNER)
    found = near_copies.near_copy_components(rows.select(key, text), key, text, shingle=5, least=0.8, owner=OWNER)
    ids = rows.select(key, doc_id).join(found, key)
    first = ids.groupBy("component_id").agg(F.min_by(key, F.struct(F.col(doc_id).isNull(), doc_id, key)).alias(key))
    return under_old_names(rows.join(first, key, "left_semi"), names)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without a passage of the benchmark. Null, empty and wordless texts hold none; repeated rows are judged
    alike; extra columns of any name are kept; an empty table gives an empty one."""
    release(spark, OWNER)
    inner, names = under_own_names(docs)
    own = {c: k for k, c in names.items()}
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontamination.decontaminate(inner, benchmark, own["doc_id"], own["text"], keep=[k for k in names if k != own["doc_id"]], owner=OWNER)
    return under_old_names(found.where(~F.col("contaminated")), names)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document. Null and empty texts are one piece, the end id; repeated rows and null ids
    are packed one by one; extra columns are ignored; an empty table gives an empty result."""
    release(spark, OWNER)
    digest = lambda ids: {"ids_crc32": F.crc32(ids)}
    return packing.pack(docs.select("doc_id", "text"), vocabulary(), capacity=2048, end_id=0, carry=digest, owner=OWNER)


STAGES = [
    ("quality rules", good_quality),
    ("toxicity", not_toxic),
    ("simhash near-dedup", no_near_duplicates),
    ("benchmark decontamination", no_leaks),
    ("best-fit packing", packed),
]
#: SQL cannot express the trained stages; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. A stage's input is dropped when the next stage has been written; the tables of the
    last stage, which its lazy result still reads, when the pipeline runs again."""
    release(spark, STAGE_TABLES)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}", STAGE_TABLES)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
