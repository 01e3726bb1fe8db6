"""A training corpus from the documents: toxicity, near copies, contamination, secrets, mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.llm import alike, contamination, mixing, queries, secrets, toxicity
from facetlake.session import materialize, scratch, tune

#: What the stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents from this score on are rejected.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxic score; the model learns from the labelled documents given."""
    marks = queries.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("session_id"), "toxic")
    scored = toxicity.session_toxicity(docs.select(*COLUMNS).withColumnsRenamed({"doc_id": "session_id", "text": "name"}), marks)
    return scored.filter(F.col("toxic_score") < TOXIC).withColumnsRenamed({"session_id": "doc_id", "name": "text"}).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return alike.distinct_logs(docs.select(*COLUMNS).withColumnsRenamed({"doc_id": "job_id", "text": "log"})).withColumnsRenamed({"job_id": "doc_id", "log": "text"}).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of any benchmark item to count."""
    items = queries.table(spark, sf_dir, "benchmark")
    return contamination.clean_logs(docs.select(*COLUMNS).withColumnsRenamed({"doc_id": "job_id", "text": "log"}), items).withColumnsRenamed({"job_id": "doc_id", "log": "text"}).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark."""
    clean = secrets.mask_files(docs.select(*COLUMNS).withColumnsRenamed({"doc_id": "job_id", "text": "content", "source": "path"}))
    named = clean.withColumnsRenamed({"job_id": "doc_id", "content": "text", "path": "source"})
    return named.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: the documents taken, ``size``, ``target`` of the source and ``taken`` words."""
    photos = docs.select(F.col("doc_id").alias("photo_id"), F.col("source").alias("shoot_id"), queries.words_of("text").alias("size"))
    mixed = mixing.mix_photos(photos).filter("taken > 0")
    taken = mixed.groupBy(F.col("photo_id").alias("_id"), F.col("shoot_id").alias("_source"), "size", "target").agg(F.max("taken").alias("taken"))
    sized = docs.select(*COLUMNS, queries.words_of("text").alias("_size"))
    same = sized["doc_id"].eqNullSafe(taken["_id"]) & sized["source"].eqNullSafe(taken["_source"]) & (sized["_size"] == taken["size"])
    return sized.join(taken, same).select(*COLUMNS, "size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
]

#: The learnt model and the content ledger have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next reads it."""
    docs = queries.table(tune(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        # What a stage stores on its way goes once its result is written.
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
