"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, mixing, token output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontam, langid, mixing, ngramjoin, tokens
from foliant.llm.common import cut, table, work_dir
from foliant.llm.queries import END_ID, tokenizer_path

#: A document stays if it has a language and the prediction is at least this sure of it.
LEAST_SCORE = 0.5
#: Tasks that a group of near duplicates is dealt to.
SHARES = 16


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text, without a letter or without a sure language go."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs, model, out=("__lang", "__score"))
    return found.where((F.col("__lang") != langid.UNDETERMINED) & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def _key() -> Column:
    """A row's key: a hash of its id, or that it has none, and its text. Only rows repeated with the same id and text share it."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 5-word n-grams at a similarity of 0.8 join, one row stays: the one with the smallest id.

    Rows without an id come last and take part as others do; of rows repeated with the same id and text one stays, the
    smallest by its other columns. Documents without a word link with nothing and stay.
    """
    keyed = docs.withColumn("__k", _key())
    found = ngramjoin.components(keyed, n=5, threshold=(4, 5), id_col="__k").where("n_shingles > 0")
    found = found.groupBy(F.col("doc_id").alias("__k")).agg(F.first("component_id").alias("c"), F.count("*").alias("copies"))
    named = cut(found.join(keyed.select("__k", "doc_id").distinct(), "__k"))
    keep = named.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__k"))["__k"].alias("keep"), F.count("*").alias("n")).where("n > 1")
    # a group's rows are dealt to SHARES tasks, each of which gets the row that stays
    keep = keep.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).select("c", "share", "keep")
    dealt = named.withColumn("share", F.pmod(F.xxhash64("__k", F.lit("share")), F.lit(SHARES)).cast("int"))
    lost = dealt.join(keep, ["c", "share"]).where("__k <> keep").select("__k")
    repeated = named.where("copies > 1").select("__k").join(lost, "__k", "left_anti")
    gone = cut(lost.withColumn("lost", F.lit(True)).unionByName(repeated.withColumn("lost", F.lit(False))))
    one = keyed.join(gone.where("not lost"), "__k", "left_semi").groupBy("__k").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return keyed.join(gone, "__k", "left_anti").select(*docs.columns).unionByName(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, whether or not they have an id."""
    keyed = docs.withColumn("__k", _key())
    found = decontam.contamination(keyed, table(spark, sf_dir, "benchmark"), id_col="__k")
    bad = found.where("contaminated").select(F.col("doc_id").alias("__k")).distinct()
    return keyed.join(bad, "__k", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs, mixing.mix_sources(docs))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Record files of the mix and their records, read back."""
    path, files = tokens.write_records(docs, tokenizer_path(), work_dir(spark, "corpus"), END_ID)
    return tokens.read_records(spark, path, files)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mix),
    ("token output", token_output),
]

#: Language scores and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = work_dir(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
