"""A training-data pipeline over ``documents``: five stages, each of one operator of ``tellgrid.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; all but the last return the columns of ``documents``, and
any further ones that the table has, whatever their names.

Defined results: null texts, empty ones and others without a letter go in the
first stage; later stages, given such, take them as empty texts; null ids and
null sources are values like others; very long texts are read whole; ties go
to the smaller id; repeated rows are rows of their own until the second stage
keeps one of them; an empty table passes all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellgrid.llm.bpe import load_ranks, round_trip
from tellgrid.llm.common import cut, table, text_or_empty
from tellgrid.llm.exact_dedup import kept_rows
from tellgrid.llm.language_id import UNDETERMINED, annotate, learn
from tellgrid.llm.mixing import mix, words
from tellgrid.llm.near_copies import near_copies

#: Least posterior probability of a document's language.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter, or of no likely language, go.  Rows are judged one by one."""
    told = annotate(docs, learn(docs), names=("__lang", "__score"))
    return told.where((F.col("__lang") != UNDETERMINED) & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the smallest id, null ids last; one of rows that repeat both."""
    return kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard 0.8 or more of five-word shingles).

    It is the one that names the group; of null ids alone, the one of the
    smallest hash.  Rows that repeat its id and text stay with it (the stage
    before leaves none).
    """
    kept = near_copies(docs).where("kept").select(F.xxhash64("doc_id", "node").alias("__unit")).distinct()
    unit = F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty("text")))
    return docs.withColumn("__unit", unit).join(kept, "__unit", "left_semi").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows that repeat id and text are counted one by one."""
    taken = mix(docs).groupBy(F.col("unit").alias("__unit")).agg(F.array_sort(F.collect_list(F.struct("size", "copies"))).alias("__takes"))
    rows = docs.withColumn("__unit", F.xxhash64(F.col("doc_id").cast("long"), text_or_empty("text"))).withColumn("__size", words("text")).join(taken, "__unit")
    nth = F.row_number().over(Window.partitionBy("__unit").orderBy("__size"))  # 1, but for rows that repeat id and text
    rows = rows.withColumn("__copies", F.element_at("__takes", nth)["copies"]).where("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every taken document, with the digests of them and of their decoding; rows are encoded one by one."""
    import public_tokenizers

    done = round_trip(docs, load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mixed), ("BPE", tokens)]

#: SQL cannot express the stages; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
