"""A corpus from raw documents: quality rules, line dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the
last return the columns of documents, whatever further columns there are. Shapes of input with a
defined result, in every stage: an empty table gives an empty table; a row with a null id keeps its
place and text in line, near and substring dedup, and is judged by its text in quality rules; a
null, empty or blank text has no words, so quality rules reject it, and a text that a later stage
empties stays as a document without text; repeated rows, and rows that share an id, stay or go
together in near-dedup; texts of any length are worked on whole.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.scratch import drop, passing, swept, written
from loomspan.llm._rows import nested, opened
from loomspan.llm.line_dedup import drop_templates
from loomspan.llm.minhash_dedup import minhash_dedup
from loomspan.llm.packing import pack_tokens
from loomspan.llm.quality import keep_quality
from loomspan.llm.substring_dedup import drop_repeats


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Texts of 1 to 49 words stay: the rules' ratios say little there, and of the labelled ones 96 % are good."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_short=True)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur in other documents go; every document stays."""
    return _sized(drop_templates(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    gone = minhash_dedup(docs, shingle=5, percent=80).where("not kept").select(F.col("doc_id").alias("id")).distinct()
    return opened(nested(docs, "doc_id", "text").join(gone, "id", "left_anti"), docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that an earlier document has go; every document stays."""
    return _sized(drop_repeats(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' tokens in sequences of 1024."""
    import public_tokenizers

    return pack_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_dedup", near_copies), ("substring_dedup", passages), ("best_fit_packing", packing)]

#: SQL can't express the forest, the components and the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with passing() as keep:
            found = stage(spark, before, sf_dir)
            with swept(spark):
                keep.append(docs := written(found, name))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
