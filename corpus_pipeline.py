"""Training-corpus pipeline over ``documents``: each stage is one operator, written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm import chosen_path, decontaminate, language_id, line_spread, packing
from tabularium.llm.queries import table, tokenizer_file
from tabularium.llm.shared import written


def carried(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns beside the whole row as one struct, whose columns meet none that an operator adds."""
    return docs.select(*names, F.struct("*").alias("corpus_row"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language; a text without letters has none and goes.

    Null and empty texts go, long texts are read whole, repeated rows stay or go together; a table without labelled rows
    or without rows gives no rows. All columns stay as they are, whatever their names.
    """
    model = language_id.train(docs, tokenizer_file("piece_bpe_32k.model"))
    return language_id.predict(carried(docs, "text"), model).filter(F.col("lang_pred") != language_id.UNDETERMINED).select("corpus_row.*")


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sources repeat; one that held nothing else goes.

    Null, empty and blank texts have no such lines and stay; repeated rows lose the same lines; an empty table gives no rows.
    text and n_chars change where lines go, all other columns stay as they are, whatever their names.
    """
    freed = line_spread.remove_boilerplate(carried(docs, "doc_id", "text", "source"))
    left = (F.col("n_removed") == 0) | (F.regexp_count("text", F.lit(r"\S")) > 0)
    changed = F.col("n_removed") > 0
    values = {"text": F.when(changed, F.col("text")).otherwise(F.col("corpus_row.text")), "n_chars": F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("corpus_row.n_chars"))}
    return freed.filter(left).select(*[values.get(c, F.col(f"corpus_row.`{c}`")).alias(c) for c in docs.columns])


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id; of repeated rows one stays.

    Null, empty and wordless texts are near nothing and stay. All columns stay as they are, whatever their names.
    """
    return chosen_path.one_of_each(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no twentieth or more is benchmark text.

    Texts without words stay, as do all if there are no items; repeated rows stay or go together. All columns stay as they
    are, whatever their names.
    """
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences.

    A null or empty text is its end id alone; a long one is cut into many pieces; repeated rows are packed each. Only doc_id
    and text are read; an empty table gives no rows.
    """
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("language id", identify_language),
    ("line dedup", remove_lines),
    ("near duplicates", remove_near_duplicates),
    ("benchmark decontamination", remove_contaminated),
    ("packing", pack),
]

#: piece models and tokenisation have no SQL form; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, in order."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
