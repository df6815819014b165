"""A corpus pipeline of five stages over `documents`, each written as Parquet and read again as the next one's input.

1. language_id: documents in no learned language (no letter, or no text) go; where no language can be learned, those without a letter go.
2. line_dedup: lines that three documents or more share stay in one of them.
3. near_dedup: of documents linked by their SimHash fingerprints the one with the smallest identifier stays; of rows that share it, the one with the smallest text.
4. mixing: documents are repeated or left out to meet the sources' target weights; the last one taken of a source is shortened.
5. packing: what is left is packed into token sequences.

run() deletes each stage's folder when the next stage is written; the last one's
holds the result.  Stages 1 to 4 return the columns of their input; n_chars follows the text where
the table has it.  Rows with a null identifier are kept by stage 3, which cannot
name them.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweft.llm import language_id as _lid
from logweft.llm.line_dedup import dedup_lines
from logweft.llm.mixing import mixed_documents
from logweft.llm.packing import pack_documents
from logweft.llm.session import checkpoint_dir
from logweft.llm.simhash_dedup import smallest_rows


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _held(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under names that no operator uses, and the names."""
    names = {c: f"in_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(c).alias(n) for c, n in names.items()]), names


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs in the given columns, n_chars the code points of the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in a learned language.

    Null texts and texts without a letter go; with nothing to learn from, all
    others stay.  Repeated rows and identifiers and null identifiers are rows
    like any other; an empty table stays empty; other columns are kept whatever
    their names.
    """
    model = _lid.train(docs, ~_lid.held_out())
    held, names = _held(docs)
    if model.languages:
        found = _lid.identify(held, model, text_col=names["text"]).where(F.col("lang_pred") != _lid.UNKNOWN)
    else:
        found = _lid.lettered(held, names["text"])
    return found.select(*[F.col(n).alias(c) for c, n in names.items()])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that three identifiers or more share but for the largest of them.

    A null text becomes an empty one; rows with one identifier hold a line
    once; rows with a null identifier keep what they share among themselves;
    n_chars follows the text; an empty table stays empty.
    """
    held, names = _held(docs)
    rest = {c: n for c, n in names.items() if c not in ("doc_id", "text")}
    out = dedup_lines(held, id_col=names["doc_id"], text_col=names["text"], keep=tuple(rest.values()))
    return _with_text(out.select("doc_id", F.decode("kept", "UTF-8").alias("text"), *[F.col(n).alias(c) for c, n in rest.items()]), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest identifier, of several such the one with the smallest text.

    Null, empty and white-space texts are copies of each other; rows that share
    an identifier but lie in several components stay once in each; rows with a
    null identifier stay; an empty table stays empty.
    """
    held, names = _held(docs)
    text = names["text"]
    kept = held.join(smallest_rows(docs), F.col(names["doc_id"]) == F.col("doc_id"))
    kept = kept.withColumn("root", F.col("groups")[F.xxhash64(F.coalesce(F.col(text), F.lit("")))]).where(F.col("root").isNotNull())
    # rows that share an identifier may be in several components
    one = kept.withColumn("place", F.row_number().over(Window.partitionBy(names["doc_id"], "root").orderBy(text))).where("place = 1").select(held.columns)
    return one.union(held.where(F.col(names["doc_id"]).isNull())).select(*[F.col(n).alias(c) for c, n in names.items()])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows once for each copy that the mix takes, the last one of a source shortened.

    Rows without a word are never taken; a null source is a source; repeated
    identifiers are rows like any other; an empty table stays empty.
    """
    return _with_text(mixed_documents(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in token sequences; a null text is an empty one, and every row, repeated or not, is packed on its own."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: the learned language model, fingerprints and tokens are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # what a stage was made from is not needed once the stage is written
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return docs
