"""A corpus pipeline: language ID, near duplicates, repeated passages, source mix, tokens; each stage reads what the last one wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm import bpe, langid, mixing, ngrams, substrings
from boxloom.llm.common import packed, scratch, text_key, unpacked, words

#: Documents whose language has a lower mean marginal are rejected.
LEAST_SCORE = 0.5


def _rows(docs: DataFrame) -> DataFrame:
    """docs as (doc_id, text, source, row): all columns stay together in one, whatever their names."""
    return docs.select("doc_id", "text", "source", packed(docs.columns).alias("row"))


def _with_text(df: DataFrame, text, columns: list[str]) -> DataFrame:
    """The columns of `row`, with another text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return df.select(*[new[c].alias(c) if c in new else own for c, own in zip(columns, unpacked("row", columns))])


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the CRF gives a language with a score of LEAST_SCORE or more; texts without a letter, empty or null ones go.

    Equal texts share their fate; rows that repeat stay as they are; an empty table gives none; other columns may have any name.
    """
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", "text", packed(others).alias("row"))
    found = langid.predict(rows, langid.train(docs), ("row", "text"))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    own = dict(zip(others, unpacked("row", others)))
    return kept.select(*[own.get(c, F.col("text")) for c in docs.columns])


def join_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the smallest doc_id (null is the greatest).

    Of rows that repeat its doc_id and text one stays, of those that repeat the doc_id alone that of the least text hash.
    Texts without words, null ones too, are alike to none; a null is not told from an empty text of the same doc_id;
    an empty table gives none; other columns may have any name.
    """
    kept = ngrams.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key")).distinct()
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), packed(docs.columns).alias("row"))
    met = rows.join(kept, rows["doc_id"].eqNullSafe(kept["kept_id"]) & (rows["key"] == kept["kept_key"]), "left_semi")
    return met.dropDuplicates(["doc_id", "key"]).select(*unpacked("row", docs.columns))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that a smaller doc_id has; what is left of a changed text is joined by single spaces, nothing left means it goes.

    Null and short texts stay as they are; rows of one doc_id, null ones too, take nothing from each other;
    an empty table gives none; other columns may have any name.
    """
    return substrings.remainders(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it whole; a part that is taken beyond that is its first words, joined by single spaces.

    Texts without words, null ones too, are taken never. Rows that repeat are rows of their own; ties are broken by the text; an
    empty table gives none; other columns may have any name.
    """
    mixed = mixing.mix(_rows(docs), keep=("row",)).where("taken > 0")
    whole, part = F.expr("taken div size").cast("int"), F.expr("taken % size").cast("int")
    pieces = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    each = mixed.withColumn("part", F.explode(pieces))
    whole = dict(zip(docs.columns, unpacked("row", docs.columns)))["text"]
    text = F.when(F.col("part") == 0, whole).otherwise(F.array_join(F.slice(words(whole), 1, F.greatest("part", F.lit(1))), " "))
    return _with_text(each, text, docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian uint32), their digest and that of what they decode to.

    A null text is an empty one, each row gives one, an empty table none; other columns are not read, whatever their names.
    """
    return bpe.round_trip(docs, ("source",), ids=True).select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify),
    ("near_duplicates", join_near),
    ("substring_dedup", drop_passages),
    ("source_mix", mix_sources),
    ("byte_bpe", tokenize),
]
#: SQL can't express the language model and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; each result but the last is written to the shared folder and read again."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        df = stage(spark, df, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch(spark, name)
            df.write.parquet(path)
            df = spark.read.parquet(path)
    return df
