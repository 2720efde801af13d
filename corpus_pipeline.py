"""A training corpus from raw documents, in five stages.

Each stage takes the documents its predecessor kept, as written and read again, and returns
documents with their columns; the last one writes token sequences and returns what it reads
back. Tables that a stage writes on the way are deleted when it returns, but for those that its
result reads. Every stage decides by row: rows with a null doc_id or one that repeats are judged each by
their own text. Columns beyond those of documents pass through untouched, whatever their names.
Texts go to Python in Arrow batches of bounded bytes, a setting of the session.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import jaccard, language, mixing, phrase_index, sequences
from factorloom.llm.common import bounded_batches, passing, release, small, stored, table

#: Vocabulary of the last stage.
VOCABULARY = "word_bpe_49k.json"


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a column that tells its rows apart, and the name of that column.

    A row read from files is named by a hash of its file and its place there, the same in every
    pass and after lost tasks. Rows from elsewhere are numbered and written once.
    """
    name = "row_number"
    while name in docs.columns:
        name += "_"
    try:
        read = docs.metadataColumn("_metadata")
        place = F.struct(F.xxhash64(read["file_path"]).alias("file"), read["row_index"].alias("place"))
        return docs.withColumn(name, place), name
    except AnalysisException:
        return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered_docs", keep=True), name


def _without(docs: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """`docs` of `_numbered` without the rows that `gone` (one column) names, and without that column."""
    gone = small(stored(gone.toDF(name), "gone", keep=True))
    return docs.join(gone, name, "left_anti").drop(name).select(*[F.col(f"`{c}`") for c in docs.columns if c != name])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be named; texts that are null or have no letter go.

    The classifiers learn from the labelled rows of `docs` outside the held-out fold; without
    any such row only the letters count. A low score alone does not reject a document.
    """
    release(spark)
    bounded_batches(spark)
    model = language.learn(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return docs.where(language.language_of(F.col("text"), model) != language.UNKNOWN)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similar shingle sets: the one with the smallest id.

    A null id counts as larger than any; of rows that repeat the smallest id one stays.
    """
    release(spark)
    bounded_batches(spark)
    with passing(spark):
        docs, row = _numbered(docs)
        found = stored(jaccard.jaccard_join(docs, id_col=row).select(F.col("doc_id").alias("row"), "component_id"), "near")
        ids = found.join(docs.select(F.col(row).alias("row"), F.col("doc_id").alias("id")), "row")
        first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "row")).alias("first"), F.count(F.lit(1)).alias("rows"))
        stays = first.where("rows > 1").select(F.col("first.row").alias("row"), "component_id")
        more = found.join(stays.select("component_id"), "component_id", "left_semi")
        return _without(docs, row, more.join(stays, "row", "left_anti").select("row"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold a notable share of benchmark windows."""
    release(spark)
    bounded_batches(spark)
    with passing(spark):
        docs, row = _numbered(docs)
        found = phrase_index.decontaminate(docs, table(spark, sf_dir, "benchmark"), id_col=row)
        return _without(docs, row, found.where("contaminated").select("doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target says."""
    release(spark)
    return mixing.emit(mixing.mix(docs))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of all documents, and one row per document read back from them."""
    import public_tokenizers

    release(spark)
    bounded_batches(spark)
    return sequences.tokenized(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_sequences", write_tokens),
]

#: Language identification and tokens cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
