"""Documents to training data: five stages, each written and read back by the next.

Language, near duplicates, benchmark passages, mixing, token ids. Every stage but the last returns the columns of
``documents``; a document that the mix takes twice is there twice.
"""

from pyspark.sql import DataFrame, SparkSession

from quayside.llm import common, cube, idcoder, oddsketch, phrases, queries, ranklang

# A text has to score what all but 0.1 % of the labelled documents of its language do, less this margin. Texts in other
# languages and random letters still spare 0.15 to 0.4 of the greatest distance, so the threshold is learned.
SHARE_BELOW, MARGIN = 0.001, 0.05
SHINGLE, PERCENT = 5, 80

# Rows of whole texts that Spark hands to a Python worker at a time. Its 10,000 are some 35 MB of text, which executor
# and worker hold several times over, for each step of a task; a tenth of that is what the operators cut them into anyway.
BATCH_ROWS = 1_000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones are in. Unlabelled documents are judged by text, too."""
    _small_batches(spark)
    learned = ranklang.profiles(docs)
    return ranklang.in_a_known_language(docs, learned, ranklang.least_scores(docs, learned, SHARE_BELOW, MARGIN))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near duplicates."""
    _small_batches(spark)
    return oddsketch.without_near_duplicates(docs, SHINGLE, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    _small_batches(spark)
    return phrases.without_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    _small_batches(spark)
    return cube.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's ids, read back from the files."""
    _small_batches(spark)
    return idcoder.encoded_documents(docs, queries.vocabulary("word_bpe_49k.json"), queries.END_ID)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

# Neither ranks of n-grams, nor MinHash groups, nor balanced samples, nor the tokenizer are SQL; the tests hold
# the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    sf_dir = str(sf_dir).rstrip("/")
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
