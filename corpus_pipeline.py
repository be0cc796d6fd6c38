"""From raw documents to training tokens, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; between
stages the documents are written as Parquet to the shared folder and read
back, so a lost executor or driver restart costs one stage.  All but the last
return the columns of ``documents``.

1. quality - documents that the attention classifier scores under 0.3 go.
2. near_duplicates - one row (that of the smallest id) of each class stays.
3. pii - personal numbers, dates and addresses become pseudonyms.
4. mixing - languages are brought to target token shares.  No domain has to
   shrink: the total grows instead and every document stays at least once.
5. tokens - SentencePiece ids and their decoded text.

Defined results: every stage decides row by row.  A null text is scored as an
empty one, has no words, no pseudonyms and no tokens but the begin and end
ids.  Texts without a word are no copies of one another and stay.  Of rows
that repeat an id and text one stays, as of any copies; rows with a null id
are compared like the others and come last in the choice of which stays; an id
with two texts loses only the text that has a copy.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.llm import dartminhash, mixing, pieces, pseudonyms, quality
from demandlake.llm.common import stage, table
from demandlake.llm.queries import MIX_TARGETS, MODEL_FILE, PSEUDONYM_KEY, labelled_domains

ACCEPT = 0.3
TOKEN_MEMORY, TOKEN_BATCH = 75_000, 1 << 18  # a Python worker outlives the stage, and what it holds with it


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.withColumn("__text", F.col("text")), model, "__text")
    return scored.where(F.col("score") >= ACCEPT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows, not ids, are compared: ids may repeat or be null
    keyed = stage(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    worded = keyed.where(F.col("text").rlike(r"[^\t-\r ]")).select("__row", "text")
    member = dartminhash.classes(worded, key="__row").select(F.col("id").alias("__row"), "class_id")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__row")
    member = stage(member.join(keyed.select("__row", "doc_id"), "__row"), "members")
    stays = member.groupBy("class_id").agg(F.min(order)["__row"].alias("__row")).select("__row")
    goes = member.select("__row").join(stays, "__row", "left_anti")
    return keyed.join(goes, "__row", "left_anti").select(*docs.columns)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pseudonyms.pseudonymise(docs, PSEUDONYM_KEY)
    changed = F.when(F.col("n_pseudonyms") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*docs.columns)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = labelled_domains(docs, table(spark, sf_dir, "labels"))
    return mixing.resample(docs, labelled, MIX_TARGETS, least=1.0, growth=True)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(docs, MODEL_FILE, memory=TOKEN_MEMORY, together=TOKEN_BATCH)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("pii", replace_pii),
    ("mixing", mix_languages),
    ("tokens", encode_tokens),
]

# learned models and hashed signatures: no SQL twin
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
