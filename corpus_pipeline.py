"""The corpus pipeline: five stages, each a function of (spark, docs, sf_dir) that returns a DataFrame.

Every stage but the last returns the columns of documents. run() writes each stage's result to the shared folder and reads it
again. Where a stage changes texts, n_chars is counted anew.

Defined cases, for every stage: a null or empty text fails the quality rules and goes in the first stage; later stages given one keep it as it is, and
packing makes it a document of the end id alone. A null doc_id stays null; of near copies the one with the smallest doc_id stays,
null last. Repeated rows are copies like any others: one stays. Ties go as each operator's docstring says. Texts of any length are
worked on whole. Other columns than doc_id and text are carried through, whatever their names, and may be absent; packing
alone returns its own. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscope.llm.dedup import remove_repeats
from siltscope.llm.packing import pack, pieces_of
from siltscope.llm.pii import EXAMPLE_KEY, mask
from siltscope.llm.quality import keep_good
from siltscope.llm.simhash import drop_near_duplicates
from siltscope.session import cut


def counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`, with n_chars counted from the text."""
    n = F.length("text").cast(like.schema["n_chars"].dataType).alias("n_chars") if "n_chars" in like.columns else None
    return docs.select(*[n if c == "n_chars" else F.col(f"`{c}`") for c in like.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the rules reject go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each group of near-duplicates stays."""
    return drop_near_duplicates(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: strings of 200 bytes that come again anywhere in what is left are cut from the texts."""
    return counted(remove_repeats(docs), docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: personal data becomes pseudonyms."""
    return counted(mask(docs, EXAMPLE_KEY), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the documents' tokens are packed into sequences."""
    import public_tokenizers

    return pack(cut(pieces_of(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048), "pieces"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("pii", pii), ("packing", packing)]
#: No stage but the first's base rules can be stated in SQL; tests/llm/test_pipeline.py has a brute-force version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
