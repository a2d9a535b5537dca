"""Operator 7: token counts through a cache that is keyed by digests of the content and of the tokenizer's version.

The cache is a Parquet folder of (tokenizer, digest, n_tokens), partitioned by tokenizer: the digest of the tokenizer file and the
library's version. Normalising may not change a count, so it is only null -> empty and UTF-8; the content digest is SHA-256 of
those bytes. Steps: (1) one scan gives each document's digest and byte length; (2) digests are made distinct (partial
aggregation first, so a hot text is one row from each task) and anti-joined with the cache; (3) a second scan sends only texts
of missing digests, each at most once from a task and compressed, to their digest's partition, where the first of each is
encoded; (4) the new counts are appended; (5) documents are joined with their counts by digest. That join carries no text, and both its
sides are plain tables, so that adaptive execution can split the partition of a text with very many copies.

Defined cases: null and empty texts count 0; equal texts are encoded once and counted alike; repeated and null doc_ids are kept;
an empty table gives no rows and appends nothing; other columns are ignored, whatever their names; a text of any length is counted whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscope.llm.common import documents, id_and_text
from siltscope.llm.tokens import encoder
from siltscope.session import cut, ship, work_dir

CACHE = "digest binary, n_tokens long, tokenizer string"


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer file and of the version of the library that runs it."""
    import importlib.metadata

    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library} {importlib.metadata.version(library)}".encode()).hexdigest()[:32]


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row for each digest."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{cache}/tokenizer={version}")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return spark.read.schema("digest binary, n_tokens long").parquet(f"{cache}/tokenizer={version}").groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each document; misses are appended to the cache."""
    spark = docs.sparkSession
    ship(spark)
    version, texts = tokenizer_digest(tokenizer), id_and_text(docs)
    digest = F.unhex(F.sha2(F.col("text"), 256))
    keyed = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest.alias("digest"))
    stored = read_cache(spark, cache, version)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            keys, rows = b.column("digest").to_pylist(), []
            for i, k in enumerate(keys):
                if k not in seen:
                    seen.add(k)
                    rows.append(i)
            if len(seen) > 1_000_000:  # a bound on memory; a text may then be sent again
                seen.clear()
            text = b.column("text")
            yield pa.RecordBatch.from_pydict({"digest": pa.array([keys[i] for i in rows], pa.binary()), "packed": pa.array([zlib.compress(text[i].as_py().encode(), 1) for i in rows], pa.binary())})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last = encoder(tokenizer), None
        for b in batches:
            keys, counts = [], []
            for k, packed in zip(b.column("digest").to_pylist(), b.column("packed")):
                if k != last:
                    last = k
                    keys.append(k)
                    counts.append(enc.count(zlib.decompress(packed.as_py()).decode()))
            yield pa.RecordBatch.from_pydict({"digest": pa.array(keys, pa.binary()), "n_tokens": pa.array(counts, pa.int64())})

    with_digest = texts.select(digest.alias("digest"), "text")
    known = stored.select("digest")
    missing = with_digest.join(known, "digest", "left_anti") if _any(stored) else with_digest
    new = missing.mapInArrow(send, "digest binary, packed binary").repartition("digest").sortWithinPartitions("digest").mapInArrow(encode, "digest binary, n_tokens long")
    new.write.mode("append").parquet(f"{cache}/tokenizer={version}")
    return keyed.join(cut(read_cache(spark, cache, version), "counts"), "digest").select("doc_id", "n_bytes", "n_tokens")


def _any(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), work_dir(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)
