"""Operator 3: flat token-id files with 64-bit document offsets, written for memory mapping.

Documents are range-partitioned by id, so that part k's ids all come before part k+1's. Each task encodes its documents into one
flat file of unsigned ids and one of 64-bit offsets, and returns one row, its number of tokens and documents. The parts' bases are prefix
sums over those rows, computed as a table: within groups of neighbouring parts, then over the groups' sums in the same way, until
one group is left. The driver sees no rows. Reading maps the files and touches only the spans asked for.

Part p is four files in the shared folder: p.ids (uint16 where the vocabulary fits, else uint32), p.off (uint64, documents + 1, counted from the part's start), p.doc
(int64 document ids) and p.nul (uint8, 1 where the document id was null). A task writes under a name of its own attempt and
renames at the end, so repeated and speculative attempts leave one whole set; the rows of the parts are written as a table, so that
reading does not write the files again. All numbers are little-endian.

Defined cases: a null or empty text is the end id alone; a null doc_id sorts first and comes back as null; equal doc_ids stay
separate documents, in no set order; an empty table gives no files and no rows; other columns are ignored, whatever their names. A document of
any length is one span: offsets are 64-bit.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltscope.llm.common import documents, id_and_text
from siltscope.llm.tokens import encoder
from siltscope.session import cut, ship, work_dir

PARTS = "part int, n_docs long, n_tokens long"


def local(path: str) -> str:
    """The mounted path of a file: URI. Memory mapping needs a mounted folder, so other schemes are refused."""
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"token files are memory-mapped and need a mounted shared folder, not {path}")
    return "/" + path.removeprefix("file:").lstrip("/")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, docs_per_part: int = 8192) -> DataFrame:
    """Write docs (doc_id, text) as token files under path; returns a row for each part: part, base_doc, base_token, n_docs, n_tokens, width."""
    spark, folder = docs.sparkSession, local(path)
    width = 2 if max(encoder(tokenizer).n_ids - 1, end_id) < 1 << 16 else 4
    ship(spark)
    rows = docs.count()
    parts = max(1, -(-rows // docs_per_part))
    ordered = id_and_text(docs).repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, end, mine = TaskContext.get().partitionId(), encoder(tokenizer), np.array([end_id], f"<u{width}").tobytes(), uuid.uuid4().hex
        os.makedirs(folder, exist_ok=True)
        tmp = {k: f"{folder}/.{part}-{mine}.{k}" for k in ("ids", "off", "doc", "nul")}
        total = n = 0
        with open(tmp["ids"], "wb") as ids, open(tmp["off"], "wb") as off, open(tmp["doc"], "wb") as doc, open(tmp["nul"], "wb") as nul:
            off.write(np.array([0], "<u8").tobytes())
            for b in batches:
                starts = np.empty(b.num_rows, "<u8")
                for i, text in enumerate(b.column("text")):
                    got = enc.ids(text.as_py())
                    ids.write(got if width == 4 else np.frombuffer(got, "<u4").astype("<u2").tobytes())
                    ids.write(end)
                    total += len(got) // 4 + 1
                    starts[i] = total
                off.write(starts.tobytes())
                who = b.column("doc_id")
                doc.write(np.asarray(who.fill_null(0), "<i8").tobytes())
                nul.write(np.asarray(who.is_null()).astype("u1").tobytes())
                n += b.num_rows
        if n:
            for k, name in tmp.items():
                os.replace(name, f"{folder}/{part}.{k}")
        else:
            for name in tmp.values():
                os.remove(name)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part] * bool(n), pa.int32()), "n_docs": pa.array([n] * bool(n), pa.int64()), "n_tokens": pa.array([total] * bool(n), pa.int64())})

    bases = prefix_sums(cut(ordered.mapInArrow(run, PARTS), "parts"), "part", parts, ["n_docs", "n_tokens"])
    out = bases.select("part", F.col("sum_n_docs").alias("base_doc"), F.col("sum_n_tokens").alias("base_token"), "n_docs", "n_tokens", F.lit(width).alias("width"))
    return cut(out, "parts")


def prefix_sums(df: DataFrame, key: str, below: int, columns: list[str], fan: int = 4096) -> DataFrame:
    """df with a column sum_<c> for each of the columns: their sums over all rows with a smaller key. key: 0 .. below - 1, each at most once.

    No task sees more than `fan` rows: sums run within groups of `fan` keys, and over the groups' sums by the same function.
    """
    own = [F.col(c) for c in columns]
    if below <= fan:
        order = Window.partitionBy(F.lit(0)).orderBy(key)
        return df.select("*", *[(F.sum(c).over(order) - c).cast("long").alias(f"sum_{n}") for c, n in zip(own, columns)])
    group = f"{key}_group"
    order = Window.partitionBy(group).orderBy(key)
    x = df.withColumn(group, F.floor(F.col(key) / fan).cast("long"))
    totals = cut(x.groupBy(group).agg(*[F.sum(c).alias(n) for c, n in zip(own, columns)]), "totals")
    ahead = prefix_sums(totals, group, -(-below // fan), columns, fan).select(group, *[F.col(f"sum_{n}").alias(f"__{n}") for n in columns])
    inner = x.select("*", *[(F.sum(c).over(order) - c).alias(f"__own_{n}") for c, n in zip(own, columns)])
    return inner.join(ahead, group).select(*df.columns, *[(F.col(f"__own_{n}") + F.col(f"__{n}")).cast("long").alias(f"sum_{n}") for n in columns])


def open_part(folder: str, part: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A part's ids, offsets, document ids and null marks, memory-mapped."""
    return tuple(np.memmap(f"{folder}/{part}.{k}", dtype=t, mode="r") for k, t in (("ids", f"<u{width}"), ("off", "<u8"), ("doc", "<i8"), ("nul", "u1")))


def read_token_files(parts: DataFrame, path: str, chunk: int = 4096) -> DataFrame:
    """A row for each document in the files: doc_id, start, n_tokens, ids (binary: little-endian unsigned 32-bit)."""
    return _each(parts, path, "ids binary", lambda x: x.tobytes(), pa.binary(), chunk)


def digest_token_files(parts: DataFrame, path: str, chunk: int = 4096) -> DataFrame:
    """A row for each document in the files: doc_id, start, n_tokens, ids_crc32."""
    return _each(parts, path, "ids_crc32 long", zlib.crc32, pa.int64(), chunk)


def _each(parts: DataFrame, path: str, field: str, of, kind, chunk: int) -> DataFrame:
    folder, name = local(path), field.split()[0]
    ship(parts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, off, doc, nul = open_part(folder, row["part"], row["width"])
                off = np.asarray(off).astype("i8")
                for i in range(0, row["n_docs"], chunk):
                    j = min(i + chunk, row["n_docs"])
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(np.asarray(doc[i:j]), pa.int64(), mask=np.asarray(nul[i:j]).astype(bool)),
                        "start": pa.array(off[i:j] + row["base_token"]),
                        "n_tokens": pa.array(off[i + 1 : j + 1] - off[i:j]),
                        name: pa.array([of(ids[s:e].astype("<u4")) for s, e in zip(off[i:j], off[i + 1 : j + 1])], kind),
                    })

    return parts.repartition(max(1, parts.count()), "part").mapInArrow(run, f"doc_id long, start long, n_tokens long, {field}")


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = work_dir(spark, "tokens")
    parts = write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return digest_token_files(parts, path)
