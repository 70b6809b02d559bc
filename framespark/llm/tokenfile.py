"""Token ids in files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

The file format is a folder of two Parquet tables. ``ranks`` holds (rank, id): rank 0 is the most frequent id of
the whole corpus. ``blocks`` holds runs of whole documents in ascending document id: for every block its documents'
ids and token counts, a control stream (two bits for each token: bytes in its rank less one, four tokens in a byte,
lowest bits first) and a data stream (the ranks' bytes, little-endian). A block decodes by table lookup alone; the
tokens before it are those of the parts before its own (one sum for each part) and those it counts ``within`` its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize
from .tokens import ChunkEncoder
from .worker import begin_task, stretches

#: Tokens at which a block is closed.
BLOCK_TOKENS = 1 << 18
#: Bytes of text encoded at once, about: the more, the fewer pieces are looked up again.
STRETCH_BYTES = 4 << 20
#: Documents' tokens in one part of the files.
PART_TOKENS = 1 << 24

_LENGTHS = np.array([[(c >> 2 * j & 3) + 1 for j in range(4)] for c in range(256)], np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    length = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = length - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of ``pack``."""
    length = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    start = np.concatenate(([0], np.cumsum(length, dtype=np.int64)))[:-1]
    octets = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)))
    out = octets[start].astype(np.uint32)
    for j in (1, 2, 3):
        wide = np.flatnonzero(length > j)
        if not len(wide):
            break
        out[wide] |= octets[start[wide] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


def encode_batches(batches: Iterator[pa.RecordBatch], tokenizer_file: str, end_id: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids of documents, their tokens with ``end_id`` as packed unsigned integers) of batches of (id, text)."""
    encoder = ChunkEncoder.shared(tokenizer_file)
    for batch in batches:
        for lo, hi in stretches(batch.column(1), STRETCH_BYTES):
            part = batch.slice(lo, hi - lo)
            yield part.column(0), encoder.encode_all(part.column(1), end_id)


def encode_documents(docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, ids): every whole text's ids (null: none) and then ``end_id``, as packed unsigned integers."""
    width = np.dtype(token_width(tokenizer_file)).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, ids in encode_batches(batches, tokenizer_file, end_id):
            n = pc.divide(pc.binary_length(ids), width).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([names, n, ids], ["id", "n", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, n long, ids binary")


def token_width(tokenizer_file: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_file).get_vocab_size() <= 1 << 16 else "<u4"


def write_token_files(
    docs: DataFrame, path: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encodes all documents once, counts ids over all of them, and writes both tables under ``path``.

    Null and empty texts become the end id alone. A null id is written as null, before all others; rows that repeat
    an id are written one after the other. Other columns are ignored; no rows give empty tables.
    """
    width = token_width(tokenizer_file)
    encoded = materialize(encode_documents(docs, tokenizer_file, end_id, id_col, text_col), "ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        total = np.zeros(1, np.int64)
        for batch in batches:
            column = batch.column(0)
            for lo, hi in stretches(column):
                got = np.bincount(np.frombuffer(b"".join(column.slice(lo, hi - lo).to_numpy(zero_copy_only=False)), width))
                if len(got) > len(total):
                    total = np.concatenate((total, np.zeros(len(got) - len(total), np.int64)))
                total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["token", "n"])

    counts = encoded.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    # at most a row for each entry of the vocabulary
    ordered = sorted(((r["n"], r["token"]) for r in counts.collect()), key=lambda x: (-x[0], x[1]))
    spark = docs.sparkSession
    spark.createDataFrame([(k, t) for k, (_, t) in enumerate(ordered)], "rank long, id long").coalesce(
        1
    ).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(1 + max((t for _, t in ordered), default=0), np.uint32)
    rank_of[[t for _, t in ordered]] = np.arange(len(ordered))
    tokens = sum(n for n, _ in ordered)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, within = TaskContext.get().partitionId(), 0
        ids, lengths, rows = [], [], []

        def close():
            nonlocal within, ids, lengths, rows
            control, data = pack(rank_of[np.frombuffer(b"".join(rows), width)])
            row = [[part], [within], [sum(lengths)], [ids], [lengths], [control], [data]]
            within, ids, lengths, rows = within + sum(lengths), [], [], []
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(row, kinds, strict=True)],
                ["part", "within", "tokens", "ids", "lengths", "control", "data"],
            )

        held = 0
        for batch in batches:
            for doc, n, raw in zip(*(batch.column(k) for k in range(3)), strict=True):
                ids.append(doc.as_py())
                lengths.append(n.as_py())
                rows.append(raw.as_py())
                held += lengths[-1]
                if held >= BLOCK_TOKENS:
                    held = 0
                    yield close()
        if rows:
            yield close()

    parts = max(1, -(-tokens // PART_TOKENS))
    schema = "part long, within long, tokens long, ids array<long>, lengths array<long>, control binary, data binary"
    (
        encoded.repartitionByRange(parts, "id")
        .sortWithinPartitions("id", "n", "ids")
        .mapInArrow(blocks, schema)
        .write.option("compression", "zstd")
        .parquet(f"{path}/blocks")
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n, ids): every document's place among all tokens, and its ids as packed unsigned 32-bit integers."""
    ranked = sorted((r["rank"], r["id"]) for r in spark.read.parquet(f"{path}/ranks").collect())  # the vocabulary
    id_of = np.array([i for _, i in ranked] or [0], "<u4")
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = dict(map(tuple, blocks.groupBy("part").agg(F.sum("tokens").alias("n")).collect()))  # a row for each part
    sizes = np.zeros(max(totals, default=0) + 1, np.int64)
    sizes[list(totals)] = list(totals.values())
    base = np.cumsum(sizes) - sizes

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for at in range(batch.num_rows) for r in batch.slice(at, 1).to_pylist()):
                lengths = np.array(row["lengths"], np.int64)
                ids = id_of[unpack(row["control"], row["data"], int(lengths.sum()))]
                ends = np.cumsum(lengths)
                raw, four = ids.tobytes(), 4
                cut = [raw[four * (e - n) : four * e] for e, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()),
                        pa.array(base[row["part"]] + row["within"] + ends - lengths),
                        pa.array(lengths),
                        pa.array(cut, pa.binary()),
                    ],
                    ["id", "start", "n", "ids"],
                )

    return blocks.mapInArrow(decode, "id long, start long, n long, ids binary")


def with_crc32(ids: DataFrame, column: str = "ids") -> DataFrame:
    """Adds ``ids_crc32``, the unsigned CRC-32 of a binary column."""
    return ids.withColumn("ids_crc32", F.crc32(column))

