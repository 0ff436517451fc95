"""Token ids as binary files: frequency-ranked ids in byte-aligned variable length with separate control bytes (operator 12)."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_path, materialize, release_memory, small_batches
from .packing import encoder
from .warc import filesystem

END = 1
MAGIC = b"OFTOKEN1"
#: Ids that are coded together; a block's control bytes stand before its data bytes.
BLOCK = 1 << 16
#: Ids that a vocabulary may have: the table of ranks is broadcast.
MAX_VOCABULARY = 1 << 22
#: Ids that a file holds at most on average.
FILE_IDS = 1 << 26
#: By control byte: bytes of each of its four numbers, where they start among its data bytes, and bytes of all.
SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
OFFSETS = np.cumsum(SIZES, axis=1) - SIZES
TOTALS = SIZES.sum(axis=1)
#: By number of bytes: the bits that count of four bytes read.
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack_numbers(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers; each takes the one to four bytes it needs."""
    values = np.asarray(values, "<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()


def unpack_numbers(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers that were packed, by looking sizes and places up in tables."""
    codes = np.frombuffer(control, np.uint8)
    starts = np.cumsum(TOTALS[codes]) - TOTALS[codes]
    at, size = (starts[:, None] + OFFSETS[codes]).ravel()[:n], SIZES[codes].ravel()[:n]
    if n and (len(control) != -(-n // 4) or at[-1] + size[-1] != len(data)):
        raise ValueError("damaged block")
    padded = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    return (padded[at] | padded[at + 1] << 8 | padded[at + 2] << 16 | padded[at + 3] << 24) & MASKS[size]


def token_table(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """(id, n, ids, tie, row): the ids of each whole text with the end id, little-endian, two bytes each where the vocabulary allows."""
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    if max(size, end + 1) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} ids")
    kind = "<u2" if max(size, end + 1) <= 1 << 16 else "<u4"
    small_batches(docs.sparkSession)

    def run(batches):
        words = encoder(tokenizer_path)
        for batch in batches:
            counts, blobs = [], []
            for ids in words.encode(batch.column(1)):
                ids[-1] = end
                counts.append(len(ids))
                blobs.append(ids.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], names=["id", "n", "ids"])
        release_memory()

    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, ids binary")
    return ids.select("id", "n", "ids", F.xxhash64("ids").alias("tie"), F.monotonically_increasing_id().alias("row"))


def rank_ids(tokens: DataFrame, wide: bool) -> DataFrame:
    """(token, count, rank): the ids in use, the most frequent first, ties by id. Each task counts its own before the shuffle."""

    def run(batches):
        counts = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4" if wide else "<u2"))
            counts = np.pad(counts, (0, max(0, len(found) - len(counts))))
            counts[: len(found)] += found
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["token", "n"])

    counts = tokens.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("count"))
    # as many rows as the vocabulary has ids
    return counts.withColumn("rank", F.row_number().over(W.orderBy(F.desc("count"), "token")) - 1)


class _File:
    """One file: magic, blocks (numbers, bytes of control and of data, checksum, then both), and a footer with the documents.

    The footer is a JSON line (documents, ids, blocks), the documents' ids and numbers of tokens as 64-bit integers with
    the null ids marked by one bit each; the last 8 bytes give its length.
    """

    def __init__(self, folder: str, task):
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        # a name of its own for each attempt: what a lost or repeated task leaves is never read
        self.path = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.tok"
        self.stream = fs.open_output_stream(filesystem(self.path)[1])
        self.bytes = self.blocks = self.held = self.total = 0
        self.waiting, self.ids, self.counts = [], [], []
        self._put(MAGIC)

    def _put(self, blob: bytes) -> None:
        self.stream.write(blob)
        self.bytes += len(blob)

    def _flush(self, last: bool) -> None:
        ranks = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        upto = len(ranks) if last else len(ranks) // BLOCK * BLOCK
        for at in range(0, upto, BLOCK):
            block = ranks[at : min(at + BLOCK, upto)]
            control, data = pack_numbers(block)
            self._put(struct.pack("<IIII", len(block), len(control), len(data), zlib.crc32(data, zlib.crc32(control))) + control + data)
            self.blocks += 1
        self.waiting, self.held = [ranks[upto:]], len(ranks) - upto

    def add(self, doc: int | None, ranks: np.ndarray) -> None:
        self.ids.append(doc)
        self.counts.append(len(ranks))
        self.waiting.append(ranks)
        self.held += len(ranks)
        self.total += len(ranks)
        if self.held >= 4 * BLOCK:
            self._flush(False)

    def close(self) -> None:
        self._flush(True)
        ids = np.array([x or 0 for x in self.ids], "<i8").tobytes()
        nulls = np.packbits(np.array([x is None for x in self.ids], bool)).tobytes()
        foot = json.dumps({"documents": len(self.ids), "ids": self.total, "blocks": self.blocks}).encode() + b"\n" + ids + np.array(self.counts, "<i8").tobytes() + nulls
        self._put(foot + struct.pack("<Q", len(foot)))
        self.stream.close()


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = END, files: int | None = None) -> str:
    """Tokenize every whole text, write ids in ascending order of documents, and return the folder.

    The folder holds ``ranks`` (token, rank), ``manifest`` (nth, path, documents, ids, bytes) and the files it names, the
    nth with the nth range of document ids. Ids are replaced by their rank of frequency in all the corpus, so the 256
    commonest take one byte. Documents are tokenized once, into a table in the shared folder; only ids are sorted.

    Order: by id, null ids first; rows that repeat an id by a hash of their ids. Such rows, equal ones too, may lie in several
    files, so one id that holds a third of all rows does not make one file long. Null, empty and blank texts hold the end id only. An
    empty table gives files without documents or none. ids are integers; other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    tokens = materialize(token_table(docs, tokenizer_path, id_col, text_col, end), "token-ids")
    from tokenizers import Tokenizer

    wide = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end + 1) > 1 << 16
    rank_ids(tokens, wide).coalesce(1).write.parquet(f"{folder}/ranks")
    used = np.array([(r["token"], r["rank"], r["count"]) for r in spark.read.parquet(f"{folder}/ranks").collect()], np.int64).reshape(-1, 3)
    table = np.zeros(int(used[:, 0].max(initial=0)) + 1, np.uint32)
    table[used[:, 0]] = used[:, 1]
    shared = spark.sparkContext.broadcast(table)

    def run(batches):
        task, ranks, out = TaskContext.get(), shared.value, None
        for batch in batches:
            if out is None and batch.num_rows:
                out = _File(folder, task)
            for doc, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out.add(doc, ranks[np.frombuffer(blob.as_buffer(), "<u4" if wide else "<u2")])
        found = []
        if out is not None:
            out.close()
            found.append((task.partitionId(), out.path, len(out.ids), out.total, out.bytes))
        names, types = ["nth", "path", "documents", "ids", "bytes"], [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], names=names)
        release_memory()

    files = files or max(spark.sparkContext.defaultParallelism, -(-int(used[:, 2].sum()) // FILE_IDS))
    order = [F.asc_nulls_first("id"), "tie", "row"]
    sorted_ = tokens.select("id", "ids", "tie", "row").repartitionByRange(files, *order).sortWithinPartitions(*order)
    sorted_.select("id", "ids").mapInArrow(run, "nth int, path string, documents long, ids long, bytes long").write.parquet(f"{folder}/manifest")
    return folder


def _blocks(stream, ids: np.ndarray):
    """The token ids of each block of a file."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of token ids")
    while True:
        head = stream.read(16)
        n, control, data, check = struct.unpack("<IIII", head)
        control, data = stream.read(control), stream.read(data)
        if zlib.crc32(data, zlib.crc32(control)) != check:
            raise ValueError("damaged block")
        yield ids[unpack_numbers(control, data, n)]


def _foot(fs, path: str) -> tuple[dict, list, np.ndarray]:
    with fs.open_input_file(path) as file:
        size = file.size()
        file.seek(size - 8)
        length = struct.unpack("<Q", file.read(8))[0]
        file.seek(size - 8 - length)
        head, _, rest = file.read(length).partition(b"\n")
    said = json.loads(head)
    n = said["documents"]
    null = np.unpackbits(np.frombuffer(rest, np.uint8, -1, 16 * n), count=n).astype(bool)
    ids = pa.array(np.frombuffer(rest, "<i8", n), mask=null).to_pylist()
    return said, ids, np.frombuffer(rest, "<i8", n, 8 * n)


class Checksum:
    """The unsigned CRC-32 of a document's ids as little-endian unsigned 32-bit numbers."""

    name, kind, arrow = "ids_crc32", "long", pa.int64()

    def __init__(self):
        self.value = 0

    def piece(self, ids: np.ndarray) -> None:
        self.value = zlib.crc32(np.ascontiguousarray(ids, "<u4"), self.value)


class Whole:
    """A document's ids in a list."""

    name, kind, arrow = "tokens", "array<long>", pa.list_(pa.int64())

    def __init__(self):
        self.value = np.empty(0, np.int64)

    def piece(self, ids: np.ndarray) -> None:
        self.value = np.append(self.value, ids.astype(np.int64))


def read_tokens(spark: SparkSession, folder: str, visit: type = Whole) -> DataFrame:
    """(id, start, n_tokens, tokens) of every document in a folder of ``write_tokens``; start counts the ids of all before it.

    Each file is read as a stream, block by block. ``visit`` makes the last column: one is made per document, takes its ids
    piece by piece and holds the value at the end, so that a checksum needs no document in memory.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    before = F.coalesce(F.sum("ids").over(W.orderBy("nth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per file
    placed = materialize(manifest.select("path", before.alias("base")), "token-files")
    ranked = [r["token"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").select("token").collect()]
    shared = spark.sparkContext.broadcast(np.array(ranked, "<u4"))

    def rows(out):
        columns = list(zip(*out, strict=True)) or [()] * 4
        types = [pa.int64(), pa.int64(), pa.int64(), visit.arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "start", "n_tokens", visit.name])

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, own = filesystem(path)
                said, docs, counts = _foot(fs, own)
                if len(docs) != said["documents"] or counts.sum() != said["ids"]:
                    raise ValueError(f"{path} does not hold what it names")
                with fs.open_input_stream(own) as stream:
                    blocks, left, out, held = _blocks(stream, shared.value), np.empty(0, "<u4"), [], 0
                    for doc, n in zip(docs, counts.tolist(), strict=True):
                        one, need = visit(), n
                        while need:
                            if not len(left):
                                left = next(blocks)
                            took = min(need, len(left))
                            one.piece(left[:took])
                            left, need = left[took:], need - took
                        out.append((doc, start, n, one.value))
                        start, held = start + n, held + n
                        if len(out) >= 5000 or held >= 1 << 20:
                            yield rows(out)
                            out, held = [], 0
                    yield rows(out)
        release_memory()

    return placed.repartition(max(1, placed.count())).mapInArrow(run, f"id long, start long, n_tokens long, {visit.name} {visit.kind}")


def op12(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    folder = write_tokens(docs, str(public_tokenizers.path("word_bpe_49k.json")))
    return read_tokens(docs.sparkSession, folder, Checksum).withColumnRenamed("id", "doc_id")
