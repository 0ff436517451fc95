"""Exact line dedup by probing sharded minimal perfect hashes (operator 1)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, materialize, release_memory, small_batches

SEED = np.uint64(0x9E3779B97F4A7C15)
SHARD_KEYS = 32_768


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys (two uint64 arrays), as a cascade of bit arrays.

    Level by level, keys that are alone at their position take the bit there and the rest go on; a key's slot is the
    number of bits before its own. About three bits a key.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # boolean arrays
        self.ranks, self.starts, at = [], [], 0
        for bits in levels:
            ranks = np.cumsum(bits) - bits
            self.ranks.append(ranks + at)
            at += int(bits.sum())
        self.size = at

    @staticmethod
    def _position(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (_mix(_mix(a + SEED * np.uint64(level + 1)) ^ b) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, gamma: float = 1.6) -> PerfectHash:
        levels = []
        while len(a):
            size = max(64, math.ceil(gamma * len(a)))
            at = cls._position(a, b, len(levels), size)
            levels.append(np.bincount(at, minlength=size) == 1)
            left = ~levels[-1][at]
            a, b = a[left], b[left]
        return cls(levels)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A slot below size for each key; keys that were not built in get any slot or -1."""
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            at = self._position(a[left], b[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u4").tobytes()
        return sizes + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, blob: bytes) -> PerfectHash:
        n = int(np.frombuffer(blob, "<u4", 1)[0])
        sizes, at, levels = np.frombuffer(blob, "<u4", n, 4), 4 + 4 * n, []
        for size in map(int, sizes):
            took = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, took, at), count=size).astype(bool))
            at += took
        return cls(levels)


def _key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, None when it is too short. bytes.strip and bytes.lower touch ASCII only, as wanted."""
    key = line.strip(BLANKS.encode()).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, a, b): the 128-bit hash of each distinct long line key of each row."""

    def run(batches):
        for batch in batches:
            ids, out, n = batch.column(0), [], []
            for text in batch.column(1):
                found = {k for line in (text.as_py() or "").encode("utf-8", "replace").split(b"\n") if (k := _key(line, min_chars))}
                out.extend(found)
                n.append(len(found))
            pairs = np.frombuffer(b"".join(out), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["id", "a", "b"])
        release_memory()

    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, a long, b long")


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    """counts (a, b, n, keeper), distinct keys -> per shard the perfect hash and its arrays by slot."""

    def build(pdf):
        a, b = (pdf[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("a", "b"))
        mph = PerfectHash.build(a, b)
        order = np.argsort(mph.slots(a, b))
        column = lambda c: pdf[c].to_numpy().astype("<i8")[order].tobytes()
        return type(pdf)({"shard": [int(pdf["shard"].iloc[0])], "mph": [mph.to_bytes()], "prints": [column("b")], "counts": [column("n")], "keepers": [column("keeper")]})

    return counts.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build, "shard int, mph binary, prints binary, counts binary, keepers binary")


def _probe(min_docs: int):
    def run(batches):
        held, mph, prints, counts, keepers = None, None, None, None, None
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            shard, salt, kind = (col[c].to_numpy(zero_copy_only=False) for c in ("shard", "salt", "kind"))
            group = shard.astype(np.int64) << 32 | salt
            edges = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (kind[1:] != kind[:-1]), True])
            for at, to in zip(edges[:-1], edges[1:], strict=True):
                if kind[at] == 0:  # an index shard comes before the lines that probe it
                    held, mph = group[at], PerfectHash.from_bytes(col["mph"][int(at)].as_py())
                    prints, counts, keepers = (np.frombuffer(col[c][int(at)].as_py(), "<i8") for c in ("prints", "counts", "keepers"))
                elif group[at] == held:
                    ids, a, b = (col[c].slice(at, to - at).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "a", "b"))
                    slots = mph.slots(a.view(np.uint64), b.view(np.uint64))
                    hit = (slots >= 0) & (prints[slots] == b) & (counts[slots] >= min_docs) & (keepers[slots] != ids)
                    yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (ids, a, b)], names=["id", "a", "b"])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with repeated lines removed from the text, and n_lines and n_dropped.

    A line's key is the line stripped of ASCII blanks and lower-cased in ASCII. Keys of at least ``min_chars`` code points
    found in at least ``min_docs`` documents lose all their lines except in the largest id that holds them.

    Lines travel as 128-bit hashes only. Keys frequent enough are indexed: sharded minimal perfect hashes point into
    arrays of fingerprints, document counts and keepers. The documents' hashes are routed to the shards, where they
    stream past the arrays; shards that get more than their share of lines are copied to several tasks. What drops is
    sent back by document.

    Null or empty text: one empty line, and the new text is empty. Rows with null id keep all lines and are not counted.
    Rows that repeat an id count once and lose lines alike. An empty table gives an empty result. ids are integers.
    Columns starting with ``__of_`` are reserved.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lines = materialize(line_hashes(docs, id_col, text_col, min_chars), "lines")
    counts = lines.groupBy("a", "b").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    counts = materialize(counts, "line-counts")
    shards = max(1, math.ceil(counts.count() / SHARD_KEYS))
    index = materialize(build_index(counts, shards), "line-index")
    # shards with more than 1/parts of all lines, so at most `parts` of them, are spread over several tasks
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    probes = lines.select("id", "a", "b", F.pmod("a", F.lit(shards)).cast("int").alias("shard"))
    share = max(1, lines.count() // parts)
    hot = materialize(probes.groupBy("shard").count().where(F.col("count") > share).select("shard", F.ceil(F.col("count") / share).cast("int").alias("salts")), "line-hot")
    hot = F.broadcast(hot)
    salts = F.coalesce("salts", F.lit(1))
    none = F.lit(None)
    probes = probes.join(hot, "shard", "left").select("shard", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), "id", "a", "b", *[none.cast("binary").alias(c) for c in ("mph", "prints", "counts", "keepers")])
    index = index.join(hot, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), *[none.cast("long").alias(c) for c in ("id", "a", "b")], "mph", "prints", "counts", "keepers")
    met = index.unionByName(probes).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    drops = met.mapInArrow(_probe(min_docs), "id long, a long, b long").groupBy(F.col("id").alias("__of_id")).agg(F.collect_set(F.struct("a", "b")).alias("__of_drop"))
    joined = docs.join(drops, docs[id_col].cast("long") == drops["__of_id"], "left").drop("__of_id")
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    schema = ", ".join(f"`{c}` {'string' if c == text_col else docs.schema[c].dataType.simpleString()}" for c in keep) + ", n_lines long, n_dropped long"

    def rebuild(batches):
        for batch in batches:
            names = batch.schema.names
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column(names.index(text_col)), batch.column(names.index("__of_drop")), strict=True):
                text = text.as_py() or ""
                gone = {np.array([d["a"], d["b"]], "<i8").tobytes() for d in drop.as_py() or ()}
                own = text.split("\n")
                kept = own if not gone else [line for line in own if _key(line.encode("utf-8", "replace"), min_chars) not in gone]
                texts.append(text if len(kept) == len(own) else "\n".join(kept))
                n_lines.append(len(own))
                n_dropped.append(len(own) - len(kept))
            arrays = [pa.array(texts, pa.string()) if c == text_col else batch.column(names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*keep, "n_lines", "n_dropped"])
            release_memory()

    return joined.select(*keep, "__of_drop").mapInArrow(rebuild, schema)


def op1(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
