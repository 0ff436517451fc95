"""Hierarchical multi-length packing of tokenized documents (operator 7)."""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right, insort
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, release_memory, small_batches

END = 2
#: Bytes of text looked at together, and bytes that a worker's memory of words may take in each of its two halves.
CHUNK_BYTES, MEMORY_BYTES = 6 << 20, 24 << 20
#: Tokens packed at once.
CHUNK = 1 << 20
#: Letters that lower-case to one letter and have no other form under NFC; İ has a combining mark in lower case.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
PLAIN = re.compile(f"[{LETTERS}]+")
#: A word that ends in ASCII marks after such a letter: the two parts never share a token.
MARKED = rf"(?s)^(?P<core>.*[{LETTERS}])(?P<mark>[!-/:-@\[-`{{-~]+)$"
BLANK = re.compile("[ \t\n\v\f\r]")
#: The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 is itself, the rest follow from 256 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
STAND_IN = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _SELF)}


def _gather(values: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups of values (group i has size[i] of them) named by which, in a row, and their sizes."""
    starts, took = np.cumsum(size) - size, size[which]
    ends = np.cumsum(took)
    return values[np.repeat(starts[which] - (ends - took), took) + np.arange(took.sum())], took


class WordEncoder:
    """The ids of whole texts, looked up word by word.

    The vocabulary's tokenizer never joins characters across ASCII blanks, and its special tokens hold none, so a text's
    ids are those of its words in a row. Each distinct word of a few MB of text is encoded once, and what recurs is
    remembered in a memory of bounded bytes: of two halves, the older goes when the younger is full.
    """

    def __init__(self, path: str, memory_bytes: int = MEMORY_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer, self.memory_bytes = Tokenizer.from_file(path), memory_bytes
        self.model = self.tokenizer.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _new(self, part: str) -> bytes:
        """Plain letters are one pre-token that normalizing only lower-cases; all else goes through the whole tokenizer."""
        if PLAIN.fullmatch(part):
            part = part.lower()
            ids = [t.id for t in self.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(STAND_IN))]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _look_up(self, parts: list[str]) -> list[bytes]:
        out = []
        for part in parts:
            found = self.young.get(part)
            if found is None:
                found = self.old.get(part)
                if found is None:
                    found = self._new(part)
                self.young[part] = found
                self.held += 200 + len(part) + len(found)
                if self.held > self.memory_bytes:
                    self.young, self.old, self.held = {}, self.young, 0
            out.append(found)
        return out

    def chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary
        marked = pc.extract_regex(pc.if_else(pc.match_substring(distinct, "<|"), None, distinct), MARKED)
        core = pc.coalesce(pc.struct_field(marked, "core"), distinct)
        core = pc.if_else(pc.match_substring_regex(core, f"^[{LETTERS}]+$"), pc.utf8_lower(core), core)
        parts = pa.concat_arrays([core, pc.fill_null(pc.struct_field(marked, "mark"), "")]).dictionary_encode()
        blobs = self._look_up(parts.dictionary.to_pylist())
        ids, size = np.frombuffer(b"".join(blobs), "<u4"), np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        # a distinct word's ids are those of its core and its mark; a text's are those of its words
        ids, size = _gather(ids, size, parts.indices.to_numpy().reshape(2, -1).T.ravel())
        ids, took = _gather(ids, size.reshape(-1, 2).sum(axis=1), words.indices.to_numpy())
        upto = np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False))
        return ids, np.diff(np.r_[0, np.r_[0, np.cumsum(took)][upto]])

    def encode(self, texts: pa.Array):
        """The ids of each text, as an array of unsigned 32-bit numbers with the end id; null counts as empty.

        Texts are joined to chunks of a few MB and longer ones cut at blanks, so the working memory is bounded.
        """
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK_BYTES, side="right")) + at)
            if sizes[at] > CHUNK_BYTES:
                yield self._long(texts[at].as_py())
                upto = at + 1
            else:
                ids, counts = self.chunk(texts.slice(at, upto - at))
                for own in np.split(ids, np.cumsum(counts)[:-1]):
                    yield np.append(own, np.uint32(END))
            at = upto

    def _long(self, text: str) -> np.ndarray:
        out, at = [], 0
        while at < len(text):
            blank = BLANK.search(text, at + CHUNK_BYTES // 4)
            upto = blank.end() if blank else len(text)
            out.append(self.chunk(pa.array([text[at:upto]]))[0])
            at = upto
        return np.append(np.concatenate(out), np.uint32(END))


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """One per worker process, kept between tasks."""
    return WordEncoder(path)


class TierPacker:
    """Packs pieces of documents into full sequences of the tiers' lengths.

    A document is cut at the longest tier; what remains waits in the pool of pieces, each in the shortest tier that holds
    it. Sequences are opened from the longest tier down: the longest waiting piece starts one of its tier, the gap is
    filled with the longest shorter pieces that fit, and the last gap with the head of a cut piece. A piece is (id, its
    document's number of tokens, start, tokens); one that waits holds no more of its document than its own tokens.
    """

    def __init__(self, tiers: tuple[int, ...], emit):
        self.tiers, self.emit = sorted(tiers), emit
        self.waiting: list[tuple[int, int]] = []  # (length, key), ascending
        self.pieces: dict[int, tuple] = {}
        self.tokens = self.key = 0

    def _wait(self, doc, total: int, start: int, ids: np.ndarray) -> None:
        insort(self.waiting, (len(ids), self.key))
        self.pieces[self.key] = (doc, total, start, ids)
        self.key += 1
        self.tokens += len(ids)

    def _take(self, at: int) -> tuple:
        length, key = self.waiting.pop(at)
        self.tokens -= length
        return self.pieces.pop(key)

    def add(self, doc, ids: np.ndarray) -> None:
        top, total, start = self.tiers[-1], len(ids), 0
        while total - start >= top:
            self.emit(top, [(doc, total, start, ids[start : start + top])])
            start += top
        if total > start:
            self._wait(doc, total, start, ids[start:].copy())

    def pack(self, last: bool) -> None:
        """Close full sequences; with ``last`` all that waits, else leave less than the longest tier."""
        while self.waiting and (last or self.tokens >= self.tiers[-1]):
            longest = self.waiting[-1][0]
            tier = next(t for t in self.tiers if t >= longest)
            if self.tokens < tier:  # the end of the input: the longest tier that can be filled
                tier = max([t for t in self.tiers if t <= self.tokens], default=tier)
            gap, held = tier, []
            while gap and self.waiting:
                at = bisect_right(self.waiting, (gap, self.key)) - 1
                if at >= 0:
                    held.append(self._take(at))
                    gap -= len(held[-1][3])
                else:
                    doc, total, start, ids = self._take(0)
                    held.append((doc, total, start, ids[:gap]))
                    self._wait(doc, total, start + gap, ids[gap:])
                    gap = 0
            self.emit(tier, held)


def balance_steps(pieces: DataFrame, tiers: tuple[int, ...], step_tokens: int) -> DataFrame:
    """pieces (part, nth, context, ...) with step_id: groups of sequences that fill ``step_tokens`` exactly.

    The sequences of a tier are numbered across all partitions by the running sum of the partitions' counts, and each
    ``step_tokens`` of them make a step. What a tier has left over joins the rest of the other tiers, longest first, in
    steps of several tiers. So only the last step of all is short.
    """
    counts = materialize(pieces.where(F.col("offset") == 0).groupBy("part", "context").agg(F.count("*").alias("n")), "sequences")
    total = {r["context"]: r["n"] * r["context"] for r in counts.groupBy("context").agg(F.sum("n").alias("n")).collect()}
    own, tail, step = {}, {}, 0
    for tier in sorted(tiers, reverse=True):
        own[tier] = step
        step += total.get(tier, 0) // step_tokens
    rest = 0
    for tier in sorted(tiers, reverse=True):
        tail[tier] = rest
        rest += total.get(tier, 0) % step_tokens
    of = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("context"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("context").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spot = ((F.col("before") + F.col("nth")) * F.col("context")).alias("spot")
    full = of({t: total.get(t, 0) // step_tokens * step_tokens for t in tiers})
    placed = pieces.join(counts.select("part", "context", before.alias("before")), ["part", "context"]).withColumn("spot", spot)
    steps = F.when(F.col("spot") < full, of(own) + F.floor(F.col("spot") / step_tokens)).otherwise(F.lit(step) + F.floor((of(tail) + F.col("spot") - full) / step_tokens))
    return placed.withColumn("step_id", steps.cast("long")).drop("part", "nth", "before", "spot")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = (512, 1024, 2048, 4096), step_tokens: int = 65_536) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context (its tier), step_id.

    Every document is tokenized whole and ends with id 2. Each partition is packed by itself, so no text is shuffled and
    only one partly filled sequence per partition is left. Steps are groups of sequences that take ``step_tokens`` tokens
    each with their padding, of one tier but for the last few (see ``balance_steps``). Reruns over the same partitions agree.

    Null or blank text: only id 2. Null ids and rows that repeat an id are packed like any other, each row once. A text of
    any length is cut into as many sequences as it needs. An empty table gives an empty result.
    """
    if step_tokens % max(tiers) or any(b % a for a, b in pairwise(sorted(tiers))):
        raise ValueError("each tier must divide the next longer one, and the longest step_tokens")

    def run(batches):
        part, out, counted, serial = TaskContext.get().partitionId(), [], {}, [0]
        words = encoder(tokenizer_path)

        def emit(tier, held):
            sequence = part << 32 | serial[0]
            serial[0] += 1
            nth = counted[tier] = counted.get(tier, -1) + 1
            offset = 0
            for doc, total, start, ids in held:
                out.append((doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), total, sequence, offset, tier, part, nth))
                offset += len(ids)

        def rows():
            columns = list(zip(*out, strict=True)) or [()] * 10
            out.clear()
            types = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "part", "nth"])

        packer = TierPacker(tiers, emit)
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1)), strict=True):
                packer.add(doc, ids)
                if packer.tokens >= CHUNK:
                    packer.pack(False)
                if len(out) > 10_000:
                    yield rows()
        packer.pack(True)
        yield rows()
        release_memory()

    small_batches(docs.sparkSession)
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context int, part long, nth long"
    pieces = materialize(docs.select(id_col, text_col).mapInArrow(run, schema), "pieces")
    return balance_steps(pieces, tiers, step_tokens).select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "step_id")


def op7(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))
