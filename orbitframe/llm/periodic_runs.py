"""Periodic runs of words, found through a dictionary of basic factors (operator 11)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, small_batches, trimmed_words

#: Words whose factors are named together; a longer text is taken alone.
CHUNK_WORDS = 1 << 18


class BasicFactors:
    """Names of all factors of power-of-two length of several texts laid end to end.

    ``names[k][i]`` names the 2^k words from i on: equal names mean equal factors of one text. Factors that occur once in
    their text, or reach beyond it, have the name -1 and are left out of the next level.
    """

    def __init__(self, codes: np.ndarray, text: np.ndarray, ends: np.ndarray):
        self.n, self.codes = len(codes), np.append(codes, -1)
        self.names, self.active = [], []
        at = np.arange(self.n)
        key, width = text * (int(codes.max(initial=0)) + 1) + codes, 1
        while len(at):
            _, name, count = np.unique(key, return_inverse=True, return_counts=True)
            again = count[name] > 1
            at = at[again]
            if not len(at):
                break
            level = np.full(self.n + 1, -1, np.int32)
            level[at] = name[again]
            self.names.append(level)
            self.active.append(at)
            at = at[at + 2 * width <= ends[at]]
            at = at[level[at + width] >= 0]
            key = level[at].astype(np.int64) * (self.n + 1) + level[at + width]
            width *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are equal from i and from j on, i and j different places of one text."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.names))):
            name = self.names[k]
            same = (name[i] >= 0) & (name[i] == name[j])
            for x in (i, j, out):
                x[same] += 1 << k
        return out

    def proposals(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, period) proposed by factors of length w = 2^k, for periods from w to 2 w - 1.

        A run of such a period q starting at x repeats the factor at x at x + q. The occurrences of that factor that
        start w to 2 w - 1 words after x form one arithmetic progression. If it has two members at most, they are the
        proposals. If it has more, the factor is itself periodic with the progression's difference d, and so are the words
        around x and around the occurrences: two stretches of period d. Either q leads to the first member, or both
        stretches end q words apart.
        """
        at, width, name = self.active[k], 1 << k, self.names[k]
        key = name[at].astype(np.int64) * (self.n + 1) + at
        order = np.argsort(key)
        key, place = key[order], np.append(at[order], [self.n] * 3)
        of = np.append(name[at][order], [-1] * 3)
        near = np.searchsorted(key, name[at].astype(np.int64) * (self.n + 1) + at + width)
        member = lambda m: (of[near + m] == name[at]) & (place[near + m] < at + 2 * width)
        out = [(at[own := member(m)], place[near + m][own] - at[own]) for m in (0, 1)]
        if (many := member(2)).any():
            x, first = at[many], place[near][many]
            d = place[near + 1][many] - first
            period = first + self.common(first, first + d) - x - self.common(x, x + d)
            fits = (period >= width) & (period < 2 * width)
            out.append((x[fits], period[fits]))
        return np.concatenate([x for x, _ in out]), np.concatenate([q for _, q in out])

    def runs(self, starts: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, period) of every run, ascending; starts[i] is where the text of place i starts."""
        found = []
        for k in range(len(self.names)):
            x, q = self.proposals(k)
            opens = (x == starts[x]) | (self.codes[x - 1] != self.codes[x - 1 + q])  # nothing before extends it
            x, q = x[opens], q[opens]
            length = q + self.common(x, x + q)
            good = length >= np.maximum(min_length, 2 * q)
            found.append((x[good], length[good], q[good]))
        x, length, q = (np.concatenate([f[c] for f in found]) if found else np.empty(0, np.int64) for c in range(3))
        order = np.lexsort((q, length, x))
        x, length, q = x[order], length[order], q[order]
        # a stretch also has the multiples of its smallest period
        least = np.r_[True, (x[1:] != x[:-1]) | (length[1:] != length[:-1])] if len(x) else np.empty(0, bool)
        return x[least], length[least], q[least]


def words_of(texts: pa.Array) -> pa.ListArray:
    """The words of each text; null and blank texts have none."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    sizes = pc.if_else(pc.equal(pc.ascii_trim_whitespace(pc.fill_null(texts, "")), ""), 0, pc.list_value_length(split))
    words = split.flatten()
    offsets = pa.array(np.r_[0, np.cumsum(sizes.to_numpy(zero_copy_only=False))], pa.int32())
    return pa.ListArray.from_arrays(offsets, words.filter(pc.not_equal(words, "")))


def runs_of(words: pa.ListArray, min_length: int) -> tuple[pa.ListArray, pa.Array]:
    """(runs, collapsed text) of each text of some, given as words."""
    upto = words.offsets.to_numpy().astype(np.int64)
    upto -= upto[0]
    size, flat = np.diff(upto), words.flatten()
    coded = flat.dictionary_encode()
    text = np.repeat(np.arange(len(size)), size)
    begin, end = upto[:-1][text], upto[1:][text]
    start, length, period = BasicFactors(coded.indices.to_numpy().astype(np.int64), text, end).runs(begin, min_length)
    own = text[start]
    fields = [pa.array(v.astype(np.int64)) for v in (start - begin[start], length, period)]
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(size) + 1)), pa.int32()), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
    cover = np.bincount(start + period, minlength=len(text) + 1) - np.bincount(start + length, minlength=len(text) + 1)
    stays = np.cumsum(cover)[: len(text)] == 0
    kept = np.r_[0, np.cumsum(stays)][upto]
    return lists, pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), flat.filter(pa.array(stays))), " ")


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 12) -> DataFrame:
    """(id, n_words, runs, collapsed) of each row: runs is an array of (start, length, period) by start, then period.

    Words are separated by ASCII blanks and numbered from 0. A run is a stretch of words with smallest period q, of at
    least ``min_length`` words and two periods, that no neighbouring word extends. The collapsed text holds the words that
    no run contains after its first period, joined by one space.

    Every row is worked on by itself, whole: no shuffle, O(n log n) for n words, and some 4 log2(n) bytes a word of what
    is looked at together (``CHUNK_WORDS``, or one longer text). Levels of the dictionary keep only factors that repeat.

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Null ids, rows that repeat an id and
    equal rows are each judged alone. An empty table gives an empty result. Other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            words = words_of(batch.column(1))
            upto = words.offsets.to_numpy().astype(np.int64)
            at = 0
            while at < len(words):
                to = max(at + 1, int(np.searchsorted(upto, upto[at] + CHUNK_WORDS, side="right")) - 1)
                part = words.slice(at, to - at)
                runs, collapsed = runs_of(part, min_length)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pc.list_value_length(part).cast(pa.int64()), runs, collapsed], names=["id", "n_words", "runs", "collapsed"])
                at = to
        release_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def plant_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where 10 divides h = crc32(doc_id), the words from a on repeat the p from there; see ``op11``. Null ids: unchanged."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, trimmed_words(F.col("text"))).alias("words"))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    spots = words.select("doc_id", "text", "words", n.alias("n"), F.try_mod(g, n).cast("int").alias("a"), (3 + g % 8).alias("share"))
    left = F.col("n") - F.col("a")
    spots = spots.withColumn("p", (1 + F.floor(left / F.col("share"))).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int")))
    planted = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), left))
    return spots.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op11(docs: DataFrame) -> DataFrame:
    """Runs of the texts with planted runs: their number, the longest (ties: smallest start, then period) and digests."""
    found = find_runs(plant_runs(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.q")
    return out.select("doc_id", "n_runs", (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
