"""Language ID: multinomial naive Bayes over hashed character n-grams (operator 6)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release_memory, sampled, small_batches

BITS = 16
ORDERS = 3
#: Characters scored at once.
CHUNK = 1 << 18


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: is it a letter, and what n-grams see of it (lower case; 32 for all but letters)."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    seen = np.full(0x110000, 32, np.uint32)
    for i in np.flatnonzero(letter):
        low = chr(i).lower()
        seen[i] = ord(low) if len(low) == 1 else i
    return letter, seen


def _features(codes: np.ndarray) -> list[np.ndarray]:
    """Hashed n-grams of each order that start at each character; codes end with ORDERS - 1 blanks."""
    out, n = [], len(codes) - ORDERS + 1
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), np.uint64)
        for k in range(ORDERS):
            h[:n] = (h[:n] + codes[k : n + k].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h[:n] ^= h[:n] >> np.uint64(29)
            out.append(((h[:n] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int32))
    return out


def _pieces(texts):
    """(row, codes) of each text, cut into chunks that overlap so that every n-gram lies in one."""
    _, seen = _tables()
    pad = np.full(ORDERS - 1, 32, np.uint32)
    for row, text in enumerate(texts):
        if text:
            codes = np.concatenate([seen[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")], pad])
            for at in range(0, len(codes) - ORDERS + 1, CHUNK):
                yield row, codes[at : at + CHUNK + ORDERS - 1]


def _group(pieces):
    """Pieces joined to about CHUNK characters: ([row], [codes])."""
    rows, held, n = [], [], 0
    for row, codes in pieces:
        rows.append(row)
        held.append(codes)
        n += len(codes)
        if n >= CHUNK:
            yield rows, held
            rows, held, n = [], [], 0
    if rows:
        yield rows, held


def _score(texts: list[str | None], logp: np.ndarray) -> np.ndarray:
    """Sum of the log probabilities of each text's n-grams, by language: counts times matrix, sparse, a chunk at a time."""
    out = np.zeros((len(texts), logp.shape[1]))
    for rows, held in _group(_pieces(texts)):
        starts = np.cumsum([0, *map(len, held[:-1])])
        for ids in _features(np.concatenate(held)):
            np.add.at(out, rows, np.add.reduceat(logp[ids], np.minimum(starts, len(ids) - 1), axis=0, dtype=np.float64))
    return out


def in_fold(id_col: Column, folds: int = 5) -> Column:
    """True for the held-out fold: crc32 of the id as text is divisible by ``folds``; null ids are held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 1500, max_langs: int = 500, alpha: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log probabilities [2^16, languages]) learnt from labelled documents.

    About ``docs_per_lang`` documents of each language are used, chosen by a hash of id and text, rows equal in both once: a bounded sample. Each task
    streams its texts into count arrays, so long texts cost no memory. Null labels and null texts teach nothing.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    counted = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").take(max_langs + 1)
    if len(counted) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs = sorted(r["lang"] for r in counted)
    if not langs:
        return [], np.zeros(0), np.zeros((1 << BITS, 0))
    total = {r["lang"]: r["count"] for r in counted}
    step = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(max(1, total[lang] // docs_per_lang)))])
    sample = sampled(known, 6, "id", "text", F.element_at(step, F.col("lang"))).select("lang", "text")

    def count(batches):
        now, counts = None, None

        def row():
            return pa.RecordBatch.from_pydict({"lang": [now], "counts": [counts.astype("<i8").tobytes()]})

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(names)):
                if lang != now:
                    if now is not None:
                        yield row()
                    now, counts = lang, np.zeros(1 << BITS, np.int64)
                for _, held in _group(_pieces([t for t, x in zip(texts, names, strict=True) if x == lang])):
                    for ids in _features(np.concatenate(held)):
                        counts += np.bincount(ids, minlength=1 << BITS)
        if now is not None:
            yield row()

    parts = sample.repartition("lang").sortWithinPartitions("lang").mapInArrow(count, "lang string, counts binary").collect()
    grid = np.zeros((1 << BITS, len(langs)))
    for r in parts:
        grid[:, langs.index(r["lang"])] += np.frombuffer(r["counts"], "<i8")
    logp = np.log(grid + alpha) - np.log(grid.sum(axis=0) + alpha * (1 << BITS))
    prior = np.log(np.array([total[x] for x in langs], float) / sum(total.values()))
    return langs, prior, logp.astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (the posterior probability of lang_pred).

    The matrix has 2^16 rows and one column for each of at most a few hundred languages, so its broadcast is bounded.
    Null text and text without a letter: ``und`` with score 0; so is everything when the model knows no language.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches):
        langs, prior, logp = shared.value
        letter, _ = _tables()
        for batch in batches:
            at = batch.schema.names.index(text_col)
            preds, scores = [], []
            for from_ in range(0, batch.num_rows, 512):
                texts = batch.column(at).slice(from_, 512).to_pylist()
                total = _score(texts, logp) + prior
                for text, row in zip(texts, total, strict=True):
                    if not langs or not text or not letter[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any():
                        preds.append("und")
                        scores.append(0.0)
                    else:
                        best = int(np.argmax(row))
                        preds.append(langs[best])
                        scores.append(float(min(1.0, 1 / np.exp(row - row[best]).sum())))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(c)) for c in keep], pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])
        release_memory()

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double"
    return docs.select(*keep).mapInArrow(run, schema)


def op6(docs: DataFrame) -> DataFrame:
    model = train(docs.where(~in_fold(F.col("doc_id"))))
    return predict(docs.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
