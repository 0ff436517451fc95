"""Periodic runs, files of token ids and the Merkle manifest against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from orbitframe.llm import merkle, periodic_runs, queries, token_files
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string"
LONG = " ".join(f"w{i % 7000}" for i in range(30_000))
ODD = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, None), (3, " \n\t ", "en", "a", 3, "y"), (4, LONG, "en", "b", 1, "z"), (4, LONG, "en", "b", 1, "z"), (4, "OTHER text", "en", "b", 1, "z"), (None, "one two three four five six", "de", None, 1, "q"), (None, "A b " * 40, "de", "b", 1, "q"), (6, "One two THREE\nfour five six", None, "b", 1, "q"), (7, "12 34 !! ÀÉ", "fr", "", 1, "q"), (10, "a b c d " * 30, "fr", "b", 1, "q")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 11 -----------------------------------------------------------------------------------------------------------------
def plain_runs(ws, least=12):
    found = {}
    for q in range(1, len(ws) // 2 + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(ws, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def periodic_texts(seed, many):
    rng, out = random.Random(seed), []
    for _ in range(many):
        n, k = rng.choice([0, 1, 5, 12, 13, 24, 60, 150, 300]), rng.choice([1, 2, 3, 5])
        ws = [rng.choice("abcde"[:k]) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + rng.randrange(n - a)
            ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
        for _ in range(rng.choice([0, 0, 1, 3]) if n else 0):
            ws[rng.randrange(n)] = "z"
        out.append(" ".join(ws))
    for _ in range(many // 8):  # runs in runs
        s = "ab"
        while len(s) < 250:
            s = s * rng.choice([1, 2, 3]) + rng.choice(["", "a", "b", "aab"]) + (s if rng.random() < 0.4 else "")
        out.append(" ".join(s[:350]))
    a, b = "a", "ab"
    while len(b) < 400:
        a, b = b, b + a
    return [*out, " ".join(b[:400]), " ".join("01"[bin(i).count("1") & 1] for i in range(300)), "a " * 100 + "b " + "a " * 100 + "b " + "a " * 90]


@pytest.mark.parametrize("least", [12, 2])
def test_runs_equal_brute_force(least):
    texts = periodic_texts(3, 800)
    lists, texts_left = periodic_runs.runs_of(periodic_runs.words_of(pa.array(texts)), least)
    total = 0
    for text, got, left in zip(texts, lists.to_pylist(), texts_left.to_pylist(), strict=True):
        want = plain_runs(text.split(), least)
        assert [(r["start"], r["length"], r["period"]) for r in got] == want
        assert left == collapsed(text.split(), want)
        total += len(want)
    assert total > 1000


def test_words_are_separated_by_ascii_blanks():
    rng, marks = random.Random(1), "".join(map(chr, range(300))) + " 　" + " \t\n\v\f\r" * 30
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(12))) for _ in range(2000)]
    assert periodic_runs.words_of(pa.array([*texts, None])).to_pylist() == [*map(words, texts), []]


def test_long_text_takes_time_in_proportion():
    """A period of three words, two million words: levels halve, nothing is compared pair by pair."""
    n = 300_000
    lists, left = periodic_runs.runs_of(periodic_runs.words_of(pa.array(["x y z " * n])), 12)
    assert lists.to_pylist() == [[{"start": 0, "length": 3 * n, "period": 3}]] and left.to_pylist() == ["x y z"]


def op11_brute(rows):
    out = []
    for doc, text in rows:
        ws = words(text)
        n, h = len(ws), None if doc is None else zlib.crc32(str(doc).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(ws)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(collapsed(ws, runs))))
    return out


OP11 = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_op11_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where(F.length("text") < 6000)
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(periodic_texts(5, 300))], "doc_id long, text string")
    docs = docs.unionByName(extra)
    got = sorted((tuple(r) for r in periodic_runs.op11(docs).select(*OP11).collect()), key=repr)
    assert got == sorted(op11_brute([tuple(r) for r in docs.collect()]), key=repr)
    assert sum(r[1] for r in got) > 100


def test_op11_edges(spark):
    odd = [r for r in ODD if r[1] != LONG]
    got = periodic_runs.op11(spark.createDataFrame(odd, DOCS))
    assert tuple(got.columns) == OP11
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(op11_brute([r[:2] for r in odd]), key=repr)
    assert periodic_runs.op11(spark.createDataFrame([], DOCS)).count() == 0
    found = {r.doc_id: r for r in periodic_runs.find_runs(spark.createDataFrame(ODD, DOCS).where("doc_id IN (1, 4, 10)")).collect()}
    assert found[1].n_words == 0 and found[1].runs == [] and found[1].collapsed == ""
    assert found[10].collapsed == "a b c d"


def test_long_texts_in_the_query(spark):
    got = periodic_runs.op11(spark.createDataFrame([(4, LONG), (4, LONG)], "doc_id long, text string")).collect()
    assert [tuple(r)[1:5] for r in got] == [(1, 0, 30_000, 7000)] * 2 or zlib.crc32(b"4") % 10 == 0


# 12 -----------------------------------------------------------------------------------------------------------------
def test_numbers_round_trip():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        for top in (1, 256, 257, 65_536, 1 << 24, 1 << 32):
            values = rng.integers(0, top, n, np.uint64).astype(np.uint32)
            control, data = token_files.pack_numbers(values)
            assert (token_files.unpack_numbers(control, data, n) == values).all() and len(control) == -(-n // 4)
    control, data = token_files.pack_numbers(np.array([1, 300]))
    assert (control, data) == (b"\x04", b"\x01\x2c\x01")
    with pytest.raises(ValueError, match="damaged"):
        token_files.unpack_numbers(control, data + b"\x00", 2)


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    return path, Tokenizer.from_file(path)


def test_op12_equals_the_tokenizer(spark, sf, vocabulary):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start, want = 0, []
    for r in docs.orderBy("doc_id").collect():
        ids = [*vocabulary[1].encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = queries.QUERIES["op12_token_files"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_token_files(spark, vocabulary, monkeypatch):
    """Many files, small blocks and small texts; ranks by frequency; nulls, repeated ids and repeated rows."""
    monkeypatch.setattr(token_files, "BLOCK", 64)
    docs = spark.createDataFrame(ODD, DOCS)
    folder = token_files.write_tokens(docs, vocabulary[0], files=5)
    plain = [(r[0], [*vocabulary[1].encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in ODD]
    got = token_files.read_tokens(spark, folder).orderBy("start").collect()
    assert Counter((r.id, tuple(r.tokens)) for r in got) == Counter((d, tuple(ids)) for d, ids in plain)
    assert [r.id is not None for r in got] == sorted(r.id is not None for r in got)
    known = [r.id for r in got if r.id is not None]
    assert known == sorted(known)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    ranks = {r.token: r.rank for r in spark.read.parquet(f"{folder}/ranks").collect()}
    counts = Counter(t for _, ids in plain for t in ids)
    assert ranks == {t: k for k, (t, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])))}
    manifest = spark.read.parquet(f"{folder}/manifest").orderBy("nth").collect()
    assert sum(m.documents for m in manifest) == len(ODD) and sum(m.ids for m in manifest) == sum(counts.values())
    again = token_files.read_tokens(spark, token_files.write_tokens(docs.repartition(3), vocabulary[0])).orderBy("start").collect()
    assert again == got
    path = manifest[-1].path
    with open(path, "r+b") as f:
        f.seek(40)
        old = f.read(1)
        f.seek(40)
        f.write(bytes([old[0] ^ 1]))
    with pytest.raises(Exception, match="damaged block"):
        token_files.read_tokens(spark, folder).collect()


def test_token_files_of_nothing(spark):
    assert token_files.op12(spark.createDataFrame([], DOCS)).count() == 0


def test_equal_ids_are_spread_over_files(spark, vocabulary):
    docs = spark.range(400).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same words").alias("text"))
    folder = token_files.write_tokens(docs, vocabulary[0], files=4)
    assert max(m.documents for m in spark.read.parquet(f"{folder}/manifest").collect()) < 300


# 13 -----------------------------------------------------------------------------------------------------------------
def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """(root, steps of each leaf)."""
    steps, row, span = [[] for _ in leaves], list(leaves), 1
    while len(row) > 1:
        for i in range(len(leaves)):
            k = i // span
            first = k // 16 * 16
            steps[i].append((row[first:k], row[k + 1 : first + 16]))
        row, span = [H(row[i : i + 16]) for i in range(0, len(row), 16)], span * 16
    return row[0], steps


def op13_brute(rows):
    def leaf(r, low):
        text = r["text"]
        if low and text is not None:
            text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
        return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)

    by = defaultdict(list)
    for r in rows:
        low = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        by[r["source"]].append(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, False)), r["doc_id"], leaf(r, False), leaf(r, low)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by[s])]) for s in order}
    root, above = plain_tree([trees[s][0] for s in order]) if order else ("", [])
    out = []
    for s, top in zip(order, above, strict=True):
        for (_, doc, own, told), steps in zip(sorted(by[s]), trees[s][1], strict=True):
            steps, x = [*steps, *top], told
            for left, right in steps:
                x = H([*left, x, *right])
            out.append((doc, own, trees[s][0], root, H(d for left, right in steps for d in (*left, *right)), x, x == root))
    return out


OP13 = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def check_manifest(docs):
    got = merkle.op13(docs)
    assert tuple(got.columns) == OP13
    want = op13_brute([r.asDict() for r in docs.collect()])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    return want


def test_manifest_edges(spark):
    check_manifest(spark.createDataFrame(ODD, DOCS))
    check_manifest(spark.createDataFrame(ODD[:1], DOCS))
    assert merkle.op13(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_of_many_sweeps(spark, levels, monkeypatch):
    """One source holds most rows, others 1, 16, 17, 256 and 257, and 300 sources have one row; one-level sweeps make many."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 16**levels)
    sizes = {"big": 4500 if levels == 3 else 700, "a": 1, "b": 16, "c": 17, "d": 256, "e": 257, None: 3, **{f"s{i}": 1 for i in range(300)}}
    rows = [(k, f"Text {k}", "en", s, k, None) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    random.Random(2).shuffle(rows)
    want = check_manifest(spark.createDataFrame(rows, DOCS).repartition(7))
    assert 0.1 < sum(not w[-1] for w in want) / len(want) < 0.3


def test_manifest_proofs(spark):
    """The packed proof leads from the leaf to the root and no other digest does."""
    rows = [(k, f"t{k}", None, "ab"[k % 3 == 0], k, None) for k in range(600)]
    out = merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()
    for r in out[:50]:
        assert merkle.fold(bytes.fromhex(r.leaf), r.proof).hex() == r.root == r.folded_root
        assert merkle.proof_digest(r.proof).hex() == r.proof_sha256
        assert merkle.fold(bytes(32), r.proof).hex() != r.root
