"""The pipeline stage by stage against brute force on each stage's own input."""

import zlib
from collections import Counter

import corpus_pipeline
from orbitframe.llm import langid, line_dedup, mixing
from test_operators import brute_components, check_packing


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select(*columns).collect()]
        out = stage(spark, docs, sf)
        if name != "sequences":
            assert out.columns == columns
        out = spark.createDataFrame(out.collect(), out.schema)
        after = [tuple(r) for r in out.collect()]
        ids = {r[0] for r in after}
        if name == "language":
            told = {r.doc_id: r for r in langid.predict(docs, langid.train(docs.where(~langid.in_fold(docs["doc_id"])))).collect()}
            assert ids == {i for i, r in told.items() if r.lang_pred != "und" and r.score >= 0.5} and len(ids) > 0.95 * len(before)
        elif name == "lines":
            seen = Counter(k for r in before for k in {line_dedup._key(x.encode(), 40) for x in r[1].split("\n")} if k)
            last = {k: r[0] for r in sorted(before) for k in {line_dedup._key(x.encode(), 40) for x in r[1].split("\n")} if k}
            kept = {r[0]: "\n".join(x for x in r[1].split("\n") if not ((k := line_dedup._key(x.encode(), 40)) and seen[k] >= 5 and last[k] != r[0])) for r in before}
            assert {r[0]: r[1] for r in after} == kept and all(r[4] == len(r[1]) for r in after)
        elif name == "near_copies":
            assert ids == {c for _, c, _ in brute_components([r[:2] for r in before]).values()}
        elif name == "mixture":
            copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
            assert Counter(r[0] for r in after) == Counter({i: c for i, c in copies.items() if c})
        else:
            import public_tokenizers

            check_packing([r[:2] for r in before], out.collect(), str(public_tokenizers.path("word_bpe_49k.json")))
        docs = out
    assert zlib.crc32(b"") == 0 and k == 4


def test_stages_on_odd_tables(spark, sf):
    """Empty and all-null documents, rows without an id, rows that share one, rows repeated whole."""
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    text = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    tables = {
        "empty": [],
        "nulls": [(None,) * 5] * 3 + [(1, None, None, None, None)],
        "odd": [(1, text(1), "en", "a", 1), (1, text(1), "en", "a", 1), (1, text(2), "en", "a", 1), (None, text(1), None, None, None), (None, text(3), "en", "b", 1), (None, text(3), "en", "b", 1), (5, text(2) + " more", "de", "b", 2), (6, "", "de", "b", 0), (7, text(4), "de", None, 9)],
    }
    for name, rows in tables.items():
        docs = spark.createDataFrame(rows, columns)
        for stage, run in corpus_pipeline.STAGES:
            out = run(spark, docs, sf)
            if stage == "near_copies" and name == "odd":
                assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(1, text(1)), (1, text(2)), (0, text(3)), (6, ""), (7, text(4))])
            if stage != "sequences":
                assert out.columns == [c.split()[0] for c in columns.split(", ")]
            out.count()
    assert corpus_pipeline.near_copies(spark, spark.createDataFrame([], columns), sf).count() == 0
