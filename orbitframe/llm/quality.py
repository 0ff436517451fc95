"""Quality rules as a short-circuit cascade ordered by rejection per cost (operator 4); DataFrame functions only."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, sampled, trimmed_words

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``fails`` is true for a document the rule rejects; an expression over __of_text (null text: empty), __of_words and the counts."""

    name: str
    fails: Column


def default_rules() -> list[Rule]:
    """Documents of ordinary prose pass all of these; each rejects one kind of junk."""
    words, n = F.col("__of_words"), F.col("n_words")
    return [
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 14 * n)),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("dup_lines", 10 * F.col("n_dup_lines") > 3 * F.size(F.split(F.col("__of_text"), "\n"))),
        Rule("letters", 10 * F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))) < 7 * n),
        Rule("shouting", 10 * F.size(F.filter(words, lambda w: w.endswith("!!"))) > 5 * n),
        Rule("one_word", F.size(F.array_distinct(words)) * 20 < n),
        Rule("bullets", 10 * F.size(F.filter(F.split(F.col("__of_text"), "\n"), lambda x: x.rlike(r"^[\x20\t]*[-•*]"))) > 9 * F.size(F.split(F.col("__of_text"), "\n"))),
    ]


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, window: int = 8) -> Column:
    """Words that lie in windows found twice or more. Only texts in which a window's hash occurs twice are sorted."""

    def hashes(w):
        starts = F.sequence(F.lit(0), F.size(w) - window)
        return F.when(F.size(w) >= window, F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))).otherwise(F.array().cast("array<bigint>"))

    def found_twice(r):
        twin = lambda p, j: (p["h"] == F.get(r, j + 1)["h"]) | (p["h"] == F.get(r, j - 1)["h"])
        return F.array_sort(F.transform(F.filter(r, lambda p, j: F.coalesce(twin(p, j), F.lit(False))), lambda p: p["i"]))

    def covered(s):
        own = F.transform(s, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(s, j + 1) - x, F.lit(window))))
        return F.aggregate(own, F.lit(0), lambda a, x: a + x)

    def count(h):
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ranked, lambda r: let(found_twice(r), covered)))

    return let(let(words, hashes), count).cast("long")


def base_counts(docs: DataFrame, text_col: str = "text", window: int = 8) -> DataFrame:
    """docs with __of_words and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; each text in its own row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("__of_text", text).withColumn("__of_words", trimmed_words(F.col(text_col)))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0)
    return df.withColumns({
        "n_words": F.size("__of_words").cast("long"),
        "word_chars": F.length(F.array_join("__of_words", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(F.col("__of_words"), window),
    })


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def calibrate(sample: DataFrame, rules: list[Rule]) -> list[tuple[str, float, float]]:
    """(name, seconds, share rejected) of each rule, timed alone over the sample, dearest use of time last.

    The order is by rejection per cost, the best first; ties by name. It changes what is evaluated, never a verdict.
    """
    def timed(*what: Column) -> tuple[float, list[int]]:
        took = time.perf_counter()
        row = sample.agg(F.count("*"), *what).first()
        return time.perf_counter() - took, [x or 0 for x in row]

    timed()  # fills the cache and compiles
    idle, (n,) = min(timed() for _ in range(2))
    found = []
    for rule in rules:
        s, (_, rejected) = min(timed(F.count_if(rule.fails)) for _ in range(2))
        found.append((rule.name, max(s - idle, 1e-4), rejected / max(n, 1)))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0]))


def cascade(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 1000, text_col: str = "text", id_col: str = "doc_id", order: list[str] | None = None) -> DataFrame:
    """docs with the base counts, base_failed, kept and rejected_by (the first rule of the cascade that rejects, else null).

    On about ``sample_rows`` rows (chosen by a hash of id and text over the whole table, copies of a row once) each rule's cost and selectivity are
    measured; then all rows run through one CASE expression in the order of rejection per cost, whose later branches are not
    evaluated once one rejects. ``order`` fixes the order instead, without a sample.

    Null and empty texts have no words and fail the base test; repeated rows are judged alike; an empty table gives an
    empty result. Columns starting with ``__of_`` are reserved.
    """
    rules = default_rules() if rules is None else rules
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("rule names must differ")
    df = base_counts(docs, text_col)
    if order is None and rules:
        step = max(1, docs.count() // sample_rows)
        picked = base_counts(sampled(docs, 4, id_col, text_col, step), text_col).persist()
        order = [name for name, _, _ in calibrate(picked.where(~base_failed()), rules)]
        picked.unpersist()
    by_name = {r.name: r.fails for r in rules}
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for name in order or []:
        verdict = verdict.when(F.coalesce(by_name[name], F.lit(False)), F.lit(name))
    df = df.withColumn("base_failed", base_failed()).withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull())
    own = [c for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")]
    return df.select(*[c for c in docs.columns if c not in own], *own)


def op4(docs: DataFrame) -> DataFrame:
    return cascade(docs.select("doc_id", "text")).drop("text")
