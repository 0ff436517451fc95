"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .common import table
from .jaccard_join import op5
from .langid import op6
from .line_dedup import op1
from .merkle import op13
from .mixing import op10
from .packing import op7
from .periodic_runs import op11
from .permutation_index import op8
from .quality import op4
from .secrets import op9
from .token_files import op12
from .url_filter import op3
from .warc import op2

QUERIES = {
    "op1_line_dedup": lambda spark, d: op1(table(spark, d, "documents")),
    "op2_warc": lambda spark, d: op2(table(spark, d, "pages")),
    "op3_url_filter": lambda spark, d: op3(table(spark, d, "pages")),
    "op4_quality_cascade": lambda spark, d: op4(table(spark, d, "documents")).drop("rejected_by"),
    "op5_jaccard_join": lambda spark, d: op5(table(spark, d, "documents")),
    "op6_language_id": lambda spark, d: op6(table(spark, d, "documents")),
    "op7_packing": lambda spark, d: op7(table(spark, d, "documents")),
    "op8_permutation_index": lambda spark, d: op8(table(spark, d, "embeddings")),
    "op9_secret_scan": lambda spark, d: op9(table(spark, d, "documents")),
    "op10_mixing": lambda spark, d: op10(table(spark, d, "documents")),
    "op11_periodic_runs": lambda spark, d: op11(table(spark, d, "documents")),
    "op12_token_files": lambda spark, d: op12(table(spark, d, "documents")),
    "op13_merkle_manifest": lambda spark, d: op13(table(spark, d, "documents")),
}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(('0x' || substr(x, {5 * i + 1}, 5)) AS INT) // {32**k} % 32, 1)" for i in range(8) for k in (3, 2, 1, 0))
_HOST = f"translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {_LOWER})"
_RULES = (("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("net", "/", "block"))


def _case(result: str) -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    return "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{result.format(rule=h + p, action=a)}'" for h, p, a in _RULES) + " END"


def _climb(made: str, depth: int) -> str:
    """Tables made0 .. of nodes (g, i, h, c) by level, from made0 on, and of their runs: maderun0 .. (g, j, a)."""
    return ", ".join(
        f"""{made}run{k} AS (SELECT g, i // 16 AS j, list(h ORDER BY i) AS a, (any_value(c) + 15) // 16 AS c FROM {made}{k} WHERE c > 1 GROUP BY g, i // 16),
        {made}{k + 1} AS (SELECT g, j AS i, sha256(array_to_string(a, '')) AS h, c FROM {made}run{k} UNION ALL SELECT * FROM {made}{k} WHERE c = 1)"""
        for k in range(depth)
    )


def _fold(table: str, made: str, place: str, depth: int) -> str:
    """Tables table1 .. from table0 on (x: the digest so far, p: the proof so far), a level each."""
    return ", ".join(
        f"""{table}{k + 1} AS (SELECT f.* EXCLUDE (x, p, q), CASE WHEN a IS NULL THEN x ELSE sha256(array_to_string(a[1:q], '') || x || array_to_string(a[q + 2:], '')) END AS x,
            CASE WHEN a IS NULL THEN p ELSE p || array_to_string(a[1:q], '') || array_to_string(a[q + 2:], '') END AS p
        FROM (SELECT *, {place} // {16**k} % 16 AS q FROM {table}{k}) f LEFT JOIN {made}run{k} r ON f.{made}_g = r.g AND f.{place} // {16 ** (k + 1)} = r.j)"""
        for k in range(depth)
    )


#: CRC-32 of the decimal digits of doc_id, bit by bit: -1 in the list stands for one shift.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda x: list_concat([ascii(x)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""
_FIELDS = ("doc_id", "source", "lang", "n_chars")
_field = lambda x: f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
_leaf = lambda text: "sha256(" + " || ".join(map(_field, (*_FIELDS, text))) + ")"
#: Levels that the SQL climbs: 16^6 documents a source, 16^4 sources.
_DEEP, _WIDE = 6, 4

ORACLE_SQL = {
    "op1_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
        l AS (SELECT doc_id, i, a[i] AS line, translate(trim(a[i], {_BLANKS}), {_LOWER}) AS k FROM d, unnest(range(1, len(a) + 1)) t(i)),
        f AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        r AS (SELECT doc_id, i, line, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM l LEFT JOIN f USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM r GROUP BY doc_id""",
    "op2_warc": f"""
        WITH s AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x FROM pages),
        f AS (SELECT x, min(page_id) AS first FROM s GROUP BY x)
        SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM s JOIN f USING (x)""",
    # pages that declare no canonical link or refresh, as here, have only spellings of one address as aliases
    "op3_url_filter": f"""
        WITH u AS (SELECT page_id, coalesce({_HOST}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
            regexp_replace(regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1), '([?&])(utm_[a-z]+|fbclid|gclid)=[^&]*', '\\1', 'g') AS rest,
            contains(url, '://') AS known FROM pages),
        m AS (SELECT page_id, host, path, {_case("{rule}")} AS rule, {_case("{action}")} AS action,
            CASE WHEN known THEN regexp_replace(host, '^www\\.', '') || regexp_replace(regexp_replace(rest, '([?&])&+', '\\1', 'g'), '[?&/]+$', '') END AS node FROM u),
        c AS (SELECT node, bool_or(action = 'allow') AS a, bool_or(action = 'block') AS b FROM m WHERE node IS NOT NULL GROUP BY node)
        SELECT page_id, host, path, rule, coalesce(action, CASE WHEN a THEN 'allow' WHEN b THEN 'block' END, 'allow') AS verdict
        FROM m LEFT JOIN c USING (node)""",
    "op4_quality_cascade": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
            list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
        g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM w, unnest(range(1, len(ws) - 6)) q(i)),
        r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
        n AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, unnest(range(8)) q(k) GROUP BY doc_id),
        b AS (SELECT w.doc_id, t, ws, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
            CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
            CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN n USING (doc_id)),
        f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_symbols > n_words
                OR 10 * n_dup_lines > 3 * len(string_split(t, chr(10)))
                OR 10 * len(list_filter(ws, lambda x: regexp_matches(x, '\pL'))) < 7 * n_words
                OR 10 * len(list_filter(ws, lambda x: ends_with(x, '!!'))) > 5 * n_words
                OR 20 * len(list_distinct(ws)) < n_words
                OR 10 * len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[ \t]*[-•*]'))) > 9 * len(string_split(t, chr(10)))) AS kept
        FROM f""",
    "op13_merkle_manifest": f"""
        WITH b AS (SELECT doc_id, coalesce('s' || source, '') AS s_g, {_leaf("text")} AS leaf,
            CASE WHEN {_CRC} % 5 = 0 THEN {_leaf(f"translate(text, {_LOWER})")} END AS told FROM documents),
        f0 AS (SELECT *, row_number() OVER (PARTITION BY s_g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, coalesce(told, leaf) AS x, '' AS p FROM b),
        s0 AS (SELECT s_g AS g, i, leaf AS h, count(*) OVER (PARTITION BY s_g) AS c FROM f0),
        {_climb("s", _DEEP)},
        {_fold("f", "s", "i", _DEEP)},
        t0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS c FROM s{_DEEP}),
        {_climb("t", _WIDE)},
        e0 AS (SELECT f.*, 0 AS t_g, row_number, h AS subroot FROM f{_DEEP} f JOIN (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS row_number FROM s{_DEEP}) o ON s_g = o.g),
        {_fold("e", "t", "row_number", _WIDE)}
        SELECT doc_id, leaf, subroot, h AS root, sha256(p) AS proof_sha256, x AS folded_root, x = h AS verified FROM e{_WIDE}, t{_WIDE}""",
}
