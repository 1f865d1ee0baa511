"""The registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flightlens.llm import (chat_format, decontamination, html_extract, lexical_rank, license_scan, merkle, packing,
                            quality, simhash_dedup, substring_dedup, token_counts, url_filter, warc)
from flightlens.llm.runtime import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.digest(simhash_dedup.near_duplicates(table(spark, sf_dir, "documents")))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.control_case(table(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.format_chat(rows))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.digest(url_filter.judge(pages, url_filter.label_by_words(pages)))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judge(table(spark, sf_dir, "documents")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.round_trip(table(spark, sf_dir, "pages")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(merkle.prove_all(table(spark, sf_dir, "documents")))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan_licenses(table(spark, sf_dir, "documents")))


def op13_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_rank.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_packing, op3_simhash_dedup, op4_chat_format, op5_url_filter, op6_quality_rules,
    op7_decontamination, op8_token_counts, op9_html_extract, op10_warc, op11_merkle_manifest, op12_license_scan,
    op13_lexical_rank)}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"'[^\x20\x09-\x0D]+'"
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

ORACLE_SQL = {
    "op1_substring_dedup": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
spot AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM spot),
least_doc AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
hit AS (SELECT win.doc_id, win.i FROM win JOIN least_doc USING (k) WHERE m < win.doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, range(50) AS r(j)),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
         FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op4_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, 4 + length(role) + 2 + length(text) + 8
        + (length(text) - length(replace(text, '\', '')))
        + (length(text) - length(regexp_replace(text, '#{3,}', '', 'g')))
        + (length(text) - length(replace(text, '</turn>', ''))) // 7
        + (length(text) - length(replace(text, '<|', ''))) // 2 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id""",
    "op6_quality_rules": f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
line AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
                unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
full_line AS (SELECT *, array_to_string(regexp_extract_all(translate(line, {_AZ}), {_WORD}), ' ') AS norm,
                     len(regexp_extract_all(line, {_WORD})) AS n,
                     row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth
              FROM line WHERE len(regexp_extract_all(line, {_WORD})) > 0),
dup AS (SELECT doc_id, count(*) AS n FROM full_line WHERE nth > 1 GROUP BY doc_id),
often AS (SELECT source, norm FROM full_line GROUP BY ALL HAVING count(DISTINCT text) > {quality.LINE_LIMIT}),
removed AS (SELECT doc_id, sum(n) AS n FROM full_line SEMI JOIN often USING (source, norm) GROUP BY doc_id),
spot AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM spot),
twice AS (SELECT doc_id, k FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM win SEMI JOIN twice USING (doc_id, k), range(8) AS r(j) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             coalesce(removed.n, 0)::BIGINT AS n_removed
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN removed USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - n_removed >= {quality.MIN_WORDS}
         AND 100 * (n_words - n_removed) >= {quality.LEFT_PERCENT} * n_words AS kept
FROM b""",
    "op7_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
           FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item,
             regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bi AS (SELECT item, ws, least(len(ws), 13) AS size, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0),
test AS (SELECT DISTINCT item, size, array_to_string(ws[i:i + size - 1], ' ') AS k FROM bi),
size AS (SELECT DISTINCT size FROM test),
di AS (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, size),
win AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS k FROM di),
hit AS (SELECT win.*, item FROM win JOIN test USING (size, k)),
word AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT DISTINCT doc_id, size, i FROM hit), range(13) AS r(j)
         WHERE j < size GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(word.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(word.n, 0) > 0 AND 20 * coalesce(word.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS largest, unhex(hex)::BIT::VARCHAR AS bits FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
           + 16 * substr(bits, 5 * i::INT + 1, 1)::INT + 8 * substr(bits, 5 * i::INT + 2, 1)::INT
           + 4 * substr(bits, 5 * i::INT + 3, 1)::INT + 2 * substr(bits, 5 * i::INT + 4, 1)::INT
           + substr(bits, 5 * i::INT + 5, 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN largest IS NOT NULL AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN largest IS NOT NULL AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM m""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE c AS (
  SELECT doc_id, lang, source, n_chars, text,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                             lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))) AS reg
  FROM documents),
f AS (SELECT doc_id, lang, n_chars, reg,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
          || coalesce(strlen(lang) || ':' || lang, '-') AS front,
        coalesce(strlen(text) || ':' || text, '-') AS back FROM c),
g AS (SELECT doc_id, lang, sha256(front || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || back) AS leaf,
        CASE WHEN xor(reg, 4294967295) % {merkle.TAMPER} = 0 AND n_chars IS NOT NULL
             THEN sha256(front || strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1) || back) END AS altered
      FROM f),
d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot,
        count(*) OVER (PARTITION BY lang) AS n FROM g),
node AS (SELECT lang, n AS width, 0 AS level, spot, leaf AS h FROM d
         UNION ALL
         SELECT lang, (width + 1) // 2, level + 1, spot // 2, sha256(string_agg(h, '' ORDER BY spot))
         FROM node WHERE width > 1 GROUP BY lang, width, level, spot // 2),
sub AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS spot, count(*) OVER () AS n
        FROM node WHERE width = 1),
high AS (SELECT n AS width, 0 AS level, spot, subroot AS h FROM sub
         UNION ALL
         SELECT (width + 1) // 2, level + 1, spot // 2, sha256(string_agg(h, '' ORDER BY spot))
         FROM high WHERE width > 1 GROUP BY width, level, spot // 2),
own AS (SELECT d.lang, d.spot, string_agg(s.h, '' ORDER BY s.level) AS steps
        FROM d, range(40) AS k(level) JOIN node s
          ON s.lang IS NOT DISTINCT FROM d.lang AND s.level = k.level AND s.spot = xor(d.spot >> k.level::INT, 1) GROUP BY ALL),
over_it AS (SELECT sub.lang, string_agg(s.h, '' ORDER BY s.level) AS steps
            FROM sub, range(40) AS k(level) JOIN high s ON s.level = k.level AND s.spot = xor(sub.spot >> k.level::INT, 1) GROUP BY ALL),
fold AS (SELECT lang, spot, n AS width, 0 AS level, spot AS j, coalesce(altered, leaf) AS h FROM d
         UNION ALL
         SELECT f.lang, f.spot, (width + 1) // 2, f.level + 1, f.j // 2,
                sha256(CASE WHEN f.j % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END)
         FROM fold f LEFT JOIN (SELECT lang, level, spot, h FROM node) s
           ON s.lang IS NOT DISTINCT FROM f.lang AND s.level = f.level AND s.spot = xor(f.j, 1) WHERE width > 1),
fold_high AS (SELECT f.lang, f.spot, sub.n AS width, 0 AS level, sub.spot AS j, f.h
              FROM fold f JOIN sub ON sub.lang IS NOT DISTINCT FROM f.lang WHERE f.width = 1
              UNION ALL
              SELECT f.lang, f.spot, (width + 1) // 2, f.level + 1, f.j // 2,
                     sha256(CASE WHEN f.j % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END)
              FROM fold_high f LEFT JOIN (SELECT level, spot, h FROM high) s ON s.level = f.level AND s.spot = xor(f.j, 1)
              WHERE width > 1)
SELECT d.doc_id, d.leaf, sub.subroot, r.h AS root, sha256(coalesce(own.steps, '') || coalesce(over_it.steps, '')) AS proof_sha256,
       e.h AS folded_root, e.h = r.h AS verified
FROM d JOIN sub ON sub.lang IS NOT DISTINCT FROM d.lang
JOIN (SELECT h FROM high WHERE width = 1) r ON true
JOIN fold_high e ON e.width = 1 AND e.lang IS NOT DISTINCT FROM d.lang AND e.spot = d.spot
LEFT JOIN own ON own.lang IS NOT DISTINCT FROM d.lang AND own.spot = d.spot
LEFT JOIN over_it ON over_it.lang IS NOT DISTINCT FROM d.lang""",
    "op13_lexical_rank": f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, {_AZ}), {_TERM})) AS term
           FROM documents),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
len AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM len),
want AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {_AZ}), {_TERM})) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs),
s AS (SELECT item_id, r, doc_id,
             sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // length))))::BIGINT AS score
      FROM want JOIN tf USING (term) JOIN w USING (term) JOIN len USING (r), total GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= {lexical_rank.TOP}""",
}
