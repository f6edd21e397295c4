"""The queries of the text operators and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitledger.llm import (
    conversations, decontamination, html_text, language, line_dedup, packing, pieces, quality, ranked_search, sharding, simhash, token_counts, toxicity,
)
from hitledger.llm.texts import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return put


@query(
    "op4_line_dedup",
    """
    WITH line AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents
    ), keyed AS (
        SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM line
    ), common AS (
        SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
    ), marked AS (
        SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
    )
    SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = line_dedup.drop_common_lines(docs, counts=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query(
    "op7_quality_cascade",
    r"""
    WITH doc AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
    ), word AS (
        SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM doc
    ), win AS (
        SELECT doc_id, i, w, list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS ww,
               lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM word
    ), rep AS (
        SELECT *, (len(ww) = 8 AND count(*) OVER (PARTITION BY doc_id, ww) > 1) AS again FROM win
    ), cover AS (
        SELECT *, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), false) AS inside
        FROM rep
    ), words AS (
        SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (inside) AS n_repeat_words,
               count(*) FILTER (regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]')) AS n_alpha,
               count(*) FILTER (regexp_matches(w, '[A-Z].*[A-Z]') AND NOT regexp_matches(w, '[a-z]')) AS n_caps,
               count(*) FILTER (w = before) AS n_stutter
        FROM cover GROUP BY doc_id
    ), line AS (
        SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM doc
    ), lines AS (
        SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
        FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
    ), base AS (
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
               CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
               coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
               coalesce(n_lines, 0) AS n_lines, coalesce(n_alpha, 0) AS n_alpha, coalesce(n_caps, 0) AS n_caps,
               coalesce(n_stutter, 0) AS n_stutter
        FROM doc d LEFT JOIN words USING (doc_id) LEFT JOIN lines USING (doc_id)
    ), judged AS (
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words
                OR 10 * n_dup_lines > 5 * n_lines OR 10 * n_alpha < 7 * n_words OR 10 * n_caps > 3 * n_words
                OR 10 * n_stutter > 3 * n_words) AS kept
    FROM judged
    """,
)
def op7_quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.assess(docs).drop("text")


def language_model(documents: DataFrame) -> language.LanguageModel:
    return language.fit(documents, F.coalesce(remainder(F.col("doc_id"), 4) != 2, F.lit(False)))


@query("op10_language_id")
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    found = language.predict(documents.select("doc_id", "text"), language_model(documents))
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query("op9_simhash")
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.cluster(table(spark, folder, "documents").select("doc_id", "text"))


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    return decontamination.find_items(docs, items)


@query("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    encoded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), check=True)
    return encoded.select("doc_id", "n_tokens", "token_ids", "round_trip")


@query(
    "op2_sharding",
    """
    WITH doc AS (
        SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
               CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS address
        FROM documents
    ), prefix AS (
        SELECT doc_id, n_bytes, d, address >> (60 - d) AS p FROM doc, (SELECT unnest(range(0, 61)) AS d)
    ), bucket AS (
        SELECT *, sum(n_bytes) OVER b AS bytes, count(*) OVER b AS n FROM prefix WINDOW b AS (PARTITION BY d, p)
    ), fits AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS nth FROM bucket WHERE bytes <= 1048576 OR n = 1
    )
    SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(p), CAST(d AS INTEGER), '0') END AS shard,
           CAST(bytes AS BIGINT) AS shard_bytes
    FROM fits WHERE nth = 1
    """,
)
def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    return sharding.assign(sized, size=F.col("n_bytes"), shard_bytes=sharding.SHARD_BYTES)


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    third = remainder(F.col("id"), 3)
    model = toxicity.fit(docs, table(spark, folder, "labels"), third == 0, third == 2)
    scored = toxicity.score(docs, model)
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"))


@query(
    "op5_html_extraction",
    """
    WITH page AS (
        SELECT page_id, url, string_split(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1),
               '</?(?:p|h1)>', chr(1), 'g'), chr(1)) AS blocks
        FROM pages
    ), block AS (
        SELECT page_id, url, unnest(blocks) AS b, generate_subscripts(blocks, 1) AS pos FROM page
    ), plain AS (
        SELECT page_id, url, pos, replace(replace(replace(replace(replace(replace(replace(replace(b, '<br>', ' '), '<b>', ''), '</b>', ''),
               '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&') AS b
        FROM block
    ), tidy AS (
        SELECT page_id, url, pos, trim(regexp_replace(b, '\\s+', ' ', 'g')) AS b FROM plain
    ), text AS (
        SELECT page_id, url, coalesce(string_agg(b, chr(10) ORDER BY pos) FILTER (b <> ''), '') AS text FROM tidy GROUP BY page_id, url
    )
    SELECT page_id, url, text, length(text) AS n_chars FROM text
    """,
)
def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    found = html_text.extract(pages).drop("html")
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query(
    "op11_conversation_repair",
    r"""
    WITH RECURSIVE crc AS (
        SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
               lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS bits
        FROM range(256) r(i)
    ), source AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT))),
               lambda c, x: xor(c >> 8, bits[(xor(c, x) & 255) + 1]))) % 20 AS kind
        FROM conversations, crc
    ), damaged AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM source, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
    ), placed AS (
        SELECT *, row_number() OVER w AS i, lag(role[1]) OVER w AS before,
               regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS ink
        FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
    ), faulty AS (
        SELECT *, role[1] AS r, CASE WHEN ink = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
               WHEN NOT regexp_matches(ink, '[.!?]$') THEN 'truncated' ELSE '' END AS fault
        FROM placed
    ), moves(origin, edit, r, target, price) AS (
        -- tops: e nothing yet, s after system, u after user, p after a pair
        VALUES ('e', 'K', 's', 's', 0), ('e', 'K', 'u', 'u', 0), ('s', 'K', 'u', 'u', 0), ('u', 'K', 'a', 'p', 0), ('p', 'K', 'u', 'u', 0),
               ('e', 'R', NULL, 'u', 1), ('s', 'R', NULL, 'u', 1), ('u', 'R', NULL, 'p', 1), ('p', 'R', NULL, 'u', 1),
               ('e', 'D', NULL, 'e', 2), ('s', 'D', NULL, 's', 2), ('u', 'D', NULL, 'u', 2), ('p', 'D', NULL, 'p', 2)
    ), inserts(origin, edits, target, price) AS (
        VALUES ('e', '', 'e', 0), ('s', '', 's', 0), ('u', '', 'u', 0), ('p', '', 'p', 0),
               ('e', 'I', 'u', 5), ('s', 'I', 'u', 5), ('u', 'I', 'p', 5), ('p', 'I', 'u', 5), ('e', 'II', 'p', 10), ('s', 'II', 'p', 10)
    ), ways AS (
        SELECT i.origin, m.edit, m.r, m.target, i.price + m.price AS price, i.edits || m.edit AS edits FROM inserts i JOIN moves m ON i.target = m.origin
    ), parse AS (
        SELECT conv_id, CAST(0 AS BIGINT) AS i, 'e' AS top, CAST(0 AS BIGINT) AS cost, '' AS audit, [''] [2:] AS lines FROM (SELECT DISTINCT conv_id FROM faulty)
        UNION ALL
        SELECT conv_id, i, top, best.cost, best.audit, best.lines FROM (
            SELECT f.conv_id, f.i, w.target AS top,
                   min(struct_pack(cost := p.cost + w.price + CASE WHEN f.fault = 'truncated' AND w.edit <> 'D' THEN 5 ELSE 0 END, audit := p.audit || w.edits,
                       lines := list_concat(p.lines, CASE WHEN w.edits LIKE 'II%' THEN ['user:', 'assistant:'] WHEN w.edits LIKE 'I%' THEN [CASE WHEN p.top = 'u' THEN 'assistant:' ELSE 'user:' END] ELSE [''] [2:] END,
                                            CASE w.edit WHEN 'K' THEN [f.role || ':' || f.text] WHEN 'R' THEN [CASE w.target WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text] ELSE [''] [2:] END))) AS best
            FROM parse p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1
            JOIN ways w ON w.origin = p.top AND (w.edit = 'D' OR f.fault IN ('', 'truncated')) AND (w.edit <> 'K' OR w.r = f.r)
            GROUP BY f.conv_id, f.i, w.target
        )
    ), size AS (
        SELECT conv_id, max(i) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
               count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
               count(*) FILTER (i > 1 AND coalesce(before, '') || coalesce(r, '') NOT IN ('su', 'ua', 'au')) AS illegal
        FROM faulty GROUP BY conv_id
    ), ended AS (
        SELECT p.conv_id, min(struct_pack(cost := p.cost + e.price, audit := p.audit || e.edits, lines := list_concat(p.lines,
               CASE e.edits WHEN 'II' THEN ['user:', 'assistant:'] WHEN 'I' THEN [CASE WHEN p.top = 'u' THEN 'assistant:' ELSE 'user:' END] ELSE [''] [2:] END))) AS best
        FROM parse p JOIN size s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.n = p.i JOIN inserts e ON e.origin = p.top AND e.target IN ('e', 'p')
        GROUP BY p.conv_id
    )
    SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN size s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
)
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.repair(conversations.damage(given), given)


@query("op12_packing")
def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    pieces_of = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces_of.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


@query(
    "op13_ranked_search",
    r"""
    WITH doc AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
    ), total AS (
        SELECT count(*) AS docs, CAST(sum(len(ws)) AS BIGINT) AS words FROM doc WHERE len(ws) > 0
    ), posting AS (
        SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM doc) GROUP BY r, w
    ), weighed AS (
        SELECT w, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS weight FROM posting, total GROUP BY w
    ), need AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark
    ), scored AS (
        SELECT item_id, d.r, any_value(doc_id) AS doc_id,
               CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(ws) * docs) // words)))) AS BIGINT) AS score
        FROM need JOIN weighed USING (w) JOIN posting p USING (w) JOIN doc d ON d.r = p.r, total GROUP BY item_id, d.r
    )
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 50
    """,
)
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark").select("item_id", "text")
    return ranked_search.search(docs, items)
