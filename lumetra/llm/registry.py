"""Queries of the subpackage and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import encoding, hard_negatives, jaccard_join, media, packing, private_data, sharding, spelling, suffix_dedup, tool_calls, toxicity, vector_file, window_dedup
from .base import table, tokenizer_file


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_tool_calls(spark, sf_dir):
    return tool_calls.format_conversations(table(spark, sf_dir, "conversations"), every_result=True)


def op2_vector_file(spark, sf_dir):
    return vector_file.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64.0)


def op3_rabin_karp(spark, sf_dir):
    return window_dedup.remove_repeated_windows(table(spark, sf_dir, "documents"), width=50)


def op4_best_two_fit(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), split_pattern(), capacity=1024, end_id=2)


def op5_matroska(spark, sf_dir):
    return media.media_table(table(spark, sf_dir, "documents"))


def op6_parity_sketch(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_difference_cover(spark, sf_dir):
    return suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"), width=50)


def op8_noisy_or(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_byte_bpe(spark, sf_dir):
    return encoding.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), split_pattern())


def op10_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


def op11_four_russians(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), every=100, positives=5, negatives=5, low=80, high=100, scale=256.0)


def op12_bootstrapped_contexts(spark, sf_dir):
    return private_data.private_data(table(spark, sf_dir, "documents"))


def op13_trie_pairs(spark, sf_dir):
    return spelling.spelling_forms(table(spark, sf_dir, "documents"), noise=199, least_length=6, least_count=5, ratio=5)


QUERIES = {
    "op1_tool_calls": op1_tool_calls,
    "op2_vector_file": op2_vector_file,
    "op3_rabin_karp": op3_rabin_karp,
    "op4_best_two_fit": op4_best_two_fit,
    "op5_matroska": op5_matroska,
    "op6_parity_sketch": op6_parity_sketch,
    "op7_difference_cover": op7_difference_cover,
    "op8_noisy_or": op8_noisy_or,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_sharding": op10_sharding,
    "op11_four_russians": op11_four_russians,
    "op12_bootstrapped_contexts": op12_bootstrapped_contexts,
    "op13_trie_pairs": op13_trie_pairs,
}

ORACLES: dict[str, str] = {
    "op1_tool_calls": """
        WITH calls AS (
            SELECT conv_id, turn, CAST(turn AS VARCHAR) AS call_id, text,
                   '{"text":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || '}' AS arguments
            FROM conversations WHERE role = 'user'
        ), results AS (
            SELECT conv_id, turn AS result_turn, CAST(turn - 1 AS VARCHAR) AS call_id, text AS content FROM conversations WHERE role = 'assistant'
        ), linked AS (
            SELECT conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.result_turn) AS turn,
                   CASE WHEN c.turn IS NOT NULL THEN 'respond' END AS name, c.arguments AS arguments, c.turn IS NOT NULL AS valid,
                   CASE WHEN c.turn IS NULL THEN '$: no call' ELSE '' END AS errors,
                   CASE WHEN c.turn IS NULL THEN 'orphan' WHEN r.result_turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
                   r.result_turn AS result_turn, r.content AS content
            FROM calls c FULL JOIN results r USING (conv_id, call_id)
        )
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, status, call_id) - 1 AS position, call_id, turn, name, arguments, valid, errors, status, result_turn,
               '{"arguments":' || coalesce(arguments, 'null') || ',"conversation":' || conv_id || ',"id":"' || call_id || '","name":' || coalesce('"' || name || '"', 'null')
               || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || ',"status":"' || status || '"}' AS message
        FROM linked
    """,
    "op2_vector_file": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.vector, c.vector), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op3_rabin_karp": r"""
        WITH w AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\t-\r ]+'), lambda x: x <> '') AS words FROM documents
        ), p AS (
            SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM w
        ), k AS (
            SELECT doc_id, pos, words[pos] AS word, CASE WHEN pos + 49 <= len(words) THEN sha256(array_to_string(words[pos : pos + 49], ' ')) END AS win FROM p
        ), f AS (
            SELECT win, min(doc_id) AS least FROM k WHERE win IS NOT NULL GROUP BY win HAVING min(doc_id) < max(doc_id)
        ), c AS (
            SELECT doc_id, pos, word,
                   max(CASE WHEN f.least < doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
            FROM k LEFT JOIN f USING (win)
        ), r AS (
            SELECT doc_id, pos, word, gone, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), 0) = 0 THEN 1 ELSE 0 END AS edge FROM c
        )
        SELECT w.doc_id, CAST(count(r.pos) AS BIGINT) AS n_words, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed,
               sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0), '')) AS kept_sha256,
               CAST(coalesce(sum(edge), 0) AS INTEGER) AS n_intervals
        FROM w LEFT JOIN r USING (doc_id) GROUP BY w.doc_id
    """,
    "op6_parity_sketch": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\t-\r ]+'), lambda x: x <> '') AS words FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))
                                                WHEN len(words) > 0 THEN [array_to_string(words, ' ')] END) AS shingle FROM w
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS MATERIALIZED (
            SELECT a, b FROM pairs JOIN n AS na ON a = na.doc_id JOIN n AS nb ON b = nb.doc_id WHERE 100 * shared >= 75 * (na.n + nb.n - shared)
        ), reached AS (
            SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT b, root FROM reached JOIN links ON node = a
        )
        SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(root), w.doc_id) AS component_id
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reached ON node = w.doc_id GROUP BY w.doc_id
    """,
    "op7_difference_cover": """
        WITH b AS (
            SELECT doc_id, unnest(bytes) AS h, generate_subscripts(bytes, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes FROM documents)
        ), b2 AS (SELECT *, h || lead(h, 1) OVER o AS h2 FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
        ), b4 AS (SELECT *, h2 || lead(h2, 2) OVER o AS h4 FROM b2 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
        ), b8 AS (SELECT *, h4 || lead(h4, 4) OVER o AS h8 FROM b4 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
        ), b16 AS (SELECT doc_id, pos, h, h2, h8 || lead(h8, 8) OVER o AS h16 FROM b8 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
        ), k AS (SELECT doc_id, pos, h, h16 || lead(h16, 16) OVER o || lead(h16, 32) OVER o || lead(h2, 48) OVER o AS string FROM b16 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
        ), f AS (
            SELECT string, min(doc_id) AS least FROM k WHERE string IS NOT NULL GROUP BY string HAVING min(doc_id) < max(doc_id)
        ), c AS (
            SELECT doc_id, pos, h, max(CASE WHEN f.least < doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM k LEFT JOIN f USING (string)
        ), r AS (
            SELECT doc_id, pos, h, gone, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), 0) = 0 THEN 1 ELSE 0 END AS edge FROM c
        )
        SELECT d.doc_id, count(r.pos) AS n_bytes, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed, CAST(coalesce(sum(edge), 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE gone = 0), ''))) AS kept_sha256
        FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id
    """,
    # the CRC-32 of the bytes by the table of its polynomial (a fixed value)
    "op10_sharding": """
        WITH RECURSIVE steps(byte, bit, rest) AS (
            SELECT range, 0, range FROM range(256)
            UNION ALL SELECT byte, bit + 1, CASE WHEN rest & 1 = 1 THEN xor(rest >> 1, 3988292384) ELSE rest >> 1 END FROM steps WHERE bit < 8
        ), crc AS (SELECT list(rest ORDER BY byte) AS entry FROM steps WHERE bit = 8
        ), sized AS (
            SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size,
                   coalesce(xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)),
                                            lambda c, b: xor(c >> 8, entry[xor(c & 255, b) + 1]), 4294967295), 4294967295), 0) AS text_crc32
            FROM documents, crc
        ), placed AS (
            SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM sized
        ), cut AS (
            SELECT *, CAST(least(15, ((2 * before + size) * 16) // (2 * total)) AS INTEGER) AS shard FROM placed
        )
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM cut
    """,
    "op11_four_russians": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.vector, c.vector), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id <> c.vec_id
            WHERE a.vec_id % 100 = 0
        ), near AS (
            SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), ranked AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
                   n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
            FROM near p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
        )
        SELECT * FROM ranked WHERE rank <= 5
    """,
    # the CRC-32 as above; near words share a word with a letter skipped
    "op13_trie_pairs": """
        WITH RECURSIVE steps(byte, bit, rest) AS (
            SELECT range, 0, range FROM range(256)
            UNION ALL SELECT byte, bit + 1, CASE WHEN rest & 1 = 1 THEN xor(rest >> 1, 3988292384) ELSE rest >> 1 END FROM steps WHERE bit < 8
        ), crc AS (SELECT list(rest ORDER BY byte) AS entry FROM steps WHERE bit = 8
        ), runs AS (
            SELECT doc_id, run, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL
        ), hashed AS (
            SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
                                           lambda c, b: xor(c >> 8, entry[xor(c & 255, b) + 1])), 4294967295) AS h
            FROM runs, crc
        ), words AS MATERIALIZED (
            SELECT word, CAST(sum(n) AS BIGINT) AS n
            FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
            WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
        ), skips AS MATERIALIZED (
            SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)
        ), near AS (
            SELECT a.word AS word, b.word AS other, b.n AS n FROM skips a JOIN skips b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM skips a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM skips a JOIN words b ON a.rest = b.word
        ), best AS (
            SELECT word, count(*) AS n_near, max(n) AS most, min_by(other, (-n, other)) AS first FROM near GROUP BY word
        ), forms AS MATERIALIZED (
            SELECT w.word, CASE WHEN most >= 5 * w.n THEN first END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN most END AS form_n FROM words w LEFT JOIN best USING (word)
        ), chain(word, ending, depth) AS (
            SELECT word, word, 0 FROM forms UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN forms f ON f.word = c.ending WHERE f.form IS NOT NULL
        )
        SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT word, max_by(ending, depth) AS root FROM chain GROUP BY word) r USING (word)
    """,
}
