"""SQL for the queries that it can express, over the same tables."""

from __future__ import annotations

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)(:[0-9]+)?([^#]*)"

CAPTURES = f"""
WITH pages_ AS (
    SELECT page_id, coalesce(html, '') AS body,
        replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS uri
    FROM pages
), hashed AS (
    SELECT *, strlen(body) AS bytes, sha1(body) AS hex,
        min(page_id) OVER (PARTITION BY body) AS first_id,
        CASE WHEN regexp_matches(uri, '{URL}') THEN
            array_to_string(list_reverse(string_split(lower(regexp_extract(uri, '{URL}', 1)), '.')), ',')
            || ')' || coalesce(nullif(regexp_extract(uri, '{URL}', 3), ''), '/')
        ELSE coalesce(uri, '') END AS url_key
    FROM pages_
)
SELECT page_id, bytes AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr(
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (((('0x' || substr(hex, (1 + (i // 4) * 5)::BIGINT, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31))::BIGINT,
        1)), '') AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
    url_key,
    row_number() OVER (ORDER BY url_key, page_id) - 1 AS capture_rank
FROM hashed
"""

DECONTAMINATION = f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM benchmark
), sized AS (
    SELECT item_id, w, least(len(w), 10) AS k FROM items WHERE len(w) > 0
), item_windows AS (
    SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS part
    FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM sized)
), doc_windows AS (
    SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS part
    FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i
          FROM docs, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k)
), found AS (
    SELECT r, d.k, i, item_id FROM doc_windows d JOIN item_windows USING (k, part)
), hits AS (
    SELECT r, count(DISTINCT place) AS n_hit
    FROM (SELECT r, unnest(range(i, i + k)) AS place FROM found) GROUP BY r
), named AS (
    SELECT r, count(DISTINCT item_id) AS n_items,
        array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS names
    FROM found GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""

CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok'
    FROM range(2) AS two(i)
), marked AS (
    SELECT *, '<turn ' || replace(replace(role, '\', '\\'), '>', '\>') || '>'
        || replace(replace(replace(text, '\', '\\'), '<turn ', '\<turn '), '</turn>', '\</turn>')
        || '</turn>' || chr(10) AS formatted
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, formatted)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, formatted) FILTER (role = 'assistant'), ''))
        AS loss_sha256,
    sum(length(formatted))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

MIXING = """
WITH RECURSIVE sizes AS (
    SELECT source, sum(strlen(coalesce(text, '')))::DOUBLE AS bytes FROM documents GROUP BY source
), weighted AS (
    SELECT source, bytes, round(pow(bytes, 0.5), 6) AS weight FROM sizes
), sums AS (
    SELECT sum(bytes) AS all_bytes, sum(weight) AS all_weights FROM weighted WHERE bytes > 0
), rated AS (
    SELECT source, CASE WHEN bytes = 0 THEN 1.0
        ELSE round(weight / all_weights * all_bytes / bytes, 9) END AS rate
    FROM weighted, sums
), pieces AS (
    SELECT source, rate, greatest(1, ceil(rate / 8))::INTEGER AS n,
        rate / greatest(1, ceil(rate / 8)) AS mean FROM rated
), cdf AS (
    SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS below FROM pieces
    UNION ALL
    SELECT source, mean, k + 1, p * mean / (k + 1), below + p * mean / (k + 1) FROM cdf WHERE k < 63
), told AS (
    SELECT *, md5(concat_ws('/', length(coalesce(doc_id::VARCHAR, 'null')), length(coalesce(source, 'null')),
        length(coalesce(text, 'null')), coalesce(doc_id::VARCHAR, 'null'), coalesce(source, 'null'),
        coalesce(text, 'null'))) AS digest
    FROM documents
), numbered AS (
    SELECT row_number() OVER () AS r, * EXCLUDE (digest),
        CASE WHEN doc_id IS NOT NULL AND count(*) OVER (PARTITION BY doc_id) = 1 THEN doc_id::VARCHAR
        ELSE concat_ws('/', coalesce(doc_id::VARCHAR, 'null'), digest,
            (row_number() OVER (PARTITION BY digest) - 1)::VARCHAR) END AS drawn_by
    FROM told
), points AS (
    SELECT r, source, rate, ('0x' || substr(md5(concat_ws('/', '17', drawn_by, i::VARCHAR)), 1, 13))::BIGINT
        / 4503599627370496.0 AS u
    FROM (SELECT r, drawn_by, d.source, rate, unnest(range(n)) AS i
          FROM numbered d JOIN pieces p ON d.source IS NOT DISTINCT FROM p.source)
), drawn AS (
    SELECT r, any_value(rate) AS rate, count(k)::INTEGER AS copies
    FROM points p LEFT JOIN cdf c ON p.source IS NOT DISTINCT FROM c.source AND c.below <= p.u
    GROUP BY r
)
SELECT doc_id, text, lang, source, n_chars, copies, round(rate, 6) AS rate, copy::INTEGER AS copy,
    ('0x' || substr(md5(concat_ws('/', '17', 'order', drawn_by, copy::VARCHAR)), 1, 13))::BIGINT
        / 4503599627370496.0 AS shuffle_key
FROM (SELECT *, unnest(range(copies)) AS copy FROM numbered JOIN drawn USING (r) WHERE copies > 0)
"""

#: CRC-32 byte by byte, with the usual table of 256 entries made by its rule.
SHARDING = """
WITH crc_table AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, step:
        CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS t
), sized AS (
    SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h
    FROM documents
), summed AS (
    SELECT doc_id, size, xor(list_reduce(
        list_transform(range(size - 1), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
    FROM sized, crc_table
), keyed AS (
    SELECT *, ('0x' || substr(md5(concat_ws('/', coalesce(doc_id::VARCHAR, 'null'), size::VARCHAR,
        text_crc32::VARCHAR)), 1, 15))::BIGINT AS key
    FROM summed
), placed AS (
    SELECT *, sum(size) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING) - size AS before,
        sum(size) OVER () AS total
    FROM keyed
), sharded AS (SELECT *, (8 * before // total)::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY key) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM sharded
"""

#: Equal words with one place left out differ in that place only.
VARIANTS = f"""
WITH RECURSIVE crc_table AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, step:
        CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS t
), runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '[a-z\u00C0-\u00FF]+')) AS run
    FROM documents
), counted AS (
    SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hexed AS (
    SELECT *, hex(encode(id || ':' || run)) AS h FROM counted
), hashed AS (
    SELECT run, n, xor(list_reduce(
        list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295) AS crc
    FROM hexed, crc_table
), spelt AS (
    SELECT CASE WHEN crc % 31 = 0
        THEN substr(run, 1, (crc % length(run))::BIGINT) || substr(run, (crc % length(run) + 2)::BIGINT)
        ELSE run END AS word, n
    FROM hashed
), vocabulary AS (
    SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 7
    GROUP BY word HAVING sum(n) >= 2
), cut AS (
    SELECT word, n, length(word) AS size, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)
), pairs AS (
    SELECT a.word, b.word AS near, b.n AS near_n
    FROM cut a JOIN cut b USING (rest, i, size) WHERE a.word <> b.word
    UNION
    SELECT a.word, b.word, b.n FROM cut a JOIN vocabulary b ON a.rest = b.word
    UNION
    SELECT b.word, a.word, a.n FROM cut a JOIN vocabulary b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, max(near_n) AS near_n,
        first(near ORDER BY near_n DESC, encode(near)) AS near
    FROM pairs GROUP BY word
), judged AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near,
        CASE WHEN near_n >= 10 * n THEN near END AS form,
        CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
    FROM vocabulary LEFT JOIN best USING (word)
), followed AS (
    SELECT word, word AS root FROM judged
    UNION ALL
    SELECT f.word, j.form FROM followed f JOIN judged j ON f.root = j.word WHERE j.form IS NOT NULL
)
SELECT j.word, j.form, f.root, j.n, j.n_near, j.form_n
FROM judged j JOIN followed f USING (word) JOIN judged k ON f.root = k.word WHERE k.form IS NULL
"""

FILTER_AUDIT = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), marks AS (
    SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), judged AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        len(words) < 200 AS a,
        100 * len(list_distinct(words)) < 50 * len(words) AS b,
        100 * length(regexp_replace(body, '[^A-Z]+', '', 'g')) > 3 * length(body) AS c,
        regexp_matches(body, '[#$%&*|]') AS d,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false) AS e
    FROM texts LEFT JOIN marks USING (doc_id)
), grouped AS (
    SELECT part, concat(if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')) AS fails,
        count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM judged GROUP BY ALL
), letters AS (
    SELECT unnest(string_split('ABCDE', '')) AS x
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), counted AS (
    SELECT part, filter_order, step::INTEGER AS step, filter_order[step] AS filter,
        sum(n) FILTER (NOT has AND NOT gone) AS kept,
        sum(n) FILTER (has AND NOT gone) AS removed,
        sum(n) FILTER (has AND gone) AS redundant,
        sum(n) FILTER (fails = filter_order[step]) AS unique_fails,
        sum(good) FILTER (has AND NOT gone) AS good_lost,
        sum(toxic) FILTER (has AND NOT gone) AS toxic_lost
    FROM (
        SELECT *, contains(fails, filter_order[step]) AS has,
            translate(fails, filter_order[:step - 1], '') <> fails AS gone
        FROM grouped, orders, range(1, 6) AS steps(step)
    ) GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
    coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
    coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
    coalesce(sum(removed) OVER (PARTITION BY part, filter), 0)::BIGINT AS shapley
FROM counted
"""

ORACLE = {
    "op1_captures": CAPTURES,
    "op2_decontamination": DECONTAMINATION,
    "op4_chat": CHAT,
    "op8_mixing": MIXING,
    "op10_sharding": SHARDING,
    "op11_variants": VARIANTS,
    "op12_filter_audit": FILTER_AUDIT,
}
