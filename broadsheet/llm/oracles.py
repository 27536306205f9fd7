"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: Words, and a text with A-Z in lower case and nothing else.
WORDS = r"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 of a number's digits, bit by bit.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda k: (ord(c) >> k) & 1)))),
 lambda c, b: xor(c >> 1, CASE WHEN (xor(c, b) & 1) = 1 THEN 3988292384 ELSE 0 END)))"""

ORACLES = {
    "op5_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_points,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
            FROM documents
        ), w AS (
            SELECT doc_id, body,
                   first_value(doc_id) OVER (PARTITION BY body ORDER BY n_points DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY body) AS group_size
            FROM n
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM w
    """,
    "base_repetition": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS.format(x="coalesce(text, '')")} AS w FROM documents),
        p AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
        t AS (SELECT doc_id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS three FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        m AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS n FROM t WHERE three IS NOT NULL) WHERE n > 1),
        r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM m) GROUP BY doc_id),
        l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
            length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
            len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed
        FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id
    """,
    "base_word_model": rf"""
        WITH d AS (SELECT doc_id, {CRC} % 7 = 2 AS held_out, list_append({WORDS.format(x=LOWER)}, ' ') AS w FROM documents),
        t AS (SELECT doc_id, held_out, unnest(w) AS token FROM d),
        c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token),
        s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
        SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
            round(sum(log10((coalesce(c, 0) + 1) / (n + (v + 1)))), 4) AS base_score
        FROM t LEFT JOIN c ON c.token = t.token, s GROUP BY doc_id, held_out
    """,
    "base_token_bytes": "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, true AS limit_holds FROM documents",
    "op11_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
                 regexp_matches(text, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)] AS bad
            FROM d LEFT JOIN g ON g.doc_id = d.doc_id),
        c AS (SELECT part, bad, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
        f AS (SELECT part, filter_order, step, n, good, toxic, bad[ascii(filter_order[step]) - 64] AS own,
                list_bool_or(list_transform(range(1, step), lambda k: bad[ascii(filter_order[k]) - 64])) AS before, list_sum(list_transform(bad, lambda b: b::INT)) AS fails
            FROM c, s),
        r AS (SELECT part, filter_order, step,
                coalesce(sum(n) FILTER (NOT own AND NOT coalesce(before, false)), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (own AND NOT coalesce(before, false)), 0)::BIGINT AS removed,
                coalesce(sum(n) FILTER (own AND before), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (own AND fails = 1), 0)::BIGINT AS unique_fails,
                coalesce(sum(good) FILTER (own AND NOT coalesce(before, false)), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT coalesce(before, false)), 0)::BIGINT AS toxic_lost
            FROM f GROUP BY ALL)
        SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
            (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley
        FROM r
    """,
    "op12_spelling_variants": r"""
        WITH RECURSIVE d AS (SELECT CAST(doc_id AS VARCHAR) AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        r AS (SELECT id, word, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(text, '[a-z\x{00C0}-\x{00FF}]+')) AS word FROM d) WHERE length(word) >= 7 GROUP BY ALL),
        b AS (SELECT word, n, flatten(list_transform(string_split(id || ':' || word, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 | (ord(c) >> 6), 128 | (ord(c) & 63)] END)) AS bytes FROM r),
        h AS (SELECT word, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(bytes, lambda c: list_transform(range(8), lambda k: (c >> k) & 1)))),
            lambda c, b: xor(c >> 1, CASE WHEN (xor(c, b) & 1) = 1 THEN 3988292384 ELSE 0 END))) AS h FROM b),
        k AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(word, 1, (h % length(word))::INT) || substr(word, (h % length(word))::INT + 2) ELSE word END AS word FROM h),
        w AS (SELECT word, sum(n)::BIGINT AS n FROM k WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        v AS (SELECT word, n, place, substr(word, 1, place) || substr(word, place + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)))::INT AS place FROM w)),
        e AS (SELECT a.word, b.word AS near, b.n AS m FROM v a JOIN v b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
            UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.rest = w.word UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.rest = w.word),
        t AS (SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, encode(near)) AS near, max(m) AS m FROM e GROUP BY word),
        f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN near END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM w LEFT JOIN t ON t.word = w.word),
        p AS (SELECT word, word AS place FROM f UNION ALL SELECT p.word, f.form FROM p JOIN f ON f.word = p.place WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, p.place AS root, f.n, f.n_near, f.form_n FROM f JOIN p ON p.word = f.word JOIN f l ON l.word = p.place AND l.form IS NULL
    """,
    "op13_chat_formatting": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
        p AS (SELECT *, length(replace(replace(replace(text, chr(92), '12'), '<turn', '123456'), '</turn', '1234567')) + length(replace(replace(replace(replace(role, chr(92), '12'), '<turn', '123456'), '</turn', '1234567'), '>', '12')) + length('<turn >') + length('</turn>') + 3 AS size FROM c),
        s AS (SELECT *, sum(size) OVER o AS upto, coalesce(max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id), -1) AS final, max(turn) OVER (PARTITION BY conv_id) AS ends FROM p WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
            coalesce(sum(upto) FILTER (role = 'assistant' OR (turn = ends AND final < ends)), 0)::BIGINT AS formatted_chars
        FROM s GROUP BY conv_id
    """,
}
