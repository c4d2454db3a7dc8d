"""DuckDB statements equal to those queries of this subpackage that SQL can state."""

OP2 = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM d
), windows AS (
    SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS win
    FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), twice AS (
    SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n >= 2
), covered AS (
    SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(0, 8) AS r(k) GROUP BY rid
), s AS (
    SELECT doc_id, t, words, len(words)::BIGINT AS n_words,
        length(array_to_string(words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        len(lines)::BIGINT AS n_lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN covered c USING (rid)
), b AS (
    SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed
        OR 10 * n_symbols > n_words
        OR word_chars > 30 * n_words OR word_chars < 2 * n_words
        OR 2 * n_dup_lines > n_lines
        OR 2 * len(list_filter(words, lambda x: regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '\p{Ll}'))) > n_words
        OR 10 * len(regexp_extract_all(t, '!')) > 3 * n_words
        OR 2 * len(regexp_extract_all(t, '\p{L}[^\x20\x09-\x0D]*')) < n_words
        OR 4 * len(list_filter(range(2, n_words + 1), lambda i: words[i] = words[i - 1])) > n_words
    ) AS kept
FROM b
"""

OP9 = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 8))::BIGINT AS h
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
    SELECT *, ([1, 2, 3])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::BIGINT AS weight, 3 * source_size AS cap FROM s
), f AS (
    SELECT *,
        sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS free_words,
        sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS free_weight
    FROM w
    WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
    SELECT *, free_words * weight > cap * free_weight AS capped FROM f
), l AS (
    SELECT free_words, free_weight FROM c WHERE NOT capped ORDER BY cap::DOUBLE / weight, source NULLS LAST LIMIT 1
), t AS (
    SELECT c.source, source_size,
        CASE WHEN capped THEN cap::DOUBLE ELSE (l.free_words * weight)::DOUBLE / l.free_weight::DOUBLE END AS target, capped
    FROM c LEFT JOIN l ON true
), p AS (
    SELECT *, CASE WHEN capped THEN 3 WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS whole FROM t
), q AS (
    SELECT *, CASE WHEN capped THEN 0 ELSE target - whole * source_size END AS part FROM p
), r AS (
    SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, q.part, d.h // 1048576 AS bucket, d.h, d.source,
        sum(d.size) OVER (PARTITION BY d.source, d.h // 1048576) AS in_bucket,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h // 1048576 RANGE UNBOUNDED PRECEDING) AS upto_bucket
    FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target,
    ((whole + CASE WHEN upto_bucket <= part THEN 1 WHEN upto_bucket - in_bucket >= part THEN 0
        WHEN upto - size / 2.0 <= part THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM r
"""

OP4 = r"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP10 = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), n AS (
    -- what a turn's own marks and escapes add to its text
    SELECT *, len(regexp_extract_all(text, '(<\\*s>)|(<\\*/s>)|(\[\\*INST\])|(\[\\*/INST\])|(<\\*<SYS>>)|(<\\*</SYS>>)|(<\\*<ROLE>>)|(<\\*</ROLE>>)|(<\\*<END>>)'))
        + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 5 WHEN 'system' THEN 18 ELSE 24 + length(role) END AS added
    FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (sum(length(text) + added))::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""

OP13 = r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d
), l AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), m AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
        len(words) < 200,
        100 * len(list_distinct(words)) < 50 * len(words),
        100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t),
        regexp_matches(t, '[#$%&*|]'),
        coalesce(w.doc_id > least, false)
    ] AS fails
    FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), c AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM m GROUP BY part, fails
), x AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 3, 4, 5]) AS i
), o AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS places
    FROM x a, x b, x c, x d, x e
    WHERE a.i NOT IN (b.i, c.i, d.i, e.i) AND b.i NOT IN (c.i, d.i, e.i) AND c.i NOT IN (d.i, e.i) AND d.i <> e.i
), s AS (
    -- of rows that fail alike: the step that removes them, what they fail besides
    SELECT part, filter_order, places, fails, n, n_good, n_toxic, len(list_filter(fails, lambda y: y)) AS n_fails,
        coalesce(list_min([CASE WHEN fails[places[1]] THEN 1 END, CASE WHEN fails[places[2]] THEN 2 END, CASE WHEN fails[places[3]] THEN 3 END,
            CASE WHEN fails[places[4]] THEN 4 END, CASE WHEN fails[places[5]] THEN 5 END]), 6) AS gone
    FROM c CROSS JOIN o
), r AS (
    SELECT part, filter_order, k.step, any_value(places[k.step]) AS f,
        coalesce(sum(n) FILTER (gone > k.step), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (gone = k.step), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (fails[places[k.step]] AND gone < k.step), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (fails[places[k.step]] AND n_fails = 1), 0)::BIGINT AS unique_fails,
        coalesce(sum(n_good) FILTER (gone = k.step), 0)::BIGINT AS good_lost,
        coalesce(sum(n_toxic) FILTER (gone = k.step), 0)::BIGINT AS toxic_lost
    FROM s CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS step) k
    GROUP BY part, filter_order, k.step
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
"""

OP11 = r"""
WITH RECURSIVE steps AS (
    -- the table of the checksum: eight shifts of each byte
    SELECT range AS byte, range AS c, 0 AS k FROM range(256)
    UNION ALL
    SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8
), tab AS (
    SELECT list(c ORDER BY byte) AS tab FROM steps WHERE k = 8
), runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
), counted AS (
    SELECT id, run, hex(encode(id || ':' || run)) AS bytes, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY id, run
), hashed AS (
    SELECT run, n, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(range(1, length(bytes) // 2 + 1), lambda i: ('0x' || substr(bytes, 2 * i - 1, 2))::BIGINT)),
        lambda c, b: xor(c // 256, tab.tab[(xor(c, b) % 256) + 1]))) AS h
    FROM counted CROSS JOIN tab
), damaged AS (
    SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word FROM hashed
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), holes AS (
    -- every word without each of its letters, and with a hole in its place
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS hole
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
    UNION
    SELECT a.word, a.n, b.word, b.n FROM holes a JOIN words b ON a.less = b.word
    UNION
    SELECT b.word, b.n, a.word, a.n FROM holes a JOIN words b ON a.less = b.word
), best AS (
    SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM near
), forms AS (
    SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near,
        CASE WHEN near_n >= 5 * words.n THEN near END AS form, CASE WHEN near_n >= 5 * words.n THEN near_n END AS form_n
    FROM words LEFT JOIN best ON words.word = best.word AND place = 1
), paths AS (
    SELECT word, word AS last, 0 AS steps FROM forms
    UNION ALL
    SELECT paths.word, forms.form, steps + 1 FROM paths JOIN forms ON paths.last = forms.word WHERE forms.form IS NOT NULL
)
SELECT word, form, arg_max(last, steps) AS root, n, n_near, form_n FROM forms JOIN paths USING (word) GROUP BY word, form, n, n_near, form_n
"""
