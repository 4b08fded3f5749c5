"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"""[x for x in string_split_regex(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> '']"""

_CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[/ROLE\]"


def _more(edits: str, cost: str, edit: str) -> str:
    """Edits that are held as nine digits of cost and an audit, and one more of them."""
    return f"CASE WHEN {edits} = 'z' THEN 'z' ELSE lpad(({edits}[1:9]::BIGINT + {cost})::VARCHAR, 9, '0') || {edits}[10:] || '{edit}' END"


STATEMENTS = {
    "op3_top_k": """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
),
part AS (SELECT r, vec_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM v),
score AS (
    SELECT q.r AS query_row, c.r, q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
    FROM part q JOIN part c ON q.i = c.i WHERE q.vec_id % 20 = 0 AND q.r <> c.r GROUP BY ALL
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id)::INTEGER AS rank FROM score)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""",
    "op6_chat": f"""
WITH turns AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
),
sized AS (
    SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROL}')) + CASE role
        WHEN 'user' THEN length('[INST]  [/INST]') WHEN 'assistant' THEN length('  </s>') WHEN 'system' THEN length('<<SYS>>  <</SYS>>')
        ELSE length('[ROLE]  [/ROLE]') + length(to_json(role)::VARCHAR) + 1 END AS formatted
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (sum(formatted) + length('<s>'))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
""",
    "op7_warc": """
WITH page AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
sized AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM page),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM sized LEFT JOIN firsts USING (payload_digest)
""",
    "op8_suffix_dedup": """
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
    SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s
    FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM doc)
),
firsts AS (SELECT s, min((doc_id, i)) AS first FROM strings GROUP BY s HAVING count(*) > 1),
repeats AS (SELECT doc_id, i FROM strings JOIN firsts USING (s) WHERE (doc_id, i) > first),
begins AS (SELECT *, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, -1) AS begins FROM repeats),
numbered AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM begins),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, span),
placed AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (
    SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept,
        max(b) AS last, sum(b - a) AS n_removed, count(*) AS n_spans
    FROM placed JOIN doc USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM doc LEFT JOIN cut USING (doc_id)
""",
    "op10_decontamination": f"""
WITH item AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS words
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)
),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
places AS (
    SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS words
    FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, (SELECT DISTINCT m FROM windows))
),
hits AS (SELECT r, i, p.m, item_id FROM places p JOIN windows USING (m, words)),
covered AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS j FROM hits) GROUP BY r),
named AS (SELECT r, list(DISTINCT item_id) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
    sha256(coalesce(array_to_string(list_sort([x::VARCHAR for x in ids]), ','), '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
""",
    "op12_filter_audit": r"""
WITH doc AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
        [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents
),
failing AS (
    SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
    FROM doc
),
label AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM failing LEFT JOIN label USING (doc_id) GROUP BY ALL
),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letter a, letter b, letter c, letter d, letter e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
),
removed AS (
    SELECT *, coalesce(list_min([strpos(filter_order, f) for f in string_split(fails, '') if f <> '']), 6) AS gone FROM masks, orders
),
steps AS (
    SELECT part, filter_order, step, filter_order[step] AS f, sum(n * (gone > step)::INT)::BIGINT AS kept, sum(n * (gone = step)::INT)::BIGINT AS removed,
        sum(n * (gone < step AND contains(fails, filter_order[step]))::INT)::BIGINT AS redundant,
        sum(n * (fails = filter_order[step])::INT)::BIGINT AS unique_fails,
        sum(good * (gone = step)::INT)::BIGINT AS good_lost, sum(toxic * (gone = step)::INT)::BIGINT AS toxic_lost
    FROM removed, (SELECT unnest(range(1, 6))::INTEGER AS step) GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM steps
""",
    "op13_source_mix": r"""
WITH RECURSIVE doc AS (
    SELECT row_number() OVER () AS r, doc_id, source, len([x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> '']) AS size,
        md5(coalesce(text, '')) AS digest FROM documents
),
sources AS (
    SELECT *, ([5, 2, 1])[(number - 1) % 3 + 1]::DOUBLE AS weight, 2 * source_size AS most
    FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM doc GROUP BY source)
),
levels AS (
    SELECT 0 AS i, 0::DOUBLE AS level
    UNION ALL
    SELECT i + 1, ((SELECT sum(source_size) * 1.5::DOUBLE FROM sources) - coalesce(sum(most) FILTER (most <= weight * level), 0))
        / (sum(weight) FILTER (most > weight * level)) AS next
    FROM levels, sources WHERE i < 1000 GROUP BY i, level
    HAVING next IS NOT NULL AND next <> level
),
targets AS (SELECT source, source_size, number, least(most::DOUBLE, weight * (SELECT max(level) FROM levels)) AS target FROM sources),
offered AS (
    SELECT r, doc_id, size, digest, number, target, unnest(range(0, ceil(target / source_size)::BIGINT)) AS round
    FROM doc JOIN targets ON doc.source IS NOT DISTINCT FROM targets.source WHERE size > 0 AND target > 0
),
queued AS (
    SELECT *, sum(size) OVER (PARTITION BY number ORDER BY round, md5(round || ':0:' || coalesce(doc_id::VARCHAR, '') || ':' || digest), r)::BIGINT AS served
    FROM offered
),
pieces AS (SELECT r, size, number, target, served, unnest(range(0, size, 128)) AS begins FROM queued),
ended AS (
    SELECT r, number, least(128, size - begins) AS words, served - size + begins + least(128, size - begins) AS served,
        (served - size + begins + least(128, size - begins)) / target AS finish FROM pieces
),
placed AS (SELECT r, words, sum(words) OVER (ORDER BY finish, number, served)::BIGINT - words AS before FROM ended),
budget AS (SELECT floor(sum(size) * 1.5)::BIGINT AS budget FROM doc),
taken AS (SELECT r, sum(least(words, budget - before))::BIGINT AS taken FROM placed, budget WHERE before < budget GROUP BY r)
SELECT doc_id, size::BIGINT AS size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM doc JOIN targets ON doc.source IS NOT DISTINCT FROM targets.source LEFT JOIN taken USING (r)
""",
    "op11_conversation_repair": rf"""
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce(range(0, 9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t
    FROM (SELECT unnest(range(0, 256)) AS n)
),
keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        [ascii(c)::BIGINT for c in string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')] AS bytes FROM conversations
),
drawn AS (
    SELECT conv_id, turn, role, text, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS damage
    FROM keyed, crc_table
),
spoilt AS (
    SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role, unnest(range(0, CASE WHEN damage = 3 THEN 2 ELSE 1 END)) AS copy,
        CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM drawn WHERE damage <> 0
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, sha256(text) AS digest FROM spoilt
),
faults AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
        left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
    FROM placed
),
-- a state's cheapest edits so far as a text: nine digits of cost, then the audit; z sorts after all
walk AS (
    SELECT conv_id, 0::BIGINT AS i, '000000000' AS n, 'z' AS s, '000000002I' AS u, '000000004II' AS a FROM (SELECT DISTINCT conv_id FROM placed)
    UNION ALL
    SELECT conv_id, i, n2, s2, u3, a3
    FROM (
        SELECT *, least(u2, {_more('least(n2, s2, a2)', '2', 'I')}) AS u3, least(a2, {_more('u3', '2', 'I')}) AS a3
        FROM (
            SELECT conv_id, f_i AS i, {_more('n', '3', 'D')} AS n2,
                least({_more('s', '3', 'D')}, CASE WHEN sound AND r = 's' THEN {_more('n', 'cut', 'K')} ELSE 'z' END) AS s2,
                least({_more('u', '3', 'D')}, CASE WHEN sound THEN {_more('to_user', '2 + cut', 'R')} ELSE 'z' END,
                    CASE WHEN sound AND r = 'u' THEN {_more('to_user', 'cut', 'K')} ELSE 'z' END) AS u2,
                least({_more('a', '3', 'D')}, CASE WHEN sound THEN {_more('u', '2 + cut', 'R')} ELSE 'z' END,
                    CASE WHEN sound AND r = 'a' THEN {_more('u', 'cut', 'K')} ELSE 'z' END) AS a2
            FROM (
                SELECT w.*, f.i AS f_i, r, fault NOT IN ('blank', 'duplicate') AS sound, (fault = 'truncated')::INT AS cut, least(n, s, a) AS to_user
                FROM walk w JOIN faults f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1
            )
        )
    )
),
cheapest AS (
    SELECT conv_id, arg_max(least(n, a), i) AS best FROM walk GROUP BY conv_id
),
edits AS (SELECT conv_id, best[1:9]::BIGINT AS cost, best[10:] AS audit, unnest(range(1, len(best) - 8)) AS k FROM cheapest),
told AS (
    SELECT conv_id, audit, k, audit[k] AS edit, sum((audit[k] <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY k) AS i,
        sum((audit[k] <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY k) AS place
    FROM edits WHERE k <= len(audit)
),
lines AS (
    SELECT t.conv_id, k, edit, f.role, CASE edit WHEN 'I' THEN '' ELSE f.text END AS text,
        place + (NOT coalesce(bool_or(edit = 'K' AND place = 1 AND f.r = 's') OVER (PARTITION BY t.conv_id), false))::INT AS from_user
    FROM told t LEFT JOIN faults f ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.i = f.i WHERE edit <> 'D'
),
written AS (
    SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN from_user % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS repaired
    FROM lines GROUP BY conv_id
),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best[1:9]::BIGINT, 0) AS cost,
    coalesce(best[10:], '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN cheapest c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN counted n ON o.conv_id IS NOT DISTINCT FROM n.conv_id
LEFT JOIN written w ON o.conv_id IS NOT DISTINCT FROM w.conv_id
""",
}
