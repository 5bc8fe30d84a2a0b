"""DuckDB SQL for the numbered queries whose whole result SQL can say: not models, seeded shuffles, XXH64 fingerprints or public vocabularies."""

ORACLE: dict[str, str] = {
    "op2_substring_dedup": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, i, list_slice(words, i, i + 19) AS k FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 19)) AS i FROM w WHERE len(words) >= 20) x),
firsts AS (SELECT k, min({'d': doc_id, 'i': i}) AS f FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (SELECT doc_id, list_distinct(flatten(list(generate_series(i, i + 19)))) AS g FROM windows v JOIN firsts f ON f.k = v.k AND {'d': v.doc_id, 'i': v.i} > f.f GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
sha256(coalesce(array_to_string(CASE WHEN g IS NULL THEN words ELSE list_filter(list_transform(words, lambda x, n: CASE WHEN list_contains(g, n) THEN NULL ELSE x END), lambda x: x IS NOT NULL) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id""",
    "op6_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), q AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS main FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < main THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < main THEN main END AS refers_to FROM r""",
    "op12_phrases": r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d) x),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS a FROM (SELECT lang, k, unnest(list_transform(generate_series(1, len(ws) - k + 1), lambda i: array_to_string(list_slice(ws, i, i + k - 1), ' '))) AS phrase FROM w, range(1, 6) ks(k) WHERE len(ws) >= k) x GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT c.lang, c.k, c.phrase, c.a, l.a AS l, r.a AS r, n, j, ((1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score
FROM (SELECT f.*, string_split(phrase, ' ') AS ws, unnest(generate_series(1, k - 1)) AS j FROM f WHERE k > 1) c JOIN total ON total.lang = c.lang
JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[j + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM best o WHERE o.lang = b.lang AND o.a = b.a AND o.k > b.k AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= 2000""",
    "op13_search": r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
tf AS (SELECT doc_id, len(ts) AS n, term, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS term FROM d) x GROUP BY doc_id, n, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
FROM q JOIN df ON df.term = q.term JOIN tf ON tf.term = q.term, c GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50""",
}
