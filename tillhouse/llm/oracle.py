"""The queries that SQL can express, as DuckDB runs them on the same tables."""

from __future__ import annotations

SUBSTRINGS = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), w AS (
  SELECT rid, doc_id, i, md5(array_to_string(ws[i + 1 : i + 50], ' ')) AS h
  FROM d, unnest(range(greatest(len(ws) - 49, 0))) AS t(i)
), least AS (
  SELECT h, min(doc_id) AS first_id FROM w GROUP BY h
), gone AS (
  SELECT DISTINCT rid, i + j AS p
  FROM w JOIN least USING (h), unnest(range(50)) AS t(j)
  WHERE first_id < doc_id
), lists AS (
  SELECT rid, list(p) AS ps FROM gone GROUP BY rid
), kept AS (
  SELECT d.rid, list(ws[k + 1] ORDER BY k) AS ks
  FROM d, unnest(range(len(ws))) AS t(k)
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.rid = d.rid AND gone.p = k)
  GROUP BY d.rid
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(ks, ' '), '')) AS kept_sha256
FROM d LEFT JOIN lists USING (rid) LEFT JOIN kept USING (rid)
"""

DECONTAMINATION = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), items AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i + 1 : i + least(len(ws), 10)], ' ') AS win
  FROM b, unnest(range(greatest(len(ws) - 9, 1))) AS t(i) WHERE len(ws) > 0
), spans AS (
  SELECT DISTINCT n FROM items
), windows AS (
  SELECT rid, i, n, array_to_string(ws[i + 1 : i + n], ' ') AS win
  FROM d, spans, unnest(range(greatest(len(ws) - n + 1, 0))) AS t(i)
), hits AS (
  SELECT rid, i, n, item_id FROM windows JOIN items USING (n, win)
), words AS (
  SELECT rid, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(n)) AS t(j) GROUP BY rid
), found AS (
  SELECT rid, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hits GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)
"""

WARC = r"""
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, ''))::BIGINT AS n FROM pages
), f AS (
  SELECT digest, min(page_id) AS original FROM p WHERE n >= 100 GROUP BY digest
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id IS NULL AND original IS NOT NULL OR page_id > original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS NULL OR page_id > original THEN original END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""

# Shared by the query of the quality rules and the pipeline.
QUALITY = r"""
d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), grams AS (
  SELECT rid, i, array_to_string(ws[i + 1 : i + 5], ' ') AS g FROM d, unnest(range(greatest(len(ws) - 4, 0))) AS t(i)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1
), repeats AS (
  SELECT rid, count(DISTINCT i + j) AS n FROM twice, unnest(range(5)) AS t(j) GROUP BY rid
), lines AS (
  SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dups
  FROM (SELECT rid, unnest(string_split(body, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), counts AS (
  SELECT rid, doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(lines.dups, 0)::BIGINT AS n_dup_lines, coalesce(lines.n, 0) AS n_lines,
         coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines USING (rid) LEFT JOIN repeats USING (rid)
), flags AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         100 * n_symbols > 10 * n_words AS symbols,
         100 * n_dup_lines > 30 * n_lines AS dup_lines,
         word_chars < 3 * n_words OR word_chars > 10 * n_words AS word_length
  FROM counts
), hosts AS (
  SELECT source, rule, count(*) AS n, sum(failed::BIGINT) AS f FROM (
    SELECT source, unnest(['base_failed', 'symbols', 'dup_lines', 'word_length']) AS rule,
           unnest([base_failed, symbols, dup_lines, word_length]) AS failed
    FROM flags WHERE source IS NOT NULL) GROUP BY source, rule
), prior AS (
  SELECT rule, m, CASE WHEN v > 0 THEN least(1e6, greatest(10.0, m * (1 - m) / v - 1)) ELSE 1e6 END AS s FROM (
    SELECT rule, m, q / t - m * m - m * (1 - m) * h / t AS v FROM (
      SELECT rule, sum(f) / sum(n) AS m, sum(f * f / n) AS q, sum(n) AS t, count(*) AS h FROM hosts GROUP BY rule))
), bad AS (
  SELECT source, rule FROM hosts JOIN prior USING (rule)
  WHERE (f + m * s) / (n + s) > CASE WHEN rule = 'base_failed' THEN 0.9 ELSE 0.5 END
), judged AS (
  SELECT flags.*, NOT base_failed AND NOT EXISTS (
    SELECT 1 FROM bad WHERE bad.source = flags.source AND (
      rule = 'base_failed' OR rule = 'symbols' AND symbols OR rule = 'dup_lines' AND dup_lines
      OR rule = 'word_length' AND word_length)) AS kept
  FROM flags
)
"""

QUALITY_RULES = f"""
WITH {QUALITY}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
       symbols, dup_lines, word_length FROM judged
"""

JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i + 1 : i + 5], ' ')) AS g
  FROM d, unnest(range(greatest(len(ws) - 4, 1))) AS t(i) WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 5 * c >= 4 * (x.n + y.n - c)
), reach(u, v) AS (
  SELECT u, v FROM links UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
), twins AS (
  SELECT doc_id, list(g ORDER BY g) AS l FROM s GROUP BY doc_id
), copies AS (
  SELECT doc_id, count(*) OVER (PARTITION BY l) AS copies FROM twins
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(copies, 1)::BIGINT AS copies,
       (SELECT count(*) FROM links WHERE u = d.doc_id)::BIGINT AS n_links,
       least(d.doc_id, coalesce((SELECT min(v) FROM reach WHERE u = d.doc_id), d.doc_id)) AS class_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN copies USING (doc_id)
"""

MERKLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '-') AS tree, text,
         CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR END
         || CASE WHEN source IS NULL THEN '-' ELSE strlen(source)::VARCHAR || ':' || source END
         || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang)::VARCHAR || ':' || lang END
         || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR END AS head,
         -- CRC-32 bit by bit: each byte enters with the first of its eight steps.
         xor(4294967295::BIGINT, list_reduce(
           [4294967295::BIGINT] || flatten(list_transform(
             string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
           lambda a, x: xor(xor(a, x) >> 1, 3988292384::BIGINT * (xor(a, x) & 1)))) AS crc
  FROM documents
), changed AS (
  SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM d
), leaves AS (
  SELECT rid, doc_id, tree,
         sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text)::VARCHAR || ':' || text END) AS leaf,
         sha256(head || CASE WHEN other IS NULL THEN '-' ELSE strlen(other)::VARCHAR || ':' || other END) AS changed
  FROM changed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos FROM leaves
), nodes AS (
  SELECT tree, 0 AS lvl, pos AS i, leaf AS h FROM placed
  UNION ALL
  SELECT tree, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes) WHERE n > 1 GROUP BY tree, lvl, i // 3
), subroots AS (
  SELECT tree, arg_max(h, lvl) AS subroot, max(lvl) AS height FROM nodes GROUP BY tree
), sources AS (
  SELECT *, row_number() OVER (ORDER BY tree) - 1 AS pos FROM subroots
), tops AS (
  SELECT 0 AS lvl, pos AS i, subroot AS h FROM sources
  UNION ALL
  SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER () AS n FROM tops) WHERE n > 1 GROUP BY lvl, i // 3
), root AS (
  SELECT arg_max(h, lvl) AS root, max(lvl) AS height FROM tops
), every AS (
  SELECT tree, lvl, i, h FROM nodes UNION ALL SELECT NULL, lvl, i, h FROM tops
), steps AS (
  SELECT rid, step, tree, lvl, (pos / power(3, lvl))::BIGINT AS place FROM (
    SELECT rid, lvl AS step, placed.tree, lvl, placed.pos - placed.pos % power(3, lvl)::BIGINT AS pos
    FROM placed JOIN subroots USING (tree), unnest(range(height)) AS t(lvl)
    UNION ALL
    SELECT rid, sources.height + lvl, NULL, lvl, sources.pos - sources.pos % power(3, lvl)::BIGINT
    FROM placed JOIN sources USING (tree), root, unnest(range(root.height)) AS t(lvl))
), siblings AS (
  SELECT rid, step, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < place), '') AS l,
         coalesce(string_agg(h, '' ORDER BY i) FILTER (i > place), '') AS r
  FROM steps JOIN every ON steps.tree IS NOT DISTINCT FROM every.tree AND steps.lvl = every.lvl AND i // 3 = place // 3
  GROUP BY rid, step
), folds AS (
  SELECT rid, 0::BIGINT AS step, changed AS h FROM placed
  UNION ALL
  SELECT rid, folds.step + 1, sha256(l || h || r) FROM folds JOIN siblings USING (rid, step)
), ends AS (
  SELECT rid, arg_max(h, step) AS folded_root FROM folds GROUP BY rid
), proofs AS (
  SELECT rid, string_agg(l || r, '' ORDER BY step) AS proof FROM siblings GROUP BY rid
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots USING (tree) JOIN ends USING (rid) LEFT JOIN proofs USING (rid) CROSS JOIN root
"""

EXACT = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW same AS (PARTITION BY text_sha256)
"""

SQL = {
    "op2_jaccard_join": JACCARD,
    "op3_substring_dedup": SUBSTRINGS,
    "op5_decontamination": DECONTAMINATION,
    "op6_warc": WARC,
    "op7_quality_rules": QUALITY_RULES,
    "op11_merkle_manifest": MERKLE,
    "op13_exact_dedup": EXACT,
}
