"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

BLOCK_TAGS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"

ORACLES: dict[str, str] = {
    "op2_line_dedup": rf"""
        WITH t AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
                regexp_replace(regexp_replace(html, '(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)', ' ', 'g'), '(?i)</?(?:{BLOCK_TAGS})\b[^<>]*>', chr(10), 'g') AS x FROM pages),
            u AS (SELECT page_id, host, array_to_string(list_filter(list_transform(string_split(regexp_replace(x, '<[^<>]*>', '', 'g'), chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda l: l <> ''), chr(10)) AS x FROM t),
            v AS (SELECT page_id, host, string_split(trim(replace(replace(replace(replace(replace(replace(
                x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(10) || ' '), chr(10)) AS lines FROM u),
            k AS (SELECT page_id, host, unnest(list_distinct(list_transform(lines, lambda l: trim(l, ' ')))) AS line FROM v),
            d AS (SELECT host, line FROM k JOIN (SELECT host, count(*) AS pages FROM v GROUP BY 1) USING (host) WHERE line <> ''
                  GROUP BY host, line, pages HAVING count(*) >= 3 AND count(*) > 0.05::DOUBLE * pages),
            h AS (SELECT host, list(line) AS gone FROM d GROUP BY 1),
            r AS (SELECT page_id, host, lines, list_filter(lines, lambda l: NOT list_contains(coalesce(gone, []), trim(l, ' '))) AS kept FROM v LEFT JOIN h USING (host))
        SELECT page_id, host, array_to_string(kept, chr(10)) AS text, len(lines)::INTEGER AS lines_in, (len(lines) - len(kept))::INTEGER AS lines_dropped FROM r
    """,
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
             d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS sha FROM p),
             bits AS (SELECT page_id, payload_bytes, sha, max(page_id) OVER (PARTITION BY sha) AS keeper FROM d)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + list_sum(list_transform(range(0, 5), lambda j:
                       ((('0x' || substr(sha, 1 + (5 * k + j) // 4, 1))::INTEGER >> (3 - (5 * k + j) % 4)) & 1) << (4 - j)))::INTEGER, 1)), '') AS payload_digest,
               CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keeper THEN keeper END AS refers_to
        FROM bits
    """,
    "op5_topk": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id,
                          list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
                   FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
    """,
    "op7_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                          ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix:' || coalesce(text, '')), 1, 13))::BIGINT AS draw FROM documents),
            r AS (SELECT doc_id, source, size, length(bin(size)) - 1 AS class, draw FROM d),
            s AS (SELECT source, sum(size)::BIGINT AS source_size, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w FROM r GROUP BY source),
            o AS (SELECT *, 2 * source_size / w AS ratio FROM s),
            f AS (SELECT *, coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
                         sum(w) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free_ FROM o),
            l AS (SELECT min_by(level, ratio) AS level FROM (SELECT ratio, (1.5 * (SELECT sum(source_size) FROM s) - full_)::DOUBLE / free_ AS level FROM f) WHERE level <= ratio),
            t AS (SELECT source, source_size, least(2.0 * source_size, w * coalesce(level, 1e300))::DOUBLE AS target FROM s, l),
            c AS (SELECT r.source, class, sum(size)::DOUBLE AS words, source_size, target, pow(2.0, -0.25 * class) AS h FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source GROUP BY ALL),
            q AS (SELECT *, (target - 2.0 * coalesce(sum(words) OVER (PARTITION BY source ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                            / sum(words * h) OVER (PARTITION BY source ORDER BY class ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS k FROM c WHERE words > 0 OR class = 0),
            m AS (SELECT source, min_by(k, class) AS k FROM q WHERE k * h <= 2 GROUP BY 1),
            e AS (SELECT c.*, round(greatest(0, CASE WHEN m.k IS NULL THEN 2 ELSE least(2, m.k * h) END), 9)::DOUBLE AS copies FROM c LEFT JOIN m ON c.source IS NOT DISTINCT FROM m.source),
            g AS (SELECT source, class, source_size, target, floor(copies) AS certain, copies - floor(copies) AS chance, target - sum(floor(copies) * words) OVER (PARTITION BY source) AS goal FROM e),
            u AS (SELECT r.doc_id, r.source, r.size, source_size, target, certain, chance, goal,
                         (draw + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS x
                  FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source AND r.class = g.class),
            p AS (SELECT *, CASE WHEN chance > 0 AND size > 0 THEN (x / (1 - x)) / (chance / (1 - chance)) END AS odds FROM u),
            n AS (SELECT *, sum(size) FILTER (odds IS NOT NULL) OVER (PARTITION BY source ORDER BY odds / (1 + odds) NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM p)
        SELECT doc_id, source, size, source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies
        FROM (SELECT *, CASE WHEN size = 0 THEN 0 ELSE certain + CASE WHEN odds IS NOT NULL AND upto - size / 2.0 <= goal THEN 1 ELSE 0 END END AS copies FROM n)
    """,
    "op9_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
            s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM w WHERE len(w) > 0)),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
            l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
                  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
            e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
            c AS (SELECT doc_id AS root, doc_id FROM documents UNION SELECT root, b FROM c JOIN e ON a = doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT doc_id, min(root) AS component_id FROM c GROUP BY 1) LEFT JOIN n USING (doc_id)
    """,
}
