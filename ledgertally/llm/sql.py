"""DuckDB twins of the queries that SQL can express."""

_MIX = r"""
WITH sizes AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight
    FROM sizes GROUP BY source
), tried AS (
    -- sources in the order in which a growing share meets their caps; the first k are capped
    SELECT *, 3.0 * source_size / weight AS meets,
           (SELECT sum(source_size) FROM sources)
             - coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
           sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
    FROM sources
), shares AS (
    SELECT rest, weights FROM tried WHERE rest::DOUBLE * weight::DOUBLE / weights::DOUBLE < 3 * source_size ORDER BY meets, source LIMIT 1
), targets AS (
    SELECT source, source_size,
           coalesce(least(3.0 * source_size, (SELECT rest::DOUBLE * weight::DOUBLE / weights::DOUBLE FROM shares)), 0)::DOUBLE AS target
    FROM sources
), parts AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets
), ranked AS (
    SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
           (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || '/mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
    FROM sizes d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
), placed AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY u / (1 - u) / size, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
    FROM ranked WHERE size > 0
)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN upto - size / 2.0 <= rest AND rest > 0 THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM placed
UNION ALL
SELECT doc_id, size, source_size, target, 0::BIGINT FROM ranked WHERE size = 0
"""

_NEAR = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                                      ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
    FROM words
), shingles AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets
), links AS (
    SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reached AS (
    SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u
), least AS (
    SELECT u, min(v) AS component_id FROM reached GROUP BY u
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON doc_id = u
"""

_VECTORS = r"""
WITH RECURSIVE vectors AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
      AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS u, b.vec_id AS v FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reached AS (
    SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u
), least AS (
    SELECT u, min(v) AS component_id FROM reached GROUP BY u
), degrees AS (
    SELECT u, count(*) AS n FROM links GROUP BY u
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON vec_id = least.u LEFT JOIN degrees ON vec_id = degrees.u
"""

_PHRASES = r"""
WITH lists AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang,
                 unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
          FROM documents WHERE text IS NOT NULL)
), totals AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang
), places AS (
    SELECT lang, unnest(w) AS w1, unnest(list_concat(w[2:], [NULL])) AS w2, unnest(list_concat(w[3:], [NULL, NULL])[:len(w)]) AS w3 FROM lists
), one AS (
    SELECT lang, w1, count(*) AS f FROM places GROUP BY ALL
), two AS (
    SELECT lang, w1, w2, count(*) AS f FROM places WHERE w2 IS NOT NULL GROUP BY ALL
), three AS (
    SELECT lang, w1, w2, w3, count(*) AS f FROM places WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), longer AS (
    SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL
), cuts AS (
    SELECT two.lang, two.w1 || ' ' || two.w2 AS phrase, 1 AS k, two.f AS a, x.f AS l, y.f AS r
    FROM two JOIN one x ON x.lang = two.lang AND x.w1 = two.w1 JOIN one y ON y.lang = two.lang AND y.w1 = two.w2
    LEFT JOIN longer ON longer.lang = two.lang AND longer.w1 = two.w1 AND longer.w2 = two.w2
    WHERE two.f >= 10 AND 100 * coalesce(longer.f, 0) < 50 * two.f
    UNION ALL
    SELECT three.lang, three.w1 || ' ' || three.w2 || ' ' || three.w3, 1, three.f, x.f, y.f
    FROM three JOIN one x ON x.lang = three.lang AND x.w1 = three.w1 JOIN two y ON y.lang = three.lang AND y.w1 = three.w2 AND y.w2 = three.w3
    UNION ALL
    SELECT three.lang, three.w1 || ' ' || three.w2 || ' ' || three.w3, 2, three.f, x.f, y.f
    FROM three JOIN two x ON x.lang = three.lang AND x.w1 = three.w1 AND x.w2 = three.w2 JOIN one y ON y.lang = three.lang AND y.w1 = three.w3
), scored AS (
    SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts
    QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY (1000000::HUGEINT * a * a) // (l::HUGEINT * r), k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored JOIN totals USING (lang) QUALIFY rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op1_minhash": _NEAR, "op2_mix": _MIX, "op4_caps": _VECTORS, "op12_phrases": _PHRASES}
