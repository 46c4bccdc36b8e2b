"""What the corpus queries must return, as SQL over the same tables.

Plain and slow on purpose; these texts share no idea with the operators.
"""

from __future__ import annotations

# Fixed value: the word pattern of the contracts.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# Highest quotients claim / (2 a + 1), one seat each, within a group.
_SEATS = """
    SELECT {group}, {part}, count(*) FILTER (WHERE place <= seats) AS quota
    FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY claim / (2 * a + 1) DESC, {part}, a) AS place
          FROM (SELECT *, unnest(range(0, CAST(floor(claim * seats / total) AS BIGINT) + 3)) AS a
                FROM (SELECT *, sum(claim) OVER (PARTITION BY {group}) AS total FROM {parts}) WHERE claim > 0))
    GROUP BY {group}, {part}"""

ORACLE: dict[str, str] = {
    "word_token_counts": f"""
        SELECT source, lang, 'words@1' AS tokenizer,
               CAST(sum(CASE WHEN toxic THEN 0 ELSE len({_WORDS}) END) AS BIGINT) AS tokens,
               CAST(sum(CASE WHEN toxic THEN 0 ELSE 1 END) AS BIGINT) AS docs
        FROM (SELECT d.*, d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
              FROM documents d)
        GROUP BY source, lang
    """,
    "op2_decontamination": r"""
        WITH docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
        items AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
        item_grams AS (SELECT item_id, n, len(w) - n + 1 AS size, array_to_string(w[i:i + n - 1], ' ') AS g
                       FROM (SELECT *, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i
                             FROM items WHERE len(w) > 0)),
        wanted AS (SELECT item_id, n, size, g, count(*) AS times FROM item_grams GROUP BY ALL),
        doc_grams AS (SELECT doc_id, n, len(w) - n + 1 AS total, i - 1 AS pos, array_to_string(w[i:i + n - 1], ' ') AS g
                      FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i
                            FROM docs, (SELECT DISTINCT n FROM wanted) WHERE len(w) >= n)),
        hits AS (SELECT doc_id, item_id, size, times, pos, total, d.g FROM doc_grams d JOIN wanted i ON d.g = i.g AND d.n = i.n),
        windows AS (SELECT *, unnest(range(greatest(0, pos - span + 1), least(pos, total - span) + 1)) AS start
                    FROM (SELECT *, least(size, total) AS span FROM hits)),
        matched AS (SELECT doc_id, item_id, start, size, span, CAST(sum(least(seen, times)) AS BIGINT) AS common
                    FROM (SELECT doc_id, item_id, start, size, span, times, g, count(*) AS seen FROM windows GROUP BY ALL)
                    GROUP BY ALL),
        judged AS (SELECT *, common / (size + span - common) AS similarity FROM matched)
        SELECT doc_id, item_id, max(similarity) AS similarity,
               CAST(arg_min(start, (-similarity, start)) AS INTEGER) AS start, count(*) AS n_windows
        FROM judged WHERE similarity >= 0.8 GROUP BY doc_id, item_id
    """,
    "op3_set_join": f"""
        WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        sized AS (SELECT doc_id, w, least(5, len(w)) AS n FROM words WHERE len(w) > 0),
        grams AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + n - 1], ' ')) AS g
                  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
        sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '' ORDER BY g)) AS print FROM grams GROUP BY doc_id),
        links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
                                    FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
                  JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
                  WHERE shared >= 0.8 * (s.n + t.n - shared) - 1e-9),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
                  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        least_id AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(min(s.doc_id) OVER (PARTITION BY s.print), d.doc_id) AS class_id,
               (SELECT count(*) FROM links WHERE a = d.doc_id) AS n_links, component_id,
               component_id = d.doc_id AS kept
        FROM documents d JOIN least_id ON a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
    """,
    "op6_near_vectors": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0),
        links AS (SELECT x.vec_id AS a, y.vec_id AS b
                  FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
                  WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings
                  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        least_id AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT vec_id, (SELECT count(*) FROM links l WHERE l.a = vec_id) AS n_links, component_id,
               component_id = vec_id AS kept
        FROM embeddings JOIN least_id ON a = vec_id
    """,
    "op7_suffix_dedup": """
        WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        windows AS (SELECT doc_id, i, md5(h[2 * i + 1:2 * i + 200]) AS k
                    FROM (SELECT *, unnest(range(0, len(h) // 2 - 99)) AS i FROM bytes WHERE len(h) >= 200)),
        late AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM windows)
                 WHERE n > 1),
        runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b
                 FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM late)
                 GROUP BY doc_id, island),
        gone AS (SELECT DISTINCT doc_id, unnest(range(a, b)) AS p FROM runs),
        holes AS (SELECT doc_id, min(p) AS a, max(p) + 1 AS b
                  FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM gone)
                  GROUP BY doc_id, island),
        spans AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n, count(*) AS n_spans FROM holes GROUP BY doc_id),
        rests AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM holes
                  UNION ALL SELECT doc_id, max(b), 1000000000 FROM holes GROUP BY doc_id),
        kept AS (SELECT doc_id, string_agg(h[2 * s + 1:2 * e], '' ORDER BY s) AS h
                 FROM rests JOIN bytes USING (doc_id) GROUP BY doc_id)
        SELECT b.doc_id, len(b.h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(k.h, b.h))) AS kept_sha256
        FROM bytes b LEFT JOIN spans USING (doc_id) LEFT JOIN kept k USING (doc_id)
    """,
    "op8_mixing": f"""
        WITH sized AS (SELECT doc_id, source, coalesce('=' || source, '') AS key, len({_WORDS}) AS size,
                              md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ticket FROM documents),
        sums AS (SELECT key, max(source) AS source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs
                 FROM sized GROUP BY key),
        weighted AS (SELECT *, source_size * 3 AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS everything,
                            [1, 2, 3][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight,
                            row_number() OVER (ORDER BY source IS NULL, source) AS no FROM sums),
        placed AS (SELECT *, row_number() OVER (ORDER BY cap / weight, no) AS place FROM weighted),
        levels AS (SELECT *, (everything - coalesce(CAST(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING
                              AND 1 PRECEDING) AS BIGINT), 0))
                            / CAST(sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                                   AS BIGINT) AS level FROM placed),
        aimed AS (SELECT *, least(CAST(cap AS DOUBLE), (SELECT arg_min(level, place) FROM levels
                                                      WHERE level * weight <= cap) * weight) AS target FROM levels),
        claims AS (SELECT 0 AS everyone, key, target AS claim, CAST(floor(everything / 16) AS BIGINT) AS seats
                   FROM aimed),
        quotas AS ({_SEATS.format(group="everyone", part="key", parts="claims")}),
        spread AS (SELECT s.*, a.source_size, a.target, coalesce(q.quota, 0) AS own_seats,
                          CAST('0x' || substr(ticket, 1, 12) AS BIGINT) % CAST(ceil(a.docs / 4096) AS BIGINT) AS shard
                   FROM sized s JOIN aimed a USING (key) LEFT JOIN quotas q USING (key)),
        shards AS (SELECT key, shard, CAST(sum(size) AS DOUBLE) AS claim, CAST(sum(size) AS BIGINT) AS words,
                          any_value(own_seats) AS seats FROM spread GROUP BY key, shard),
        shares AS ({_SEATS.format(group="key", part="shard", parts="shards")}),
        quota AS (SELECT h.key, h.shard, words, least(coalesce(quota, 0) * 16, words * 3) AS q
                  FROM shards h LEFT JOIN shares USING (key, shard)),
        lined AS (SELECT *, CAST(sum(size) OVER (PARTITION BY key, shard ORDER BY ticket, doc_id, size
                                  ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start,
                         CASE WHEN words > 0 THEN q // words ELSE 0 END AS rounds
                  FROM spread JOIN quota USING (key, shard))
        SELECT doc_id, size, source_size, target,
               CAST(rounds * size + greatest(0, least(start + size, q - rounds * words) - start) AS BIGINT) AS taken
        FROM lined
    """,
    "op10_substrings": f"""
        WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k
                    FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
        earliest AS (SELECT k, min(doc_id) AS d FROM windows GROUP BY k),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
                 FROM windows JOIN earliest USING (k) WHERE d < doc_id),
        each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
                 FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
               sha256(coalesce(text, '')) AS kept_sha256
        FROM words LEFT JOIN kept USING (doc_id)
    """,
    # The pages mark their articles; references in them are those replaced here.
    "op11_html_extraction": r"""
        WITH parts AS (SELECT page_id, url, unnest(regexp_split_to_array(
                              regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1),
                              '</?(?:p|h1)>')) AS part,
                              generate_subscripts(regexp_split_to_array(
                              regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1),
                              '</?(?:p|h1)>'), 1) AS i FROM pages),
        shown AS (SELECT page_id, url, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(
                         part, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'),
                         '[\s\x0b]+', ' ', 'g')) AS line FROM parts),
        texts AS (SELECT page_id, url, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE line <> ''), '') AS text
                  FROM shown GROUP BY page_id, url)
        SELECT page_id, url, text, length(text) AS n_chars FROM texts
    """,
    "op12_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text,
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
                        FROM documents),
        words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g
                  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i
                        FROM words, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k)),
        f AS (SELECT lang, k, g, count(*) AS a FROM grams GROUP BY ALL),
        totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        often AS (SELECT lang, k, g, a, string_split(g, ' ') AS w FROM f WHERE k >= 2 AND a >= 10),
        cuts AS (SELECT lang, g, a, c, array_to_string(w[1:c], ' ') AS first, array_to_string(w[c + 1:k], ' ') AS rest
                 FROM (SELECT *, unnest(range(1, k)) AS c FROM often)),
        scored AS (SELECT u.lang, u.g, u.a, u.c, x.a AS l, y.a AS r,
                          (1000000::HUGEINT * u.a * u.a) // (x.a::HUGEINT * y.a) AS score
                   FROM cuts u JOIN f x ON x.lang = u.lang AND x.g = u.first JOIN f y ON y.lang = u.lang AND y.g = u.rest),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
        held AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS g, a
                 FROM (SELECT *, unnest([1, 2]) AS i FROM often WHERE k = 3)),
        holders AS (SELECT lang, g, max(a) AS longer FROM held GROUP BY ALL),
        ranked AS (SELECT t.lang, s.g AS phrase, s.a, s.l, s.r, t.n, CAST(s.score AS BIGINT) AS score,
                          row_number() OVER (PARTITION BY t.lang ORDER BY s.score DESC, s.a DESC, s.g) AS rank
                   FROM lowest s JOIN totals t ON t.lang = s.lang
                   LEFT JOIN holders h ON h.lang = s.lang AND h.g = s.g
                   WHERE coalesce(100 * h.longer < 50 * s.a, true))
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
    """,
}
