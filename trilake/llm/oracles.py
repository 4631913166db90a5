"""SQL for the numbered queries that SQL can express, written from their contracts."""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
NORMAL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {}

ORACLE["op2_mixing"] = rf"""
WITH d AS (
    SELECT doc_id, source, len({WORDS}) AS size, md5(concat('42:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS key
    FROM documents
), s AS (
    SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank
    FROM d GROUP BY source
), w AS (
    SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s
), l AS (
    SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM w
), t AS (
    SELECT *, least(CAST(cap AS DOUBLE), weight * max(level) OVER ()) AS target FROM l
), b AS (
    SELECT *, CAST(greatest(1, least(2048, floor(min(CASE WHEN target > 0 THEN target END) OVER () / 200))) AS BIGINT) AS block,
        count(*) OVER () AS n
    FROM t
), q AS (
    SELECT rank, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank, k) AS place, floor(total / block + 0.5) AS blocks
    FROM (
        SELECT rank, target, total, block, unnest(range(0, CAST(floor(target / block) + n + 2 AS BIGINT))) AS k
        FROM b WHERE target > 0
    )
), seats AS (
    SELECT rank, count(*) AS seats FROM q WHERE place <= blocks GROUP BY rank
), quotas AS (
    SELECT rank, shard, count(*) FILTER (place <= blocks * shard // 16) AS upto
    FROM (SELECT rank, place, CAST(blocks AS BIGINT) AS blocks, unnest(range(1, 17)) AS shard FROM q) GROUP BY rank, shard
), placed AS (
    SELECT d.doc_id, d.source, d.size, b.rank, b.source_size, b.target, b.block,
        least(b.cap, coalesce(seats, 0) * b.block) AS words,
        coalesce(sum(d.size) OVER (PARTITION BY b.rank ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN seats ON seats.rank = b.rank
)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
    CAST(greatest(0, least(size, words - start)) + greatest(0, least(size, words - start - source_size))
        + greatest(0, least(size, words - start - 2 * source_size)) AS BIGINT) AS taken,
    block,
    CASE WHEN least(size, words - start) > 0
        THEN CAST((SELECT count(*) FROM quotas WHERE quotas.rank = placed.rank AND upto * placed.block <= placed.start) AS INTEGER) END AS shard
FROM placed
"""

ORACLE["op4_decontaminate"] = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {NORMAL_WORDS} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {NORMAL_WORDS} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS words
    FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)
),
found AS (
    SELECT x.row, x.i, x.size, windows.item
    FROM (
        SELECT row, i, size, array_to_string(w[i : i + size - 1], ' ') AS words
        FROM (
            SELECT row, w, size, unnest(range(1, CAST(len(w) - size + 2 AS BIGINT))) AS i
            FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size
        )
    ) x JOIN windows USING (size, words)
),
hits AS (SELECT row, count(DISTINCT pos) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS pos FROM found) GROUP BY row),
of AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT row, item FROM found) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (row) LEFT JOIN of USING (row)
"""

ORACLE["op5_warc"] = r"""
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS size,
        regexp_replace(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(www\.)?', '') AS rest
    FROM pages
), f AS (
    SELECT *, CASE WHEN size >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first_id,
        count(*) OVER (PARTITION BY html) AS n
    FROM p
), r AS (
    SELECT *, CASE WHEN n > 1 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM f
)
SELECT page_id, size AS payload_bytes, sha256(html) AS payload_digest,
    CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to,
    concat(array_to_string(list_reverse(string_split(regexp_extract(rest, '^([^/?#]*)', 1), '.')), ','), ')',
        regexp_extract(rest, '^[^/?#]*(.*)$', 1)) AS url_key,
    1704067200 + page_id % 1000000000 AS captured_epoch
FROM r
"""

ORACLE["op8_repetition"] = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
win AS (SELECT row, i, md5(array_to_string(w[i : i + 4], ' ')) AS h FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT row, i, count(*) OVER (PARTITION BY row, h) AS n FROM win),
repeated AS (SELECT row, count(DISTINCT pos) AS n FROM (SELECT row, unnest(range(i, i + 5)) AS pos FROM twice WHERE n > 1) GROUP BY row),
lines AS (
    SELECT row, line, count(*) AS n
    FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row, line
),
dup AS (SELECT row, sum(n - 1) AS n FROM lines GROUP BY row),
steps AS (
    -- runs that start at neighbouring places and repeat at the same distance are one longer run
    SELECT a.row, a.i, b.i AS j FROM win a JOIN win b ON a.row = b.row AND a.h = b.h AND a.i < b.i
),
runs AS (SELECT row, count(*) + 4 AS n FROM (SELECT row, j - i AS shift, i - row_number() OVER (PARTITION BY row, j - i ORDER BY i) AS start FROM steps) GROUP BY row, shift, start),
short AS (
    SELECT row, max(size) AS n FROM (
        SELECT row, size FROM (
            SELECT row, size, array_to_string(w[i : i + size - 1], ' ') AS g
            FROM (SELECT row, w, size, unnest(range(1, CAST(len(w) - size + 2 AS BIGINT))) AS i FROM d, range(1, 5) s(size) WHERE len(w) >= size)
        ) GROUP BY row, size, g HAVING count(*) > 1
    ) GROUP BY row
),
longest AS (SELECT row, max(n) AS n FROM (SELECT row, n FROM runs UNION ALL SELECT row, n FROM short) GROUP BY row),
m AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(longest.n, 0) AS BIGINT) AS longest_repeat
    FROM d LEFT JOIN dup USING (row) LEFT JOIN repeated USING (row) LEFT JOIN longest USING (row)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND longest_repeat <= 100 AS kept
FROM m
"""

ORACLE["op9_chat"] = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

#: Checksums go byte by byte through a table made from the polynomial.
ORACLE["op13_resampling"] = rf"""
WITH crc_table AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
    FROM range(256) t(i)
), d AS (
    SELECT true AS corpus, row_number() OVER () AS row, doc_id, {NORMAL_WORDS} AS w FROM documents
    UNION ALL SELECT false, row_number() OVER (), NULL, {NORMAL_WORDS} FROM benchmark
), runs AS (
    SELECT corpus, row, array_to_string(w[i : i + n - 1], ' ') AS run
    FROM (SELECT corpus, row, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, range(1, 4) s(n) WHERE len(w) >= n)
), counted AS (
    SELECT corpus, row, run, count(*) AS n FROM runs GROUP BY corpus, row, run
), distinct_runs AS (
    SELECT run, hex(encode(run)) AS h FROM (SELECT DISTINCT run FROM counted)
), sums AS (
    SELECT run, xor(list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(h), 2), lambda i: 16 * (strpos('0123456789ABCDEF', h[i]) - 1) + strpos('0123456789ABCDEF', h[i + 1]) - 1)),
        lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
    FROM distinct_runs, crc_table
), features AS (
    SELECT corpus, row, bucket, n FROM counted JOIN sums USING (run)
), gains AS (
    SELECT bucket, floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (sum(s) OVER () + 10000) / ((CAST(s AS DOUBLE) + 1) * (sum(t) OVER () + 10000)))) AS gain
    FROM (SELECT bucket, sum(CASE WHEN corpus THEN n ELSE 0 END) AS s, sum(CASE WHEN corpus THEN 0 ELSE n END) AS t FROM features GROUP BY bucket)
), weighed AS (
    SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM features JOIN gains USING (bucket) WHERE corpus GROUP BY row
), scored AS (
    SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST(concat('0x', sha256(concat('42:', coalesce(CAST(doc_id AS VARCHAR), '')))[1:8]) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score
    FROM d LEFT JOIN weighed USING (row) WHERE corpus
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, n_words, weight) AS place,
        count(*) OVER (PARTITION BY n_words >= 20) AS able
    FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * able // 100 THEN place END AS rank FROM placed
"""
