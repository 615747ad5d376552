"""The queries that SQL can express, on DuckDB, by plainer ways than the operators take."""

from __future__ import annotations

from courtline.llm import secrets
from courtline.llm.centroids import CLUSTERS, ROUNDS, SEED, SIZE
from courtline.llm.centroids import SCALE as CENTROID_SCALE
from courtline.llm.collocations import INSIDE, LEAST, LONGEST, SCALE, TOP
from courtline.llm.near_duplicates import PERCENT, SHINGLE
from courtline.llm.quality_rules import BUCKETS, MIN_MICRO, PSEUDO
from courtline.llm.substring_dedup import WINDOW

_WORD = r"[^\x20\x09-\x0D]+"
_WORDS = f"SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents"
def _half_byte(value: int) -> int:
    """Remainder of a half byte by the reflected CRC-32 polynomial."""
    for _ in range(4):
        value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
    return value


_CRC = str([_half_byte(v) for v in range(16)])


def _crc32(column: str) -> str:
    """CRC-32 of a text, half byte by half byte, the lower half first."""
    digits = f"hex(encode({column}))"
    halves = (
        f"list_transform(range(1, length({digits}) + 1), lambda i: CAST(strpos('0123456789ABCDEF', "
        f"{digits}[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) - 1 AS BIGINT))"
    )
    step = f"lambda c, x: xor(({_CRC})[(xor(c, x) & 15) + 1], c >> 4)"
    return f"xor(list_reduce(list_prepend(4294967295, {halves}), {step}), 4294967295)"


QUALITY = f"""
WITH w AS ({_WORDS}),
grams AS (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS g FROM w),
coded AS (SELECT g, {_crc32("g")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT g FROM grams)),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
counted AS (SELECT bucket, count(*) AS r, count(CASE WHEN doc_id IN (SELECT doc_id FROM good) THEN 1 END) AS t FROM grams JOIN coded USING (g) GROUP BY bucket),
totals AS (SELECT sum(r) + {PSEUDO * BUCKETS} AS raw, sum(t) + {PSEUDO * BUCKETS} AS trusted FROM counted),
micro AS (SELECT bucket, CAST(round((ln((t + {PSEUDO}) / trusted) - ln((r + {PSEUDO}) / raw)) * 1000000) AS BIGINT) AS m FROM counted, totals),
scored AS (SELECT doc_id, CAST(sum(m) AS BIGINT) AS total, count(*) AS n FROM grams JOIN coded USING (g) JOIN micro USING (bucket) GROUP BY doc_id),
threes AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM threes) WHERE c > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(3) AS d(j) GROUP BY doc_id),
base AS (
    SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines, coalesce(repeated.n, 0) AS n_repeat_words
    FROM w LEFT JOIN repeated USING (doc_id)
),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words,
    base_failed, coalesce(CAST(total AS DOUBLE) / n, 0) AS score_micro,
    NOT base_failed AND coalesce(total, 0) >= {MIN_MICRO} * coalesce(n, 0) AS kept
FROM judged LEFT JOIN scored USING (doc_id)"""

SUBSTRINGS = f"""
WITH w AS ({_WORDS}),
windows AS (SELECT doc_id, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM later, range({WINDOW}) AS d(j)),
stay AS (SELECT doc_id, p, x FROM (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w) ANTI JOIN gone USING (doc_id, p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM stay GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

_SHINGLES = " || ' ' || ".join(f"ws[i + {j}]" for j in range(SHINGLE))
NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents
),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {SHINGLE} THEN list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: {_SHINGLES})
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, sides.b FROM reach JOIN sides ON sides.a = reach.r)
SELECT d AS doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id, d = min(r) AS kept
FROM reach LEFT JOIN n ON n.doc_id = d GROUP BY d"""

_GRAMS = " UNION ALL ".join(
    f"SELECT lang, {n} AS size, array_to_string(ws[i : i + {n - 1}], ' ') AS phrase "
    f"FROM (SELECT lang, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w)" for n in range(1, LONGEST + 1)
)
COLLOCATIONS = f"""
WITH d AS (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d)),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, size, phrase, count(*) AS c, string_split(phrase, ' ') AS ws FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (
    SELECT lang, phrase, c AS a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail
    FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1)
),
scored AS (
    SELECT cuts.*, x.c AS l, y.c AS r, CAST(({SCALE}::HUGEINT * a) // (x.c + y.c) AS BIGINT) AS score
    FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = head JOIN f AS y ON y.lang = cuts.lang AND y.phrase = tail
),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
spans AS (SELECT lang, c, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM f WHERE size > 2)),
inner_most AS (SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, max(c) AS longer FROM spans GROUP BY 1, 2),
kept AS (SELECT worst.* FROM worst LEFT JOIN inner_most AS s USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < {INSIDE} * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}"""


def _assigned(i: int) -> str:
    """Nearest of the centroids ``c{i}`` for each vector, then the centroids of the next round."""
    return f"""
a{i} AS MATERIALIZED (
    SELECT id, vec_id, e, c, d FROM (
        SELECT v.*, c.c, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{i} AS c
    ) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1
),
s{i} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM a{i}) GROUP BY c, j),
m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS e FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.e, c.e) AS e FROM c{i} AS c LEFT JOIN m{i} AS m USING (c))"""


CENTROIDS = f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor({CENTROID_SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}
),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, e) - 1 AS c, e FROM v
    QUALIFY c < {CLUSTERS}
),{",".join(_assigned(i) for i in range(ROUNDS + 1))}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
    CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.e, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} AS k USING (c)"""

SQL = {
    "op1_quality_rules": QUALITY, "op2_substring_dedup": SUBSTRINGS, "op3_secret_scans": secrets.sql(),
    "op10_near_duplicates": NEAR_DUPLICATES, "op11_collocations": COLLOCATIONS, "op12_centroids": CENTROIDS,
}
