"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .block_neighbours import nearest_neighbours
from .common import read
from .chunk_dedup import exact_dedup
from .lattice_dedup import embedding_groups
from .license_scan import BASE_PHRASES, TEMPLATES, scan_licenses
from .pairwise_quality import score_quality
from .pfair_mix import mix_sources, root_weights
from .phrase_mining import collocations
from .piece_tokenizer import encode_texts, load_vocabulary
from .repeat_spans import remove_repeats
from .simhash import simhash_groups
from .target_resample import resample_to_target
from .token_spans import attribute_tokens, sentences
from .url_filter import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


URL_SQL = r"""
WITH parts AS (
  SELECT page_id, strpos(url, '://') AS pos, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
hosts AS (
  SELECT page_id, CASE WHEN pos > 0 THEN regexp_extract(rest, '^[^/?#]*', 0) ELSE '' END AS h,
         CASE WHEN pos > 0 THEN rest ELSE '' END AS rest FROM parts),
urls AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*', 0) AS path FROM hosts),
rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (
  SELECT u.page_id, u.host, u.path, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS rn
  FROM urls u LEFT JOIN rules r
    ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best WHERE rn = 1
"""


@query("op2_url_filter", URL_SQL)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


CHUNK_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""


@query("op5_exact_dedup", CHUNK_SQL)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def _strings(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


LICENSE_SQL = r"""
WITH templates(id, base, label, words, phrase, phrase_at) AS (VALUES %s),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
entries AS (SELECT DISTINCT id, phrase, phrase_at, unnest(phrase) AS word FROM templates),
places AS (
  SELECT r, word, p FROM (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d)
  WHERE word IN (SELECT word FROM entries)),
df AS (SELECT word, count(DISTINCT r) AS n FROM places GROUP BY word),
rare AS (
  SELECT id, word, phrase_at + list_position(phrase, word) AS nth FROM entries LEFT JOIN df USING (word)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(n, 0), word) <= 3),
starts AS (SELECT r, id, p - nth AS s, count(*) AS agree FROM places JOIN rare USING (word) GROUP BY ALL),
found AS (
  SELECT r, base, label, s,
         CASE WHEN s < 0 THEN 0 ELSE
           list_sum(list_transform(range(1, len(words) + 1), lambda i: CASE WHEN ws[s + i] = words[i] THEN 1 ELSE 0 END)) / len(words)
         END AS part
  FROM starts JOIN templates USING (id) JOIN d USING (r)
  WHERE (agree >= 2 OR words = phrase) AND s + phrase_at >= 0
    AND ws[s + phrase_at + 1 : s + phrase_at + len(phrase)] = phrase),
facts AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, coalesce(max(part) FILTER (NOT base), 0) AS best
  FROM found GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(round(CASE WHEN n_base > 0 THEN greatest(best, 0.5) ELSE coalesce(best, 0) END, 6) AS DOUBLE) AS score
FROM d LEFT JOIN facts USING (r)
""" % ", ".join(
    f"({i}, {i < len(BASE_PHRASES)}, '{t.label}', {_strings(t.words)}, {_strings(t.phrase)}, {t.phrase_at})"
    for i, t in enumerate([*BASE_PHRASES, *TEMPLATES])
)


@query("op6_license_scan", LICENSE_SQL)
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"), BASE_PHRASES, TEMPLATES)


@query("op7_pfair_mix")
def op7_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mix_sources(docs, root_weights(docs)).select("doc_id", "source", "block", "phase", "release", "deadline", "slot")


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"), words=3, max_bits=3)


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op3_token_spans")
def op3_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute_tokens(read(spark, sf_dir, "documents"), rule="most", split=sentences)


@query("op4_lattice_dedup")
def op4_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(read(spark, sf_dir, "embeddings"), cosine=0.9)


@query("op8_piece_tokenizer")
def op8_piece_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(read(spark, sf_dir, "documents"), load_vocabulary())


REPEAT_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
windows AS (
  SELECT r, doc_id, unnest(range(1, len(ws) - 11)) AS j,
         unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i : i + 12], ' '))) AS w FROM d),
least AS (SELECT w, min(doc_id) AS first_doc FROM windows GROUP BY w),
gone AS (
  SELECT r, list(DISTINCT p) AS g
  FROM (SELECT r, unnest(range(j, j + 13)) AS p FROM windows JOIN least USING (w) WHERE first_doc < doc_id) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(ws, lambda x, i: NOT coalesce(list_contains(g, i), false)), ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""


@query("op9_repeat_spans", REPEAT_SQL)
def op9_repeat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), k=13)


LOWER_SQL = "translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# crc32 is linear: a byte's part depends on its distance from the end, that of the start value on the length
RESAMPLE_SQL = r"""
WITH RECURSIVE
steps(b, i, v) AS (
  SELECT CAST(b AS UBIGINT), 0, CAST(b AS UBIGINT) FROM range(256) t(b)
  UNION ALL
  SELECT b, i + 1, CASE WHEN v %% 2 = 1 THEN xor(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END FROM steps WHERE i < 8),
tab AS (SELECT b, v FROM steps WHERE i = 8),
texts AS (
  SELECT false AS target, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT true, -row_number() OVER (), NULL, text FROM benchmark),
words AS (SELECT target, r, doc_id, regexp_extract_all(%s, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
feats AS (
  SELECT target, r, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS f FROM words),
each AS (SELECT f, hex(encode(f)) AS h, CAST(length(hex(encode(f))) // 2 AS BIGINT) AS size FROM (SELECT DISTINCT f FROM feats)),
part(k, b, v) AS (
  SELECT CAST(0 AS BIGINT), b, v FROM tab
  UNION ALL
  SELECT k + 1, p.b, xor(p.v >> 8, t.v) FROM part p JOIN tab t ON t.b = p.v %% 256 WHERE k + 1 < (SELECT max(size) FROM each)),
start(k, v) AS (
  SELECT CAST(0 AS BIGINT), CAST(4294967295 AS UBIGINT)
  UNION ALL
  SELECT k + 1, xor(s.v >> 8, t.v) FROM start s JOIN tab t ON t.b = s.v %% 256 WHERE k < (SELECT max(size) FROM each)),
bytes AS (
  SELECT f, size, size - 1 - i AS k, CAST('0x' || substr(h, 2 * i + 1, 2) AS UBIGINT) AS b
  FROM (SELECT f, h, size, unnest(range(size)) AS i FROM each)),
sums AS (SELECT f, any_value(size) AS size, bit_xor(p.v) AS v FROM bytes JOIN part p USING (k, b) GROUP BY f),
hashed AS (SELECT f, xor(xor(sums.v, start.v), CAST(4294967295 AS UBIGINT)) %% 10000 AS bucket FROM sums JOIN start ON start.k = size),
placed AS (SELECT target, r, bucket FROM feats JOIN hashed USING (f)),
counted AS (SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM placed GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counted) + 10000)::DOUBLE
         / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counted) + 10000)::DOUBLE))) AS g FROM counted),
weights AS (SELECT r, floor(sum(g) / count(*)) AS w FROM placed JOIN gain USING (bucket) WHERE NOT target GROUP BY r),
scored AS (
  SELECT doc_id, len(ws) AS n_words, CAST(greatest(2 * len(ws) - 1, 0) AS BIGINT) AS n_features, CAST(coalesce(w, 0) AS BIGINT) AS weight,
         CAST(coalesce(w, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS UBIGINT)::DOUBLE + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (r) WHERE NOT target),
ranks AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= 25 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN place END AS rank
FROM ranks
""" % (LOWER_SQL % "coalesce(text, '')")


@query("op11_resample", RESAMPLE_SQL)
def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_to_target(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), percent=25, seed=7, min_words=20)


NEIGHBOUR_SQL = r"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda x, y: x + y) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER near AS INTEGER) AS rank, vec_id, score FROM pairs
WINDOW near AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER near <= 20
"""


@query("op12_neighbours", NEIGHBOUR_SQL)
def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


COLLOCATION_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(%s, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i : i + size - 1], ' '))) AS phrase
  FROM words, range(1, 5) t(size)),
f AS (SELECT lang, phrase, any_value(size) AS size, count(*) AS f FROM grams GROUP BY lang, phrase HAVING count(*) >= 30),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM words GROUP BY lang),
long AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM long)),
scored AS (
  SELECT c.lang, c.phrase, a, k, h.f AS l, t.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (CAST(h.f AS HUGEINT) + t.f) AS BIGINT) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[pos : pos + part - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, part, unnest(range(1, size - part + 2)) AS pos FROM (SELECT *, unnest(range(2, size)) AS part FROM long)) GROUP BY ALL),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
""" % (LOWER_SQL % "coalesce(text, '')")


@query("op13_collocations", COLLOCATION_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"), least=30, most_words=4, top=2000, percent=80)
