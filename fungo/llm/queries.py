"""The registered queries of this subpackage: thin digests over the operators' real outputs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .align import align_documents
from .common import read_table, shared_path
from .decontam import contaminated, find_contamination
from .html_extract import extract_main_text
from .langid import identify
from .linededup import dedup_lines
from .minhash import near_duplicate_sets
from .quality import judge_quality
from .secrets import KINDS, find_secrets
from .sharding import shard_digest, write_shards
from .simhash import hex_of, near_duplicates
from .spelling import group_variants
from .spm import encode_documents
from .urlfilter import filter_urls

#: Files of the public tokenizers on the driver; operators take such paths as parameters.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BPE_PATTERN = public_tokenizers.PATTERN
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark, sf_dir):
    out = write_shards(read_table(spark, sf_dir, "documents"), shared_path(spark), n_shards=16)
    return out.select(*shard_digest())


def op2_html_extraction(spark, sf_dir):
    return extract_main_text(read_table(spark, sf_dir, "pages"))


def op3_quality_rules(spark, sf_dir):
    out = judge_quality(read_table(spark, sf_dir, "documents"), PIECE_MODEL, BPE_RANKS, BPE_PATTERN)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_piece", "chars_bpe", "byte_share", "entropy", "script")


def quality_base(spark, sf_dir):
    """What SQL can say of op3_quality_rules too."""
    return op3_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op4_simhash_near_dedup(spark, sf_dir):
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


def op5_language_id(spark, sf_dir):
    return identify(read_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark, sf_dir):
    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


#: The contract's rules, host and path: verdict.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op7_url_filters(spark, sf_dir):
    return filter_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def url_rules(spark, sf_dir):
    """What SQL can say of op7_url_filters too: the given rules and the verdicts of urls that they decide."""
    found = op7_url_filters(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("given"))


def op8_sentencepiece(spark, sf_dir):
    return encode_documents(read_table(spark, sf_dir, "documents"), PIECE_MODEL)


def op9_secret_scans(spark, sf_dir):
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, KINDS))
    rows = F.arrays_zip("kinds", "starts", "ends")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kinds"] + 1), s["starts"].cast("string"), s["ends"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("kinds", lambda x: x == KINDS.index(kind))).cast("long")

    base = F.filter(rows, lambda s: s["kinds"] < KINDS.index("model"))
    return found.select("doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"), F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(rows).alias("spans"))


def secrets_base(spark, sf_dir):
    """What SQL can say of op9_secret_scans too: the spans of the fixed patterns."""
    return op9_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def op10_decontamination(spark, sf_dir):
    out = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.encode(F.concat_ws(",", "items"), "UTF-8"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), contaminated().alias("contaminated"))


def op11_minhash_near_dedup(spark, sf_dir):
    return near_duplicate_sets(read_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op12_cross_tokenizer_alignment(spark, sf_dir):
    out = align_documents(read_table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_MODEL)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_spelling_variants(spark, sf_dir):
    return group_variants(read_table(spark, sf_dir, "documents"), min_chars=6, min_n=5, times=5, typo_every=199)


OP1_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS step
), sized AS (
  SELECT doc_id, coalesce(text, '') AS body, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size FROM documents
), placed AS (
  SELECT *, row_number() OVER w AS place, sum(size) OVER w AS upto, sum(size) OVER () AS total
  FROM sized WINDOW w AS (ORDER BY substr(md5(body), 1, 15), doc_id ROWS UNBOUNDED PRECEDING)
), dealt AS (
  -- boundary j of 16 lies before a row if it is as near to that row's beginning as to its end
  SELECT *, CAST(least(15, (2 * upto - size) * 8 // total) AS INT) AS shard FROM placed
)
SELECT doc_id, size,
       CAST(xor(list_reduce(list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS BIGINT) AS text_crc32,
       'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM dealt, crc
"""

QUALITY_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, s, w[s] AS a, w[s + 1] AS b, w[s + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM w WHERE len(w) >= 3))
), repeated AS (
  SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest([s, s + 1, s + 2]) AS x FROM windows WHERE n > 1) GROUP BY doc_id
), counted AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN repeated r ON w.doc_id = r.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
FROM counted
"""

URL_SQL = r"""
WITH rest AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '(?s)^[^/?#]*(/[^?#]*)', 1) AS path FROM rest
), rules(rule, given, h, p) AS (
  VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')
), fits AS (
  SELECT page_id, rule, given, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, rule) AS n
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT parts.page_id, host, path, rule, given FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id AND n = 1
"""

SECRETS_SQL = r"""
WITH patterns(kind, name, p, least) AS (
  VALUES (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', 8),
         (1, 'access', 'AKIA[A-Z0-9]{12,}', 16), (2, 'hex', '[0-9a-f]{32,}', 32)
), matched AS (
  SELECT doc_id, kind, name, least, regexp_extract_all(text, p) AS m, string_split_regex(text, p) AS gap FROM documents, patterns WHERE text IS NOT NULL
), placed AS (
  SELECT doc_id, kind, name, least, m[i] AS s, CAST(list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM matched)
), kept AS (
  SELECT *, start + length(s) AS stop FROM placed
  WHERE kind > 0 OR length(regexp_replace(s, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?', '')) >= least
)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
       sha256(coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind), '')) AS base_sha256
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id GROUP BY d.doc_id
"""

OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.*, (f.k IS NOT NULL AND f.keeper <> l.doc_id) AS gone FROM lines l LEFT JOIN frequent f ON l.k = f.k
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP10_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM iw WHERE len(w) > 0)
), places AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT p.doc_id, p.s, p.n, v.item_id FROM places p JOIN windows v ON p.g = v.g AND p.n = v.n
), words AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words ON dw.doc_id = words.doc_id LEFT JOIN items ON dw.doc_id = items.doc_id
"""

OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, least(4, len(w)) AS n, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS s FROM w WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT u, v FROM shared JOIN sizes x ON u = x.doc_id JOIN sizes y ON v = y.doc_id WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)
), ways AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach(doc_id, least_id) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT v, least_id FROM reach JOIN ways ON reach.doc_id = u WHERE least_id < v
)
SELECT d.doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles, min(r.least_id) AS component_id, d.doc_id = min(r.least_id) AS kept
FROM documents d JOIN reach r ON d.doc_id = r.doc_id LEFT JOIN sizes s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""

OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS step
), runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM runs, crc
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), gaps AS (
  SELECT word, substr(word, 1, i - 1) || '$' || substr(word, i + 1) AS gap, substr(word, 1, i - 1) || substr(word, i + 1) AS less
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.word <> b.word
  UNION SELECT a.word, w.word FROM gaps a JOIN words w ON a.less = w.word
  UNION SELECT w.word, a.word FROM gaps a JOIN words w ON a.less = w.word
), ranked AS (
  SELECT near.word, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS place
  FROM near JOIN words o ON other = o.word
), formed AS (
  SELECT w.word, CASE WHEN other_n >= 5 * n THEN other END AS form, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND place = 1
), way(word, here) AS (
  SELECT word, word FROM formed UNION ALL SELECT way.word, form FROM way JOIN formed ON here = formed.word WHERE form IS NOT NULL
)
SELECT f.word, f.form, way.here AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN way ON f.word = way.word JOIN formed last ON way.here = last.word AND last.form IS NULL
"""


def queries():
    found = [op1_sharding, op2_html_extraction, op3_quality_rules, op4_simhash_near_dedup, op5_language_id, op6_line_dedup, op7_url_filters, op8_sentencepiece, op9_secret_scans, op10_decontamination, op11_minhash_near_dedup, op12_cross_tokenizer_alignment, op13_spelling_variants, quality_base, url_rules, secrets_base]
    return {f.__name__: f for f in found}


def oracle_sql():
    return {"op1_sharding": OP1_SQL, "quality_base": QUALITY_SQL, "url_rules": URL_SQL, "secrets_base": SECRETS_SQL, "op6_line_dedup": OP6_SQL, "op10_decontamination": OP10_SQL, "op11_minhash_near_dedup": OP11_SQL, "op13_spelling_variants": OP13_SQL}
