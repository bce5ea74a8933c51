"""The contract queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import table
from waymark.llm.decontamination import contamination
from waymark.llm.html_extract import extract
from waymark.llm.language_id import identify, in_fold
from waymark.llm.lm_scoring import score_documents
from waymark.llm.merkle import manifest_digest
from waymark.llm.near_dedup import near_duplicates
from waymark.llm.packing import pack
from waymark.llm.prefix_doubling import doubling_digest
from waymark.llm.prefix_trie import prefix_trie
from waymark.llm.sharding import shard_documents
from waymark.llm.substring_dedup import dedup_digest
from waymark.llm.topk_search import exact_topk
from waymark.llm.url_filter import filter_urls

#: (rule, verdict) of the contract.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), max_len=2048, eos=0)


def op2_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digest(table(spark, sf_dir, "documents"), window=35)


def op3_class_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), ~in_fold("doc_id", 10, 0))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), folds=4, held_out=2)


def op8_min_cut_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85, bands=24, rows=4)


def op10_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), n_shards=16)


def op11_prefix_doubling_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubling_digest(table(spark, sf_dir, "documents"), length=400)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_digest(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def crc32_sql(number: str) -> str:
    """SQL for the unsigned crc32 of a number's decimal digits, bit by bit."""
    digits = f"CAST({number} AS VARCHAR)"
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    values = f"list_transform(range(1, length({digits}) + 1), lambda i: CAST(ascii(substr({digits}, i, 1)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {values}), lambda c, b: {bits}), 4294967295)"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_recompression_dedup": op2_recompression_dedup,
    "op3_class_lm_scoring": op3_class_lm_scoring,
    "op4_url_filter": op4_url_filter,
    "op5_decontamination": op5_decontamination,
    "op6_exact_topk": op6_exact_topk,
    "op7_language_id": op7_language_id,
    "op8_min_cut_extraction": op8_min_cut_extraction,
    "op9_superminhash_dedup": op9_superminhash_dedup,
    "op10_feistel_sharding": op10_feistel_sharding,
    "op11_prefix_doubling_dedup": op11_prefix_doubling_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLES: dict[str, str] = {
    "op2_recompression_dedup": r"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS s FROM words, unnest(range(1, len(w) - 33)) AS t(i) WHERE len(w) >= 35),
repeated AS (SELECT r, i FROM windows WHERE s IN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, k FROM repeated, unnest(range(i, i + 35)) AS t(k)),
removed AS (SELECT r, count(*) AS n_removed, list(k) AS ks FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN ks IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(ks, k)), lambda k: w[k]) END, ' ')) AS kept_sha256
FROM words LEFT JOIN removed USING (r)""",
    "op5_decontamination": r"""
WITH doc_words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
windows AS (SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s FROM item_words, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
found AS (SELECT r, i, size, item FROM (SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS s FROM doc_words, sizes, unnest(range(1, len(w) - size + 2)) AS t(i) WHERE len(w) >= size) JOIN windows USING (s, size)),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM found, unnest(range(i, i + size)) AS t(k) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hits USING (r) LEFT JOIN items USING (r)""",
    "op4_url_filter": r"""
WITH rules(rule, verdict) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'block'), ('example.net/de/8', 'allow'), ('org/es/', 'block')),
cut AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM cut),
split AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path FROM rules)
SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, coalesce(max_by(verdict, length(rule)), 'allow') AS verdict
FROM parts LEFT JOIN split ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY page_id, host, path""",
    "op9_superminhash_dedup": r"""
WITH RECURSIVE tokens AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS s FROM tokens),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT doc_id, b FROM reach JOIN links ON other = a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(other) AS component_id, s.doc_id = min(other) AS kept FROM sets s JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id, len(s.s)""",
    "op6_exact_topk": """
WITH usable AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
  CAST(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10""",
    "op11_prefix_doubling_dedup": """
WITH bytes AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
sized AS (SELECT r, doc_id, h, strlen(h) // 2 AS n FROM bytes),
windows AS (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS s FROM sized, unnest(range(0, n - 399)) AS t(i) WHERE n >= 400),
repeated AS (SELECT r, i FROM windows WHERE s IN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1)),
marked AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 400, true) AS new FROM repeated),
numbered AS (SELECT r, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS span FROM marked),
spans AS (SELECT r, span, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY r, span),
gone AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM spans GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN starts IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(starts) + 1), lambda k: substr(h, CASE WHEN k = 0 THEN 1 ELSE 2 * ends[k] + 1 END, CASE WHEN k = len(starts) THEN 2 * n ELSE 2 * starts[k + 1] END - CASE WHEN k = 0 THEN 0 ELSE 2 * ends[k] END)), '') END)) AS kept_sha256
FROM sized LEFT JOIN gone USING (r)""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE fields AS (SELECT row_number() OVER () AS r, doc_id, source,
  coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
  coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS lowered,
  coalesce({crc32_sql('doc_id')} % 5 = 0, false) AS hit FROM documents),
leaves AS (SELECT r, doc_id, source, sha256(head || body) AS leaf, CASE WHEN hit THEN sha256(head || lowered) ELSE sha256(head || body) END AS used FROM fields),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM leaves),
up(source, level, place, n, hash, preimage) AS (SELECT source, 0, place, n, leaf, '' FROM placed
  UNION ALL SELECT source, level + 1, place // 16, (any_value(n) + 15) // 16, sha256(string_agg(hash, '' ORDER BY place)), string_agg(hash, '' ORDER BY place) FROM up WHERE n > 1 GROUP BY source, level, place // 16),
tops AS (SELECT source, hash, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1),
roof(level, place, n, hash, preimage) AS (SELECT 0, place, n, hash, '' FROM tops
  UNION ALL SELECT level + 1, place // 16, (any_value(n) + 15) // 16, sha256(string_agg(hash, '' ORDER BY place)), string_agg(hash, '' ORDER BY place) FROM roof WHERE n > 1 GROUP BY level, place // 16),
walk(r, doc_id, source, leaf, level, place, n, hash, siblings) AS (SELECT r, doc_id, source, leaf, 0, place, n, used, '' FROM placed
  UNION ALL SELECT w.r, w.doc_id, w.source, w.leaf, w.level + 1, w.place // 16, u.n, sha256(substr(u.preimage, 1, 64 * (w.place % 16)) || w.hash || substr(u.preimage, 64 * (w.place % 16) + 65)), w.siblings || substr(u.preimage, 1, 64 * (w.place % 16)) || substr(u.preimage, 64 * (w.place % 16) + 65)
  FROM walk w JOIN up u ON w.source IS NOT DISTINCT FROM u.source AND u.level = w.level + 1 AND u.place = w.place // 16 WHERE w.n > 1),
climb(r, doc_id, leaf, subroot, level, place, n, hash, siblings) AS (SELECT w.r, w.doc_id, w.leaf, t.hash, 0, t.place, t.n, w.hash, w.siblings FROM walk w JOIN tops t ON w.source IS NOT DISTINCT FROM t.source WHERE w.n = 1
  UNION ALL SELECT c.r, c.doc_id, c.leaf, c.subroot, c.level + 1, c.place // 16, u.n, sha256(substr(u.preimage, 1, 64 * (c.place % 16)) || c.hash || substr(u.preimage, 64 * (c.place % 16) + 65)), c.siblings || substr(u.preimage, 1, 64 * (c.place % 16)) || substr(u.preimage, 64 * (c.place % 16) + 65)
  FROM climb c JOIN roof u ON u.level = c.level + 1 AND u.place = c.place // 16 WHERE c.n > 1)
SELECT doc_id, leaf, subroot, (SELECT hash FROM roof WHERE n = 1) AS root, sha256(siblings) AS proof_sha256, c.hash AS folded_root, c.hash = (SELECT hash FROM roof WHERE n = 1) AS verified FROM climb c WHERE c.n = 1""",
    "op13_conversation_trie": f"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS nth FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, any_value({crc32_sql("conv_id")}) % 6 AS h, list(struct_pack(r := role, t := text) ORDER BY nth) AS ts FROM turns GROUP BY conv_id),
whole AS (SELECT o.conv_id, list_concat(coalesce(b.ts[1 : o.h], []), o.ts[o.h + 1 :]) AS ts FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
prefixes AS (SELECT conv_id, d AS depth, ts[1 : d] AS p, ts[1 : d - 1] AS up, len(ts) = d AS ends FROM whole, unnest(range(0, len(ts) + 1)) AS t(d)),
nodes AS (SELECT p, any_value(depth) AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids FROM prefixes GROUP BY p),
children AS (SELECT up, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up),
known AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(p[depth].t) END AS saved FROM nodes n LEFT JOIN children c ON n.p = c.up),
below AS (SELECT p[1 : d] AS top, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM known, unnest(range(0, depth + 1)) AS t(d) GROUP BY top)
SELECT k.conv_id, CAST(k.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(k.ids) AS ends_sha256
FROM known k JOIN below b ON b.top = k.p LEFT JOIN nodes u ON k.depth > 0 AND u.p = k.up""",
}
