"""The registered queries of the corpus operators, with production parameters
over whole tables, and the DuckDB text of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (embedding, exact_dedup, group_packing, lexical, licences, merkle, minhash, mixing, packing, sharding,
               substring, suffix, toxicity)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), **MIX)


def op2_chunk_recipe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op4_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_spherical_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_two_stage_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op7_seed_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op8_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_sentence_rule_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_postorder_merkle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents")).drop("proof")


def op12_presence_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_tournament_tree_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


#: Parameters of the mixing query: 97 % of the largest entropy, at most 4 epochs of a source, all documents.
MIX = {"target_entropy": 0.97, "max_repeats": 4.0, "budget": None, "block_tokens": 1 << 18, "seed": 17}


def queries() -> dict[str, Query]:
    import corpus_pipeline

    ops = [op1_temperature_mixing, op2_chunk_recipe_dedup, op3_label_propagation_shards, op4_compression_toxicity,
           op5_spherical_cap_filters, op6_two_stage_suffix_sort, op7_seed_and_extend, op8_bin_completion_packing,
           op9_sentence_rule_licences, op10_order_minhash, op11_postorder_merkle_log, op12_presence_mask_search,
           op13_tournament_tree_packing]
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_temperature_mixing": MIXING_SQL, "op2_chunk_recipe_dedup": DEDUP_SQL,
            "op11_postorder_merkle_log": MERKLE_SQL, "op12_presence_mask_search": SEARCH_SQL}


def _field_sql(c: str, value: str | None = None) -> str:
    value = value or f"{c}::VARCHAR"
    return f"coalesce(octet_length(encode({value}))::VARCHAR || ':' || {value}, '-')"


#: Trees level by level; proofs as the other children of each ancestor's parent; the checksum bit by bit.
MERKLE_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('=' || source, '') AS k,
         sha256({" || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
         sha256({" || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars"))}
                || {_field_sql("text", "replace(text, chr(10), '')")}) AS altered,
         list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1),
             lambda p: [ascii(substr(doc_id::VARCHAR, p::BIGINT, 1))::BIGINT] || list_transform(range(8), lambda b: -1::BIGINT))),
             lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384::BIGINT)
                            ELSE s >> 1 END) % 2 = 1 AS hit
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY k) AS n FROM docs),
nodes(k, lv, i, h, n) AS (
  SELECT k, 0, i, leaf, n FROM leaves
  UNION ALL
  SELECT k, lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3
  FROM nodes WHERE n > 1 GROUP BY k, lv, i // 3, n),
subroots AS (
  SELECT k, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper(lv, i, h, n) AS (
  SELECT 0, i, subroot, n FROM subroots
  UNION ALL
  SELECT lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3
  FROM upper WHERE n > 1 GROUP BY lv, i // 3, n),
lower_steps AS (
  SELECT l.k, l.i, own.lv, coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i < own.i), '') AS a,
         coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i > own.i), '') AS b
  FROM leaves l JOIN nodes own ON own.k = l.k AND own.i = l.i // (3 ** own.lv)::BIGINT AND own.n > 1
  JOIN nodes o ON o.k = own.k AND o.lv = own.lv AND o.i // 3 = own.i // 3
  GROUP BY l.k, l.i, own.lv),
upper_steps AS (
  SELECT s.k, own.lv, coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i < own.i), '') AS a,
         coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i > own.i), '') AS b
  FROM subroots s JOIN upper own ON own.i = s.i // (3 ** own.lv)::BIGINT AND own.n > 1
  JOIN upper o ON o.lv = own.lv AND o.i // 3 = own.i // 3
  GROUP BY s.k, own.lv),
steps AS (
  SELECT k, i, lv, a, b FROM lower_steps
  UNION ALL
  SELECT l.k, l.i, 1000 + u.lv, a, b FROM leaves l JOIN upper_steps u ON u.k = l.k),
numbered AS (SELECT *, row_number() OVER (PARTITION BY k, i ORDER BY lv) AS step FROM steps),
folding(k, i, step, h) AS (
  SELECT k, i, 0::BIGINT, CASE WHEN hit THEN altered ELSE leaf END FROM leaves
  UNION ALL
  SELECT f.k, f.i, s.step, sha256(s.a || f.h || s.b)
  FROM folding f JOIN numbered s ON s.k = f.k AND s.i = f.i AND s.step = f.step + 1),
ends AS (SELECT k, i, arg_max(h, step) AS folded FROM folding GROUP BY k, i),
proofs AS (SELECT k, i, string_agg(a || b, '' ORDER BY step) AS proof FROM numbered GROUP BY k, i),
top AS (SELECT h AS root FROM upper WHERE n = 1)
SELECT l.doc_id, l.leaf, s.subroot, t.root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.folded AS folded_root,
       e.folded = t.root AS verified
FROM leaves l JOIN subroots s ON s.k = l.k CROSS JOIN top t JOIN ends e ON e.k = l.k AND e.i = l.i
LEFT JOIN proofs p ON p.k = l.k AND p.i = l.i
"""

SEARCH_SQL = """
WITH terms_of AS (
  SELECT 0 AS kind, doc_id AS id, row_number() OVER () AS row,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
  UNION ALL
  SELECT 1, item_id, row_number() OVER (),
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') FROM benchmark),
docs AS (SELECT id AS doc_id, row, terms, len(terms) AS n FROM terms_of WHERE kind = 0 AND len(terms) > 0),
size AS (SELECT count(*) AS d, sum(n)::BIGINT AS l FROM docs),
asked AS (SELECT DISTINCT id AS item_id, row AS item, unnest(terms) AS term FROM terms_of WHERE kind = 1),
tf AS (
  SELECT doc_id, row, n, term, count(*) AS tf
  FROM (SELECT doc_id, row, n, unnest(terms) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
given AS (
  SELECT tf.*, floor(1000 * ln((2 * d + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
               * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * d) // l))) AS part
  FROM tf JOIN df USING (term), size),
scores AS (
  SELECT item_id, item, doc_id, row, sum(part)::BIGINT AS score
  FROM asked JOIN given USING (term) GROUP BY ALL HAVING sum(part) > 0)
SELECT item_id, (row_number() OVER best)::INT AS rank, doc_id, score FROM scores
WINDOW best AS (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)
QUALIFY row_number() OVER best <= 10
"""


DEDUP_SQL = """
WITH t AS (
  SELECT DISTINCT doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM t WINDOW same AS (PARTITION BY norm)
"""

MIXING_SQL = """
WITH RECURSIVE base AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS k,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n
  FROM documents),
src AS (SELECT k, sum(n)::BIGINT AS n FROM base GROUP BY k HAVING sum(n) > 0),
tot AS (SELECT sum(n)::DOUBLE AS total, count(*) AS c, max(n) AS largest FROM src),
bisect(i, lo, hi, lo2, hi2) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1,
    CASE WHEN e THEN (lo + hi) / 2 ELSE lo END, CASE WHEN e THEN hi ELSE (lo + hi) / 2 END,
    CASE WHEN r THEN (lo2 + hi2) / 2 ELSE lo2 END, CASE WHEN r THEN hi2 ELSE (lo2 + hi2) / 2 END
  FROM (SELECT b.*,
          (SELECT ln(sum(pow(n / total, (b.lo + b.hi) / 2)))
                  - (b.lo + b.hi) / 2 * sum(pow(n / total, (b.lo + b.hi) / 2) * ln(n / total))
                    / sum(pow(n / total, (b.lo + b.hi) / 2)) FROM src, tot) >= 0.97 * ln((SELECT c FROM tot)) AS e,
          (SELECT max(pow(n / total, (b.lo2 + b.hi2) / 2 - 1)) / min(pow(n / total, (b.lo2 + b.hi2) / 2 - 1))
           FROM src, tot) > 4.0 AS r
        FROM bisect b WHERE i < 45)),
ends AS (
  SELECT round(greatest(CASE WHEN lo > 1 - 1e-9 THEN 1.0 ELSE lo END, hi2 * (hi2 > 1e-9)::INT), 6) AS a
  FROM bisect WHERE i = 45),
plan AS (
  SELECT k, src.n AS total_k, floor(src.n::DOUBLE * pow(largest::DOUBLE / src.n::DOUBLE, 1.0 - a))::BIGINT AS budget,
         ceil(src.n / 262144)::BIGINT AS blocks
  FROM src, tot, ends),
size AS (SELECT greatest(1, ceil(sum(budget) / 262144))::BIGINT AS n_blocks FROM plan),
ep AS (
  SELECT b.doc_id, b.source, b.k, b.n, p.*, unnest(range(0, budget // total_k + 1))::INT AS epoch
  FROM base b JOIN plan p ON b.k = p.k WHERE b.n > 0),
hashed AS (
  SELECT *, ('0x' || substr(md5('17:' || epoch || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM ep WHERE epoch < budget // total_k OR budget % total_k > 0),
run AS (
  SELECT *, sum(n) OVER (PARTITION BY k, epoch ORDER BY h % blocks, h, doc_id, n
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM hashed),
placed AS (
  SELECT doc_id, source, n, epoch, h, (epoch::BIGINT * total_k + upto - n)::DOUBLE / budget::DOUBLE AS place
  FROM run WHERE epoch < budget // total_k OR upto <= budget % total_k
  UNION ALL
  SELECT doc_id, source, n, 0, ('0x' || substr(md5('17:0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT, -1.0
  FROM base WHERE n = 0)
SELECT doc_id, source, n AS n_tokens, epoch, mix_block,
       row_number() OVER (PARTITION BY mix_block ORDER BY place, h, doc_id, n) - 1 AS mix_slot
FROM (SELECT *, CASE WHEN place < 0 THEN 0 ELSE floor(place * n_blocks)::BIGINT END AS mix_block FROM placed, size)
"""
