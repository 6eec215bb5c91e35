"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text is cut where its own content says so (:data:`CHUNK`), each chunk gets an
identifier, and a document becomes its *recipe*: the ordered list of its
chunks' identifiers.  Only recipes are grouped and joined.  The identifiers of
every document whose recipe occurs twice are verified against the chunk store
(distinct chunk texts per identifier): where one identifier stands for two
texts, the texts get different variants and the recipes are compared again.
Long documents are thus never moved whole, and chunk texts only once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, null_safe_semi, saved, with_group_totals

#: A chunk ends after 512 or more characters where a word that ends in d, s, t or y is followed
#: by one that starts with a to f, and at 8192 characters at the latest.
CHUNK = r"(?s).{512,8190}?[dsty] (?=[a-f])|(?s).{1,8192}"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Null counts as empty; A-Z become a-z and nothing else changes."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UP, _LOW))


def chunks(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def _identifier(chunk: Column, bits: int) -> Column:
    h = F.xxhash64(chunk)
    return h if bits == 64 else h.bitwiseAND(F.lit((1 << bits) - 1))


def _with_groups(recipes: DataFrame, keys: list[str], having: Column | None = None, how: str = "inner") -> DataFrame:
    return with_group_totals(
        recipes, keys, ["doc_id", "text_sha256"],
        [F.count("*").alias("_n"), F.max("doc_id").alias("_m")],
        [F.sum("_n").alias("group_size"), F.max("_m").alias("keep_id")], having=having, how=how)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is an
    empty text, so null and empty texts form one group.  Of a group the largest
    id stays (a null id only if all are null).  Rows repeated with the same id
    and an equal text are one document.  An empty table gives an empty result;
    other columns are ignored, whatever their names.

    ``id_bits``: bits of the unverified chunk identifier (fewer only in tests,
    to provoke clashes)."""
    src = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    recipes = src.select(
        "doc_id", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("n_bytes"),
        F.transform(chunks(F.col("norm")), lambda c: _identifier(c, id_bits)).alias("recipe"),
    ).dropDuplicates(["doc_id", "text_sha256"])
    marked = saved(_with_groups(recipes, ["recipe", "n_bytes"], having=F.col("group_size") > 1, how="left"), "recipes")

    # the chunk store: every chunk text of documents that seem to have a copy, once
    suspects = marked.filter("group_size > 1")
    store = saved(
        null_safe_semi(src, suspects, ["doc_id"]).select(F.explode(chunks(F.col("norm"))).alias("chunk"))
        .select(_identifier(F.col("chunk"), id_bits).alias("chunk_id"), "chunk").distinct(), "chunks")
    clashing = store.groupBy("chunk_id").agg(F.sort_array(F.collect_list("chunk")).alias("texts")).filter(
        F.size("texts") > 1) if id_bits < 64 else store.groupBy("chunk_id").agg(
        F.count("*").alias("n")).filter("n > 1")
    if not clashing.isEmpty():
        marked = _verified(src, marked, store, id_bits)
    size = F.coalesce("group_size", F.lit(1))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return marked.select("doc_id", keep.alias("keep_id"), size.cast("long").alias("group_size"),
                         F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def _verified(src: DataFrame, marked: DataFrame, store: DataFrame, id_bits: int) -> DataFrame:
    """``marked`` with the groups formed anew on recipes of verified identifiers."""
    shared_ids = store.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").select("chunk_id")
    variants = saved(
        store.join(shared_ids, "chunk_id", "left_semi")
        .select("chunk_id", "chunk", F.sha2("chunk", 256).alias("variant")), "variants")
    texts = null_safe_semi(src.withColumn("text_sha256", F.sha2("norm", 256)), marked.filter("group_size > 1"),
                           ["doc_id", "text_sha256"])
    rows = (texts.select("doc_id", "text_sha256",
                         F.posexplode(chunks(F.col("norm"))).alias("pos", "chunk"))
            .withColumn("chunk_id", _identifier(F.col("chunk"), id_bits))
            .join(variants, ["chunk_id", "chunk"], "left")
            .dropDuplicates(["doc_id", "text_sha256", "pos"])
            .groupBy("doc_id", "text_sha256")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "chunk_id", "variant"))).alias("recipe")))
    lone = marked.filter("group_size is null").select("doc_id", "text_sha256", "group_size", "keep_id")
    # an empty text has no chunk; all empty texts are equal
    empty = marked.filter("group_size > 1 and n_bytes = 0").select("doc_id", "text_sha256", "group_size", "keep_id")
    again = _with_groups(rows, ["recipe"]).select("doc_id", "text_sha256", "group_size", "keep_id")
    return lone.unionByName(empty).unionByName(again)


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that :func:`exact_dedup` keeps, with all their columns."""
    verdict = exact_dedup(docs, id_col, text_col).filter("kept").select(
        F.col("doc_id").alias("_kid"), F.col("text_sha256").alias("_ksha"))
    sha = fresh(docs, "sha")
    tagged = docs.withColumn(sha, F.sha2(normalised(F.col(text_col)), 256))
    kept = tagged.join(verdict, tagged[id_col].eqNullSafe(verdict["_kid"]) & (tagged[sha] == verdict["_ksha"]), "left_semi")
    # rows repeated with one id are one document; only such rows are compared
    again = saved(docs.groupBy(F.col(id_col).alias("_kid")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_kid"),
                  "repeated")
    if again.isEmpty():
        return kept.drop(sha)
    once = kept.join(again, kept[id_col].eqNullSafe(again["_kid"]), "left_anti")
    more = kept.join(again, kept[id_col].eqNullSafe(again["_kid"]), "left_semi").dropDuplicates([id_col, sha])
    return once.unionByName(more).drop(sha)
