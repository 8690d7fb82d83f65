"""Exact deduplication: group by a 128-bit content hash, then compare bytes inside the groups.

DataFrame functions only. The texts are hashed in one pass that keeps ids and digests; only texts whose hash occurs
more than once are moved, and a grouping on the text itself (with map-side aggregation, so that a group holding a third
of all rows leaves each task as one row) compares their bytes. Where all texts of a hash are equal, its rows are that
group; rows of a hash that several texts share find theirs by the text. A digest of equal texts is never taken for proof.

Defined cases: a null text counts as empty; all empty texts are one group; a null ``doc_id`` is smaller than any other
and wins only in a group of null ids; rows that repeat the winning ``doc_id`` are all marked kept; very long texts are
hashed and compared whole; an empty table gives an empty result; further columns are ignored by ``exact_groups`` and kept
by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import UPPER, cut, join_groups, lower_ascii, whole


def normalised(text: Column | str = "text") -> Column:
    """The form in which texts are compared: null as empty, A-Z lower-cased."""
    return lower_ascii(whole(text))


def exact_groups(docs: DataFrame, hash_of=None) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``hash_of`` maps the hex SHA-256 of a normalised text to the grouping hash; by default its first 128 bits. Tests
    pass a weak one to force collisions.
    """
    hash_of = hash_of or (lambda sha: F.substring(sha, 1, 32))
    norm = normalised()
    sha = F.sha2(norm.cast("binary"), 256)
    digests = cut(docs.select("doc_id", sha.alias("text_sha256")))
    digests = digests.withColumn("h", hash_of(F.col("text_sha256")))
    repeated = cut(digests.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    total = digests.count()
    candidates = join_groups(digests, repeated, ["h"], "n", total).where("n IS NOT NULL").select(F.col("doc_id").alias("c_id"))
    texts = docs.select("doc_id", "text").join(candidates, F.col("doc_id").eqNullSafe(F.col("c_id")), "left_semi")
    same_bytes = cut(
        texts.select("doc_id", norm.alias("norm"))
        .groupBy("norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select(hash_of(F.sha2(F.col("norm").cast("binary"), 256)).alias("h"), "keep_id", "group_size")
        .join(repeated.select("h"), "h", "left_semi")  # not the other texts of a repeated id
    )
    collided = cut(same_bytes.groupBy("h").agg(F.count("*").alias("texts"), F.sum("group_size").alias("n")).where("texts > 1"))
    groups = same_bytes.join(collided, "h", "left_anti")
    rows = digests
    if not collided.isEmpty():
        rows = cut(join_groups(digests, collided, ["h"], "n", total).where("texts IS NULL").select(digests.columns))
    found = join_groups(rows, groups, ["h"], "group_size", total)
    if not collided.isEmpty():
        told = docs.select("doc_id", norm.alias("norm"), sha.alias("text_sha256")).withColumn("h", hash_of(F.col("text_sha256")))
        told = cut(told.join(collided.select("h"), "h", "left_semi"))
        per_text = cut(told.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
        found = found.unionByName(join_groups(told, per_text, ["norm"], "group_size", total).select(found.columns))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id").eqNullSafe(keep), F.lit(False)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents with one row of each group of equal texts left: the one with the largest ``doc_id``.

    All columns stay. Where ids repeat, rows are told apart by their text too, and one of equal rows is left.
    """
    kept = cut(exact_groups(docs).where("kept").select(F.col("doc_id").alias("__pg_id"), F.col("text_sha256").alias("__pg_sha")))
    rows, ids = docs.agg(F.count("*"), F.count_distinct(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).first()
    same_id = F.col("doc_id").eqNullSafe(F.col("__pg_id"))
    if rows == ids:
        return docs.join(kept.select("__pg_id"), same_id, "left_semi")
    sha = F.sha2(normalised().cast("binary"), 256)
    left = docs.withColumn("__pg_own", sha).join(kept.distinct(), same_id & (F.col("__pg_own") == F.col("__pg_sha")), "left_semi")
    return left.dropDuplicates(["doc_id", "__pg_own"]).drop("__pg_own")


SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS norm FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
             CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size FROM d)
"""
