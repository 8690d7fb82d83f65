"""Document fingerprints: bottom-k sketches of shingle hashes.

DataFrame functions only. A sketch is the ascending array of the ``k`` smallest distinct hashes of a text's word shingles
(five words; a shorter text is one shingle of all its words). Sketches of parts merge into the sketch of the whole, and
two sketches estimate resemblance, containment and the number of distinct shingles.

*Neighbours.* The edited text of a document needs the next document's text, in order of ``doc_id``. Ids are cut into
ranges at approximate quantiles (an array that the driver holds, of at most ``MAX_RANGES`` longs), texts are moved once,
by range, and a window over each range finds the next text; a copy of each range's first document closes the range
before it. No task sees more than a range, whatever the distribution of the ids.

Defined cases: a null text counts as empty; a text without words has an empty sketch, and two empty sketches are alike
(1), an empty and another are not (0); null ids come first; rows that repeat an id are ordered by a hash of their text;
the next document of the last is the first, of a single row itself; very long texts are sketched whole; equal hashes count
once; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.llm.common import whole, words

K = 128
SHINGLE = 5
RANGE_ROWS = 2048
MAX_RANGES = 65_536
SPAN = 4294967296.0  # hashes lie in 0 .. SPAN - 1


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """Bottom-k sketch of a text's word shingles: ascending array of distinct 32-bit hashes, at most ``k``."""

    def of(h: Column) -> Column:
        last = F.size(h) - (shingle - 1)
        at = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(shingle)]).bitwiseAND(F.lit(0xFFFFFFFF))
        hashes = F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), at))
        return bottom(F.coalesce(hashes, F.array().cast("array<bigint>")), k)

    return _let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.array_distinct(F.sort_array(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two texts' shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the union's shingles that both hold: the share of the merged sketch found in both."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact for a sketch that isn't full."""
    spread = F.try_element_at(a, F.lit(-1)).cast("double") + 1
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * SPAN / spread)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` holds; 1 for an empty ``a``."""
    common = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / F.greatest(distinct_count(a, k), F.lit(1.0))))


def merge_groups(sketches: DataFrame, key: str, column: str, k: int = K) -> DataFrame:
    """One sketch per key from many. Values are ranked within salts first, so that no task sorts a whole hot key."""
    values = sketches.select(key, F.explode(column).alias("v")).dropDuplicates()
    values = values.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(64)))
    for by in ([key, "salt"], [key]):
        values = values.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy("v"))).where(F.col("rn") <= k)
    return values.groupBy(key).agg(F.sort_array(F.collect_list("v")).alias(column))


def text_of(sketch_column: Column) -> Column:
    """A sketch as a string: eight hexadecimal digits a hash."""
    return F.array_join(F.transform(sketch_column, lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), "")


def _range_of(ids: DataFrame) -> Column:
    """The number of a row's range of ``doc_id``; -1 for a null id."""
    ranges = min(MAX_RANGES, ids.count() // RANGE_ROWS)
    if ranges < 2:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    share = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", share, 100 * ranges)).first()[0] or []))
    if not bounds:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    # A binary search in a constant: the number of bounds up to the id.
    array = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    n = len(bounds)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, math.ceil(math.log2(n + 1)))))])
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda low, s: F.when((low + s <= n) & (F.element_at(array, F.least(low + s, F.lit(n))) <= F.col("doc_id")), low + s).otherwise(low),
    )
    return F.when(F.col("doc_id").isNull(), -1).otherwise(found)


def with_next(docs: DataFrame, compute) -> DataFrame:
    """Rows of (doc_id, text) with columns of the next row.

    ``compute(rows, following)`` gets the rows, moved by range, with ``next_text`` added, and a function from a column to
    its value in the next row; its result must keep the columns ``_range``, ``_ghost``, ``doc_id`` and ``_tie``.
    """
    base = docs.select("doc_id", whole("text").alias("text"))
    ids = docs.select("doc_id")
    number = _range_of(ids)
    firsts = ids.withColumn("_range", number).groupBy("_range").agg(F.min("doc_id").alias("first_id"))
    everything = Window.partitionBy()
    order = Window.orderBy("_range")  # one row for each range, at most MAX_RANGES + 1
    closing = firsts.select(
        "first_id",
        F.coalesce(F.lag("_range").over(order), F.max("_range").over(everything)).alias("_to"),
    )
    rows = base.withColumn("_range", number).withColumn("_ghost", F.lit(0))
    ghosts = (
        base.join(F.broadcast(closing), F.col("doc_id").eqNullSafe(F.col("first_id")))
        .withColumn("_range", F.col("_to"))
        .withColumn("_ghost", F.lit(1))
        .drop("first_id", "_to")
    )
    both = rows.unionByName(ghosts).withColumn("_tie", F.xxhash64("text"))
    window = Window.partitionBy("_range").orderBy("_ghost", "doc_id", "_tie")
    both = both.withColumn("next_text", F.lead("text").over(window))
    return compute(both, lambda c: F.lead(c).over(window)).where("_ghost = 0")


def document_fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """One row per document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``; the edited text is the
    text with its last floor(n_chars / 2) code points replaced by the first as many of the next document's. Then
    ``n_distinct``, the estimated number of distinct shingles, ``held_by_edited``, the estimated share of them that the
    edited text holds, and ``n_distinct_with_next``, the estimated number in this text and the next together.
    """

    def compute(rows: DataFrame, following) -> DataFrame:
        n = F.length("text")
        half = F.floor(n / 2).cast("int")
        edited = F.concat(
            F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)
        )
        rows = rows.select("*", n.cast("long").alias("n_chars"), edited.alias("edited"))
        rows = rows.select(
            "_range", "_ghost", "doc_id", "_tie", "n_chars",
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            sketch(F.col("text"), k).alias("own"),
            sketch(F.col("edited"), k).alias("changed"),
        )
        return rows.withColumn("after", following(F.col("own")))

    found = with_next(docs, compute)
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_of(F.col("own")).alias("fingerprint"),
        text_of(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("after"), k).alias("near_next"),
        distinct_count(F.col("own"), k).alias("n_distinct"),
        containment(F.col("own"), F.col("changed"), k).alias("held_by_edited"),
        distinct_count(merged(F.col("own"), F.col("after"), k), k).alias("n_distinct_with_next"),
    )
