"""Mixing sources to target weights.

DataFrame functions only. Each source's documents are laid end to end and their tokens packed into blocks of
``block`` tokens. Every source gets a number of block draws that meets its target; how many of them each output shard
holds is drawn, the slots so counted are sent through the source's pseudorandom permutation of its block indexes, and
blocks are joined by (source, index).

*Shard counts.* The counts of sources in a shard are a multinomial draw conditioned on the corpus totals being the
quotas (a multivariate hypergeometric one): draws of all sources are placed by one pseudorandom permutation of all
places and counted by source and shard. An unconditioned draw would let a source's total stray from its target by the
square root of its blocks. Everything that is taken comes from these counts: shards use up a source's slots in turn.

*Permutations* are swap-or-not shuffles (Hoang, Morris, Rogaway 2012), which work on any domain size without cycle
walking and are evaluated row by row, with 60-bit hashes; nothing is sorted or collected by source.

*Scale.* One pass over the texts yields (id, source, words), which is cut to the checkpoint folder; all later rows are
numbers. Packing sums within buckets of about 32,768 documents (a hot source spans many buckets) and then over buckets;
the table of sources has one row each. Draws are placed in chunks of 8,192 that are first spread over tasks; slots are
generated from the shard counts, at most 1,024 from a row.

Defined cases: a null text has no words; a null source is a source of its own, last in order; documents without words
take nothing; repeated rows, and rows of one id or without one, are packed as documents of their own; very long texts
span as many blocks as they fill; an empty table gives an empty result; further columns are ignored by ``mixed_sizes``
and kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.llm.common import cut, md5_int, shuffle_partitions, whole, word_count

BLOCK = 128
SHARD = 1024
WEIGHTS = (5, 2, 1)
LIMIT = 3
ROUNDS = 16
BUCKET = 32_768
CHUNK = 8_192


def row_key() -> Column:
    """A digest of a document's id and text: equal only for rows that repeat both."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), whole("text")).cast("binary"))


def sized(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """``doc_id, source, size``: words of each document, with ``row_key`` if asked for. Written out once, since everything
    else derives from it."""
    key = [row_key().alias("key")] if keyed else []
    return cut(docs.select("doc_id", "source", word_count(whole("text")).alias("size"), *key))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """One row per source: ``source, source_size, rank, target``.

    Shares by weight of all words; a target above ``limit`` times its source's words is cut there and the excess is
    shared again by weight. That loop ends in a common level: sorted by words per weight, the sources up to some row are
    at their limit and the rest take level times weight, so the first row that is within its limit gives the level.
    """
    factor = 1
    for w in set(weights):
        factor *= w
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = per_source.withColumn("rank", F.row_number().over(by_name).cast("long"))
    at = F.lit(0)
    for k, w in enumerate(weights):
        at = F.when((F.col("rank") - 1) % len(weights) == k, w).otherwise(at)
    big = lambda c: c.cast("decimal(38,0)")
    ranked = ranked.withColumn("weight", at.cast("long")).withColumn("cap", F.col("source_size") * limit)
    ranked = ranked.withColumn("per_weight", F.col("cap") * (F.lit(factor) / F.col("weight")).cast("long"))
    by_room = Window.orderBy("per_weight", "rank")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (
        ranked.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("place", F.row_number().over(by_room))
        .withColumn("fits", big(F.col("left")) * factor <= big(F.col("per_weight")) * big(F.col("left_weight")))
    )
    level = F.min(F.when(F.col("fits"), F.struct("place", "left", "left_weight"))).over(everything)
    ranked = ranked.withColumn("level", level)
    target = F.when(F.col("place") < F.col("level.place"), F.col("cap").cast("double")).otherwise(
        F.col("weight").cast("double") * (F.col("level.left").cast("double") / F.col("level.left_weight").cast("double"))
    )
    return ranked.select("source", "source_size", "rank", target.alias("target"))


def offsets(n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """The round constants of a permutation of 0..n-1: an array for ``permuted``, computed once for many rows."""
    return F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: F.pmod(md5_int(F.concat_ws(":", key, r)), n))


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS, constants: Column | None = None) -> Column:
    """Image of ``x`` under the pseudorandom permutation of 0..n-1 that ``key`` names."""
    constants = offsets(n, key, rounds) if constants is None else constants

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.get(constants, r - 1) - at, n)
        swap = md5_int(F.concat_ws(":", key, r, F.greatest(at, other))) % 2 == 1
        return F.when(swap, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, step)


def packed(sizes: DataFrame, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """Each document's place: ``doc_id, source, size, bucket, rn, start, first_block`` and its source's ``blocks``.

    ``start`` counts words from the start of the bucket, whose first block has index ``first_block`` in the source.
    """
    n = sizes.agg((F.floor(F.count("*") / bucket) + 1).alias("buckets"))
    placed = sizes.crossJoin(F.broadcast(n)).withColumn(  # one row
        "bucket", F.pmod(md5_int(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.col("buckets"))
    )
    order = Window.partitionBy("source", "bucket").orderBy("doc_id", "size")
    placed = placed.withColumn("rn", F.row_number().over(order)).withColumn(
        "start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    )
    per_bucket = placed.groupBy("source", "bucket").agg(F.ceil(F.sum("size") / block).cast("long").alias("n_blocks"))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    offsets = per_bucket.select(
        F.col("source").alias("o_source"),
        F.col("bucket").alias("o_bucket"),
        (F.sum("n_blocks").over(along) - F.col("n_blocks")).alias("first_block"),
        F.sum("n_blocks").over(Window.partitionBy("source")).alias("blocks"),
    )
    on = F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket"))
    return placed.join(offsets, on).drop("o_source", "o_bucket", "buckets")


def quotas(goal: DataFrame, blocks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Block draws of each source: ``rank, blocks, draws, first_slot, slots`` (all sources' draws)."""
    held = blocks.groupBy("source").agg(F.max("blocks").alias("blocks"))
    q = goal.join(held.withColumnRenamed("source", "h_source"), F.col("source").eqNullSafe(F.col("h_source")))
    exact = F.floor(F.col("target") * F.col("blocks") / F.greatest("source_size", F.lit(1)) + 0.5).cast("long")
    q = q.withColumn("draws", F.least(exact, F.col("blocks") * limit))
    along = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return q.select(
        "rank",
        "blocks",
        "draws",
        (F.sum("draws").over(along) - F.col("draws")).alias("first_slot"),
        F.sum("draws").over(Window.partitionBy()).alias("slots"),
    )


def shard_counts(quota: DataFrame, shard: int = SHARD, rounds: int = ROUNDS) -> DataFrame:
    """Draws of each source in each output shard: ``rank, blocks, shard, n``, with what comes before them.

    ``first`` counts the source's draws in earlier shards, ``before`` the shard's draws of earlier sources and
    ``in_shard`` all of the shard's: ``shard``, or what is left in the last one.
    """
    chunks = quota.where("draws > 0").select(
        "*",
        offsets(F.col("slots"), F.lit("slot"), rounds).alias("constants"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("draws") - 1) / CHUNK))).alias("chunk"),
    )
    chunks = chunks.repartition(shuffle_partitions(quota.sparkSession), "rank", "chunk")
    last = F.least(F.col("draws"), (F.col("chunk") + 1) * CHUNK) - 1
    one = chunks.select("*", F.explode(F.sequence(F.col("chunk") * CHUNK, last)).alias("i"))
    at = permuted(F.col("first_slot") + F.col("i"), F.col("slots"), F.lit("slot"), rounds, F.col("constants"))
    counts = one.groupBy("rank", "blocks", F.floor(at / shard).alias("shard")).agg(F.count("*").alias("n"))
    of_source = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    of_shard = Window.partitionBy("shard").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(
        "*",
        (F.sum("n").over(of_source) - F.col("n")).alias("first"),
        (F.sum("n").over(of_shard) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy("shard")).alias("in_shard"),
    )


def slots(counts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The slots that the shard counts ask for: ``rank, pass, block_index, shard, position``."""
    s, p = F.concat(F.lit("s"), F.col("rank")), F.concat(F.lit("p"), F.col("shard"))
    counts = counts.repartition(shuffle_partitions(counts.sparkSession), "rank", "shard")
    counts = counts.select("*", offsets(F.col("blocks"), s, rounds).alias("of_source"), offsets(F.col("in_shard"), p, rounds).alias("of_shard"))
    one = counts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    one = one.withColumn("i", F.col("first") + F.col("j"))
    return one.select(
        "rank",
        F.floor(F.col("i") / F.col("blocks")).alias("pass"),
        permuted(F.col("i") % F.col("blocks"), F.col("blocks"), s, rounds, F.col("of_source")).alias("block_index"),
        "shard",
        permuted(F.col("before") + F.col("j"), F.col("in_shard"), p, rounds, F.col("of_shard")).alias("position"),
    )


def pieces(place: DataFrame, block: int = BLOCK) -> DataFrame:
    """Documents cut by block: ``bucket, rn, block_index, from_word`` (in the document) and ``n_words``; needs ``rank``."""
    first = F.floor(F.col("start") / block)
    final = F.floor((F.col("start") + F.col("size") - 1) / block)
    cuts = place.where("size > 0").select("*", F.explode(F.sequence(first, final)).alias("b"))
    begin = F.greatest(F.col("b") * block, F.col("start"))
    end = F.least((F.col("b") + 1) * block, F.col("start") + F.col("size"))
    return cuts.select(
        "rank", "bucket", "rn", "doc_id", *[c for c in ("key", "nth") if c in place.columns],
        (F.col("first_block") + F.col("b")).alias("block_index"),
        (begin - F.col("start")).alias("from_word"),
        (end - begin).alias("n_words"),
    )


def plan(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, keyed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their source's target and place, pieces of documents by block, slots of the mix).

    ``keyed``: documents and pieces carry ``key`` and ``nth``, the row's number among those of its key.
    """
    sizes = sized(docs, keyed)
    goal = cut(targets(sizes))
    place = packed(sizes, block)
    named = goal.withColumnRenamed("source", "g_source")
    place = place.join(named, F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")
    if keyed:
        place = place.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("source")))
    place = cut(place)
    return place, pieces(place, block), slots(cut(shard_counts(quotas(goal, place), shard)))


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, first_shard``.

    ``first_shard`` is the first output shard that holds words of the document; null if it isn't taken.
    """
    place, parts, drawn = plan(docs)
    times = drawn.groupBy("rank", "block_index").agg(F.count("*").alias("times"), F.min("shard").alias("first_shard"))
    taken = (
        parts.join(times, ["rank", "block_index"])
        .groupBy("rank", "bucket", "rn")
        .agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"), F.min("first_shard").alias("first_shard"))
    )
    return place.join(taken, ["rank", "bucket", "rn"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard"
    )


def mixed_blocks(docs: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mix as output shards, a row for each block: ``shard, position, source, pass, block_index, pieces``.

    ``pieces``: array of (doc_id, from_word, n_words), the parts of documents that the block holds, in order.
    """
    place, parts, drawn = plan(docs, block, shard)
    kept = F.struct(F.struct("bucket", "rn").alias("start"), "doc_id", "from_word", "n_words")
    whole_blocks = parts.groupBy("rank", "block_index").agg(F.sort_array(F.collect_list(kept)).alias("pieces"))
    names = place.select(F.col("rank").alias("n_rank"), "source").distinct()
    found = drawn.hint("merge").join(whole_blocks, ["rank", "block_index"]).join(names, F.col("rank") == F.col("n_rank"))
    pieces_of = F.transform("pieces", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["from_word"].alias("from_word"), p["n_words"].alias("n_words")))
    return found.select("shard", "position", "source", "pass", "block_index", pieces_of.alias("pieces"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each document's row once per pass in which any of its blocks is drawn.

    A pass that draws all of a document's blocks returns its text unchanged; otherwise the words of the drawn blocks,
    in order, joined by single spaces. What is drawn follows the shard counts, but a document stays together: laid out by
    shard, its blocks would fall apart (``mixed_blocks``). Documents that no slot draws are left out. Columns are those of ``docs``;
    ``n_chars``, if there, is that of the new text. Rows are told apart by id and text, those that repeat both by their
    number among their like.
    """
    place, parts, drawn = plan(docs, keyed=True)
    # Slots come out of a few rows of chunks, so the planner takes them for few and would broadcast them: they aren't.
    times = drawn.select("rank", "block_index", "pass").hint("merge")
    spans = parts.join(times, ["rank", "block_index"]).groupBy("key", "nth", "pass")
    spans = spans.agg(
        F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("spans"), F.sum("n_words").alias("n_taken")
    )
    spans = spans.groupBy(F.col("key").alias("__pg_id")).agg(
        F.collect_list(F.struct("nth", "pass", "spans", "n_taken")).alias("__pg_passes")
    )
    same_key = Window.partitionBy("__pg_key").orderBy("source")
    rows = docs.withColumn("__pg_key", row_key()).withColumn("__pg_nth", F.row_number().over(same_key))
    joined = rows.join(spans, F.col("__pg_key") == F.col("__pg_id"))
    row = joined.select("*", F.explode("__pg_passes").alias("__pg_m")).where(F.col("__pg_m.nth") == F.col("__pg_nth"))
    tokens = F.regexp_extract_all(whole("text"), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))
    part = lambda w, s: F.slice(w, (s["from_word"] + 1).cast("int"), s["n_words"].cast("int"))
    parts = F.transform(F.array(tokens), lambda w: F.flatten(F.transform("__pg_m.spans", lambda s: part(w, s))))  # words once
    some = F.array_join(F.element_at(parts, 1), " ")
    text = F.when(F.col("__pg_m.n_taken") == word_count(whole("text")), F.col("text")).otherwise(some)
    fields = []
    for c in docs.columns:
        if c == "text":
            fields.append(text.alias("text"))
        elif c == "n_chars":
            fields.append(F.length(text).cast(docs.schema[c].dataType).alias(c))
        else:
            fields.append(F.col(c))
    return row.select(*fields)


def _sql_perm(x: str, n: str, key: str) -> str:
    """``permuted`` in DuckDB."""
    h = lambda s: f"CAST('0x' || substr(md5({s}), 1, 15) AS BIGINT)"
    other = f"((({h(f'{key} || chr(58) || r')} % {n}) - x + {n}) % {n})"
    swap = f"{h(f'{key} || chr(58) || r || chr(58) || greatest(x, {other})')} % 2 = 1"
    return f"list_reduce(list_prepend(CAST({x} AS BIGINT), [CAST(q AS BIGINT) FOR q IN range(1, {ROUNDS + 1})]), lambda x, r: CASE WHEN {swap} THEN {other} ELSE x END)"


SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM per),
weighed AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM ranked),
room AS (SELECT *, cap * (10 // weight) AS pw FROM weighed),
levels AS (
  SELECT *, row_number() OVER o AS place,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY pw, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lft,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY pw, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lw
  FROM room WINDOW o AS (ORDER BY pw, rank)),
level AS (SELECT place AS p, lft AS l, lw AS w FROM levels WHERE CAST(lft AS HUGEINT) * 10 <= CAST(pw AS HUGEINT) * lw ORDER BY place LIMIT 1),
goal AS (
  SELECT source, source_size, rank,
    CASE WHEN place < p THEN CAST(cap AS DOUBLE) ELSE CAST(weight AS DOUBLE) * (CAST(l AS DOUBLE) / CAST(w AS DOUBLE)) END AS target
  FROM levels, level),
b AS (SELECT count(*) // {BUCKET} + 1 AS buckets FROM sizes),
placed0 AS (
  SELECT s.*, g.source_size, g.rank, g.target, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % buckets AS bucket
  FROM sizes s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source, b),
placed AS (
  SELECT *, row_number() OVER w AS rn, CAST(sum(size) OVER (PARTITION BY rank, bucket ORDER BY doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start
  FROM placed0 WINDOW w AS (PARTITION BY rank, bucket ORDER BY doc_id, size)),
pb AS (SELECT rank, bucket, CAST(ceil(sum(size) / {BLOCK}) AS BIGINT) AS nb FROM placed GROUP BY rank, bucket),
offs AS (SELECT rank, bucket, CAST(sum(nb) OVER (PARTITION BY rank ORDER BY bucket) - nb AS BIGINT) AS fb, CAST(sum(nb) OVER (PARTITION BY rank) AS BIGINT) AS blocks FROM pb),
held AS (SELECT rank, max(blocks) AS blocks FROM offs GROUP BY rank),
quota AS (SELECT g.rank, blocks, least(CAST(floor(target * blocks / greatest(source_size, 1) + 0.5) AS BIGINT), blocks * 3) AS draws FROM goal g JOIN held USING (rank)),
lined AS (
  SELECT rank, blocks, draws, CAST(sum(draws) OVER (ORDER BY rank) - draws AS BIGINT) AS first_slot, CAST(sum(draws) OVER () AS BIGINT) AS slots FROM quota),
draw AS (SELECT rank, blocks, slots, first_slot + unnest(range(draws)) AS i FROM lined WHERE draws > 0),
sharded AS (SELECT rank, blocks, {_sql_perm("i", "slots", "'slot'")} // {SHARD} AS shard FROM draw),
slot AS (SELECT rank, blocks, shard, row_number() OVER (PARTITION BY rank ORDER BY shard) - 1 AS i FROM sharded),
times AS (
  SELECT rank, block_index, count(*) AS times, min(shard) AS first_shard
  FROM (SELECT rank, shard, {_sql_perm("i % blocks", "blocks", "('s' || rank)")} AS block_index FROM slot) GROUP BY 1, 2),
cuts AS (
  SELECT p.rank, p.bucket, p.rn, start, size, fb, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) AS blk
  FROM placed p JOIN offs USING (rank, bucket) WHERE size > 0),
taken AS (
  SELECT c.rank, c.bucket, c.rn, CAST(sum((least((blk + 1) * {BLOCK}, start + size) - greatest(blk * {BLOCK}, start)) * t.times) AS BIGINT) AS taken, min(t.first_shard) AS first_shard
  FROM cuts c JOIN times t ON t.rank = c.rank AND t.block_index = fb + blk GROUP BY 1, 2, 3)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_shard FROM placed LEFT JOIN taken USING (rank, bucket, rn)
"""
