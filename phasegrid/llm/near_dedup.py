"""MinHash near-deduplication with bottom-k sketches from one hash function.

1. A pass over the texts hashes each document's two-word shingles once and keeps the set's size, a 128-bit signature of
   the whole set and its bottom-k sketch (k = 64). Documents with equal signatures become one representative.
2. Inverted lists of retained values generate candidates. Two sets with resemblance 0.8 or more share at least
   ``needed`` retained values: ceil(0.8 n) when n <= 40 (exactly), 32 of 64 otherwise (of the 64 smallest hashes of the
   union, a share of 0.8 lies in both; fewer than 32 has probability 2e-7 for a pair right at 0.8, less above). So they
   share three (or all that are needed) of each one's ``size - needed + 3`` rarest retained values, rarity being the
   value's count over all representatives. Only those enter the lists; values that only one document holds need none.
3. Lists of more than ``SHORT`` members link them to their smallest and largest one, not to each other; components of
   what is confirmed collapse the large groups. Then pairs of different components are compared too, so no link is lost:
   those that meet in three short lists, and in long lists those between the largest component's members and the others,
   and among the others. Lists with the same largest component are united where that is less work, since a family of near
   copies meets in many. They are compared in blocks of up to ``BLOCK`` members and about ``BLOCK_HASHES`` hashes, by
   products of incidence matrices: sketches first, then the full sets of hashes, which are sent once a block. A block
   returns only pairs that join components not yet joined in it, fewer than its members, however many are alike. A list
   that has collapsed into one component costs nothing more. ``SHORT`` says which way is taken, never whether a pair is
   compared.
4. The union sketch estimates each candidate's resemblance and drops those below 0.5; texts of the others are compared
   exactly, on full sets of words. A pair's text of more links is sent once for up to ``CHUNK`` partners. Components are found by
   alternating large and small stars.

All counts are over all documents; nothing is capped. Components, links and sketches stay in DataFrames. Joins of rows
with what they may share with a large part of all rows broadcast the few large groups (``common.join_groups``).

Defined cases: null text, or one without words: no shingles, linked with nothing; one word: that word is its shingle; a
null ``doc_id`` is linked with nothing and has a null component (kept); rows that repeat a ``doc_id`` are one node with
the links of all their texts; very long texts are hashed and compared whole; equal counts of values are ordered by hash;
an empty table gives an empty result; further columns are ignored, and kept by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import cut, join_groups, release

K = 64
NEEDED = 32
MEET = 3
SHORT = 64
BLOCK = 8192
BLOCK_HASHES = 1 << 20
TILE = 256
SLICE = 4096
FEW = 100_000
CHUNK = 32
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CACHE_WORDS = 400_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def tokens(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased (``bytes.split`` cuts at just those bytes)."""
    return (text or "").encode().translate(_LOWER).split()


def shingle_set(text: str | None, size: int = 2) -> frozenset:
    w = tokens(text)
    if not w:
        return frozenset()
    return frozenset(zip(*(w[i:] for i in range(size)))) if len(w) >= size else frozenset([tuple(w)])


def shingle_hashes(text: str | None, hashes: dict, size: int = 2) -> np.ndarray:
    """Distinct 63-bit shingle hashes of a text, ascending."""
    w = tokens(text)
    if not w:
        return np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    if len(h) >= size:
        mixed = h[: len(h) - size + 1].copy()
        for i in range(1, size):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i]
    else:
        mixed = h[:1].copy()
        for i in range(1, len(h)):
            mixed = mixed * np.uint64(0xD6E8FEB86659FD93) + h[i]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique((mixed ^ (mixed >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)


_SKETCH = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sketch", pa.list_(pa.int64()))]
)


def _sketches(k: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            ids, n, s1, s2, kept, ends = batch.column(0), [], [], [], [], [0]
            for text in batch.column(2):
                u = shingle_hashes(text.as_py(), known, size)
                sig = xxhash.xxh3_128_digest(u.tobytes())
                n.append(len(u))
                s1.append(int.from_bytes(sig[:8], "little", signed=True))
                s2.append(int.from_bytes(sig[8:], "little", signed=True))
                kept.append(u[:k])
                ends.append(ends[-1] + min(k, len(u)))
            flat = np.concatenate(kept) if kept else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(1), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), lists], schema=_SKETCH
            )

    return run


def _identified(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, text``: id and hash tell rows apart, whatever repeats."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def sketches(docs: DataFrame, k: int = K, size: int = 2) -> DataFrame:
    """``doc_id, text_hash, n, s1, s2, sketch`` of every document."""
    return _identified(docs).mapInArrow(_sketches(k, size), "doc_id long, text_hash long, n long, s1 long, s2 long, sketch array<long>")


def _similar(a: frozenset, b: frozenset, percent: int) -> bool:
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verifier(percent: int, size: int):
    """Rows of (a, b, text) by a: first a's own text, b being null, then its partners'."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_set = None, frozenset()
        for batch in batches:
            out_a, out_b = [], []
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if b is None:
                    own, own_set = a, shingle_set(text.as_py(), size)
                elif own != a:
                    raise ValueError("a pair without its first text")
                elif _similar(own_set, shingle_set(text.as_py(), size), percent):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], schema=schema)

    return run


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, percent: int = 80, k: int = K, size: int = 2) -> DataFrame:
    """The pairs (a, b) of representatives whose full shingle sets have the resemblance asked for."""
    for x in "ab":  # sizes first: they are small and rule out most pairs
        pairs = pairs.join(reps.select(F.col("rep").alias(x), F.col("n").alias(f"{x}_n")), x)
    pairs = pairs.where(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent).select("a", "b")
    for x in "ab":
        pairs = pairs.join(reps.select(F.col("rep").alias(x), F.col("sketch").alias(f"{x}_sketch")), x)
    union = F.slice(F.sort_array(F.array_union("a_sketch", "b_sketch")), 1, k)
    shared = F.size(F.array_intersect(union, F.array_intersect("a_sketch", "b_sketch")))
    alike = cut(pairs.where(shared * 2 >= F.size(union)).select("a", "b"))
    release(docs.sparkSession)
    links = cut(alike.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links")))
    needed = reps.select("rep", "doc_id", "text_hash").join(links.select("rep"), "rep", "left_semi")
    texts = cut(_identified(docs).join(needed, ["doc_id", "text_hash"]).select("rep", "text").dropDuplicates(["rep"]))
    release(docs.sparkSession)
    for x in "ab":
        alike = alike.join(links.select(F.col("rep").alias(x), F.col("links").alias(f"{x}_links")), x)
    more = F.struct("a_links", "a") >= F.struct("b_links", "b")
    alike = alike.select(
        F.when(more, F.col("a")).otherwise(F.col("b")).alias("a"),
        F.when(more, F.col("b")).otherwise(F.col("a")).alias("b"),
        F.greatest("a_links", "b_links").alias("links"),
    )
    alike = alike.select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("links") / CHUNK)).alias("chunk"), "b")
    partners = alike.join(texts.withColumnRenamed("rep", "b"), "b").select("a", "chunk", "b", "text")
    own = alike.select("a", "chunk").distinct().join(texts.withColumnRenamed("rep", "a"), "a")
    rows = own.select("a", "chunk", F.lit(None).cast("long").alias("b"), "text").unionByName(partners)
    rows = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "b")  # nulls first
    return rows.select("a", "b", "text").mapInArrow(_verifier(percent, size), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node of the edges (a, b).

    Alternating large and small stars (Kiveris and others 2014): each round is two joins on the edges, which are cut to
    the checkpoint folder; the rounds grow with the logarithm of the longest path.
    """
    e = cut(_tidy(edges))
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _tidy(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(_tidy(small.unionByName(low.select("a", F.col("m").alias("b")))))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = e.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def hash_sets(reps: DataFrame, docs: DataFrame, size: int = 2) -> DataFrame:
    """``rep, hashes``: all shingle hashes of the representatives, ascending. Up to ``FEW`` of them are broadcast."""
    schema = pa.schema([("rep", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            first, sets, total = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                sets.append(shingle_hashes(text.as_py(), known, size))
                total += len(sets[-1])
                if total >= BLOCK_HASHES or i + 1 == batch.num_rows:
                    ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]), pa.int32())
                    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets), pa.int64()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), lists], schema=schema)
                    first, sets, total = i + 1, [], 0

    wanted = reps.select("rep", "doc_id", "text_hash")
    if wanted.count() <= FEW:
        wanted = F.broadcast(wanted)
    rows = _identified(docs).join(wanted, ["doc_id", "text_hash"]).select("rep", "text")
    return cut(rows.mapInArrow(run, "rep long, hashes array<long>").dropDuplicates(["rep"]))


def _shared(left: np.ndarray, left_of: np.ndarray, right: np.ndarray, right_of: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Numbers of values that each of ``rows`` sets shares with each of ``columns``, from values and their owners."""
    common = np.intersect1d(left, right)
    sides = []
    for values, owner in ((left, left_of), (right, right_of)):
        at = np.searchsorted(common, values)
        found = at < len(common)
        found[found] = common[at[found]] == values[found]
        at, owner = at[found], owner[found]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], owner[order]))
    shared = np.zeros((rows, columns))
    for low in range(0, len(common), SLICE):  # so that long texts need no matrix as wide as all they share
        parts = []
        for (at, owner), n in zip(sides, (rows, columns)):
            some = slice(*np.searchsorted(at, (low, low + SLICE)))
            part = np.zeros((n, min(SLICE, len(common) - low)), np.float32)
            part[owner[some], at[some] - low] = 1
            parts.append(part)
        shared += parts[0] @ parts[1].T
    return shared


class _Tile:
    """Some members of a list, with near sizes; their sketches, or all their hashes, of which the first are the sketch."""

    def __init__(self, frame, k: int):
        self.rep, self.component, self.n = (frame[c].to_numpy(np.int64) for c in ("rep", "component", "n"))
        self.sets = frame["hashes" if "hashes" in frame else "sketch"].to_list()
        sketches = [x[:k] for x in self.sets]
        self.kept = np.array([len(x) for x in sketches], np.int64)
        self.values, self.owner = np.concatenate(sketches), np.repeat(np.arange(len(sketches)), self.kept)

    def candidates(self, other: _Tile, k: int) -> np.ndarray:
        """Whether components differ and sizes and sketches allow a resemblance of 0.8, for each pair."""
        if self.n.max() * 5 < other.n.min() * 4 or other.n.max() * 5 < self.n.min() * 4:
            return np.zeros((len(self.rep), len(other.rep)), bool)
        shared = _shared(self.values, self.owner, other.values, other.owner, len(self.rep), len(other.rep))
        union = self.kept[:, None] + other.kept[None, :] - shared
        ok = shared * 2 >= np.minimum(union, k)
        ok &= self.component[:, None] != other.component[None, :]
        return ok & (np.minimum(self.n[:, None], other.n[None, :]) * 5 >= np.maximum(self.n[:, None], other.n[None, :]) * 4)

    def similar(self, other: _Tile, percent: int) -> np.ndarray:
        """Whether all hashes have the resemblance asked for, for each pair."""
        sides = [(np.concatenate(t.sets), np.repeat(np.arange(len(t.sets), dtype=np.int32), t.n)) for t in (self, other)]
        both = _shared(*sides[0], *sides[1], len(self.rep), len(other.rep))
        return 100 * both >= percent * (self.n[:, None] + other.n[None, :] - both)


class _Joined(dict):
    """Which components the pairs so far have joined."""

    def root(self, x: int) -> int:
        while (up := self.setdefault(x, x)) != x:
            self[x] = x = self[up]
        return x

    def roots(self, components: np.ndarray) -> np.ndarray:
        return np.array([self.root(x) for x in components.tolist()], np.int64)

    def joining(self, left: np.ndarray, right: np.ndarray) -> Iterator[int]:
        """Places of the pairs of components that weren't joined before."""
        for i, (x, y) in enumerate(zip(left.tolist(), right.tolist())):
            x, y = self.root(x), self.root(y)
            if x != y:
                self[x] = y
                yield i


def _rest(k: int, tile: int, percent: int | None = None):
    """Pairs of a block of a list's members outside its largest component and a block of all its members.

    Without ``percent``, all that sketches allow; with it, of those that all hashes confirm as many as join components.
    """

    def run(members):
        import pandas as pd

        tiles, joined, found = {}, _Joined(), []
        for outside, some in members.sort_values("n", kind="stable").groupby("outside"):
            tiles[bool(outside)] = [_Tile(some.iloc[i : i + tile], k) for i in range(0, len(some), tile)]
        for x in tiles.get(True, ()):
            for y in tiles.get(False, ()):
                ok = x.candidates(y, k)
                if percent is not None and ok.any():
                    ok &= joined.roots(x.component)[:, None] != joined.roots(y.component)[None, :]
                    if ok.any():
                        ok &= x.similar(y, percent)
                i, j = np.nonzero(ok)
                if percent is not None:
                    new = list(joined.joining(x.component[i], y.component[j]))
                    i, j = i[new], j[new]
                found.append(np.sort(np.stack([x.rep[i], y.rep[j]], 1), 1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def long_list_pairs(
    at: DataFrame, reps: DataFrame, docs: DataFrame, percent: int = 80, k: int = K, size: int = 2, block: int = BLOCK
) -> DataFrame:
    """Links (a, b) of lists, given as (v, rep, component): as many as join the components that their members' links join."""
    parts = at.groupBy("v", "component").agg(F.count("*").alias("m"))
    lists = parts.groupBy("v").agg(
        F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("m"), F.count("*").alias("parts")
    )
    lists = lists.where("parts > 1").select(
        "v", F.col("top.component").alias("top"), ((F.col("m") - F.col("top.m")) * F.col("m")).alias("work")
    )
    lists = cut(lists)
    members = cut(at.join(lists.select("v", "top"), "v").select("v", "top", "rep", "component"))
    other = F.col("component") != F.col("top")
    united = members.select("top", "rep", "component").distinct()
    whole = united.groupBy("top").agg((F.count_if(other) * F.count("*")).alias("together"))
    whole = cut(whole.join(lists.groupBy("top").agg(F.sum("work").alias("work")), "top").where("together <= work").select("top"))
    columns = ["united", "v", "top", "rep", "component"]
    groups = united.join(whole, "top").select("*", F.lit(True).alias("united"), F.col("top").alias("v")).select(columns)
    groups = groups.unionByName(members.join(whole, "top", "left_anti").select("*", F.lit(False).alias("united")).select(columns))
    groups = cut(groups.join(reps.select("rep", "n"), "rep"))
    sets = hash_sets(reps.join(groups.select("rep").distinct(), "rep", "left_semi"), docs, size)
    numbers = lambda m, n: F.greatest(F.ceil(m / block), F.ceil(n / BLOCK_HASHES))
    blocks = groups.groupBy("united", "v").agg(
        numbers(F.count_if(other), F.sum(F.when(other, F.col("n")).otherwise(0))).alias("others"),
        numbers(F.count("*"), F.sum("n")).alias("blocks"),
    )
    rows = groups.join(blocks, ["united", "v"]).join(sets, "rep")
    number = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["united", "v", "i", "j", "outside", "rep", "component", "n", "hashes"]
    outside = rows.where(other).select("*", F.lit(True).alias("outside"), number("others").alias("i"), every("blocks").alias("j"))
    inside = rows.select("*", F.lit(False).alias("outside"), every("others").alias("i"), number("blocks").alias("j"))
    both = outside.select(columns).unionByName(inside.select(columns))
    return both.groupBy("united", "v", "i", "j").applyInPandas(_rest(k, TILE, percent), "a long, b long")


def document_components(docs: DataFrame, percent: int = 80, k: int = K, size: int = 2) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    if percent < 80:
        raise ValueError("the sketch bounds hold for a resemblance of 0.8 or more")
    s = cut(sketches(docs, k, size))
    named = s.where("n > 0 AND doc_id IS NOT NULL")
    total = named.count()
    same = named.groupBy("s1", "s2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows"))
    same = cut(same.withColumn("rep", F.monotonically_increasing_id()))
    of = join_groups(named, same, ["s1", "s2"], "rows", total)
    reps = cut(
        of.where("doc_id = first_id").select("rep", "doc_id", "text_hash", "n", "sketch", "rows").dropDuplicates(["rep"])
    )
    of = cut(of.select("doc_id", "n", "rep", "first_id"))
    values = reps.select("rep", "n", F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    held = values.join(shared, "v").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    kept = F.least("n", F.lit(k))
    needed = F.least(F.ceil(F.col("n") * 0.8).cast("long"), F.lit(NEEDED))
    meet = F.least(needed, F.lit(MEET))
    prefix = kept - needed + meet - (kept - F.size("vs"))  # values of one document come first and need no list
    chosen = F.slice("vs", 1, F.greatest(prefix, F.lit(0)).cast("int"))
    postings = cut(
        held.select("rep", meet.alias("meet"), F.explode(chosen).alias("x")).select("rep", "meet", F.col("x.v").alias("v"))
    )
    release(docs.sparkSession)
    sizes = postings.groupBy("v").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("m"))
    postings = cut(postings.join(sizes.where("m > 1"), "v"))
    stars = postings.where(F.col("m") > SHORT)
    stars = stars.select(F.col("lo").alias("a"), F.col("rep").alias("b")).unionByName(
        stars.select(F.col("rep").alias("a"), F.col("hi").alias("b"))
    )
    links = cut(confirmed(_tidy(stars), reps, docs, percent, k, size))
    release(docs.sparkSession)
    spread = of.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).where("b < top")
    twins = of.join(spread, "doc_id")  # rows that repeat an id with other texts
    links = links.unionByName(twins.select(F.col("rep").alias("a"), "b").where("a <> b"))
    found = cut(components(links))
    # Members of a list in different components.
    at = postings.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "v", "rep", "meet", "m", F.coalesce("component", "rep").alias("component")
    )
    open_lists = at.groupBy("v").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1")
    at = cut(at.join(open_lists.select("v"), "v"))
    release(docs.sparkSession)
    short = at.where(F.col("m") <= SHORT)
    other = short.select("v", F.col("rep").alias("b"), F.col("component").alias("b_component"), F.col("meet").alias("b_meet"))
    pairs = short.join(other, "v").where("rep < b AND component <> b_component")
    pairs = pairs.groupBy(F.col("rep").alias("a"), "b").agg(F.count("*").alias("n"), F.min(F.least("meet", "b_meet")).alias("meet"))
    pairs = pairs.where("n >= meet").select("a", "b")
    long = at.where(F.col("m") > SHORT)
    if not long.isEmpty():
        pairs = pairs.unionByName(long_list_pairs(long, reps, docs, percent, k, size, BLOCK))
    rest = cut(_tidy(pairs))
    release(docs.sparkSession)
    more = cut(confirmed(rest, reps, docs, percent, k, size))
    if not more.isEmpty():
        joined = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = components(joined.unionByName(more))
    first = found.join(reps.select(F.col("rep").alias("node"), "doc_id"), "node")
    first = cut(first.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("nodes")))
    named_parts = join_groups(found, first, ["component"], "nodes", max(1, reps.count()))
    named_parts = named_parts.select(F.col("node").alias("rep"), "component_id").join(reps.select("rep", "rows"), "rep")
    ids = s.select("doc_id", "n").withColumn("linked", (F.col("n") > 0) & F.col("doc_id").isNotNull())
    lone = ids.where("NOT linked").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    linked = join_groups(of, cut(named_parts), ["rep"], "rows", total).select(
        "doc_id", "n", F.coalesce("component_id", "first_id").alias("component_id")
    )
    rows = linked.unionByName(lone)
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """The documents with one of each component left: the one with the smallest ``doc_id``."""
    kept = document_components(docs, percent, K, size).where("kept").select(F.col("doc_id").alias("__pg_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__pg_id")), "left_semi")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS s
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0))),
sized AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id) AS n, count(*) OVER (PARTITION BY s) AS df FROM sh),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY df, s) AS p FROM sized),
prefix AS (SELECT doc_id, s, n FROM placed WHERE df > 1 AND p <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1),
cand AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb FROM prefix x JOIN prefix y ON x.s = y.s AND x.doc_id < y.doc_id
         WHERE least(x.n, y.n) * 100 >= 80 * greatest(x.n, y.n)),
links AS (
  SELECT a, b FROM (
    SELECT a, b, any_value(na) + any_value(nb) AS total, count(*) AS i
    FROM cand JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b AND y.s = x.s GROUP BY a, b)
  WHERE 100 * i >= 80 * (total - i)),
pairs2 AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT pairs2.b, reach.c FROM reach JOIN pairs2 ON pairs2.a = reach.node AND reach.c < pairs2.b),
comp AS (SELECT node, min(c) AS component_id FROM reach GROUP BY node),
counts AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp ON comp.node = d.doc_id LEFT JOIN counts USING (doc_id)
"""
