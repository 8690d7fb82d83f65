"""SentencePiece encoding and decoding by suffix-array matching, for BPE models with byte fallback.

A batch's texts are cut where no piece reaches across (before a space that follows another character, and around line
feeds); its distinct parts that the worker hasn't met are laid end to end and indexed by a suffix array (prefix doubling
up to the longest piece). A binary search, for all pieces at once, gives each piece's range of occurrences; occurrences
are edges of a lattice over the text, sorted by their end in the part, and relaxed in that order.

*Relaxing.* The model's scores are merge ranks, not log-probabilities, so the best path isn't the one of highest sum.
What decides an edge is whether the model's merges would leave a boundary between it and the last token of the text
before it: undoing merges from both sides, later ones first, must meet no merge across the boundary that would have come
earlier. Exactly one edge into each position passes, so relaxation is exact and gives the library's ids.

Work is map-only; what a worker remembers of parts is bounded by ``CACHE_PARTS``, an index by ``INDEX_CHARS``. So most
texts of a warm worker are put together from parts that an earlier batch's suffix array has matched.

The model file is read by every worker: its path is a parameter, by default the session's setting ``MODEL_SETTING``, and
``MODEL`` where that is not set.

Defined cases: null or empty text has no tokens; characters outside the vocabulary become byte tokens; U+2581 is read as
a space, as in the library, so only texts without it decode to themselves; very long texts are encoded whole, part by
part (one part if they hold no space); a worker without the model file raises; null ids and repeated rows are rows like
any other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MODEL_SETTING = "spark.phasegrid.sentencepiece.model"
CACHE_PARTS = 600_000
INDEX_CHARS = 600_000
_PART = re.compile(r" +[^ \n]*|[^ \n]+|\n")
_START = -1


class _Pairs:
    """A hash table from pairs of tokens to the token of their merge, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int32)
        self.probes = 1
        for k, v in zip(keys.tolist(), values.tolist()):
            at, n = int(self._slot(np.int64(k))), 1
            while self.keys[at] >= 0:
                at, n = (at + 1) & ((1 << self.bits) - 1), n + 1
            self.keys[at], self.values[at], self.probes = k, v, max(self.probes, n)

    def _slot(self, key):
        with np.errstate(over="ignore"):
            return ((np.asarray(key).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        """The merge, or a large number where there is none."""
        out = np.full(len(key), 2**31 - 1, np.int64)
        slot, todo = self._slot(key), np.arange(len(key))
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == key[todo]
            out[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (found >= 0)
            if not go.any():
                break
            todo, slot = todo[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out


class Codec:
    """Encoder and decoder of one model file. Tokens inside are ranks: single characters first, then merges in order."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        if not os.path.isfile(model):
            raise FileNotFoundError(f"no SentencePiece model at {model} on this worker; set {MODEL_SETTING}")
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(self.pieces[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        self.special = np.zeros(n, bool)  # tokens that aren't decoded to their piece
        self.special[[*self.byte_of, *self.control, self.unknown]] = True
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        single = [i for i in plain if len(self.pieces[i]) == 1]
        merges = sorted((i for i in plain if len(self.pieces[i]) > 1), key=lambda i: (-sp.get_score(i), i))
        self.ids = np.array(single + merges, np.int64)  # rank -> id
        names = [self.pieces[i] for i in self.ids]
        rank = {p: r for r, p in enumerate(names)}
        self.base = len(single)
        self.left, self.right = np.arange(len(names)), np.arange(len(names))
        reached = list(range(self.base))
        for r in range(self.base, len(names)):
            parts = self._merge(names[r], rank)
            if parts is not None:
                self.left[r], self.right[r] = parts
                reached.append(r)
        keys, values = [], []
        live = set(reached)
        for r in reached[self.base :]:
            p = names[r]
            for cut_at in range(1, len(p)):
                a, b = rank.get(p[:cut_at]), rank.get(p[cut_at:])
                if a in live and b in live:
                    keys.append(a << 20 | b)
                    values.append(r)
        self.pairs = _Pairs(np.array(keys, np.int64), np.array(values, np.int32))
        self.matched = np.array(reached)
        self.length = np.array([len(names[r]) for r in reached], np.int64)
        self.longest = int(self.length.max())
        self.chars = np.zeros((len(reached), self.longest), np.uint32)
        for k, r in enumerate(reached):
            self.chars[k, : len(names[r])] = [ord(c) for c in names[r]]
        self.known_chars = np.unique(self.chars[self.length == 1, 0])
        self._forget()

    def _forget(self) -> None:
        self.part: dict[str, int] = {}
        self.flat, self.start = np.empty(0, np.int32), np.zeros(1, np.int64)

    @staticmethod
    def _merge(piece: str, rank: dict[str, int]) -> tuple[int, int] | None:
        """The last merge by which the model builds a piece; None if it builds something else."""
        parts = list(piece)
        while len(parts) > 2:
            options = [(rank.get(a + b, 2**31), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best, i = min(options)
            if best == 2**31:
                return None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        a, b = rank.get(parts[0]), rank.get(parts[-1])
        return None if len(parts) != 2 or a is None or b is None else (a, b)

    def _boundary(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merges leave a boundary between tokens a and b that stand side by side."""
        ok = np.ones(len(a), bool)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[todo].astype(np.int64), b[todo].astype(np.int64)
        limit = np.full(len(a), 2**31 - 1, np.int64)
        while len(todo):
            merged = self.pairs.get(a << 20 | b)
            bad = merged < limit
            ok[todo[bad]] = False
            # Undo the later of the two merges; single characters can't be undone.
            later = a > b
            new_limit = np.where(later, a, b + 1)
            split_a, split_b = self.right[a], self.left[b]
            stuck_a, stuck_b = split_a == a, split_b == b
            use_a = np.where(later, ~stuck_a, stuck_b & ~stuck_a)
            use_b = np.where(later, stuck_a & ~stuck_b, ~stuck_b)
            done = bad | ~(use_a | use_b)
            new_limit = np.where(use_a, a, np.where(use_b, b + 1, new_limit))
            a, b = np.where(use_a, split_a, a), np.where(use_b, split_b, b)
            go = ~done
            todo, a, b, limit = todo[go], a[go], b[go], new_limit[go]
        return ok

    def _suffixes(self, text: np.ndarray) -> np.ndarray:
        """Suffixes of the text in order of their first ``longest`` characters."""
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
        h = 1
        while h < self.longest:
            shifted = np.zeros_like(rank)
            shifted[:-h] = rank[h:]
            rank = np.unique(rank * (len(text) + 2) + shifted, return_inverse=True)[1].astype(np.int64) + 1
            h *= 2
        return np.argsort(rank)

    def _ranges(self, text: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each piece's occurrences as a range of the suffix array."""
        n = len(text)
        low, high = np.zeros(len(self.length), np.int64), np.full(len(self.length), n, np.int64)
        padded = np.concatenate([text, np.zeros(self.longest, text.dtype)])
        for c in range(self.longest):
            live = np.flatnonzero((self.length > c) & (low < high))
            if not len(live):
                break
            want = self.chars[live, c]
            bounds = []
            for upper in (False, True):
                a, b = low[live].copy(), high[live].copy()
                while True:
                    open_ = a < b
                    if not open_.any():
                        break
                    mid = (a + b) >> 1
                    at = padded[suffixes[np.minimum(mid, n - 1)] + c]
                    less = (at <= want) if upper else (at < want)
                    a = np.where(open_ & less, mid + 1, a)
                    b = np.where(open_ & ~less, mid, b)
                bounds.append(a)
            low[live], high[live] = bounds
        return low, np.maximum(low, high)

    def _index(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the parts, end to end, and where each part's start (one more entry for the end); spaces are U+2581."""
        lengths = np.array([len(p) for p in parts], np.int64)
        text = np.frombuffer(("\n".join(parts) + "\n").replace(" ", "▁").encode("utf-32-le"), np.uint32)
        n = len(text)
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        suffixes = self._suffixes(text)
        low, high = self._ranges(text, suffixes)
        count = high - low
        token = np.repeat(self.matched, count)
        size = np.repeat(self.length, count)
        pos = suffixes[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        own = np.flatnonzero(~np.isin(text, self.known_chars) & (text != 10))  # characters outside the vocabulary
        token = np.concatenate([token, -2 - text[own].astype(np.int64)])
        size, pos = np.concatenate([size, np.ones(len(own), np.int64)]), np.concatenate([pos, own])
        end = pos + size
        # By end in the part, longest first. Edges of one end and size stand in different parts, so their order is free.
        key = ((end - np.repeat(starts, lengths + 1)[pos]) * 32 - size).astype(np.int32 if n < 1 << 26 else np.int64)
        order = np.argsort(key)
        token, pos, end, key = token[order], pos[order], end[order], key[order]
        groups = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        last, come = np.full(n + 1, -(2**40), np.int64), np.full(n + 1, -1, np.int64)
        last[starts] = _START
        for a, b in zip(groups, np.concatenate([groups[1:], [len(key)]])):
            e = end[a:b]
            need = np.flatnonzero(come[e] < 0)
            t, p = token[a:b][need], pos[a:b][need]
            passed = self._boundary(last[p], t)
            e, t, p = e[need][passed], t[passed], p[passed]
            last[e], come[e] = t, p
        at, part = starts + lengths, np.arange(len(parts))
        tokens, owners = [], []
        while len(at):
            tokens.append(last[at])
            owners.append(part)
            at = come[at]
            go = at > starts[part]
            at, part = at[go], part[go]
        token = np.concatenate(tokens[::-1])
        owner = np.concatenate(owners[::-1])
        order = np.argsort(owner, kind="stable")
        token, owner = token[order], owner[order]
        if (token < 0).any():
            spelled = [[self.byte_id[b] for b in chr(-2 - t).encode()] if t < 0 else [int(self.ids[t])] for t in token.tolist()]
            each = np.array([len(s) for s in spelled], np.int64)
            ids, owner = np.array([i for s in spelled for i in s], np.int32), np.repeat(owner, each)
        else:
            ids = self.ids[token].astype(np.int32)
        return ids, np.searchsorted(owner, np.arange(len(parts) + 1))

    def _learn(self, parts: list[str]) -> None:
        todo: list[str] = []
        held = 0
        for i, p in enumerate(parts):
            todo.append(p)
            held += len(p) + 1
            if held >= INDEX_CHARS or i == len(parts) - 1:
                ids, at = self._index(todo)
                base = len(self.start) - 1
                self.part.update(zip(todo, range(base, base + len(todo))))
                self.start = np.concatenate([self.start, at[1:] + self.start[-1]])
                self.flat = np.concatenate([self.flat, ids])
                todo, held = [], 0

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text."""
        if len(self.part) > CACHE_PARTS:
            self._forget()
        cut_up = []
        for t in texts:
            t = (t or "").replace("▁", " ")
            cut_up.append(_PART.findall(" " + t) if t else [])
        new = set().union(*cut_up).difference(self.part)
        if "\n" in new:
            new.discard("\n")
            self.part["\n"] = len(self.start) - 1
            self.flat = np.append(self.flat, np.int32(self.byte_id[10]))
            self.start = np.append(self.start, self.start[-1] + 1)
        if new:
            self._learn(sorted(new))
        counts = np.array([len(parts) for parts in cut_up], np.int64)
        at = np.fromiter(map(self.part.__getitem__, itertools.chain.from_iterable(cut_up)), np.int64, counts.sum())
        size = self.start[at + 1] - self.start[at]
        before = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.repeat(self.start[at] - before[:-1], size) + np.arange(before[-1])]
        return np.split(flat, before[np.cumsum(counts)][:-1]) if texts else []

    def decode(self, ids) -> str:
        """The text of token ids; control tokens say nothing, bytes that aren't UTF-8 become U+FFFD."""
        if not len(ids):
            return ""
        ids = np.asarray(ids, np.int64)
        out: list[str] = []
        held = bytearray()
        last, every = 0, ids.tolist()

        def flush() -> None:
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()

        for k in [*np.flatnonzero(self.special[ids]).tolist(), len(every)]:
            if k > last:
                flush()
                out.extend(map(self.pieces.__getitem__, every[last:k]))
            last = k + 1
            if k == len(every):
                break
            b = self.byte_of.get(every[k])
            if b is not None:
                held.append(b)
                continue
            flush()
            if every[k] == self.unknown:
                out.append(" ⁇ ")
        flush()
        text = "".join(out).replace("▁", " ")
        return text[1:] if text.startswith(" ") else text


_CODECS: dict[str, Codec] = {}


def codec(model: str = MODEL) -> Codec:
    """The process's codec of a model file."""
    if model not in _CODECS:
        _CODECS[model] = Codec(model)
    return _CODECS[model]


def _model_of(df: DataFrame, model: str | None) -> str:
    return model or df.sparkSession.conf.get(MODEL_SETTING, MODEL)


def encoded(docs: DataFrame, model: str | None = None, rows: int = 1000) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, round_trip, ids``; ``round_trip`` says that the ids decode to the text.

    Parts are indexed ``rows`` texts at a time.
    """
    model = _model_of(docs, model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                texts = [t.as_py() or "" for t in some.column(1)]
                ids = c.encode(texts)
                same = [c.decode(i) == t for i, t in zip(ids, texts)]
                ends = np.cumsum([0] + [len(i) for i in ids])
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                n = pa.array(np.diff(ends), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), n, pa.array(same, pa.bool_()), lists], names=["doc_id", "n_tokens", "round_trip", "ids"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, round_trip boolean, ids array<int>")


def decoded(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""
    model = _model_of(tokens, model)
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            texts = [c.decode(i.as_py() or []) for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
