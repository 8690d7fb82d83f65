import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from phasegrid.llm import sentencepiece_codec as op

SP = sentencepiece.SentencePieceProcessor(model_file=op.MODEL)
TEXTS = [
    "Hello  world", "  a b\n c", "", "\n", "a　b ﬁ é", "tab\tx", "x ", "emoji 😀 12345", "aaaaaaaaaa bbbbb", "      x", "internationalization of the",
    " " * 40 + "q", "a" * 300, "thethethethe", "x\n\n y", "héé😀😀é", "▁x ▁▁", "\x00\x01", "日本語テキスト", "def f(x):\n    return x",
]


def test_ids_of_the_library():
    c = op.codec()
    for t, ids in zip(TEXTS, c.encode(TEXTS)):
        assert ids.tolist() == SP.encode(t), repr(t)
        assert c.decode(ids) == t.replace("▁", " ") == SP.decode(ids.tolist())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(t):
    c = op.codec()
    assert c.encode([t])[0].tolist() == SP.encode(t)


def test_generated_words():
    r = random.Random(1)
    texts = [" ".join("".join(r.choice("theandoniger") for _ in range(r.randint(1, 14))) for _ in range(40)) for _ in range(60)]
    assert [i.tolist() for i in op.codec().encode(texts)] == SP.encode(texts)


def test_suffix_array_and_ranges_by_brute_force():
    c = op.codec()
    text = np.frombuffer("▁the▁then\n▁other\n".encode("utf-32-le"), np.uint32)
    s = "".join(map(chr, text))
    order = c._suffixes(text)
    assert [s[i : i + c.longest] for i in order] == sorted(s[i : i + c.longest] for i in range(len(s)))
    low, high = c._ranges(text, order)
    for k in range(0, len(c.length), 37):
        piece = "".join(map(chr, c.chars[k, : c.length[k]]))
        assert sorted(order[low[k] : high[k]]) == [i for i in range(len(s)) if s.startswith(piece, i)]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(op, "CACHE_PARTS", 5)
    monkeypatch.setattr(op, "INDEX_CHARS", 20)
    c = op.codec()
    for _ in range(3):
        assert [i.tolist() for i in c.encode(TEXTS)] == SP.encode(TEXTS)


@pytest.mark.parametrize("rows", [1, 1000])
def test_table(make, odd, rows):
    docs = make(odd + [(100 + i, t, "s") for i, t in enumerate(TEXTS)])
    found = op.encoded(docs, rows=rows)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in found.collect():
        assert r.ids == SP.encode(text[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.round_trip == ("▁" not in text[r.doc_id])
    back = op.decoded(found).collect()
    assert all(r.text == text[r.doc_id].replace("▁", " ") for r in back) and len(back) == docs.count()
    assert op.encoded(make([])).collect() == []


def test_a_missing_model_is_named(spark, make):
    spark.conf.set(op.MODEL_SETTING, "/nowhere/x.model")
    try:
        with pytest.raises(Exception, match="no SentencePiece model at /nowhere/x.model"):
            op.encoded(make([(1, "a", "s")])).collect()
    finally:
        spark.conf.unset(op.MODEL_SETTING)
