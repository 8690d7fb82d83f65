import re
import string
import time

from phasegrid.llm import licenses as op
from phasegrid.llm.license_rules import rules

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
TEXTS = [
    "Released under the MIT License. MIT license, mit-license; Mit\nLicense!",
    "Licensed under the Apache License, Version 2.0 (the License)",
    "GNU General Public License, version 3. GENERAL PUBLIC LICENSE",
    "no licence here, permit licenses",
    "SPDX-License-Identifier: Apache-2.0",
    "mité license é mit licenseé mit license",
    "Licensed under CC BY-NC 4.0.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
]


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(FOLD))


def brute_base(t):
    w = words(t)
    hits = sorted((i, v) for p, v in PHRASES.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p)
    labels = ",".join(sorted({v for _, v in hits}))
    return len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, labels


def brute_detections(t):
    """Every rule tried on every text, and containment resolved by comparing all with all."""
    norm = " " + " ".join(words(t)) + " "
    found = []
    for label, priority, confidence, _, pattern in rules():
        for m in re.finditer(f"(?<= ){pattern}(?= )", norm):
            found.append((norm[: m.start()].count(" ") - 1, norm[: m.end() + 1].count(" ") - 1, priority, label, confidence))
    kept = []
    for d in sorted(set(found), key=lambda d: (d[0], -d[1], *d[2:])):
        if not any(k[0] <= d[0] and k[1] >= d[1] and k[2] <= d[2] for k in kept):
            kept.append(d)
    return kept


def test_hundreds_of_rules_with_keywords():
    assert len(rules()) > 200
    for _, _, _, keyword, pattern in rules():
        re.compile(pattern)
        assert any(root in keyword or root in pattern for root in op.ROOTS), keyword


def test_digest_and_detections(make, odd):
    rows = odd + [(100 + i, t, "s") for i, t in enumerate(TEXTS)]
    docs = make(rows)
    found = op.license_digest(docs).collect()
    assert len(found) == len(rows)
    by_text = {}
    for r in found:
        by_text.setdefault(r.doc_id, r)
    for i, t, _ in rows:
        r = by_text[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t)
        labels = {d[3] for d in brute_detections(t)} | set(filter(None, r.base_labels.split(",")))
        assert r.labels == ",".join(sorted(labels)), t[:60]
        assert 0 <= r.score <= 1
    for r in op.scan(docs.select("doc_id", "text")).collect():
        mine = sorted((d.start, -d.minus_end, d.priority, d.label) for d in r.scan.detections)
        assert mine == sorted(d[:4] for d in brute_detections(r.text))


def test_many_matches_and_empty_table(make):
    r = op.license_digest(make([(1, "MIT License " * 2000, "s")])).first()
    assert (r.n_base, r.last_word, r.labels) == (2000, 3998, "mit")
    assert op.license_digest(make([])).collect() == []


def test_words_of_a_root_may_stand_apart(make):
    texts = ["CC_BY_4.0", "CC/BY-SA 4.0", "cc  by 4.0", "CC\nBY-NC 4.0", "accept by 4.0"]
    for r in op.license_digest(make([(i, t, "s") for i, t in enumerate(texts)])).collect():
        assert set(filter(None, r.labels.split(","))) == {d[3] for d in brute_detections(texts[r.doc_id])}
        assert bool(r.labels) == (r.doc_id < 4)


def test_time_grows_with_the_number_of_matches(make):
    seconds = []
    for n in (8000, 32_000):
        docs = make([(1, "licensed under gpl 3 or apache 2.0 then " * n, "s")])
        began = time.time()
        assert op.license_digest(docs).first().labels
        seconds.append(time.time() - began)
    assert seconds[1] < 8 * seconds[0] + 5


def test_clashing_names(make):
    docs = make([(1, "MIT License", "s")])
    assert op.scan(docs, "other").columns == [*docs.columns, "other"] and op.scan(docs).columns == docs.columns
