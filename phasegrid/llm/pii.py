"""PII surrogates: every detected entity is replaced by a keyed one of the same type, format, script and gender.

A surrogate is the image of the entity's canonical form under a keyed permutation of all forms of its pattern (letters
stay letters of their script and case, vowels vowels, digits digits, separators stay), so equal entities get equal
surrogates in every document (coreference) and different ones different surrogates (distinctness), without a table of
entities that grows with the corpus. The permutation is a single cycle through the pattern's numbers (a step of one
between a balanced Feistel network and its inverse), walked on to the forms that are valid: a card keeps its issuer digit
and Luhn check, an address its being public or private, an IBAN its country and check sum. Names are mapped word by word,
whatever the title or place: a given name of a known gender becomes another of that gender; other words keep their
endings, which carry gender in many languages, and never become one of those given names.

*Collisions* can't happen: each kind's map is one to one over all canonical forms, in no way depends on the document, and
as a cycle leaves nothing in place, so nothing is ever drawn again. ``collisions`` verifies that over a corpus.

Detected: e-mail addresses, telephone numbers, IPv4 addresses, payment cards (Luhn), US social security numbers, IBANs,
and personal names after a form of address, with every other mention in the same text of a word of such a name ("Mr. John
Smith came. Smith left."), so a word that is also an ordinary one is replaced throughout that text. Map-only, one document
at a time.

Defined cases: an entity with nothing to exchange (``_@example.com``) has no other form and is listed as its own
surrogate; a null text stays null with no entities; text without entities is returned unchanged; null ids and
repeated rows are rows like any other; of overlapping detections the more specific kind stays, then the first; a text of
any length is read whole, in time that grows with its length; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = b"phasegrid-surrogates"
ROUNDS = 8

_DOMAIN = re.compile(r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_PHONE = re.compile(
    r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,12}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w-]*\d)"
)
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)")
_CARD = re.compile(r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-]*\d)")
_SSN = re.compile(r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_TITLES = (
    "Mr|Herr|Herrn|Monsieur|Señor|Sr|Signor|Senhor|господин|г-н"
    "|Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Señora|Sra|Signora|Senhora|госпожа|г-жа"
    "|Dr|Prof"
)
_WORD = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+"
_NAME = re.compile(rf"(?<!\w)({_TITLES})\.? ({_WORD}(?:[ -]{_WORD}){{0,2}})")
_CAPITALISED = re.compile(rf"(?<!\w){_WORD}(?!\w)")

_GIVEN = {
    "m": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Peter Hans Karl Jürgen Klaus Wolfgang Pierre Jean Louis Henri Antoine José Juan Carlos Miguel Pedro".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Anna Emma Olivia Sophie Laura Ursula Greta Ingrid Monika Claire Camille Juliette Margot Hélène María Carmen Lucía Isabel Elena".split(),
}
_GIVEN["m"] += "George Edward Henry Frank Arthur Walter Simon Martin Stefan Andreas Markus Uwe Jens Ralf Dieter Günter Heinz Werner Luc Marc Olivier Philippe Nicolas François Julien Étienne Jorge Luis Diego Pablo Rafael Fernando Andrés Sergio Javier".split()
_GIVEN["f"] += "Helen Margaret Rita Alice Grace Emily Hannah Julia Sabine Petra Birgit Andrea Heike Renate Katrin Silke Ilse Martina Chantal Nathalie Sylvie Brigitte Céline Élodie Amélie Valérie Ana Rosa Pilar Teresa Beatriz Cristina Raquel Sofía Marta".split()
_GIVEN["m, Cyrillic"] = "Иван Пётр Сергей Андрей Дмитрий Алексей Николай Михаил Владимир Александр Павел Юрий Олег Игорь Виктор Максим".split()
_GIVEN["f, Cyrillic"] = "Мария Анна Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Людмила Галина Юлия Вера Надежда Дарья Ксения".split()
_GENDER = {n: g for g, names in _GIVEN.items() for n in names}
#: Alphabets within which letters are exchanged.
_ALPHABETS = [
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", "àâäáãèéêëìíîïòóôöõùúûü",
    "ÀÂÄÁÃÈÉÊËÌÍÎÏÒÓÔÖÕÙÚÛÜ", "åæøýÿ", "ÅÆØÝ", "çðñþß", "ÇÐÑÞ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ",
    "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "ёѐѝ", "ЁЀЍ", "ъь", "ЪЬ", "αεηιοωυ", "βγδζθκλμνξπρστφχψ",
]
_CLASS = {c: a for a in _ALPHABETS for c in a}
#: (network, bits below it) of the private IPv4 addresses.
_PRIVATE = [(10, 24), (172 << 4 | 1, 20), (192 << 8 | 168, 16)]


def _mix(key: bytes, label: str, r: int, value: int) -> int:
    return int.from_bytes(hmac.new(key, f"{label}|{r}|{value}".encode(), hashlib.sha256).digest(), "big")


def permuted(x: int, n: int, label: str, key: bytes = KEY) -> int:
    """Image of x under a keyed permutation of 0..n-1 that is one cycle, so nothing is its own image if n > 1.

    A Feistel network over two halves of the bits, walked into range, takes x to its place on the cycle; its inverse
    takes the next place back to a number.
    """
    if n < 2:
        return x
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for r in range(ROUNDS):
            a, b = b, a ^ (_mix(key, label, r, b) & mask)
        x = a << half | b
        if x < n:
            break
    x = (x + 1) % n
    while True:
        a, b = x >> half, x & mask
        for r in reversed(range(ROUNDS)):
            a, b = b ^ (_mix(key, label, r, a) & mask), a
        x = a << half | b
        if x < n:
            return x


@lru_cache(maxsize=10_000)
def _alphabet(c: str) -> str | None:
    """The characters that one is exchanged with; outside the known alphabets those of its kind in its block of 128."""
    if c in _CLASS or c.isascii() or not c.isalnum():
        return _CLASS.get(c)
    alike = lambda d: unicodedata.category(d) == unicodedata.category(c) and d not in _CLASS and d.upper().lower() == d.lower() == d
    block = "".join(d for d in map(chr, range(ord(c) & ~127, (ord(c) & ~127) + 128)) if alike(d))
    return block if c in block else None


def same_pattern(text: str, label: str, key: bytes = KEY, fixed=()) -> str:
    """Image of a string under a keyed permutation of the strings of its pattern; positions in ``fixed`` stay."""
    alphabets = [None if i in fixed else _alphabet(c) for i, c in enumerate(text)]
    pattern = "".join(c if a is None else f"\x00{a[0]}\x00" for c, a in zip(text, alphabets))
    x, n = 0, 1
    for c, a in zip(text, alphabets):
        if a:
            x, n = x * len(a) + a.index(c), n * len(a)
    x = permuted(x, n, f"{label}|{pattern}", key)
    out = []
    for c, a in zip(reversed(text), reversed(alphabets)):
        if a:
            x, k = divmod(x, len(a))
            c = a[k]
        out.append(c)
    return "".join(reversed(out))


def _walk(text: str, label: str, key: bytes, valid, fixed=()) -> str:
    """``same_pattern``, repeated until the result is valid: a cycle through the valid strings of the pattern.

    The text must be valid itself; a second one that isn't would end at the same string.
    """
    while True:
        text = same_pattern(text, label, key, fixed)
        if valid(text):
            return text


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def _iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def _refill(form: str, characters: str) -> str:
    """The form with its letters and digits replaced in order."""
    it = iter(characters)
    return "".join(next(it) if c.isalnum() else c for c in form)


def _address(octets: list[int], label: str, key: bytes) -> str:
    v = octets[0] << 24 | octets[1] << 16 | octets[2] << 8 | octets[3]
    public = lambda v: 1 <= v >> 24 < 224 and v >> 24 != 127
    bits = next((b for net, b in _PRIVATE if v >> b == net), 32)
    new = v
    while True:
        new = v >> bits << bits | permuted(new & (1 << bits) - 1, 1 << bits, f"{label}|{v >> bits}", key)
        if bits < 32 or public(new) == public(v) and all(new >> b != net for net, b in _PRIVATE):
            return ".".join(str(new >> s & 255) for s in (24, 16, 8, 0))


def canonical(kind: str, text: str) -> str:
    """The form in which mentions of one entity agree."""
    if kind == "phone":
        d = re.sub(r"\D", "", text)
        return d[-10:] if len(d) in (10, 11) else d
    if kind == "iban":
        s = text.replace(" ", "")
        return s[:2] + _iban_check(s[:2], s[4:]) + s[4:]  # 00, 01 and 99 pass as 97, 98 and 02
    if kind == "card":
        return re.sub(r"[ -]", "", text)
    return text.lower() if kind == "email" else text


@lru_cache(maxsize=100_000)
def surrogate(kind: str, text: str, key: bytes = KEY) -> str:
    """The replacement of an entity as it is written; one to one over the canonical forms of a kind."""
    core = canonical(kind, text)
    if kind == "email":
        local, domain = core.split("@", 1)
        new = same_pattern(local, kind, key)
        new = "".join(n.upper() if o.isupper() else n for n, o in zip(new, text)) + "@"  # case as it is written
        # Names under .example are what others become, so they are replaced like those: kept, two could meet in one.
        reserved = domain == "example.com" or domain.endswith((".example.com", ".example.org", ".example.net"))
        new += domain if reserved else same_pattern(domain.rpartition(".")[0], kind, key) + "." + domain.rpartition(".")[2] + ".example"
        return new
    if kind == "phone":
        digits = re.sub(r"\D", "", text)
        return _refill(text, digits[: len(digits) - len(core)] + same_pattern(core, kind, key))
    if kind == "card":
        n = len(core)
        body = same_pattern(core[:-1], kind, key, fixed=(0,))
        check = next(c for c in "0123456789" if luhn(body + c))
        return _refill(text, body + check if n else "")
    if kind == "ssn":
        return _walk(text, kind, key, lambda s: bool(_SSN.fullmatch(s)))
    if kind == "iban":
        body = same_pattern(core[4:], kind, key)
        return _refill(text, f"{core[:2]}{_iban_check(core[:2], body)}{body}")
    if kind == "ip":
        return _address([int(x) for x in text.split(".")], kind, key)
    out = []
    for p in re.split(r"([ -])", text):
        if p in (" ", "-", ""):
            out.append(p)
        elif p in _GENDER:
            names = _GIVEN[_GENDER[p]]
            out.append(names[permuted(names.index(p), len(names), f"{kind}|{_GENDER[p]}", key)])
        else:
            last = tuple(k for k in (len(p) - 1, len(p) - 2) if k > 1)
            out.append(_walk(p, kind, key, lambda s: s not in _GENDER, fixed=last))
    return "".join(out)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses, from each @ outwards: the domain ahead, the local part back to the last address at most."""
    last, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        a = at
        while m and a > last and (text[a - 1].isalnum() or text[a - 1] in "_.%+-"):
            a -= 1
        if a < at:
            yield a, m.end()
            last = m.end()
        at = text.find("@", max(last, at + 1))


def _names(text: str) -> list[tuple[int, int]]:
    """Names after a form of address, and all mentions of their words; neighbouring words are one mention."""
    titled = [(m.start(2), m.end(2)) for m in _NAME.finditer(text)]
    if not titled:
        return []
    known = {w for a, b in titled for w in re.split("[ -]", text[a:b])}
    found: list[tuple[int, int]] = []
    for m in _CAPITALISED.finditer(text):
        if m.group() in known:
            if found and m.start() == found[-1][1] + 1 and text[m.start() - 1] in " -":
                found[-1] = (found[-1][0], m.end())
            else:
                found.append((m.start(), m.end()))
    return found


def find_entities(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a text's entities, by start, without overlaps; code points, end exclusive."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []  # the more specific kinds first
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if re.search(r"\d{2}", text):
        found += [("iban", m.start(), m.end()) for m in _IBAN.finditer(text) if _iban_ok(m.group().replace(" ", ""))]
        found += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if luhn(re.sub(r"\D", "", m.group()))]
        found += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text)]
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text)]
    if text.count(".") > 2 and re.search(r"\d\.\d", text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text)]
    found += [("name", a, b) for a, b in _names(text)]
    taken: list[tuple[int, int, str]] = []  # by start
    for kind, a, b in found:
        i = bisect.bisect_left(taken, (b,))
        if not i or taken[i - 1][1] <= a:
            taken.insert(i, (a, b, kind))
    return [(kind, a, b) for a, b, kind in taken]


def replace_entities(text: str | None, key: bytes = KEY) -> tuple[str | None, list[tuple[str, int, int, str, str]]]:
    """The text with surrogates, and (kind, start, end, original, surrogate) of each entity, positions in the original."""
    entities = find_entities(text)
    if not entities:
        return text, []
    out, spans, at = [], [], 0
    for kind, a, b in entities:
        old = text[a:b]
        new = surrogate(kind, old, key)
        out += [text[at:a], new]
        spans.append((kind, a, b, old, new))
        at = b
    return "".join([*out, text[at:]]), spans


_SPAN = pa.struct([("kind", pa.string()), ("start_at", pa.int64()), ("end_at", pa.int64()), ("surrogate", pa.string())])


def surrogates(docs: DataFrame, key: bytes = KEY, originals: bool = False) -> DataFrame:
    """One row per document: ``doc_id, text`` (with surrogates), ``n_entities`` and ``entities``.

    ``entities``: array of (kind, start_at, end_at, surrogate), positions in the original text. ``originals`` adds what
    was replaced and the surrogate, both in canonical form, for ``collisions``; leave it out of anything that is published.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [*_SPAN, *([pa.field("original", pa.string()), pa.field("canonical", pa.string())] if originals else [])]
    span = pa.list_(pa.struct(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, spans = [], [], []
            for t in batch.column(1):
                new, found = replace_entities(t.as_py(), key)
                texts.append(new)
                n.append(len(found))
                spans.append(
                    [
                        {"kind": k, "start_at": a, "end_at": b, "surrogate": s} | ({"original": canonical(k, o), "canonical": canonical(k, s)} if originals else {})
                        for k, a, b, o, s in found
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(spans, span)],
                names=["doc_id", "text", "n_entities", "entities"],
            )

    more = ",original:string,canonical:string" if originals else ""
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, text string, n_entities long, entities array<struct<kind:string,start_at:bigint,end_at:bigint,surrogate:string{more}>>",
    )


def collisions(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """Surrogates that stand for more than one entity of the corpus: ``kind, surrogate, entities``. Empty if all is well."""
    e = surrogates(docs, key, originals=True).select(F.explode("entities").alias("e")).select("e.*")
    e = e.select("kind", F.col("canonical").alias("surrogate"), "original").distinct()
    return e.groupBy("kind", "surrogate").agg(F.count("*").alias("entities")).where("entities > 1")
