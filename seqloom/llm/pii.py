"""Personal data replaced by surrogates: keyed, of the same type, gender, script and format.

Emails, IBANs, phone numbers, IP addresses, national numbers (3-2-4), cards, street addresses and names are found by patterns: a
name after a title or a phrase that introduces one, or a known first name before a surname; after that every bare mention of
its parts in the document too, in capitals as well. Each is written as a number in the space of all strings of its format and
sent through a keyed permutation of that space, walked until the image is another of the same kind (a valid card number stays
valid, a private address private, a known name of one gender becomes another of that gender, an unknown one stays unknown).
A permutation has no collisions, so different entities get different surrogates and the same entity the same one, in every
row and without any shared state. Per document this is checked all the same; an entity that clashed would take the next key
derived from the first until none does.

The same entity is: an email or a name in any letter case, a number however it is spaced, an address however its octets are
padded. Spelling is kept: letters in capitals stay so, spaces and marks stay where they are.

Defined cases: null texts stay null, empty ones empty; entities that overlap go to the kind named first above; rows repeat
alike; very long texts are treated whole, in linear time; empty tables give empty results; other columns aren't read by
`report`. First names outside the lists are found after a title or an introduction only; national numbers of other forms
are not found. A map over rows: no shuffle, nothing collected.
"""

from __future__ import annotations

import ipaddress
import math
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import common

# First names by gender and script, titles, letters.
NAMES = {
    "female-latin": "Alice Anna Barbara Carmen Carla Claire Elena Emily Emma Eva Hannah Ines Isabel Jane Julia Laura Lena Lucia Maria Marie Mary Nina Paula Rosa Sarah Sophie Susan Teresa".split(),
    "male-latin": "Adam Andrew Carlos Daniel David Felix Hans Henry Hugo Ivan James Jean John Jorge Juan Lucas Luis Mark Martin Michael Paul Pedro Peter Pierre Robert Thomas Victor William".split(),
    "female-cyrillic": "Анна Вера Дарья Елена Ирина Мария Наталья Ольга София Татьяна".split(),
    "male-cyrillic": "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Mlle Señor Señora Sr Sra Don Doña".split()
ALPHABETS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", "àâäáéèêëîïíôöóùûüú", "ÀÂÄÁÉÈÊËÎÏÍÔÖÓÙÛÜÚ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ")

_OF = {c: a for a in ALPHABETS for c in a}


@lru_cache(maxsize=1)
def _classes() -> dict[tuple[str, str, bool], str]:
    """All other letters and digits of Unicode by script (the first word of the character's name) and category."""
    found: dict[tuple[str, str, bool], list[str]] = {}
    for c in map(chr, range(128, sys.maxunicode + 1)):
        if c.isalnum() and c not in _OF:
            found.setdefault(_class(c), []).append(c)
    return {k: "".join(v) for k, v in found.items()}


def _class(c: str) -> tuple[str, str, bool]:
    """The last: a name's pattern doesn't begin with it."""
    return unicodedata.name(c, "NONE").split(" ")[0].split("-")[0], unicodedata.category(c), "à" <= c <= "ÿ" or "а" <= c <= "я"


@lru_cache(maxsize=100_000)
def _alphabet(c: str) -> str | None:
    """The letters or digits that c may become; none for other characters and for a letter alone in its class."""
    if c in _OF or not c.isalnum():
        return _OF.get(c)
    own = _classes()[_class(c)]
    return own if len(own) > 1 else None


_GROUP = {n: g for g, names in NAMES.items() for n in names}
_CAP = r"[^\W\d_a-zà-ÿа-я][^\W\d_]+(?:-[^\W\d_]+)?"
# Phrases before a name, words of street addresses.
CUES = "[Mm]y name is|I am called|Dear|[Jj]e m'appelle|Cher|Chère|[Ii]ch heiße|[Mm]ein Name ist|Lieber|Liebe|[Mm]e llamo|[Mm]i nombre es|Querido|Querida|[Мм]еня зовут"
STREETS = "Street St Avenue Ave Road Rd Lane Ln Drive Boulevard Blvd Way Court Square rue avenue boulevard place chemin impasse Calle Avenida Plaza Paseo".split()
PARTICLES = "de la du des del los las".split()
GERMAN = "straße|strasse|weg|allee|platz|gasse"
_OF_STREET = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,2}}{_CAP}(?: {_CAP})*"
_PATTERNS = {
    "email": re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "phone": re.compile(
        r"(?<![\w+.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\w])|(?<![\w+.-])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?![\w])"
        r"|(?<![\w+.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w])|(?<![\w+.-])0\d(?:[ .-]\d{2}){4}(?![\w])"
    ),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)(?!\w|\.\d)"),
    "ip6": re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)"),
    "national": re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])"),
    "card": re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    "address": re.compile(
        rf"(?<!\w)\d{{1,5}} (?:{_CAP} ){{1,3}}(?:{'|'.join(STREETS[:13])})(?!\w)|(?<!\w)\d{{1,5}},? (?:{'|'.join(STREETS[13:19])}) {_OF_STREET}"
        rf"|(?<!\w)(?:{'|'.join(STREETS[19:])}) {_OF_STREET},? \d{{1,5}}(?!\w)|(?<!\w){_CAP}(?:{GERMAN}) \d{{1,5}}(?!\w)"
    ),
    "name": re.compile(rf"(?:(?<!\w)(?:(?:{'|'.join(TITLES)})\.?|{CUES}) ({_CAP}(?: {_CAP}){{0,2}}))|(?:(?<!\w)((?:{'|'.join(_GROUP)}) {_CAP})(?!\w))"),
}
_HINT = {"email": "@", "ip": ".", "ip6": ":", "national": "-", "name": " ", "address": " "}


@lru_cache(maxsize=200_000)
def _round(key: bytes, tweak: str, k: int, x: int) -> int:
    return int.from_bytes(blake2b(f"{tweak}|{k}|{x}".encode(), key=key, digest_size=16).digest(), "little")


def permuted(x: int, n: int, key: bytes, tweak: str, kind: Callable[[int], object] = lambda _: None) -> int:
    """The image of x under a keyed permutation of range(n) that keeps `kind`: the numbers in the order that an unbalanced
    Feistel network deals them form one ring, on which x goes to the next one of its kind. So x stays only where it is the
    sole one of its kind."""
    a = max(1, math.isqrt(n - 1) + 1)
    b = -(-n // a)

    def forth(y: int) -> int:
        while True:
            left, right = divmod(y, b)
            for k in range(0, 6, 2):
                left = (left + _round(key, tweak, k, right)) % a
                right = (right + _round(key, tweak, k + 1, left)) % b
            y = left * b + right
            if y < n:
                return y

    def back(y: int) -> int:
        while True:
            left, right = divmod(y, b)
            for k in range(4, -1, -2):
                right = (right - _round(key, tweak, k + 1, left)) % b
                left = (left - _round(key, tweak, k, right)) % a
            y = left * b + right
            if y < n:
                return y

    own, at = kind(x), forth(x)
    while True:
        at = (at + 1) % n
        y = back(at)
        if kind(y) == own:
            return y


def _letters(text: str, key: bytes, tweak: str, kind: Callable[[str], object] = lambda _: None) -> str:
    """Each letter and digit replaced by one of its class; everything else stays."""
    classes = [_alphabet(c) for c in text]
    shape = "".join(c if own is None else (str(ALPHABETS.index(own)) if own in ALPHABETS else repr(_class(c))) + "," for c, own in zip(text, classes, strict=True))
    n = math.prod(len(own) for own in classes if own)

    def word(x: int) -> str:
        out = []
        for c, own in zip(text, classes, strict=True):
            if own:
                x, k = divmod(x, len(own))
                c = own[k]
            out.append(c)
        return "".join(out)

    x, unit = 0, 1
    for c, own in zip(text, classes, strict=True):
        if own:
            x += unit * own.index(c)
            unit *= len(own)
    return word(permuted(x, n, key, f"{tweak}:{shape}", lambda v: kind(word(v))))


def _low(text: str) -> str:
    """Each letter in lower case, where upper case gives it back."""
    return "".join(v if len(v := c.lower()) == 1 and v.upper() == c else c for c in text)


def _cased(new: str, like: str) -> str:
    """new with capitals where `like`, of the same length, has them."""
    return "".join(u if c != _low(c) and len(u := n.upper()) == 1 and _low(u) == n else n for n, c in zip(new, like, strict=True))


def _digits(text: str, digits: str) -> str:
    """The text with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in text)


def _number(digits: str, key: bytes, tweak: str) -> str:
    """Another number of as many digits, with a leading zero where this one has it."""
    n = len(digits)
    return str(permuted(int(digits), 10**n, key, f"{tweak}{n}", lambda v: v >= 10 ** (n - 1))).zfill(n)


def _email(text: str, key: bytes) -> str:
    local, _, host = _low(text).rpartition("@")
    labels = host.split(".")
    kept = 2 if len(labels) >= 2 and labels[-2] == "example" else 1
    head = ".".join(labels[:-kept])
    return _cased(f"{_letters(local, key, 'local')}@" + ".".join(x for x in (_letters(head, key, "host"), *labels[-kept:]) if x), text)


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(text: str, key: bytes) -> str:
    plain = text.replace(" ", "")
    body = _letters(plain[4:], key, f"iban {plain[:2]}")
    rest = iter(f"{plain[:2]}{98 - _iban_rest(plain[:2] + '00' + body):02d}{body}")
    return "".join(c if c == " " else next(rest) for c in text)


def _phone(text: str, key: bytes) -> str:
    digits = "".join(c for c in text if c.isdigit())
    free = digits[-10:] if len(digits) > 10 else digits
    return _digits(text, digits[: len(digits) - len(free)] + _number(free, key, "phone"))


def _ip_kind(x: int) -> tuple[bool, bool, bool]:
    a = ipaddress.IPv4Address(x)
    return a.is_private, a.is_multicast, a.is_reserved


def _octets(text: str) -> int:
    return int.from_bytes(map(int, text.split(".")), "big")


def _ip(text: str, key: bytes) -> str:
    return str(ipaddress.IPv4Address(permuted(_octets(text), 2**32, key, "ip", _ip_kind)))


def _ip6(text: str, key: bytes) -> str:
    """The first 16 bits, which tell the address's use, stay."""
    head, rest = divmod(int(ipaddress.IPv6Address(text)), 2**112)
    new = ipaddress.IPv6Address((head << 112) + permuted(rest, 2**112, key, f"ip6 {head}"))
    out = str(new) if "::" in text else ":".join(f"{int(x, 16):x}" for x in new.exploded.split(":"))
    return out.upper() if text != text.lower() else out


def _national(text: str, key: bytes) -> str:
    digits = text.replace("-", "")

    def valid(x: int) -> bool:
        area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    return _digits(text, str(permuted(int(digits), 10**9, key, "national", valid)).zfill(9))


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def _card(text: str, key: bytes) -> str:
    digits = "".join(c for c in text if c.isdigit())
    n = len(digits)
    new = permuted(int(digits), 10**n, key, f"card{n}", lambda x: _luhn(str(x).zfill(n)))
    return _digits(text, str(new).zfill(n))


def _part(part: str, key: bytes) -> str:
    """One word of a name, the same in any letter case."""
    group = _GROUP.get(part.capitalize())
    if group:
        names = NAMES[group]
        new = names[permuted(names.index(part.capitalize()), len(names), key, group)]
        return new.upper() if part.isupper() else new
    return _cased(_letters(_low(part), key, "name", lambda w: w.capitalize() in _GROUP), part)


def _name(text: str, key: bytes) -> str:
    return " ".join(_part(part, key) for part in text.split(" "))


def _address(text: str, key: bytes) -> str:
    def one(m: re.Match) -> str:
        word = m[0]
        if word.isdigit():
            return _number(word, key, "house")
        if word in STREETS or word in PARTICLES:
            return word
        stem = re.fullmatch(rf"(.{{2,}})({GERMAN})", word)
        return _cased(_letters(_low(stem[1]), key, "street"), stem[1]) + stem[2] if stem else _cased(_letters(_low(word), key, "street"), word)

    return re.sub(r"\d+|[^\W\d_]+", one, text)


_MAKE = {"email": _email, "iban": _iban, "phone": _phone, "ip": _ip, "ip6": _ip6, "national": _national, "card": _card, "address": _address, "name": _name}


def _real(kind: str, text: str) -> bool:
    """What a pattern can't say."""
    if kind == "iban":
        return _iban_rest(text.replace(" ", "")) == 1
    if kind == "ip6":
        try:
            ipaddress.IPv6Address(text)
        except ValueError:
            return False
        return sum(map(bool, text.split(":"))) >= 3
    return True


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), not overlapping, in order."""
    found: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))

    def take(a: int, b: int, kind: str) -> None:
        if not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            found.append((a, b, kind))

    for kind, pattern in _PATTERNS.items():
        if kind in _HINT and _HINT[kind] not in text:
            continue
        for m in pattern.finditer(text):
            a, b = m.span(0 if kind != "name" else 1 if m[1] else 2)
            if _real(kind, text[a:b]):
                take(a, b, kind)
    parts = {p for a, b, kind in found if kind == "name" for p in text[a:b].split(" ") if len(p) > 2}
    if parts:
        bare = sorted({v for p in parts for v in (p, p.upper(), p.capitalize())})
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, bare))})(?!\w)", text):
            take(*m.span(), "name")
    return sorted(found)


def canonical(kind: str, text: str) -> str:
    """Equal for entities that are the same one, however written."""
    if kind in ("phone", "card", "national"):
        return "".join(c for c in text if c.isdigit())
    if kind == "ip":
        return str(_octets(text))
    if kind == "ip6":
        return str(int(ipaddress.IPv6Address(text)))
    return text.replace(" ", "") if kind == "iban" else _low(text)


def replace(text: str | None, key: bytes) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with surrogates, and the entities (start, end, kind) that it had."""
    if not text:
        return text, []
    out, at, found = [], 0, entities(text)
    forth: dict[tuple[str, str], str] = {}
    back: dict[tuple[str, str], str] = {}
    own: dict[tuple[str, str], bytes] = {}
    for a, b, kind in found:
        one = canonical(kind, text[a:b])
        use = own.get((kind, one), key)
        while True:
            new = _MAKE[kind](text[a:b], use)
            two = canonical(kind, new)
            if back.setdefault((kind, two), one) == one and forth.setdefault((kind, one), two) == two:
                break
            use = own[kind, one] = blake2b(use, digest_size=32).digest()
            forth.pop((kind, one), None)
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), found


def report(spark: SparkSession, docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates, n_entities, and n_<kind> for each kind."""
    common.prepare(spark)
    kinds, secret = tuple(_PATTERNS), blake2b(key.encode(), digest_size=32).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], {k: [] for k in kinds}
            for text in batch.column(1):
                new, found = replace(text.as_py(), secret)
                texts.append(new)
                for k in kinds:
                    counts[k].append(sum(f[2] == k for f in found))
            total = [sum(c) for c in zip(*counts.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), *[pa.array(c, pa.int64()) for c in counts.values()]], ["doc_id", "text", "n_entities", *[f"n_{k}" for k in kinds]])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, n_entities long, " + ", ".join(f"n_{k} long" for k in kinds))
