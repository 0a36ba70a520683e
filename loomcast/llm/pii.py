"""Personal data: detection, and keyed surrogates that keep type, gender, script and format.

A surrogate is the image of the entity under a keyed permutation of all entities of its format:
the characters of an entity are digits of a mixed-radix number, whose radix at each place is the
size of the class that the character may be replaced from, and the number goes through a Feistel
network over exactly that range. So distinct entities have distinct surrogates and the same
entity has the same surrogate in every document and on every executor, with no table of
entities to share. The collision check is that the inverse permutation gives the entity back;
it is made for every surrogate. Case, separators and check digits are put back afterwards, so an
entity written in another way keeps its identity.

Entities: e-mail addresses, IPv4 and IPv6 addresses, payment card numbers with a valid check digit,
phone numbers, social security numbers, IBANs with valid check digits, and names: after a form of
address, or a listed given name before a capitalised word. A given name or surname found so, of
whatever length, is replaced by one surrogate wherever the document repeats it as a whole word; a word
found as both keeps the kind it was found as first. A listed given name that stands alone everywhere
in its document is left, as it may be a word; so is a name of neither form.

Given names go to others of their script and gender. Surnames keep endings that tell the gender
(Иванов and Иванова become one stem with two endings). Letters of no class are replaced from the
letters of their stretch of 32 code points; a letter that is alone there stays.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
import unicodedata
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import kernels as K
from .common import documents, id_array, ids, map_texts, rewrite_texts, texts

REDACTED = "doc_id long, n_entities long, n_distinct long, entities string, text string"
#: Key of the permutations where a caller gives none. Real corpora need a secret one.
DEFAULT_KEY = b"loomcast surrogate key"

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*::)(?!:::)[0-9A-Fa-f]{0,4}(?::{1,2}[0-9A-Fa-f]{1,4}){1,7}(?:::)?|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::)(?![0-9A-Za-z:]|\.[0-9])")
IPV4 = re.compile(rf"(?<![0-9A-Za-z.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9A-Za-z]|\.[0-9])")
CARD = re.compile(r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[.-][0-9])")
PHONE = re.compile(
    r"(?<![0-9A-Za-z.+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z]|[.-][0-9])"
)
SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")

#: Forms of address, after which a capitalised word is a name.
ADDRESS = ("Mr", "Mister", "Mrs", "Ms", "Miss", "Mx", "Dr", "Doctor", "Prof", "Professor", "Herr", "Herrn", "Frau", "Fräulein", "Monsieur", "Madame", "Mme", "Mademoiselle", "Mlle", "Señor", "Señora", "Sr", "Sra", "Господин", "Госпожа", "Κύριος", "Κυρία")
#: Given names by script and gender; a name is replaced by another of its list.
GIVEN = {
    ("latin", "f"): "Alice Anna Beatriz Carla Carmen Charlotte Clara Elena Emily Emma Eva Hannah Heidi Ines Isabel Jane Julia Karen Laura Lena Louise Lucia Maria Marie Martha Mary Nora Olivia Paula Rosa Sarah Sofia Sophie Susan Ursula".split(),
    ("latin", "m"): "Albert Andreas Anton Carlos Charles Daniel David Diego Emil Felix Frank George Hans Henri Henry Hugo Ivan Jack James Jean John Jorge Juan Karl Louis Lucas Luis Mark Martin Michael Otto Pablo Paul Peter Robert Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Галина Елена Ирина Мария Надежда Ольга Софья Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split(),
    ("greek", "f"): "Άννα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξανδρος Γιώργος Δημήτρης Ιωάννης Κώστας Νίκος".split(),
}
#: Letters that may replace each other.
LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóú", "àèìòù", "âêîôû", "äëïöü", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ")
LETTER_CLASS = {c: letters for letters in LETTERS for c in letters}
#: Endings of surnames that tell the gender, which surrogates keep.
ENDINGS = ("ова", "ева", "ёва", "ина", "ына", "ская", "цкая", "ов", "ев", "ёв", "ин", "ын", "ский", "цкий", "ская", "ска", "ски", "ová", "ski", "ska", "cki", "cka", "dóttir", "son", "ίδης", "ίδου", "άκης", "άκη", "όπουλος", "οπούλου", "ος", "ου", "ης")
ENDING = re.compile(f"(?:{'|'.join(sorted(set(ENDINGS), key=lambda x: (-len(x), x)))})$")
WORD = r"[^\W\d_]+(?:[-'’][^\W\d_]+)?"
CAPITAL = r"[A-ZÀ-ÖØ-ÞŠŽÁА-ЯЁΆ-ΏΑ-Ϋ]"
GIVEN_NAMES = frozenset(name for names in GIVEN.values() for name in names)
PAIR = re.compile(rf"(?<!\w)({CAPITAL}[^\W\d_]+)(?=[ \t]({CAPITAL}[^\W\d_]*(?:[-'’][^\W\d_]+)?))")
NAMED = re.compile(rf"(?<!\w)(?:(?:{'|'.join(ADDRESS)})\.?[ \t])+({WORD})(?:[ \t]({WORD}))?")
POSSESSIVE = re.compile(r"['’]s$")
NAMED_BYTES = re.compile("|".join(rf"{a}\.?[ \t]" for a in ADDRESS).encode())
_ANY = "0123456789abcdefghijklmnopqrstuvwxyz"
_given_hashes = np.sort(K.word_hashes(K.split_words(*K.text_buffer(pa.array(sorted(GIVEN_NAMES))))))


@lru_cache(1 << 14)
def letter_class(c: str) -> str:
    """The letters that may stand for a lower-case letter, itself among them; '' where there is no other."""
    if c in LETTER_CLASS:
        return LETTER_CLASS[c]
    if not c.isalpha():
        return ""
    kind, begin = unicodedata.category(c), ord(c) & ~31
    near = "".join(x for x in map(chr, range(begin, begin + 32)) if unicodedata.category(x) == kind and x.lower() == x and len(x.upper()) == 1 and x not in LETTER_CLASS)
    return near if c in near and len(near) > 1 else ""


def lower(value: str) -> str:
    """Lower case, but for letters that become several."""
    return "".join(x if len(x.lower()) > 1 else x.lower() for x in value)


def like(value: str, image: str) -> str:
    """`image` with capitals where `value` has them."""
    return "".join(b.upper() if a != a.lower() and len(b.upper()) == 1 else b for a, b in zip(value, image))


class Permutation:
    """A keyed permutation of range(size): a Feistel network over a rectangle, walked until inside."""

    ROUNDS = 6

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.a = max(1, math.isqrt(size - 1) + 1) if size > 1 else 1
        self.b = -(-size // self.a)
        self.seed = hashlib.blake2b(tweak.encode(), key=hashlib.blake2b(key).digest(), digest_size=32).digest()

    def _f(self, i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(x.to_bytes((x.bit_length() + 8) // 8, "big"), key=self.seed, salt=bytes([i]), digest_size=64).digest(), "big")

    def _once(self, x: int) -> int:
        u, v = x % self.a, x // self.a
        for i in range(self.ROUNDS):
            if i % 2:
                v = (v + self._f(i, u)) % self.b
            else:
                u = (u + self._f(i, v)) % self.a
        return u + self.a * v

    def _back(self, x: int) -> int:
        u, v = x % self.a, x // self.a
        for i in reversed(range(self.ROUNDS)):
            if i % 2:
                v = (v - self._f(i, u)) % self.b
            else:
                u = (u - self._f(i, v)) % self.a
        return u + self.a * v

    def apply(self, x: int) -> int:
        y = self._once(x)
        while y >= self.size:
            y = self._once(y)
        return y

    def invert(self, y: int) -> int:
        x = self._back(y)
        while x >= self.size:
            x = self._back(x)
        return x

    def move(self, x: int) -> int:
        """The image of x under a permutation that moves every number, if there are two: a keyed shift
        of the places that apply() gives. Checked by its inverse."""
        if self.size < 2:
            return x
        step = 1 + self._f(255, 0) % (self.size - 1)
        out = self.invert((self.apply(x) + step) % self.size)
        if self.invert((self.apply(out) - step) % self.size) != x:
            raise AssertionError("two entities share a surrogate")
        return out


def luhn(digits: str) -> int:
    """The sum that is divisible by 10 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total


def iban_rest(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


@dataclass(frozen=True)
class Entity:
    kind: str
    start: int
    end: int


class Surrogates:
    def __init__(self, key: bytes = DEFAULT_KEY):
        self.key = key
        self.known: dict[tuple, str] = {}

    def permute(self, tweak: str, value: str, classes: list[str]) -> str:
        """The image of `value`, whose i-th character is replaced from classes[i] ('': stays)."""
        size, number = 1, 0
        for c, letters in zip(value, classes):
            if letters:
                size, number = size * len(letters), number * len(letters) + letters.index(c)
        shape = "".join(letters and f"[{letters}]" or c for c, letters in zip(value, classes))
        image = Permutation(self.key, f"{tweak}|{shape}", size).move(number)
        out = []
        for c, letters in zip(reversed(value), reversed(classes)):
            if letters:
                image, i = divmod(image, len(letters))
                c = letters[i]
            out.append(c)
        return "".join(reversed(out))

    def of(self, kind: str, value: str) -> str:
        cached = self.known.get((kind, value))
        if cached is None:
            if len(self.known) > 200_000:
                self.known.clear()
            cached = self.known[kind, value] = getattr(self, kind)(value)
        return cached

    def _alnum(self, tweak: str, value: str) -> str:
        """Letters from letters and digits from digits, whatever the case; case is put back."""
        low = value.lower()
        image = self.permute(tweak, low, [_ANY[:10] if c.isdigit() else _ANY[10:] if c.isalpha() else "" for c in low])
        return "".join(b.upper() if a.isupper() else b for a, b in zip(value, image))

    def email(self, value: str) -> str:
        local, _, domain = value.rpartition("@")
        labels, _, top = domain.rpartition(".")
        return f"{self._alnum('local|' + domain.lower(), local)}@{self._alnum('domain|' + top.lower(), labels)}.{top}"

    @staticmethod
    def network(value: str) -> str:
        a, b = (int(x) for x in value.split(".")[:2])
        if a == 10:
            return "10"
        if a == 192 and b == 168:
            return "192.168"
        if a == 172 and 16 <= b < 32:
            return "172.16"
        return "local" if a == 127 else "other" if a in (0, 169) or a >= 224 else "public"

    def ip(self, value: str) -> str:
        net, walk = self.network(value), Permutation(self.key, "ip", 1 << 32)
        number = start = int.from_bytes(map(int, value.split(".")), "big")
        while True:  # the next address of the same network on the permutation's cycle
            number = walk.move(number)
            said = ".".join(map(str, number.to_bytes(4, "big")))
            if self.network(said) == net or number == start:
                return said

    def card(self, value: str) -> str:
        digits = re.sub(r"\D", "", value)
        body = self.permute(f"card{len(digits)}", digits[1:-1], [_ANY[:10]] * (len(digits) - 2))
        check = next(c for c in _ANY[:10] if luhn(digits[0] + body + c) % 10 == 0)
        return refill(value, digits[0] + body + check)

    def phone(self, value: str) -> str:
        digits = re.sub(r"\D", "", value)
        country = len(re.match(r"\+?([0-9]*)", value)[1]) if value[0] == "+" else 0
        country = country if country <= 3 else 2
        rest = digits[country:]
        classes = [_ANY[2:10] if i == 0 and c in _ANY[2:10] else "" if i == 0 else _ANY[:10] for i, c in enumerate(rest)]
        return refill(value, digits[:country] + self.permute("phone" + digits[:country], rest, classes))

    def ssn(self, value: str) -> str:
        digits = value.replace("-", "")
        return refill(value, self.permute("ssn", digits, [_ANY[:10]] * 9))

    def iban(self, value: str) -> str:
        plain = value.replace(" ", "")
        body = self._alnum("iban" + plain[:2], plain[4:])
        check = 98 - iban_rest(plain[:2] + "00" + body)
        return refill(value, f"{plain[:2]}{check:02d}{body}")

    def ipv6(self, value: str) -> str:
        """The first group stays, zeros stay zeros and other groups become others, so the form stays."""
        full = ipaddress.IPv6Address(value).exploded.split(":")
        numbers = [int(x, 16) for x in full]
        rest = [x for x in numbers[1:] if x]
        size, number = 1, 0
        for x in rest:
            number, size = number * 65535 + x - 1, size * 65535
        image = Permutation(self.key, f"ipv6|{full[0]}|{[x > 0 for x in numbers]}", size).move(number)
        made = []
        for _ in rest:
            image, x = divmod(image, 65535)
            made.append(x + 1)
        new = iter(reversed(made))
        groups = [numbers[0], *[next(new) if x else 0 for x in numbers[1:]]]
        left, gap, right = value.partition("::")
        sides = [side.split(":") if side else [] for side in (left, right)]
        out, place = [], 0
        for side in sides:
            place = place if side is sides[0] else 8 - len(side)
            out.append(":".join(f"{groups[place + i]:x}".zfill(len(x) if x[0] == "0" else 1) for i, x in enumerate(side)))
        said = gap.join(out) if gap else out[0]
        return said.upper() if any(c.isupper() for c in value) else said

    def surname(self, value: str) -> str:
        """Its letters from their classes; an ending that tells the gender stays, in all its images."""
        low = lower(value)
        ending = ENDING.search(low)
        kept = ending.start() if ending and ending.start() > 1 else len(low)

        def step(x: str) -> str:
            return self.permute("surname", x[:kept], [letter_class(c) for c in x[:kept]]) + low[kept:]

        def ends(x: str) -> int:
            found = ENDING.search(x)
            return found.start() if found and found.start() > 1 else len(x)

        image = step(low)
        while ends(image) != kept:  # an image that reads as another kind of surname is passed over
            image = step(image)
        return like(value, image)

    def given(self, value: str) -> str:
        for names in GIVEN.values():
            if value.capitalize() in names:
                other = names[Permutation(self.key, "given" + names[0], len(names)).move(names.index(value.capitalize()))]
                return other.upper() if value.isupper() and len(value) > 1 else other
        # its last letter, which may tell the gender, stays; listed names stay among themselves
        step = lambda x: self.permute("given", x, [letter_class(c) for c in x[:-1]] + [""])
        image = step(lower(value))
        while image.capitalize() in GIVEN_NAMES:
            image = step(image)
        return like(value, image)


def refill(value: str, characters: str) -> str:
    """`value` with its letters and digits replaced, one by one."""
    new = iter(characters)
    return "".join(next(new) if c.isalnum() else c for c in value)


def is_ipv6(value: str) -> bool:
    """Whether it is an address of a host: neither the loopback nor without any group to replace."""
    try:
        return any(int(x, 16) for x in ipaddress.IPv6Address(value).exploded.split(":")[1:]) and not ipaddress.IPv6Address(value).is_loopback
    except ValueError:
        return False


def detect(text: str) -> list[Entity]:
    """The entities of a text, in order and without overlap; earlier kinds have precedence."""
    found: list[Entity] = []
    if "@" in text:
        found += [Entity("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [Entity("iban", *m.span()) for m in IBAN.finditer(text) if 15 <= len(m[0].replace(" ", "")) <= 34 and iban_rest(m[0].replace(" ", "")) == 1]
    found += [Entity("ipv6", *m.span()) for m in IPV6.finditer(text) if is_ipv6(m[0])]
    found += [Entity("ip", *m.span()) for m in IPV4.finditer(text)]
    found += [Entity("card", *m.span()) for m in CARD.finditer(text) if luhn(re.sub(r"\D", "", m[0])) % 10 == 0 and len(set(m[0])) > 2]
    found += [Entity("ssn", *m.span()) for m in SSN.finditer(text)]
    found += [Entity("phone", *m.span()) for m in PHONE.finditer(text)]
    known: dict[str, str] = {}
    for m in NAMED.finditer(text):
        names = [i for i in (1, 2) if m[i] and m[i][0].isupper()]
        if not names or names[0] != 1 or m[1] in ADDRESS:
            continue
        for i in names:
            name = POSSESSIVE.sub("", m[i])
            kind = known.setdefault(name, "surname" if i == names[-1] else "given")
            found.append(Entity(kind, m.start(i), m.start(i) + len(name)))
    for m in PAIR.finditer(text):
        if m[1] in GIVEN_NAMES and m[2] not in ADDRESS:
            other = POSSESSIVE.sub("", m[2])
            for i, name, kind in ((1, m[1], "given"), (2, other, "given" if other in GIVEN_NAMES else "surname")):
                found.append(Entity(known.setdefault(name, kind), m.start(i), m.start(i) + len(name)))
    if known:
        longest = sorted(known, key=lambda name: (-len(name), name))
        found += [Entity(known[m[0]], *m.span()) for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, longest))})(?!\w)", text)]
    taken: list[Entity] = []
    for e in found:
        i = bisect_left(taken, e.start, key=lambda t: t.start)
        if (i == len(taken) or taken[i].start >= e.end) and (i == 0 or taken[i - 1].end <= e.start):
            taken.insert(i, e)
    return taken


def candidates(column: pa.Array) -> np.ndarray:
    """Which texts can hold an entity: with an at sign, four digits, colons, a form of address or a listed name."""
    data, offsets = K.text_buffer(column)
    counts = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])
    out = (counts((data >= 48) & (data <= 57)) >= 4) | (counts(data == 64) > 0)
    raw = data.tobytes()
    at = np.array([m.start() for m in NAMED_BYTES.finditer(raw)], dtype=np.int64)
    if b"::" in raw or (counts(data == 58) >= 7).any():  # addresses without four digits
        out |= counts(data == 58) >= 2
    words = K.split_words(data, offsets, K.PUNCTUATION)
    hashes = K.word_hashes(words)
    listed = _given_hashes[np.minimum(np.searchsorted(_given_hashes, hashes), len(_given_hashes) - 1)] == hashes
    for found in (at, words.start[listed]):
        out[np.searchsorted(offsets, found, side="right") - 1] = True
    return out


def redact(text: str, surrogates: Surrogates) -> tuple[str, list[Entity], int]:
    """(the text with surrogates, its entities, how many distinct ones)."""
    entities, parts, at, distinct = detect(text), [], 0, set()
    for e in entities:
        value = text[e.start : e.end]
        parts += [text[at : e.start], surrogates.of(e.kind, value)]
        at = e.end
        distinct.add((e.kind, parts[-1].lower()))
    return "".join([*parts, text[at:]]), entities, len(distinct)


def replace(docs: DataFrame, key: bytes = DEFAULT_KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of REDACTED for each document: its entities (kind:start:end in code points of the
    original, comma-joined) and its whole text with surrogates. A null text stays null."""

    def make():
        surrogates = Surrogates(key)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = texts(batch)
            new, found = _redact_column(column, surrogates)
            say = [",".join(f"{e.kind}:{e.start}:{e.end}" for e in es) for es, _ in found]
            return pa.RecordBatch.from_arrays(
                [id_array(ids(batch)), pa.array([len(es) for es, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64()), pa.array(say, pa.string()), new],
                names=["doc_id", "n_entities", "n_distinct", "entities", "text"],
            )

        return each

    return map_texts(documents(docs, id_col, text_col), make, REDACTED)


def replace_texts(docs: DataFrame, key: bytes = DEFAULT_KEY, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, with surrogates in their texts."""

    def make():
        surrogates = Surrogates(key)
        return lambda column: _redact_column(column, surrogates)[0]

    return rewrite_texts(docs, make, text_col)


def _redact_column(column: pa.Array, surrogates: Surrogates) -> tuple[pa.Array, list[tuple[list[Entity], int]]]:
    found: list[tuple[list[Entity], int]] = [([], 0)] * len(column)
    at = np.flatnonzero(candidates(column))
    changed: dict[int, str] = {}
    for i, text in zip(at.tolist(), column.take(pa.array(at)).to_pylist()):
        if text:
            new, entities, distinct = redact(text, surrogates)
            if entities:
                changed[i], found[i] = new, (entities, distinct)
    if not changed:
        return column.cast(pa.string()), found
    mask = np.zeros(len(column), dtype=bool)
    mask[list(changed)] = True
    return pc.replace_with_mask(column.cast(pa.string()), pa.array(mask), pa.array([changed[i] for i in sorted(changed)], pa.string())), found
