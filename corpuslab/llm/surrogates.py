"""Keyed surrogates for personal data and secrets."""

from __future__ import annotations

import hashlib
import math
import re
import string
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_rows, sized

# Given names that are recognised; a name's surrogate has its script and gender.
GIVEN = {
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Margaret Dorothy Ursula Ingrid Monika Brigitte Isabelle Françoise Nathalie Carmen Dolores Josefina "
    "Maria Anna Emma Sarah Laura Julia Karen Nancy Lisa Sandra Helen Claudia Sabine Petra Heike Anja Chantal Céline Sylvie Lucía Pilar Mercedes Rosa",
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Charles Daniel Jürgen Wolfgang Dieter Heinrich Philippe François Laurent Antonio Francisco Fernando "
    "Peter Paul Thomas George Edward Henry Frank Martin Stefan Klaus Hans Matthias Andreas Jean Pierre Jacques Michel Luc Carlos José Miguel Javier Pablo",
    ("cyrillic", "f"): "Мария Анна Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия",
    ("cyrillic", "m"): "Иван Сергей Алексей Дмитрий Николай Андрей Михаил Владимир Павел Пётр",
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Αγγελική",
    ("greek", "m"): "Γεώργιος Ιωάννης Κωνσταντίνος Δημήτριος Νικόλαος Παναγιώτης",
}
# Capitalised words that stand behind a given name or title and are no family names.
_NOT_FAMILY = frozenset(
    "a an and are as at but by can did do does for from had has have he her his how i if in is it its may my no not of on or our she so that the their then there they this to was we were what "
    "when where who why will with would you your said says who whom der die das und ist war hat mit von für nicht le la les et est il elle de du des que qui el los las y es en un una".split()
)
# Titles that announce a person, by gender (n: either).
TITLES = {"f": "Mrs Ms Miss Madam Madame Mme Frau Señora Sra Госпожа Κυρία", "m": "Mr Sir Herr Monsieur Señor Sr Господин Κύριος", "n": "Dr Prof"}
#: Entities with another attempt that may go to all tasks.
MAX_RETRIED = 100_000
_SYLLABLES = {
    "latin": "bar ben cal dor el far gil hal jor kel lan mar nel or pel quin ros sal tor ul ver wil yar zel".split(),
    "cyrillic": "бар вел гор дан ель жар зор кал лан мар нор пел рос сал тор фед".split(),
    "greek": "αλ βερ γαρ δελ καλ λαν μαρ νικ παλ ρος σαρ τορ φιλ".split(),
}
_ENDING = {("cyrillic", "f"): "ова", ("cyrillic", "m"): "ов", ("greek", "f"): "ου", ("greek", "m"): "ος"}
_GIVEN_OF = {n: k for k, names in GIVEN.items() for n in names.split()}
_TITLE_OF = {t: g for g, words in TITLES.items() for t in words.split()}

_NAME = r"[^\W\d_a-zа-яα-ω][^\W\d_]+(?:[-'’][^\W\d_]+)?"
_GIVEN_RE, _TITLE_RE = "|".join(sorted(_GIVEN_OF, key=len, reverse=True)), "|".join(sorted(_TITLE_OF, key=len, reverse=True))
_CAPS_RE, _CAPS = "|".join(sorted((n.upper() for n in _GIVEN_OF), key=len, reverse=True)), r"[^\W\d_a-zà-ÿа-яα-ω]{2,}(?:[-'’][^\W\d_a-zà-ÿа-яα-ω]+)?"
# Words behind which a person's whole name stands.
_CUE = r"(?:[Mm]y name is|[Nn]ame:|[Rr]egards,|[Ss]incerely,|[Yy]ours truly,|[Ss]igned,|[Ww]ritten by)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_KINDS = re.compile(
    r"(?P<key>-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----)"
    r"|(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?)(?P<assigned>(?=[^\s\"',;]*\d)[^\s\"',;]{6,})"
    r"|\b(?P<secret>(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}|(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{32,128})(?![\w-])"
    r"|(?<![A-Za-z0-9._%+\-])(?P<email>[A-Za-z0-9_%+\-](?:[A-Za-z0-9._%+\-]{0,62}[A-Za-z0-9_%+\-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24})(?![A-Za-z0-9-])"
    r"|\b(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b"
    rf"|(?<![\w.])(?P<ip>(?:{_OCTET}\.){{3}}{_OCTET})(?!\.?\d|[A-Za-z_])"
    r"|(?<![\w:])(?P<mac>(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2})(?![\w:])"
    r"|(?<![\w:])(?P<ipv6>(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})(?![\w:])"
    r"|(?<![\w.+-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w.+-])(?P<card>\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\w-])"
    r"|(?<![\w.])(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-]|\.\d)"
    rf"|\b(?P<title>{_TITLE_RE})\b\.?\s(?:(?P<given>{_GIVEN_RE})\s)?(?P<family>{_NAME})"
    rf"|\b(?P<given2>{_GIVEN_RE})\s(?P<family2>{_NAME})"
    rf"|\b(?P<given3>{_CAPS_RE})\s(?P<family3>{_CAPS})\b"
    rf"|\b{_CUE}[ \t]*\n?[ \t]*(?P<first>{_NAME})[ \t](?P<last>{_NAME})"
)
# Beginnings of keys that may hold no digit; a text with one is searched as a whole.
_WHOLE = ("-----BEGIN", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "eyJ")
# What a line needs to hold any of these: a digit or an at sign, or one of the words behind which names stand.
_DIGIT = re.compile("[0-9@]")
_WORDS = ahocorasick.Automaton()
for _w in {*_GIVEN_OF, *(n.upper() for n in _GIVEN_OF), *_TITLE_OF, "y name is", "ame:", "egards,", "incerely,", "ours truly,", "igned,", "ritten by"}:
    _WORDS.add_word(_w, len(_w))
_WORDS.make_automaton()
# The words that announce a password or key, and the most line breaks that may stand between one and its value.
_ANNOUNCED, _BREAKS = re.compile("password|passwd|pwd|secret|token|key", re.I), 6


@dataclass(frozen=True)
class Entity:
    kind: str
    start: int
    end: int
    norm: str
    trait: str = ""  # script and gender of a name


def luhn(digits: str) -> int:
    """The check digit that makes ``digits`` plus itself valid."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _issuer(card: str) -> int:
    """The leading digits that say who issued a card of this number and length; 0 where nobody does."""
    n = len(card)
    if card[0] == "4":
        return 1 if n in (13, 16, 19) else 0
    if card[:2] in ("34", "37"):
        return 2 if n == 15 else 0
    if "51" <= card[:2] <= "55" or "2221" <= card[:4] <= "2720":
        return (2 if card[0] == "5" else 4) if n == 16 else 0
    if card[:2] in ("36", "38", "39") or "300" <= card[:3] <= "305":
        return 3 if 14 <= n <= 19 else 0
    if card[:2] == "35" or card[0] == "6" or card[:2] in ("50", "56", "57", "58", "59"):
        return 4 if 13 <= n <= 19 else 0
    return 0


def _iban_ok(text: str) -> bool:
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _script(word: str) -> str:
    return "cyrillic" if "Ѐ" <= word[-1] <= "ӿ" else "greek" if "Ͱ" <= word[-1] <= "Ͽ" or "ἀ" <= word[-1] <= "῿" else "latin"


def _entities(m: re.Match) -> Iterator[Entity]:
    kind = m.lastgroup
    if kind in ("family", "family2", "family3", "last"):
        if m[kind].lower() in _NOT_FAMILY:
            return
        given = next((g for g in ("given", "given2", "given3") if m[g]), None)
        gender = _GIVEN_OF[m[given].title()][1] if given else _TITLE_OF[m["title"]] if m["title"] else "n"
        if given:
            yield Entity("given", *m.span(given), m[given].title(), "")
        for name in ("first", kind) if kind == "last" else (kind,):
            yield Entity("family", *m.span(name), m[name].lower(), f"{_script(m[name])}:{gender if _script(m[name]) != 'latin' else 'n'}")
        return
    value = m[kind]
    if kind == "key":
        kind, norm = "secret", value
    elif kind == "assigned":
        kind, norm = "secret", value
    elif kind == "iban":
        norm = value.replace(" ", "")
        if not _iban_ok(norm):
            return
    elif kind == "card":
        norm = re.sub(r"\D", "", value)
        if not _issuer(norm) or luhn(norm[:-1]) != int(norm[-1]):
            return
    elif kind == "phone":
        norm = re.sub(r"\D", "", value)[-10:]
        if not 7 <= len(re.sub(r"\D", "", value)) <= 15:
            return
    else:
        norm = value if kind == "secret" else value.lower()
    yield Entity(kind, *m.span(m.lastgroup), norm)


def detect(text: str | None) -> list[Entity]:
    """The entities of a text, in order and without overlaps."""
    out: list[Entity] = []
    if not text:
        return out
    if any(p in text for p in _WHOLE):
        pieces = [(0, text)]
    else:
        # a family name may stand on the line after a hint, and the name of a password on lines before its value
        lines = text.split("\n")
        starts = list(accumulate((len(x) + 1 for x in lines), initial=0))
        named = {bisect_right(starts, end) - 1 for end, _ in _WORDS.iter(text)}
        pieces, until = [], -1
        before = _BREAKS if len(lines) > 1 and _ANNOUNCED.search(text) else 0
        for n, line in enumerate(lines):
            hint = n in named or _DIGIT.search(line)
            if hint or n == until:
                first, last = starts[max(0, n - before)] if hint else starts[n], starts[n + 1] - 1
                if pieces and first <= pieces[-1][1] + 1:
                    pieces[-1][1] = last
                else:
                    pieces.append([first, last])
                until = n + 1 if hint else until
        pieces = [(a, text[a:b]) for a, b in pieces]
    for at, piece in pieces:
        for m in _KINDS.finditer(piece):
            out += [Entity(e.kind, e.start + at, e.end + at, e.norm, e.trait) for e in _entities(m)]
    return out


def mentions(text: str | None) -> list[Entity]:
    """The entities of a text, and further mentions of the persons named in it: a given or family name standing alone."""
    found = detect(text)
    names: dict[str, Entity] = {}
    for e in found:
        if e.kind in ("given", "family"):
            for form in (text[e.start : e.end], text[e.start : e.end].title(), text[e.start : e.end].upper()):
                names.setdefault(form, e)
    if not names:
        return found
    taken, long = {i for e in found for i in (e.start, e.end - 1)}, [e for e in found if e.kind not in ("given", "family")]
    more = [
        Entity(names[m[0]].kind, *m.span(), names[m[0]].norm, names[m[0]].trait)
        for m in re.finditer(rf"(?<![\w@.-])(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})(?![\w@]|[-.]\w)", text)
        if m.start() not in taken and m.end() - 1 not in taken and not any(f.start <= m.start() < f.end for f in long)
    ]
    return sorted(found + more, key=lambda e: e.start)


def _stream(key: bytes, *parts: object) -> Iterator[int]:
    seed, n = "|".join(map(str, parts)).encode("utf-8", "surrogatepass"), 0
    while True:
        yield from hashlib.blake2b(seed + b"|%d" % n, key=key, digest_size=64).digest()
        n += 1


def _feistel(key: bytes, tweak: bytes, x: int, bits: int, back: bool) -> int:
    """A keyed permutation of the numbers of ``bits`` bits, or its inverse."""
    low = bits // 2
    a, b, masks = x >> low, x & ((1 << low) - 1), ((1 << (bits - low)) - 1, (1 << low) - 1)
    for r in reversed(range(8)) if back else range(8):
        own = int.from_bytes(hashlib.blake2b(b"%d|%d|%d" % (r, bits, a if r % 2 else b) + tweak, key=key, digest_size=64).digest(), "big")
        if r % 2:
            b ^= own & masks[1]
        else:
            a ^= own & masks[0]
    return a << low | b


def shifted(key: bytes, tweak: bytes, x: int, n: int, by: int) -> int:
    """The number ``by`` places behind ``x`` on a keyed circle of all numbers below ``n``.

    For each ``by`` this is a permutation, without a fixed point unless ``n`` divides ``by``.
    """
    bits = max(2, (n - 1).bit_length())
    for back in (False, True):
        x = x if back is False else (x + by) % n
        x = _feistel(key, tweak, x, bits, back)
        while x >= n:
            x = _feistel(key, tweak, x, bits, back)
    return x


@dataclass(frozen=True)
class Format:
    """All values of an entity's format: what they have in common, their number, and this one's place among them."""

    common: str
    size: int
    place: int
    write: Callable[[int], str]


_DIGITS, _HEX = string.digits, "0123456789abcdef"
#: Formats of more values than this don't need a permutation: keyed values never meet.
_MANY = 1 << 256


def _slots(text: str, slots: Sequence[str | None], around: Callable[[str], str] = str, head: str = "") -> Format:
    """The format of a text whose characters range over alphabets (None: they stay)."""
    place, size = 0, 1
    for c, alphabet in zip(text, slots):
        if alphabet:
            place, size = place * len(alphabet) + alphabet.index(c), size * len(alphabet)

    def write(n: int) -> str:
        out = []
        for c, alphabet in zip(reversed(text), reversed(slots)):
            if alphabet:
                n, at = divmod(n, len(alphabet))
                c = alphabet[at]
            out.append(c)
        return around("".join(reversed(out)))

    return Format(head + "".join(c if a is None else f"<{a[0]}{len(a)}>" for c, a in zip(text, slots)), size, place, write)


def _classes(text: str, hexadecimal: bool = False) -> list[str | None]:
    if hexadecimal:
        return [_HEX if c in _HEX else None for c in text]
    return [_DIGITS if c in _DIGITS else string.ascii_lowercase if c in string.ascii_lowercase else string.ascii_uppercase if c in string.ascii_uppercase else None for c in text]


_PRIVATE = re.compile(r"(?:10|127)\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.")


def _octets(norm: str) -> Format:
    """An address keeps the length of each octet, and a private one its range."""
    own = _PRIVATE.match(norm)
    head = own[0] if own else ""
    ranges = [{1: (0, 10), 2: (10, 100), 3: (100, 256)}[len(o)] for o in norm[len(head) :].split(".")]
    place, size = 0, 1
    for o, (a, b) in zip(norm[len(head) :].split("."), ranges):
        place, size = place * (b - a) + int(o) - a, size * (b - a)

    def write(n: int) -> str:
        out = []
        for a, b in reversed(ranges):
            n, at = divmod(n, b - a)
            out.append(str(a + at))
        return head + ".".join(reversed(out))

    return Format(head + "|".join(str(a) for a, _ in ranges), size, place, write)


def format_of(kind: str, norm: str) -> Format | None:
    """The format that a surrogate keeps; None for names and for texts that are too long to count."""
    if kind == "family" or len(norm) > 200:
        return None
    if kind == "email":
        local, _, domain = norm.rpartition("@")
        return _slots(local, _classes(local), lambda x: f"{x}@{domain}", f"@{domain}|")
    if kind == "domain":
        return _slots(norm, _classes(norm), lambda x: f"{x}.example")
    if kind == "phone":
        return _slots(norm, ["23456789" if norm[0] in "23456789" else "01", *[_DIGITS] * (len(norm) - 1)])
    if kind == "ip":
        return _octets(norm)
    if kind in ("mac", "ipv6"):
        return _slots(norm, _classes(norm, True))
    if kind == "ssn":
        return _slots(norm, _classes(norm))
    if kind == "card":
        keep = _issuer(norm)
        return _slots(norm[:-1], [None] * keep + [_DIGITS] * (len(norm) - 1 - keep), lambda x: x + str(luhn(x)), f"{len(norm)}|")
    if kind == "iban":
        check = lambda x: f"{98 - int(''.join(str(int(c, 36)) for c in x + norm[:2] + '00')) % 97:02d}"
        return _slots(norm[4:], _classes(norm[4:]), lambda x: norm[:2] + check(x) + x, norm[:2])
    head = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|eyJ", norm)
    keep = head[0] if head else ""
    body = norm[len(keep) :]
    return _slots(body, _classes(body, bool(re.fullmatch(r"[0-9a-f]+", body))), lambda x: keep + x, keep)


def _like(norm: str, rnd: Iterator[int]) -> str:
    """Characters of the same classes; others stay."""
    return "".join(a[(next(rnd) * 256 + next(rnd)) % len(a)] if a else c for c, a in zip(norm, _classes(norm, bool(re.fullmatch("[0-9a-f]+", norm)))))


@lru_cache(maxsize=20_000)
def surrogate(kind: str, norm: str, trait: str, attempt: int, key: bytes) -> str:
    """The replacement, in normal form, that the key gives for an entity's normal form.

    Of formats that can be counted it is a permutation, so that two entities
    never meet in the same attempt, and no entity is its own surrogate.
    """
    if kind == "family":
        rnd, (script, gender) = _stream(key, kind, norm, trait, attempt), trait.split(":")
        parts = _SYLLABLES[script]
        return "".join(parts[(next(rnd) * 256 + next(rnd)) % len(parts)] for _ in range(3 + attempt // 2)) + _ENDING.get((script, gender), "")
    own = format_of(kind, norm)
    if own is not None and 1 < own.size <= _MANY:
        place, tweak = own.place, f"{kind}|{own.common}".encode("utf-8", "surrogatepass")
        while True:
            place = shifted(key, tweak, place, own.size, 1 + attempt % (own.size - 1))
            new = own.write(place)
            if kind != "ip" or "." in own.common or not _PRIVATE.match(new):
                return new
    rnd = _stream(key, kind, norm, trait, attempt)
    if kind == "domain":
        return _like(norm, rnd) + ".example"
    head, tail = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|eyJ|-----BEGIN [A-Z ]*-----", norm), re.search(r"-----END [A-Z ]*-----$", norm)
    keep, end = head[0] if head else "", tail[0] if tail else ""
    return keep + _like(norm[len(keep) : len(norm) - len(end)], rnd) + end


def given_name(name: str, key: bytes) -> str:
    """Another name of the same script and gender: the next on a keyed circle of them, so that no two meet."""
    circle = sorted(GIVEN[_GIVEN_OF[name]].split(), key=lambda n: hashlib.blake2b(n.encode(), key=key).digest())
    return circle[(circle.index(name) + 1) % len(circle)]


def _render(kind: str, text: str, new: str) -> str:
    """The normal form in the written form of the original."""
    if kind in ("phone", "card", "iban"):
        rest, out = list(new), []
        for c in reversed(text):
            out.append(rest.pop() if rest and (c.isalnum() if kind == "iban" else c.isdigit()) else c)
        return "".join(reversed(out))
    if kind == "family":
        return new.upper() if text.isupper() else new.title()
    return new.upper() if kind != "secret" and text.isupper() and len(text) > 1 else new


def replace(text: str | None, key: bytes, attempts: dict[str, int]) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and where they stand in it."""
    found, parts, spans, at, size = mentions(text), [], [], 0, 0
    for e in found:
        old = text[e.start : e.end]
        if e.kind == "given":
            new = given_name(e.norm, key)
            new = new.upper() if old.isupper() else new
        else:
            new = surrogate(e.kind, e.norm, e.trait, attempts.get(_code(e.kind, e.norm, e.trait), 0), key)
            if e.kind == "email":
                local, _, domain = new.rpartition("@")
                new = f"{local}@{surrogate('domain', domain, '', attempts.get(_code('domain', domain, ''), 0), key)}"
            new = _render(e.kind, old, new)
        parts += [text[at : e.start], new]
        size += e.start - at
        spans.append({"kind": e.kind, "start": size, "end": size + len(new)})
        size += len(new)
        at = e.end
    return ("".join([*parts, text[at:]]) if found else text), spans


def _code(kind: str, norm: str, trait: str) -> str:
    return hashlib.blake2b(f"{kind}|{norm}|{trait}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _listed(text: str | None) -> list[tuple[str, str, str]]:
    found = {(e.kind, e.norm, e.trait) for e in detect(text) if e.kind != "given"}
    return sorted(found | {("domain", n.rpartition("@")[2], "") for k, n, _ in found if k == "email"})


def assign(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``kind, norm, trait, attempt`` of the entities whose first surrogate met another's, or is itself another entity.

    All distinct entities of the corpus get their keyed surrogate.  Those that
    meet try their next, again and again; in a format of which less than a
    quarter is taken, or whose values grow with the attempts, each try fails with
    probability a half at most, so the few that are left soon come to an end.
    Where the entities are a quarter or more of their format's values, the
    permutation alone keeps their surrogates distinct from one another and from their
    own originals; that one of them is another's original can't be avoided there.
    """
    entity = "array<struct<kind:string,norm:string,trait:string>>"
    listed = map_rows(docs.select(text_col), lambda c: [[[dict(zip(("kind", "norm", "trait"), e)) for e in _listed(t)] for t in c[0]]], f"e {entity}").select(F.inline("e"))

    def named(columns: list) -> list:
        kinds, norms, traits, tries = columns
        formats = [format_of(k, n) for k, n in zip(kinds, norms)]
        return [kinds, norms, traits, tries, [surrogate(*x, key) for x in zip(kinds, norms, traits, tries)], [f.common if f else "" for f in formats], [float(min(f.size, _MANY)) if f else math.inf for f in formats]]

    def given(df: DataFrame) -> DataFrame:
        return map_rows(df.select("kind", "norm", "trait", "attempt"), named, "kind string, norm string, trait string, attempt int, new string, common string, size double")

    now = checkpoint(given(listed.distinct().withColumn("attempt", F.lit(0))))
    per_format = now.groupBy("kind", "common").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    crowded = per_format.filter("4 * n >= size").select("kind", "common", F.lit(True).alias("crowded"))
    free = checkpoint(now.join(crowded, ["kind", "common"], "left").filter("crowded is null and kind <> 'email'").drop("crowded", "common", "size"))
    olds = now.filter("kind <> 'email'").select("kind", F.col("norm").alias("new")).distinct()
    first = free.groupBy("kind", "new").agg(F.count("*").alias("n"), F.min(F.struct("norm", "trait")).alias("first"))
    met = first.join(olds.withColumn("old", F.lit(True)), ["kind", "new"], "left").filter("n > 1 or old")
    bad = free.join(met, ["kind", "new"]).filter((F.struct("norm", "trait") != F.col("first")) | F.coalesce("old", F.lit(False))).select("kind", "norm", "trait", "attempt")
    open_, settled = checkpoint(bad), docs.sparkSession.createDataFrame([], "kind string, norm string, trait string, attempt int, new string")
    taken = None if open_.isEmpty() else checkpoint(now.select("kind", "new").unionByName(olds).distinct())
    while not open_.isEmpty():
        tried = checkpoint(given(open_.withColumn("attempt", F.col("attempt") + 1)).drop("common", "size"))
        new = tried.select("kind", "new").distinct()
        clash = taken.join(sized(new), ["kind", "new"]).unionByName(settled.join(new, ["kind", "new"]).select("kind", "new")).distinct()
        own = tried.groupBy("kind", "new").agg(F.min(F.struct("norm", "trait")).alias("first")).join(clash, ["kind", "new"], "left_anti")
        good = checkpoint(tried.join(own, ["kind", "new"]).filter(F.struct("norm", "trait") == F.col("first")).select(*settled.columns))
        settled = checkpoint(settled.unionByName(good))
        open_ = checkpoint(tried.drop("new").join(good.select("kind", "norm", "trait"), ["kind", "norm", "trait"], "left_anti"))
    return settled.drop("new")


def pseudonymise(docs: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_entities, entities`` for each row.

    E-mail addresses, phone, card, social security and bank account numbers,
    network addresses, passwords, keys and tokens, and names of persons are
    replaced in the whole text by keyed values of the same kind and format;
    names keep script and gender.  The same entity has the same surrogate in
    all documents and written forms, different ones have different surrogates,
    and no entity keeps its own value.  A person named in full or with a title
    is replaced at all mentions in that text, also where the given or the family name stands alone.
    ``entities`` says kind and place in the new text.  Null texts stay null;
    texts without entities stay as they are; texts of any length are searched
    whole; ids may be null or repeat, and a repeated row is replaced in the same way each time; other columns,
    whatever their names, play no part; an empty table gives no rows.

    Names are found by given names of four languages and three scripts, titles
    and a few phrases that announce a name; others are beyond it.

    The few entities that need another attempt go to all tasks while their
    count is bounded, and otherwise to their documents by a join.
    """
    kind = dict(docs.dtypes)[id_col]
    retried = assign(docs, key, text_col)
    schema = f"doc_id {kind}, text string, n_entities int, entities array<struct<kind:string,start:int,end:int>>"

    def out(columns: list, attempts: list) -> list:
        made = [replace(t, key, a) for t, a in zip(columns[1], attempts)]
        return [columns[0], [t for t, _ in made], [len(s) for _, s in made], [s for _, s in made]]

    if retried.limit(MAX_RETRIED + 1).count() <= MAX_RETRIED:
        table = docs.sparkSession.sparkContext.broadcast({_code(r["kind"], r["norm"], r["trait"]): r["attempt"] for r in retried.collect()})
        return map_rows(docs.select(id_col, text_col), lambda c: out(c, [table.value] * len(c[0])), schema)
    entity = "array<struct<kind:string,norm:string,trait:string>>"
    own = map_rows(docs.select(id_col, text_col), lambda c: [c[0], [[dict(zip(("kind", "norm", "trait"), e)) for e in _listed(t)] for t in c[1]]], f"_id {kind}, e {entity}").select("_id", F.inline("e"))
    pairs = own.distinct().join(retried, ["kind", "norm", "trait"]).groupBy("_id").agg(F.collect_list(F.struct("kind", "norm", "trait", "attempt")).alias("_retried"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(pairs, "_id", "left").select("_id", "_text", "_retried")
    return map_rows(rows, lambda c: out(c, [{_code(r["kind"], r["norm"], r["trait"]): r["attempt"] for r in x or []} for x in c[2]]), schema)
