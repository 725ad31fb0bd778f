"""Surrogates for personal data and secrets.

A detected entity is read as a number in the mixed radix of its own shape: each letter, digit or
hexadecimal place counts within the alphabet of its kind and script, what is left is punctuation
and stays. Over numbers of that shape a keyed permutation P (a Feistel network, walked along its
cycle into range) gives the surrogate P'(P(x) + 1), P' undoing P: never x itself, one to one, and
the same wherever the entity occurs. So format and script match, distinct entities stay distinct
and mentions of one stay together, with no table to share between tasks. Constraints (a card
number's check digit, a listed given name of one gender, a private address) are kept by walking on
until the constraint holds as it did before, which is one to one again. A name has one surrogate,
as given name or as surname and under any form of address: a listed one goes to another of its
list, so gender stays, names on no list go to names on no list. A name found behind a form of
address is rewritten wherever it stands in the same text as a word, or part of a hyphenated one, of
its own (single letters aside). ``collisions`` checks all of it over a whole corpus; op9 runs it
and takes another key if anything collides.

Letters and digits of other scripts count within the letters of their script, case and block of 64
code points. What has no other member of its shape, or finds none in TRIES steps, is masked by its
kind in brackets and never left as it was; masked entities are not told apart.

Defined cases: null text stays null with no entities, empty text likewise; repeated rows are
rewritten each, alike; a null doc_id is carried; an empty table gives nothing; other columns are
carried by ``pseudonymise``, and a column named like the one for entities is an error; addresses
that differ in leading zeros only are one.

Detected: mail addresses; what follows token, secret, password, passwd or api key and a sign; hex of
32 places or more; IPv4 and IPv6; phone numbers with a leading '+', with an area code in brackets
or a leading 0, or as 3-3-4 digits; cards in fours or 4-6-5; IBANs of right check digits; US social
security numbers; names directly behind one of the forms of address in ``ADDRESS``, and the same
names elsewhere in that text. Not detected, and so neither rewritten nor counted: other names,
postal addresses, dates of birth, local numbers without an area code,
other identity, tax and account numbers, user names, secrets not announced by such a word.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.llm.names import free
from slackline.plans.scratch import Scratch

#: For the registered query and tests only: whoever knows the key can undo the surrogates.
DEMONSTRATION_KEY = b"slackline-demonstration-key"
#: Steps of a walk after which an entity is masked.
TRIES = 100_000

#: Given names by gender.
GIVEN = {
    "f": "Alice Anna Clara Diana Elena Emma Grace Hanna Ines Julia Karin Laura Maria Nora Olga Paula Rosa Sara Teresa Vera".split(),
    "m": "Adam Bruno Carl David Erik Felix Georg Hugo Ivan Jonas Karl Louis Marco Noah Oscar Peter Ralf Simon Tomas Victor".split(),
}
#: Forms of address and the gender that they tell.
ADDRESS = {"mr": "m", "herr": "m", "monsieur": "m", "señor": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "madame": "f", "señora": "f", "dr": ""}
#: Letters by script, vowels apart so that names can be said.
ALPHABETS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", "àáâäéèêëíìîïóòôöúùûü", "ÀÁÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜ", "çñß", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзиклмнопрстуфхцчшщэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ")


class _Places(dict):
    """A character to its alphabet and its place there; None for what stays."""

    def __missing__(self, c: str) -> tuple[str, int] | None:
        kind, script = unicodedata.category(c), unicodedata.name(c, "").split(" ")[0]
        self[c] = None
        if kind[0] == "L" or kind == "Nd":
            block = (chr(k) for k in range(ord(c) & ~63, (ord(c) & ~63) + 64))
            same = "".join(x for x in block if x not in _FIXED and unicodedata.category(x) == kind and unicodedata.name(x, "").split(" ")[0] == script)
            self.update((x, (same, k)) for k, x in enumerate(same) if len(same) > 1)
        return self[c]


_FIXED = {c: (a, k) for a in ALPHABETS for k, c in enumerate(a)}
_PLACE = _Places(_FIXED)
_HEX, _SIX = ([{c: (a, k) for k, c in enumerate(a)} for a in both] for both in (("0123456789abcdef", "0123456789ABCDEF"), ("abcdef", "ABCDEF")))

PATTERNS: list[tuple[str, re.Pattern, Callable[[str], bool]]] = [
    ("email", re.compile(r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}"), lambda t: "@" in t),
    ("secret", re.compile(r"""(?i)(?:token|secret|password|passwd|api[_-]?key)\s*[=:]\s*["']?([\w+/.-]{8,})"""), lambda t: "=" in t or ":" in t),
    ("hex", re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])"), bool),
    ("ipv4", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"), lambda t: "." in t),
    ("phone", re.compile(r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\d)"), lambda t: "+" in t),
    ("phone", re.compile(r"(?<![\w)])\((?:\d{3}\) ?\d{3}[ .-]\d{4}|0\d{1,4}\)[ .-]?\d{3,8}(?:[ -]\d{2,6}){0,2})(?!\d)"), lambda t: "(" in t),
    ("phone", re.compile(r"(?<![\w.,+/-])0(?=(?:[ /-]?\d){6,14}(?!\d))\d{1,4}[ /-]\d{3,8}(?:[ -]\d{2,6}){0,2}(?![\d])"), lambda t: "0" in t),
    ("phone", re.compile(r"(?<![\w.+-])\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}(?![\w-])"), bool),
    ("card", re.compile(r"(?<![\d.-])(?:\d{4}[ -]?){3}\d{1,7}(?![\d])"), bool),
    ("card", re.compile(r"(?<![\d.-])(?:\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![\d-])"), bool),
    ("ipv6", re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{3,39}(?![\w:]|\.\d)"), lambda t: t.count(":") > 1),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"), bool),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), lambda t: "-" in t),
]
_LETTERS = r"(?:[^\W\d_][\u0300-\u036f]*)+"
_NAME = re.compile(rf"\b(?i:(mrs?|ms|miss|herr|frau|madame|monsieur|señora?|dr))\.? ({_LETTERS}(?:-{_LETTERS})*)(?: ({_LETTERS}(?:-{_LETTERS})*))?")
_WORD = re.compile(rf"(?<![\w-]){_LETTERS}(?:-{_LETTERS})*(?!\w)")
_PART = re.compile(_LETTERS)
_DIGIT = re.compile(r"\d")


# --- keyed permutations ------------------------------------------------------------------------

def _feistel(x: int, bits: int, tweak: bytes, back: bool) -> int:
    half = bits // 2
    mask, size = (1 << half) - 1, (half + 7) // 8
    left, right = x >> half, x & mask
    for k in range(8):
        turn = 7 - k if back else k
        if back:
            left, right = right, left
        digest = hashlib.blake2b(bytes([turn]) + right.to_bytes(size, "big"), key=tweak, digest_size=min(64, size)).digest()
        if size > 64:
            digest = digest * (size // 64 + 1)
        left ^= int.from_bytes(digest[:size], "big") & mask
        if not back:
            left, right = right, left
    return left << half | right


def _permute(x: int, n: int, tweak: bytes, back: bool = False) -> int:
    bits = max(2, (n - 1).bit_length() + (n - 1).bit_length() % 2)
    while True:
        x = _feistel(x, bits, tweak, back)
        if x < n:
            return x


def shifted(x: int, n: int, tweak: bytes) -> int:
    """A one-to-one map of 0 .. n - 1 that moves every number (of n > 1)."""
    return x if n < 2 else _permute((_permute(x, n, tweak) + 1) % n, n, tweak, back=True)


def reshape(text: str, key: bytes, kind: str, keep: Callable[[str], object] | None = None, places: dict = _PLACE) -> str | None:
    """Another text of the same shape; of those for which ``keep`` says what it says of ``text``. None if there is no other or TRIES steps meet none."""
    at = [(k, *places[c]) for k, c in enumerate(text) if (c in places or places is _PLACE) and places[c]]
    n, x, shape = 1, 0, list(text)
    for k, alphabet, digit in at:
        x, n = x * len(alphabet) + digit, n * len(alphabet)
        shape[k] = alphabet[0]
    if n == 1:
        return None
    tweak = hashlib.blake2b(f"{kind}\0{''.join(shape)}".encode("utf-8", "surrogatepass"), key=key, digest_size=32).digest()
    for _ in range(TRIES):
        x = shifted(x, n, tweak)
        y, out = x, list(text)
        for k, alphabet, _digit in reversed(at):
            y, digit = divmod(y, len(alphabet))
            out[k] = alphabet[digit]
        made = "".join(out)
        if keep is None or keep(made) == keep(text):
            return None if made == text else made
    return None


# --- surrogates by kind --------------------------------------------------------------------------

def _behind(head: str, made: str | None, tail: str = "") -> str | None:
    return None if made is None else head + made + tail


def luhn(text: str) -> bool:
    digits = [int(c) for c in reversed(text) if c.isdigit()]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


def _ipv4(text: str, key: bytes) -> str:
    a, b, c, d = map(int, text.split("."))
    fixed, n = ((f"{a}.", 24) if a in (10, 127) else (f"{a}.{b}.", 16) if (a, b) in ((192, 168), (172, 16)) else ("", 32))
    x = ((a << 24) | (b << 16) | (c << 8) | d) & ((1 << n) - 1)
    while True:
        x = shifted(x, 1 << n, hashlib.blake2b(f"ipv4 {fixed}".encode(), key=key, digest_size=32).digest())
        octets = [x >> s & 255 for s in range(n - 8, -1, -8)]
        if fixed or octets[0] not in (10, 127) and (octets[0], octets[1]) not in ((192, 168), (172, 16)):
            return fixed + ".".join(map(str, octets))


def _is_ipv6(text: str) -> bool:
    try:
        return ipaddress.IPv6Address(text) is not None and any(c.isdigit() for c in text)
    except ValueError:
        return False


def _ipv6(text: str, key: bytes) -> str | None:
    local = lambda t: t[:3].lower() in ("fe8", "fe9", "fea", "feb") or t[:2].lower() in ("fc", "fd")
    head = text[: text.index(":")] if local(text) else ""
    rest = text[len(head) :]
    keep = lambda t: (not head and local(t), t != t.lower(), any(c.isdigit() for c in head + t))
    return _behind(head, reshape(rest, key, "ipv6 " + head, keep, _HEX[rest != rest.lower()]))


def _iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in rest + country if c != " ") + "00") % 97


def _is_iban(text: str) -> bool:
    return 15 <= len(text.replace(" ", "")) <= 34 and int(text[2:4]) == _iban_check(text[:2], text[4:])


def _iban(text: str, key: bytes) -> str | None:
    rest = reshape(text[4:], key, "iban " + text[:2])
    return None if rest is None else f"{text[:2]}{_iban_check(text[:2], rest):02d}{rest}"


#: What must hold of a match beside its pattern.
VALID = {"ipv6": _is_ipv6, "iban": _is_iban}


_LISTED = {name: gender for gender, names in GIVEN.items() for name in names}


def _name(name: str, key: bytes) -> str | None:
    if name in _LISTED:
        listed = GIVEN[_LISTED[name]]
        return listed[shifted(listed.index(name), len(listed), hashlib.blake2b(f"given {_LISTED[name]}".encode(), key=key, digest_size=32).digest())]
    parts = name.split("-")
    if len(parts) > 1:  # each part as if it stood alone
        made = [_name(p, key) for p in parts]
        return None if None in made else "-".join(made)
    return reshape(name, key, "name", lambda t: t in _LISTED)


def _surrogate(kind: str, text: str, key: bytes) -> str | None:
    if kind in ("given", "surname"):
        return _name(text, key)
    if kind == "ipv4":
        return _ipv4(text, key)
    if kind == "ipv6":
        return _ipv6(text, key)
    if kind == "iban":
        return _iban(text, key)
    if kind == "card":
        return reshape(text, key, kind, luhn)
    if kind == "hex":
        if text.isdigit():
            return reshape(text, key, "hex of digits")
        if text.isalpha():
            return reshape(text, key, "hex of letters", None, _SIX[text != text.lower()])
        return reshape(text, key, kind, lambda t: not t.isdigit() and not t.isalpha(), _HEX[text != text.lower()])
    if kind == "phone" and not text.startswith("+"):
        return reshape(text, key, kind, lambda t: t.lstrip("(")[0] == "0")
    if kind == "phone":
        country = re.match(r"\+\d{1,3}(?=[ .(-])", text)
        head = country[0] if country else "+"
        return _behind(head, reshape(text[len(head) :], key, "phone " + head))
    if kind == "email":
        head, _, tld = text.rpartition(".")
        return _behind("", reshape(head, key, kind), "." + tld)
    return reshape(text, key, kind)


def surrogate(kind: str, text: str, key: bytes) -> str:
    """What ``text`` becomes, wherever it occurs; its kind in brackets where nothing else of its shape is found."""
    return _surrogate(kind, text, key) or f"[{kind}]"


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), in order, none overlapping; of those that do, the one that starts first, then the longest."""
    found: list[tuple[int, int, str]] = []
    if "@" in text or "=" in text or ":" in text or _DIGIT.search(text):
        for kind, pattern, worth in PATTERNS:
            if worth(text):
                for m in pattern.finditer(text):
                    lo, hi = m.span(m.lastindex or 0)
                    if kind in VALID and not VALID[kind](text[lo:hi]):
                        continue
                    k = "hex" if kind == "secret" and (set(text[lo:hi]) <= set("0123456789abcdef") or set(text[lo:hi]) <= set("0123456789ABCDEF")) else kind
                    found.append((lo, hi, k))
    names: dict[str, str] = {}
    for m in _NAME.finditer(text):
        if m[2][0].islower():  # letters of scripts without case may begin a name
            continue
        if m[3] and not m[3][0].islower():
            found += [(*m.span(2), "given"), (*m.span(3), "surname")]
            names.setdefault(m[3], "surname")
            names[m[2]] = "given"
        else:
            found.append((*m.span(2), "given" if m[2] in _LISTED else "surname"))
            names.setdefault(m[2], found[-1][2])
    if names:
        names |= {p: kind for name, kind in names.items() for p in name.split("-") if p not in names}
        met = {e[0] for e in found}
        for m in _WORD.finditer(text):
            for part in (m,) if m[0] in names else _PART.finditer(text, *m.span()):
                if len(part[0]) > 1 and part[0] in names and part.start() not in met:
                    found.append((*part.span(), names[part[0]]))
    found.sort(key=lambda e: (e[0], -e[1]))
    out: list[tuple[int, int, str]] = []
    for e in found:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def rewrite(text: str, key: bytes) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, entity, surrogate) of each."""
    parts, at, told = [], 0, []
    for lo, hi, kind in find_entities(text):
        new = surrogate(kind, text[lo:hi], key)
        parts += [text[at:lo], new]
        told.append((kind, text[lo:hi], new))
        at = hi
    return "".join([*parts, text[at:]]), told


_ENTITY = "array<struct<kind:string,entity:string,surrogate:string>>"


def pseudonymise(docs: DataFrame, key: bytes, entities: str = "entities") -> DataFrame:
    """``docs`` with ``text`` rewritten and a column of entities (kind, entity, surrogate), which a caller drops or guards."""
    if free(docs.columns, entities) != [entities]:
        raise ValueError(f"there is a column {entities} already; name another for the entities")

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            made = [(None, []) if t is None else rewrite(t, key) for t in batch]
            yield pd.DataFrame({"text": [t for t, _ in made], "entities": [[{"kind": a, "entity": b, "surrogate": c} for a, b, c in e] for _, e in made]})

    (both,) = free([*docs.columns, entities], "rewritten")
    made = docs.withColumn(both, F.pandas_udf(run, f"text string, entities {_ENTITY}")(F.col("text")))
    return made.withColumns({"text": F.col(f"{both}.text"), entities: F.col(f"{both}.entities")}).drop(both)


def collisions(rewritten: DataFrame) -> DataFrame:
    """kind, surrogate, n of every surrogate that stands for several entities or for itself, or for one that has others; empty if all is well. Masks don't count."""
    same = F.when(F.col("e.kind") == "ipv4", F.regexp_replace("e.entity", r"(^|\.)0+(?=\d)", "$1")).otherwise(F.col("e.entity"))
    each = rewritten.select(F.explode("entities").alias("e")).where(F.col("e.surrogate") != F.concat(F.lit("["), "e.kind", F.lit("]")))
    each = each.select(F.when(F.col("e.kind").isin("given", "surname"), "name").otherwise(F.col("e.kind")).alias("kind"), same.alias("entity"), "e.surrogate").groupBy("kind", "entity", "surrogate").agg(F.count("*").alias("mentions"))
    several = each.groupBy("kind", "entity").agg(F.count("*").alias("n"), F.min("surrogate").alias("surrogate")).where("n > 1").select("kind", "surrogate", "n", F.lit(0).alias("self"))
    shared = each.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.max((F.col("entity") == F.col("surrogate")).cast("int")).alias("self")).where("n > 1 or self = 1")
    return shared.unionByName(several)


def checked(docs: DataFrame, key: bytes, tries: int = 4) -> DataFrame:
    """``pseudonymise`` as a written table in which nothing collides: while something does, all is rewritten under another key. Raises if every key collides."""
    scratch = Scratch(docs.sparkSession, "pii")
    for k in range(tries):
        made = scratch.save(pseudonymise(docs, key), f"made{k}")
        if collisions(made).isEmpty():
            return made
        scratch.drop(f"made{k}")
        key = hashlib.blake2b(b"next", key=key, digest_size=32).digest()
    raise ValueError(f"surrogates collide under {tries} keys")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (rewritten), n_entities, kinds of every document."""
    made = checked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), DEMONSTRATION_KEY)
    return made.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.array_sort(F.array_distinct("entities.kind")).alias("kinds"))
