"""Personal data and secrets replaced by keyed surrogates of the same type and form.

Entities are found by patterns (secret assignments and keys, e-mail and IP addresses, IBANs, payment cards, telephone and social security numbers, names
after a title), by a lexicon (a listed given name with the names after it), and by reference (a surname of the text, wherever else it stands in it). An
entity's surrogate is a keyed permutation of its form: characters are read as digits of a mixed-radix number (a radix per class: digits, lower and upper
Latin, accented Latin, Greek, Cyrillic, ...), which a Feistel network over the key and the form maps to another number of the same size. So script, case,
length, separators and validity stay: octets below 256, check digits of cards and IBANs, areas of social security numbers, country codes. A listed given
name becomes another of its gender and script; other names keep their last letter, which carries the gender, and vowels stay vowels.

An entity is permuted in a canonical spelling (addresses in lower case, numbers without separators, North American telephone numbers without their country
code) and written as the original was, so that its notations share a surrogate. A permutation gives equal entities equal surrogates in the whole corpus
(coreference) and different entities different ones (distinctness) without any table of entities, so nothing is gathered. Collisions are ruled out, not repaired:
names that aren't listed, and numbers that aren't valid, walk on along the permutation past the listed and valid ones. It has no fixed points but for the rare
walk that ends where it began.

Defined results: null texts stay null, empty ones empty; every occurrence in texts of any length is replaced; where patterns overlap the one that starts first
holds, and of those that start together the first above; repeated rows are treated alike; other columns pass unchanged, but for one named as the spans; an empty table gives
an empty result.
"""

from __future__ import annotations

import functools
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentis.llm.common import small_batches

#: The production key comes from the caller; this one serves the registered query and tests.
DEFAULT_KEY = b"momentis surrogate key"
ROUNDS = 8

#: Character classes that a surrogate keeps, as alphabets.
_CLASSES = [
    "0123456789",
    "bcdfghjklmnpqrstvwxz",
    "aeiouy",
    "BCDFGHJKLMNPQRSTVWXZ",
    "AEIOUY",
    "àâäáãåèéêëìíîïòóôöõùúûü",
    "ÀÂÄÁÃÅÈÉÊËÌÍÎÏÒÓÔÖÕÙÚÛÜ",
    "çñß",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    "бвгджзйклмнпрстфхцчшщ",
    "аеёиоуыэюя",
    "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
    "АЕЁИОУЫЭЮЯ",
]
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
_CLASS_OF = {c: a for a in _CLASSES for c in a}
_HEX_OF = dict.fromkeys("0123456789abcdef", "0123456789abcdef") | dict.fromkeys("ABCDEF", "ABCDEF")
_WIDE_OF = {c: a for a in (_CLASSES[0], _LOWER, _UPPER) for c in a}

_TITLES = r"Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Señorita|Sr|Sra|Signor|Signora"
_NAME = r"[^\W\d_a-zà-öø-ÿα-ωа-я][^\W\d_]+"
_PATTERNS = {
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth))\s*[:=]\s*[\"']?(?P<secret>[^\s\"',;]{6,})",
    "bearer": r"(?i:\bbearer)\s+(?P<bearer>[A-Za-z0-9._~+/-]{16,}=*)",
    "key": r"(?P<key>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\b(?:sk|pk|rk|ghp|gho|ghs|glpat|xox[abp])[-_][A-Za-z0-9_-]{16,}|\bAIza[A-Za-z0-9_-]{35}|\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})",
    "email": r"(?P<email>(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+)",
    "ip": r"(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\w))",
    "iban": r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)",
    "card": r"(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))",
    "ssn": r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
    "phone": r"(?P<phone>(?<!\w)(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w))",
    "ipv6": r"(?P<ipv6>(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){1,7}:)(?![\w:.]))",
    "name": rf"\b(?:{_TITLES})\.?\s(?P<name>{_NAME}(?:[ -]{_NAME})?)",
}
#: Given names by gender and script; those that are common words too are left out.
GIVEN = [
    "James John Robert Michael David Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Andrew Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Nicholas Eric Jonathan Stephen Peter Paul Henry Hans Klaus Jürgen Wolfgang Pierre Jacques François Carlos José Miguel Antonio Giovanni Marco Luca".split(),
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Helen Sharon Cynthia Kathleen Amy Angela Anna Ursula Ingrid Heike Marie Claire Sophie Camille María Carmen Lucía Isabel Giulia Francesca Chiara".split(),
    "Александр Сергей Дмитрий Андрей Алексей Иван Михаил Николай Владимир Павел Юрий Олег".split(),
    "Анна Мария Елена Ольга Наталья Екатерина Татьяна Ирина Светлана Юлия Дарья Ксения".split(),
    "Γιώργος Δημήτρης Κώστας Νίκος Παναγιώτης Βασίλης Χρήστος Θανάσης".split(),
    "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα".split(),
]
_GIVEN_OF = {name: k for k, names in enumerate(GIVEN) for name in names}
_CAPITALS = re.compile(rf"(?<!\w){_NAME}(?:[ -]{_NAME}){{1,3}}(?!\w)")
_CAPITAL = re.compile(rf"(?<!\w){_NAME}")
_ENTITY = re.compile("|".join(_PATTERNS.values()))
#: Every entity holds a digit, an at sign or one of these; texts without them are passed over.
_WORDS = ("passw", "pwd", "secret", "token", "api", "access", "auth", "bearer")
_STARTS = ("AKIA", "ASIA", "AIza", "eyJ", "sk-", "sk_", "pk-", "pk_", "rk-", "rk_", "ghp", "gho", "ghs", "glpat", "xox")
_CALLED = tuple(_TITLES.split("|"))
_SIGNS = np.zeros(256, bool)
_SIGNS[[*b"0123456789@"]] = True


def may_hold(text: str) -> bool:
    """Whether a text may hold an entity."""
    if _SIGNS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)].any():
        return True
    lower = text.lower()
    return any(w in lower for w in _WORDS) or any(w in text for w in _STARTS) or any(w in text for w in _CALLED)


@functools.cache
def others(c: str) -> str:
    """The class of a letter or digit outside the fixed classes: its kind in its block of code points; empty for all else."""
    if c.isascii() or not c.isalnum() or c in _CLASS_OF:
        return ""
    kind, width = unicodedata.category(c), 128
    while width <= 1 << 21:
        low = ord(c) // width * width
        found = [x for x in map(chr, range(max(low, 128), min(low + width, 0x110000))) if x.isalnum() and x not in _CLASS_OF and unicodedata.category(x) == kind]
        if len(found) > 1:
            break
        width *= 2
    return "".join(found)


class Surrogates:
    """Keyed permutations of entities within their form."""

    def __init__(self, key: bytes):
        self.key = key

    def permuted(self, digits: list[int], radix: list[int], tweak: str) -> list[int]:
        """A keyed permutation of mixed-radix numbers without fixed points: a Feistel network, a keyed step that isn't 0, and the network back."""
        half = (len(digits) + 1) // 2
        value, size = [0, 0], [1, 1]
        for k, (d, r) in enumerate(zip(digits, radix, strict=True)):
            side = int(k >= half)
            value[side] = value[side] * r + d
            size[side] *= r
        self.turned(value, size, tweak, 1)
        total = size[0] * size[1]
        if total > 1:
            step = 1 + int.from_bytes(hmac.digest(self.key, f"{tweak}|step|{size}".encode(), "sha512"), "big") % (total - 1)
            value[:] = divmod((value[0] * size[1] + value[1] + step) % total, size[1])
        self.turned(value, size, tweak, -1)
        out = []
        for side, places in ((1, range(len(digits) - 1, half - 1, -1)), (0, range(half - 1, -1, -1))):
            for k in places:
                value[side], d = divmod(value[side], radix[k])
                out.append(d)
        return out[::-1]

    def turned(self, value: list[int], size: list[int], tweak: str, way: int) -> None:
        """An alternating Feistel network over two halves, or its inverse where way is -1, in place."""
        for turn in range(ROUNDS)[::way]:
            side = turn % 2
            message = f"{tweak}|{turn}|{size}|{value[1 - side]}".encode()
            value[side] = (value[side] + way * int.from_bytes(hmac.digest(self.key, message, "sha256"), "big")) % size[side]

    def spelled(self, text: str, tweak: str, classes: dict[str, str] = _CLASS_OF, fixed: int = 0, tail: int = 0) -> str:
        """text with letters and digits permuted within their classes, but for the first `fixed` and the last `tail`."""
        of = [classes.get(c) or others(c) for c in text]
        at = [k for k in range(fixed, len(text) - tail) if of[k]]
        if not at:
            return text
        alphabets = [of[k] for k in at]
        form = "".join(a[0] if a else c for a, c in zip(of, text, strict=True))
        new = self.permuted([a.index(text[k]) for k, a in zip(at, alphabets, strict=True)], [len(a) for a in alphabets], f"{tweak}|{form}|{text[:fixed]}|{text[len(text) - tail :]}")
        out = list(text)
        for k, a, d in zip(at, alphabets, new, strict=True):
            out[k] = a[d]
        return "".join(out)

    def part_of_name(self, text: str) -> str:
        """Another given name of the gender and script of a listed one; a name spelled otherwise, and not as a listed one, for others."""
        listed = _GIVEN_OF.get(text)
        if listed is not None:
            names = GIVEN[listed]
            return names[self.permuted([names.index(text)], [len(names)], f"given|{listed}")[0]]
        new = self.spelled(text, "namepart", tail=1)
        while new in _GIVEN_OF:
            new = self.spelled(new, "namepart", tail=1)
        return new

    def filled(self, text: str, digits: list[int]) -> str:
        """text with other digits in the places of its own."""
        fresh = iter(digits)
        return "".join(str(next(fresh)) if c.isascii() and c.isdigit() else c for c in text)

    def of(self, kind: str, text: str) -> str:
        """The surrogate of an entity."""
        tweak = kind
        digits = [int(c) for c in text if c.isascii() and c.isdigit()]
        if kind in ("secret", "bearer", "key"):
            fixed = re.match(r"(?:AKIA|ASIA|AIza|eyJ|(?:sk|pk|rk|ghp|gho|ghs|glpat|xox[abp])[-_])?", text).end()
            # One alphabet for all, so that secrets of hexadecimal digits and others don't meet.
            return self.spelled(text, tweak, _WIDE_OF, fixed)
        if kind == "email":
            lower = text.lower()
            if len(lower) != len(text):
                return self.email(text)
            return "".join(n.upper() if c != p else n for n, c, p in zip(self.email(lower), text, lower, strict=True))
        if kind == "ip":
            octets = [int(x) for x in text.split(".")]
            first = range(1, 224) if 1 <= octets[0] < 224 else [0, *range(224, 256)]
            new = self.permuted([list(first).index(octets[0]), *octets[1:]], [len(first), 256, 256, 256], f"{tweak}|{len(first)}")
            return ".".join(map(str, [first[new[0]], *new[1:]]))
        if kind == "ipv6":
            try:
                own = ipaddress.IPv6Address(text)
            except ValueError:
                return self.spelled(text, tweak, _HEX_OF)
            groups = [int(x, 16) for x in own.exploded.split(":")]
            new = self.permuted(groups[1:], [1 << 16] * 7, f"{tweak}|{groups[0]}")
            return str(ipaddress.IPv6Address(":".join(f"{x:x}" for x in [groups[0], *new])))
        if kind == "card":
            off = (digits[-1] - check_digit(digits[:-1])) % 10
            # The leading digit names the issuer's industry and stays.
            new = [digits[0], *self.permuted(digits[1:-1], [10] * (len(digits) - 2), f"{tweak}|{digits[0]}|{len(digits)}|{off}")]
            return self.filled(text, [*new, (check_digit(new) + off) % 10])
        if kind == "iban":
            plain = text.replace(" ", "")
            off = (int(plain[2:4]) - iban_check(plain)) % 100
            body = self.spelled(plain[4:], f"{tweak}|{plain[:2]}|{off}", _WIDE_OF)
            new = iter(f"{plain[:2]}{(iban_check(plain[:4] + body) + off) % 100:02d}{body}")
            return "".join(c if c == " " else next(new) for c in text)
        if kind == "ssn":
            return self.filled(text, self.ssn(digits))
        if kind == "phone":
            code = re.match(r"\+(\d{1,3})(?=\D)|\+(\d)|", text)
            code = code[1] or code[2] or ""
            body = digits[len(code) :]
            # North American numbers are one with and without their country code.
            home = "1" if code in ("", "1") and len(body) == 10 else code
            return self.filled(text, [*digits[: len(code)], *self.permuted(body, [10] * len(body), f"{tweak}|{home}|{len(body)}")])
        if kind == "name":
            return " ".join("-".join(map(self.part_of_name, w.split("-"))) for w in text.split(" "))
        return self.spelled(text, tweak)

    def email(self, text: str) -> str:
        local, _, domain = text.rpartition("@")
        name, dot, top = domain.rpartition(".")
        reserved = re.search(r"(?:^|\.)example$", name)
        cut = reserved.start() if reserved else len(name)
        domain = self.spelled(name[:cut], "emaildomain", _WIDE_OF) + name[cut:] + dot + top
        return self.spelled(local, f"email|{domain}", _CLASS_OF) + "@" + domain

    def ssn(self, digits: list[int]) -> list[int]:
        """A valid number for a valid one (areas 001 to 899 but 666, no part 0), one that isn't for another."""
        number = int("".join(map(str, digits)))
        area, group, serial = number // 10**6, number // 10**4 % 100, number % 10**4
        areas = [x for x in range(1, 900) if x != 666]
        if valid_ssn(number):
            a, g, n = self.permuted([areas.index(area), group - 1, serial - 1], [len(areas), 99, 9999], "ssn")
            number = areas[a] * 10**6 + (g + 1) * 10**4 + n + 1
        else:
            while True:
                digits = self.permuted(digits, [10] * 9, "ssn")
                number = int("".join(map(str, digits)))
                if not valid_ssn(number):
                    break
        return [int(c) for c in f"{number:09d}"]

    def entities(self, text: str) -> list[tuple[int, int, str]]:
        """Start, end and kind of each entity, in order and apart."""
        found = [(*m.span(m.lastgroup), m.lastgroup) for m in _ENTITY.finditer(text)] if may_hold(text) else []
        capitals = set(_CAPITAL.findall(text))
        if not _GIVEN_OF.keys().isdisjoint(capitals):
            for m in _CAPITALS.finditer(text):
                words = [(m.start() + w.start(), m.start() + w.end()) for w in re.finditer(r"[^ -]+", m[0])]
                k = next((k for k, (a, b) in enumerate(words[:-1]) if text[a:b] in _GIVEN_OF), None)
                if k is not None:
                    found.append((words[k][0], words[min(k + 2, len(words) - 1)][1], "name"))
        # A surname of this text is one wherever else it stands in it.
        surnames = {text[a:b].replace("-", " ").split(" ")[-1] for a, b, kind in found if kind == "name"}
        surnames = {x for x in surnames if len(x) > 2 and x not in _GIVEN_OF}
        if surnames:
            found += [(*m.span(), "name") for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(surnames, key=lambda x: (-len(x), x)))) + r")(?!\w)", text)]
        out: list[tuple[int, int, str]] = []
        for span in sorted(found, key=lambda x: (x[0], -x[1])):
            if not out or span[0] >= out[-1][1]:
                out.append(span)
        return out

    def replaced(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """text with surrogates, and the kind, start and end of each in the new text."""
        given: dict[tuple[str, str], str] = {}
        parts, spans, at, length = [], [], 0, 0
        for start, stop, kind in self.entities(text):
            own = text[start:stop]
            new = given.get((kind, own))
            if new is None:
                new = given[kind, own] = self.of(kind, own)
            parts += [text[at:start], new]
            length += start - at
            spans.append((kind, length, length + len(new)))
            length += len(new)
            at = stop
        parts.append(text[at:])
        return "".join(parts), spans


def iban_check(text: str) -> int:
    """The check digits under which an IBAN (without spaces) leaves 1 modulo 97."""
    return 98 - int("".join(str(int(c, 36)) for c in text[4:] + text[:2] + "00")) % 97


def valid_ssn(number: int) -> bool:
    area, group, serial = number // 10**6, number // 10**4 % 100, number % 10**4
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def check_digit(digits: list[int]) -> int:
    """The Luhn check digit that follows the digits."""
    total = sum(d if k % 2 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
    return -total % 10


def replace_private(docs: DataFrame, text: str = "text", key: bytes = DEFAULT_KEY, spans: str = "pii_spans") -> DataFrame:
    """docs with surrogates in the text and, as a last column, the array of (kind, start, end) of each in the new text."""
    small_batches(docs.sparkSession)
    names = [x for x in docs.columns if x != spans]
    inner = [f"_k{i}" for i in range(len(names))]
    at = names.index(text)
    plain = docs.select(*(F.col(f"`{x}`").alias(y) for x, y in zip(names, inner, strict=True)))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Surrogates(key)
        for batch in batches:
            found = [(None, []) if t is None else own.replaced(t) for t in batch.column(at).to_pylist()]
            columns = [pa.array([t for t, _ in found], pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            rows = pa.array([[{"kind": a, "start": b, "end": c} for a, b, c in s] for _, s in found], kind)
            yield pa.RecordBatch.from_arrays([*columns, rows], [*inner, "_spans"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields), "_spans array<struct<kind:string,start:int,end:int>>"])
    return plain.mapInArrow(run, schema).select(*(F.col(y).alias(x) for x, y in zip(names, inner, strict=True)), F.col("_spans").alias(spans))


def op9_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = replace_private(docs)
    return found.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_entities"), F.to_json("pii_spans").alias("spans"))
