"""PII surrogates: keyed, type-consistent replacements with a collision check over the whole corpus.

An entity's surrogate is derived from HMAC-SHA256 of its type, canonical value and attempt, in the same format: digits
for digits, letters of the same script and case, the same separators, a valid check digit for cards (digits without one
are no card). Equal entities have equal surrogates everywhere, in whatever format they're written, and a name has one
surrogate whatever stands before it and wherever in a name it stands: its gender is what most of the corpus's forms of
address say. Initials are exchanged by a keyed permutation that names follow too, so initials still fit their names.
Distinctness is checked on the table of distinct entities: where two share a surrogate, or a surrogate is the value of
some entity of the corpus, all but the smallest go on to the next attempt, until none is left; every few attempts the
format gets wider, so there are always free surrogates.

Texts are searched once: rows and their spans are stored in the shared folder, and only texts with entities are taken up
again. Only what a span doesn't tell, attempts above 0 and genders, is carried back to the texts.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import secrets
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, process_cache, skew_join, stored

#: The session's setting with the key. Without it a session draws a key of its own.
KEY_SETTING = "spark.vmlens.pii.key"
#: Bytes of carried back values up to which they're sent to every task; beyond, they're joined to the texts that hold them.
BROADCAST_BYTES = 4 << 20
#: Attempts in a format, before the next one has a character more (of addresses: a wider range); for names: fewer.
ATTEMPTS_A_FORMAT = 16
ATTEMPTS_A_LETTER = 2


def session_key(spark: SparkSession) -> bytes:
    """The key of the session's setting; else a random one, the same as long as the driver lives."""
    given = spark.conf.get(KEY_SETTING, None)
    return given.encode() if given else process_cache().setdefault("pii key", secrets.token_bytes(32))

def class_of(*categories: str) -> str:
    """Ranges of a character class that has all characters of the categories."""
    marked = "".join("x" if unicodedata.category(chr(i)) in categories else " " for i in range(sys.maxunicode + 1))
    return "".join(f"{chr(m.start())}-{chr(m.end() - 1)}" for m in re.finditer("x+", marked))


#: Upper-case letters, and those of scripts without case; all letters, and the marks that go with them.
UPPER = class_of("Lu", "Lt", "Lo")
LETTER = UPPER + class_of("Ll", "Lm", "Mn", "Mc")
#: Forms of address, by the gender they tell (fixed values).
TITLES = {
    "m": ["Mr", "Herr", "Señor", "Monsieur", "Sir"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mademoiselle", "Lady"],
    "u": ["Dr", "Prof"],
}
TITLE = "|".join(x for v in TITLES.values() for x in v)
#: Common given names, by gender: they tell a name that no form of address introduces (fixed values).
GIVEN = {
    "m": ["Alexander", "Andreas", "Andrew", "Antonio", "Benjamin", "Carlos", "Charles", "Daniel", "David", "Edward", "François", "George", "Giovanni", "Hans", "Henri", "James", "Javier", "Jean", "John", "Jonathan", "Joseph", "José", "Juan", "Jürgen", "Kevin", "Klaus", "Luis", "Matthew", "Michael", "Michel", "Miguel", "Mohammed", "Nicholas", "Paul", "Pedro", "Peter", "Philippe", "Pierre", "Richard", "Robert", "Stefan", "Steven", "Thomas", "Timothy", "William", "Wolfgang"],
    "f": ["Alice", "Amanda", "Anna", "Barbara", "Camille", "Carmen", "Caroline", "Catherine", "Christine", "Claudia", "Elena", "Elisabeth", "Elizabeth", "Emily", "Emma", "Fatima", "Helen", "Isabel", "Jennifer", "Jessica", "Julia", "Karen", "Katharina", "Laura", "Linda", "Lucía", "Margaret", "Maria", "Marie", "María", "Martha", "Mary", "Michelle", "Monika", "Nathalie", "Nicole", "Olivia", "Patricia", "Rachel", "Rebecca", "Sandra", "Sarah", "Sofía", "Sophie", "Stephanie", "Susan", "Teresa", "Ursula", "Victoria"],
}
GIVEN_NAME = "|".join(x for v in GIVEN.values() for x in v)
#: A capitalised word of any script, or initials.
NAME = rf"(?!(?:{TITLE})\b)(?:[{UPPER}]\.(?:-?[{UPPER}]\.)*|[{UPPER}][{LETTER}]*(?:[-'’](?!s\b)[{LETTER}]+)*)"
PATTERNS = [
    ("email", r"[\w.%+\-]+@[\w\-]+(?:\.[\w\-]+)+"),
    ("aws_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("api_key", r"(?<![A-Za-z0-9_])(?:(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{10,}|gh[opsru]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|AIza[A-Za-z0-9_\-]{35})"),
    ("secret", r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b)[\"']?[ \t]*[=:][ \t]*[\"']?(?P<secret_value>[^\s\"',;]{6,})"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"),
    ("ipv6", r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:(?=[0-9A-Fa-f:])|::)(?:[0-9A-Fa-f]{0,4}:){0,6}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)"),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("card", r"(?<![\d\-])[3-6]\d{3}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}(?!\d)"),
    ("phone", r"(?<![\d\w])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)"),
    ("phone_intl", r"(?<![\d\w])\+\d{1,3}(?:[ .\-]?\d{2,4}){3,5}(?!\d)"),
    ("phone_national", r"(?<![\d\w.\-])\(?0[1-9]\d{0,3}\)?[ \-/]\d{3,4}[ \-]\d{3,5}(?![\d\-])"),
    ("name", rf"\b(?P<titles>(?:{TITLE})(?:\.? (?:{TITLE}))*)\.? (?P<names>{NAME}(?: {NAME})*)"),
    ("plain_name", rf"\b(?P<plain>(?:{GIVEN_NAME})(?: {NAME})+)"),
]
FINDER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS))
#: What any entity has, and on the same line: saves the search of texts and lines that have none of it. Expressions that
#: begin with few characters, and strings, are found much faster than one expression for all.
HINTS = [re.compile(x) for x in (r"\d(?:\d\d|\.\d)", r"\+\d", r"[A-Z][A-Z]\d\d", r":[0-9A-Fa-f]{0,4}:", r"gh[opsru]_", r"xox[abprs]-", rf"(?:{TITLE})\.? ", rf"(?:{GIVEN_NAME}) ")]
HINT_STRINGS = ("@", "AKIA", "ASIA", "AIza", "_live_", "_test_")
SECRET_WORDS = ("password", "passwd", "pwd", "token", "secret", "api")
#: A word as NAME has it, of either case.
MENTION = re.compile(rf"(?<!\w)[{LETTER}]+(?:[-'’](?!s\b)[{LETTER}]+)*(?!\w)")
TITLE_GENDER = {x: g for g, v in TITLES.items() for x in v}
GIVEN_GENDER = {x.casefold(): g for g, v in GIVEN.items() for x in v}
DIGITS = ("phone", "phone_intl", "phone_national", "card", "ssn")
API_PREFIX = re.compile(r"(?:[a-z]+_)*(?:xox.-|AIza)?")

#: start, end, type, canonical value, and the gender told here (m, f or nothing).
Entity = tuple[int, int, str, str, str]


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def ipv6(text: str) -> str | None:
    """The compressed form; None for what is no address, or too short to be told from other text with colons."""
    try:
        value = ipaddress.IPv6Address(text).compressed
    except ValueError:
        return None
    return value if len(re.findall("[0-9a-f]+", value)) > 2 or value.startswith(("fe80:", "2", "fd")) else None


def name_parts(text: str, a: int, b: int, gender: str) -> list[Entity]:
    """The words and initials of a name; those before the last word are given names."""
    parts = [(a + m.start(), a + m.end(), m.group()) for m in re.finditer(r"\S+", text[a:b])]
    last = max((i for i, part in enumerate(parts) if not part[2].endswith(".")), default=len(parts) - 1)
    out = []
    for i, (start, end, word) in enumerate(parts):
        value = word.casefold()
        told = (GIVEN_GENDER.get(value) or gender) if i < last else ""
        out.append((start, end, "initial", value, "") if word.endswith(".") else (start, end, "name", value, told))
    return out


def entity(text: str, m: re.Match) -> list[Entity]:
    """What a match of FINDER holds: nothing, one entity, or the parts of a name."""
    if m.group("secret"):
        value = m.group("secret_value")
        mask = len(set(value)) == 1 and not value[0].isalnum()
        return [] if mask else [(*m.span("secret_value"), "secret", value, "")]
    if m.group("name"):
        told = [TITLE_GENDER[x] for x in re.findall(r"\w+", m.group("titles"))]
        return name_parts(text, *m.span("names"), next((g for g in told if g != "u"), ""))
    if m.group("plain_name"):
        return name_parts(text, *m.span("plain"), "")
    kind, value = m.lastgroup, m.group()
    if kind in DIGITS:
        value, kind = re.sub(r"\D", "", value), "phone" if kind.startswith("phone") else kind
        return [] if kind == "card" and not luhn(value) else [(*m.span(), kind, value, "")]
    if kind == "ipv6":
        value = ipv6(value)
        return [(*m.span(), "ip", value, "")] if value else []
    return [(*m.span(), kind, value.lower() if kind == "email" else value.replace(" ", ""), "")]


def hinted(text: str) -> bool:
    lower = text.casefold()
    return any(x in text for x in HINT_STRINGS) or any(x in lower for x in SECRET_WORDS) or any(x.search(text) for x in HINTS)


def entities(text: str | None) -> list[Entity]:
    """The entities of the whole text, in order, none overlapping. A match is on one line, which holds a hint."""
    found: list[Entity] = []
    if not text or not hinted(text):
        return found
    low = 0
    for line in text.split("\n"):
        if hinted(line):
            for m in FINDER.finditer(text, low, low + len(line)):
                found += entity(text, m)
        low += len(line) + 1
    return with_mentions(text, found)


def with_mentions(text: str, found: list[Entity]) -> list[Entity]:
    """The entities, and wherever a name that was found is mentioned again by itself."""
    # a letter is no name that could be told from others
    names = {text[a:b]: value for a, b, kind, value, _ in found if kind == "name" and len(value) > 1}
    if not names:
        return found
    out, at, k = [], 0, 0
    for m in MENTION.finditer(text):
        while k < len(found) and found[k][1] <= m.start():
            at, k = found[k][1], k + 1
        if m.group() in names and m.start() >= at and (k == len(found) or m.end() <= found[k][0]):
            out.append((*m.span(), "name", names[m.group()], ""))
    return sorted([*found, *out])


class Stream:
    """Numbers drawn from HMAC-SHA256 in counter mode."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.seed, self.data, self.block = key, "\x1f".join(parts).encode("utf-8", "replace"), b"", 0

    def below(self, n: int) -> int:
        if len(self.data) < 4:
            self.data += hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        value, self.data = int.from_bytes(self.data[:4], "big"), self.data[4:]
        return value % n


#: Ranges of letters that stand for one another: script and case stay.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "àáâäèéêëìíîïòóôöùúûüñç", "ÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜÑÇ"]
ALPHABET = {c: a for a in ALPHABETS for c in a}
#: (vowels, consonants) of scripts that surrogate names are spelled in; in others each letter is replaced.
SPELLINGS = [("aeiou", "bdfgklmnprstvz"), ("аеиоу", "бвгдзклмнпрст"), ("αειου", "βγδκλμνπρστ")]
SPELLING = {c: x for x, lower in zip(SPELLINGS, (ALPHABETS[1] + ALPHABETS[7], ALPHABETS[3], ALPHABETS[5])) for c in lower}


#: For secrets that have neither letters nor digits.
SYMBOLS = "!#$%&()*+-./:<=>?@[]^_{|}~"


@cache
def alphabet_of(c: str) -> str:
    """What stands for a character: of letters and digits outside ALPHABETS, those of their kind nearby; of others nothing."""
    kind = unicodedata.category(c)
    if c in ALPHABET or kind[0] not in "LN":
        return ALPHABET.get(c, "")
    first = ord(c) & ~63
    return "".join(x for x in map(chr, range(first, first + 64)) if unicodedata.category(x) == kind)


def like(text: str, draw: Stream, others: str = "") -> str:
    """Characters of the same kind; hexadecimal strings (not those of digits alone) stay hexadecimal. Texts without any such characters are drawn from `others`."""
    fixed = "0123456789abcdef" if len(text) >= 16 and re.fullmatch(r"[0-9]*[a-f][0-9a-f]*", text) else None
    if others and not any(len(alphabet_of(c)) > 1 for c in text):
        fixed = others
    out = []
    for c in text:
        alphabet = fixed or alphabet_of(c)
        out.append(alphabet[draw.below(len(alphabet))] if alphabet else c)
    return "".join(out)


@cache
def permutation(alphabet: str, key: bytes) -> dict[str, str]:
    """A keyed permutation of an alphabet that leaves no letter in place: one cycle through all."""
    order = sorted(alphabet, key=lambda c: hmac.new(key, f"initial\x1f{c}".encode(), hashlib.sha256).digest())
    return dict(zip(order, [*order[1:], order[0]]))


def initial_like(c: str, key: bytes) -> str:
    """The letter that stands for an initial; what is no letter stays."""
    alphabet = alphabet_of(c)
    return permutation(alphabet, key)[c] if alphabet else c


def name_like(value: str, gender: str, draw: Stream, attempt: int, key: bytes) -> str:
    """A pronounceable name of the same script, hyphens and about the same length; female ones end with a vowel, male ones don't."""
    extra, segments = attempt // ATTEMPTS_A_LETTER, re.split("([-'’])", value)
    if value[0] not in SPELLING:
        out = initial_like(value[0], key) + like(value[1:], draw)
        return out + like(value[-1] * extra, draw)
    vowels, consonants = SPELLING[value[0]]
    out = ""
    for i, segment in enumerate(segments):
        last = i == len(segments) - 1
        if segment in "-'’" and segment:
            out += segment
            continue
        length = max(5 - len(out), min(12, len(segment))) + extra if last else len(segment)
        word = "" if out else initial_like(value[0], key)
        while len(word) < length:
            choice = consonants if word and word[-1] in vowels else vowels if word else consonants
            word += choice[draw.below(len(choice))]
        if last and gender == "f":
            word += "" if word[-1] == vowels[0] else (consonants[draw.below(len(consonants))] if word[-1] in vowels else "") + vowels[0]
        if last and gender == "m" and word[-1] in vowels:
            word += consonants[draw.below(len(consonants))]
        out += word
    return out


def address_like(value: str, draw: Stream, wider: int) -> str:
    """An address of the same private range, else a public one; then of 10.0.0.0/8, of all public ones, and of 2001:db8::/32."""
    if ":" in value:
        prefix = "fe80" if value.startswith("fe80") else "fd00" if value.startswith(("fc", "fd")) else "2001:db8"
        return prefix + ":" + ":".join(f"{1 + draw.below(65535):x}" for _ in range(6 if prefix == "2001:db8" else 7))
    first, second, *_ = value.split(".")
    keep = [first] if first in ("10", "127", "0") else [first, second] if (first, second) in (("192", "168"), ("169", "254")) or (first == "172" and 16 <= int(second) < 32) else []
    if wider > 2:
        return "2001:db8:" + ":".join(f"{1 + draw.below(65535):x}" for _ in range(6))
    if wider and keep:
        keep = ["10"] if wider == 1 else []
    public = [x for x in range(1, 224) if x not in (10, 127, 169, 172, 192)]
    rest = [str(public[draw.below(len(public))])] * (not keep)
    return ".".join([*keep, *rest, *(str(1 + draw.below(254)) for _ in range(4 - len(keep) - len(rest)))])


def surrogate(kind: str, value: str, gender: str, attempt: int, key: bytes) -> str:
    """Canonical surrogate of a canonical value. The gender of a name only says how it ends."""
    draw = Stream(key, kind, value, str(attempt))
    wider = attempt // ATTEMPTS_A_FORMAT
    if kind == "name":
        return name_like(value, gender, draw, attempt, key)
    if kind == "initial":
        return "".join(initial_like(c, key) for c in value)
    if kind == "email":
        local, _, domain = value.partition("@")
        *labels, top = domain.split(".")
        return f"{like(local, draw)}{like('x' * wider, draw)}@{'.'.join([like('.'.join(labels), Stream(key, 'domain', domain)), top])}"
    if kind == "ip":
        return address_like(value, draw, wider)
    if kind == "phone":
        code = max(0, len(value) - 10)
        return value[:code] + str(2 + draw.below(8)) + like(value[code + 1 :] + "0" * wider, draw)
    if kind == "card":
        body = value[0] + like(value[1:-1] + "0" * wider, draw)
        return body + next(c for c in "0123456789" if luhn(body + c))
    if kind in ("aws_key", "iban", "api_key"):
        fixed = {"aws_key": 4, "iban": 2}.get(kind) or API_PREFIX.match(value).end()
        return value[:fixed] + like(value[fixed:] + "0" * wider, draw)
    if kind == "ssn":
        return like(value + "0" * wider, draw)
    return like(value, draw, SYMBOLS) + like("x" * wider, draw)


def rendered(kind: str, original: str, canonical: str) -> str:
    """The canonical surrogate in the format of the original."""
    if kind in ("phone", "card", "ssn", "iban"):
        rest = iter(canonical)
        return "".join([*(next(rest, "") if c.isalnum() else c for c in original), *rest])
    if kind in ("name", "initial"):
        if original.isupper() and (len(original) > 1 or kind == "initial"):
            return canonical.upper()
        shown = iter(re.split("[-'’]", original))
        raised = [x[:1].upper() + x[1:] if next(shown, "")[:1].isupper() else x for x in re.split("([-'’])", canonical)[::2]]
        return "".join(x for pair in zip(raised, [*re.findall("[-'’]", canonical), ""]) for x in pair)
    if kind == "email":
        return canonical.upper() if original.isupper() else canonical
    return canonical


def replaced(text: str | None, found: list[Entity], known: Callable[[str, str], tuple[str, int]], key: bytes) -> str | None:
    """The text with the entities found in it replaced; `known` gives the gender and attempt of a value."""
    out, at = [], 0
    for a, b, kind, value, *_ in found:
        out += [text[at:a], rendered(kind, text[a:b], surrogate(kind, value, *known(kind, value), key))]
        at = b
    return "".join([*out, text[at:]]) if found else text


SPANS = "array<struct<a:int,b:int,kind:string,value:string,gender:string>>"
PLAIN = ("", 0)


def find_column(text: Column) -> Column:
    """The entities of each text; null and empty texts have none."""

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("a", "b", "kind", "value", "gender"), e)) for e in entities(x)] for x in texts], dtype=object)

    return find(text)


def entity_table(spans: DataFrame, column: str = "spans") -> DataFrame:
    """Distinct (kind, value) of all spans, and the gender that most say. Initials need no entry."""
    each = spans.select(F.explode(column).alias("e")).where("e.kind <> 'initial'")
    says = lambda g: F.sum(F.when(F.col("e.gender") == g, 1).otherwise(0))
    counted = each.groupBy(F.col("e.kind").alias("kind"), F.col("e.value").alias("value")).agg(says("f").alias("f"), says("m").alias("m"))
    return counted.select("kind", "value", F.expr("CASE WHEN f > m THEN 'f' WHEN m > f THEN 'm' ELSE '' END").alias("gender"))


def attempts(table: DataFrame, key: bytes, make: Callable[[str, str, str, int, bytes], str] = surrogate) -> DataFrame:
    """(kind, value, gender, attempt, surrogate), the surrogates of a kind distinct and none of them the value of an entity."""

    @F.pandas_udf("string")
    def made(kinds: pd.Series, values: pd.Series, genders: pd.Series, tries: pd.Series) -> pd.Series:
        return pd.Series([make(k, v, g, int(t), key) for k, v, g, t in zip(kinds, values, genders, tries)], dtype=object)

    names = ["kind", "value", "gender", "attempt", "surrogate"]
    table = durable(table)
    state = durable(table.withColumn("attempt", F.lit(0)).withColumn("surrogate", made("kind", "value", "gender", "attempt")).select(*names))
    while True:
        first = state.groupBy("kind", "surrogate").agg(F.min("value").alias("winner"), F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", "surrogate", "winner")
        real = table.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
        marked = skew_join(skew_join(state, first, ["kind", "surrogate"], "left"), real, ["kind", "surrogate"], "left")
        marked = marked.withColumn("again", F.coalesce("real", F.lit(False)) | F.coalesce(F.col("winner") != F.col("value"), F.lit(False)))
        marked = durable(marked.select(*names, "again"))
        if not marked.where("again").limit(1).count():
            return state
        moved = marked.where("again").withColumn("attempt", F.col("attempt") + 1).withColumn("surrogate", made("kind", "value", "gender", "attempt"))
        state = durable(marked.where("NOT again").select(*names).unionByName(moved.select(*names)))


def replace(docs: DataFrame, key: bytes, text_column: str = "text", broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """(row, text, n): every row of `docs` as a struct, its text with surrogates, and how many entities it had."""
    if not key:
        raise ValueError("surrogates need a key")
    text = F.col("row").getField(text_column)
    rows = stored(docs.select(F.struct("*").alias("row")).select("row", find_column(text).alias("spans"), F.monotonically_increasing_id().alias("id")), "pii")
    carried = durable(attempts(entity_table(rows), key).where("attempt > 0 OR gender <> ''").select("kind", "value", "gender", "attempt"))
    size = carried.agg(F.sum(F.octet_length("value") + 32)).first()[0] or 0
    some = F.size("spans") > 0
    plain = rows.where(~some).select("row", text.alias("text"), F.lit(0).cast("long").alias("n"))
    n = F.size("spans").cast("long").alias("n")
    if size <= broadcast:
        known = {(r["kind"], r["value"]): (r["gender"], r["attempt"]) for r in carried.collect()}

        @F.pandas_udf("string")
        def swap(texts: pd.Series, spans: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else replaced(x, [tuple(e.values()) for e in s], lambda k, v: known.get((k, v), PLAIN), key) for x, s in zip(texts, spans)], dtype=object)

        # texts without entities aren't sent to Python
        return rows.select("row", F.when(some, swap(F.when(some, text), F.when(some, F.col("spans")).otherwise(F.array().cast(SPANS)))).otherwise(text).alias("text"), n)

    @F.pandas_udf("string")
    def swap_with(texts: pd.Series, spans: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for x, s, e in zip(texts, spans, own):
            here = {} if e is None else {(r["kind"], r["value"]): (r["gender"], r["attempt"]) for r in e}
            out.append(replaced(x, [tuple(e.values()) for e in s], lambda k, v: here.get((k, v), PLAIN), key))  # noqa: B023
        return pd.Series(out, dtype=object)

    held = rows.where(some).select("id", F.explode("spans").alias("e")).select("id", "e.kind", "e.value").distinct()
    own = skew_join(held, carried, ["kind", "value"]).groupBy("id").agg(F.collect_list(F.struct("kind", "value", "gender", "attempt")).alias("own"))
    swapped = skew_join(rows.where(some), own, ["id"], "left").select("row", swap_with(text, F.col("spans"), F.col("own")).alias("text"), n)
    return swapped.unionByName(plain)


def replace_texts(docs: DataFrame, key: bytes, text_column: str = "text", **options) -> DataFrame:
    """`docs` with surrogates in its texts; all other columns, whatever their names, stay as they are."""
    out = replace(docs, key, text_column, **options)
    return out.select(*(F.col("text").alias(c) if c == text_column else F.col("row").getField(c).alias(c) for c in docs.columns))


def pseudonymise(docs: DataFrame, key: bytes, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One row per row of `docs`: doc_id, the text with surrogates, and n_entities.

    A null text stays null, with 0 entities; a text without entities stays as it is. Repeated rows and ties are replaced
    alike. Columns of other names aren't read; an empty table gives an empty result. An empty key raises ValueError.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return replace(source, key, **options).select(F.col("row.doc_id").alias("doc_id"), "text", F.col("n").alias("n_entities"))
