"""PII: detected entities are replaced by keyed surrogates of their own type.

Kinds: email, ip (both versions), card, phone, ssn, iban, and persons' names: after a title, after a known given name
(`GIVEN`, a short list), after words that introduce a name (`INTRODUCED`), and wherever a surname found so stands again
in the same text. A name may have inner capitals, apostrophes and particles (which stay), or be all capitals or Han characters; one in small letters, or of
given names that aren't listed and without a title, isn't found. An entity's canonical form (lower-cased address, bare digits, a name's single parts) is the
same for all its spellings, so that every mention anywhere gets the same replacement (coreference), written as the mention is: its
separators, its case, its title. A name is one entity of its script, whatever titles its mentions have and whether it is a given name here and
a surname there: it counts as a given name if any mention does, and its gender is what the mentions that show one agree on.
A surrogate is drawn by HMAC-SHA-256 under `key` from kind, canonical form and attempt, and matches the entity: gender and
script of given names, script of surnames, letters and digits in place, a number's issuer and length, whether its check
digits hold, private addresses' ranges. Whoever has the key can draw them again, so none is built in: callers give one.

Distinctness: over all entities of the input, a surrogate that another entity of its kind (of names: another name of its script) draws too, that was given
before or that is itself an entity of the input is drawn anew, with the next attempt, until none collides. This is done on a table of
the distinct entities by joins; it is never gathered. So that this ends even where a format has fewer members than
entities, the format widens with the attempts: names come from lists for `LISTED_ATTEMPTS` and are then made up of more and more
syllables; from attempt `WIDER` on, addresses' and numbers' surrogates grow by a character for every two attempts, and
version-4 addresses leave their private range for 10/8, then become version-6 ones (of fd00::/8 and 2001:db8::/32).

Defined results: rows without entities, null and empty texts pass unchanged, with all columns; a `n_chars` column follows
the new text; repeated rows are rewritten alike; a text of any length is searched whole; extra columns of any name pass
unchanged, but for one named as `kinds_column`, whose place that takes; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import itertools
import re
import secrets
import uuid
from functools import lru_cache, reduce

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, free_name, persist, small_batches, tidy

KEY_CONF = "spark.brooktext.pii.key"
LISTED_ATTEMPTS, WIDER, WIDEST = 3, 8, 16

#: Titles by gender, and common given names by gender and script.
TITLES = {
    "m": "Mr Mister Herr Herrn Monsieur Señor Sr Господин Κύριος",
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Госпожа Κυρία",
    "n": "Dr Prof Professor Doktor Docteur Доктор Δρ",
}
GIVEN = {
    ("m", "latin"): "Oliver Henry Jack George Edward Benjamin Samuel Alexander Lucas Noah Liam Ethan Mark Brian Kevin Jason Bob Frank Walter Werner Heinz Dieter Jean Jacques Luis Diego Pablo James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Paul Andrew Peter Hans Jürgen Klaus Stefan Wolfgang Günter Pierre Michel Philippe Laurent François Nicolas José Antonio Manuel Francisco Javier Carlos Miguel Pedro",
    ("f", "latin"): "Emma Olivia Sophia Charlotte Amelia Grace Alice Laura Julia Anna Hannah Rachel Rebecca Emily Claire Sophie Julie Elena Ana Rosa Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Helga Ursula Ingrid Sabine Monika Renate Petra Marie Nathalie Isabelle Sylvie Catherine Françoise Camille Carmen Josefa Dolores Cristina Lucía Pilar Teresa",
    ("m", "cyrillic"): "Иван Александр Сергей Дмитрий Андрей Алексей Михаил Николай Владимир Павел",
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия",
}
SURNAMES = {
    "latin": "Ashford Bexley Calder Dunmore Ellery Farrow Garland Hadley Ingram Jarvis Kendrick Langley Merrick Norwood Oakes Penrose Quill Radcliff Selby Thorne Upton Verner Wexford Yardley Albrecht Brandt Castell Delorme Esteban Fontaine",
    "cyrillic": "Белов Волков Громов Дубов Зимин Котов Лесин Морозов Носов Орлов Полев Рыбин Седов Титов Фролов",
}
#: Words after which a name stands.
INTRODUCED = "my name is|My name is|mein Name ist|Mein Name ist|ich heiße|Ich heiße|je m'appelle|Je m'appelle|me llamo|Me llamo|mi nombre es|Mi nombre es|меня зовут|Меня зовут"
#: Particles before a surname, which stay as they are.
PARTICLES = "van der|van den|van de|van|von der|von|zu|de la|de los|de las|de|del|della|di|da|dos|du|le|la|ter|ten|bin|al"
#: Consonants and vowels of which syllables are made.
SOUNDS = {"latin": ("bdfgklmnprstv", "aeo"), "cyrillic": ("бдклмнрст", "аео"), "greek": ("βγδκλμνπρστ", "αεο"), "armenian": ("բգդկլմնպրստ", "աեո"), "han": ("王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗", "文明华平安宁海山玉林春秋志远成思雨欣月天")}
GENDER_OF = {n: g for (g, _), names in GIVEN.items() for n in names.split()}
_TITLE_GENDER = {t: g for g, ts in TITLES.items() for t in ts.split()}
_TITLE_GENDER |= {t.upper(): g for t, g in _TITLE_GENDER.items() if len(t) > 1}
_GIVEN_WORDS = frozenset(GENDER_OF) | frozenset(n.upper() for n in GENDER_OF if len(n) > 2)
_NAME_WORDS = frozenset(_TITLE_GENDER) | _GIVEN_WORDS

_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])")
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)")
_CARD = re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])")
_PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])")
_SSN = re.compile(r"(?<![\w.-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_HOME_PHONE = re.compile(r"(?<![\w.+/-])(?!\d{1,2}[./-]\d{1,2}[./-]\d{4})0\d{1,4}(?:/ ?\d{3,8}(?:[ -]\d{2,5}){0,3}|(?:[ -]\d{2,8}){1,4}|(?:\.\d{2}){4})(?![\w/-])")
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4}|::(?:[0-9A-Fa-f]{1,4}:){1,6}[0-9A-Fa-f]{1,4})(?![\w:])")
_DIGIT = re.compile(r"[0-9@]|::")
_CAPITALIZED = regex.compile(r"\p{Lu}\p{L}*")
_BLANK = "[ \u00a0]"
_PART = r"(?:\p{Lu}(?:['’]\p{Lu})?\p{Ll}{1,30}(?:['’-]\p{Lu}?\p{Ll}{1,30}|\p{Lu}\p{Ll}{1,30}){0,4}|\p{Lu}{3,30}(?:['’-]\p{Lu}{1,30}){0,3}|\p{Lu}['’]\p{Lu}{2,30}|\p{Han}{2,4})(?!\p{L})"
_SUR = rf"(?:(?:{PARTICLES}){_BLANK})?{_PART}"
_TITLED = regex.compile(rf"(?<!\p{{L}})({'|'.join(sorted(_TITLE_GENDER, key=len, reverse=True))})\.?{_BLANK}((?:\p{{Lu}}\.{_BLANK})*{_SUR}(?:{_BLANK}{_SUR})?)")
_NAMED = regex.compile(rf"(?<!\p{{L}})({'|'.join(sorted(_GIVEN_WORDS, key=len, reverse=True))}){_BLANK}(?:(?:{PARTICLES}){_BLANK})?({_PART})")
_INTRODUCED = regex.compile(rf"(?<!\p{{L}})(?:{INTRODUCED}){_BLANK}({_PART}(?:{_BLANK}{_SUR})?)")
_WHOLE_PART = regex.compile(_PART)

#: start, end, kind, canonical form
Span = tuple[int, int, str, str]


def luhn(digits: str) -> bool:
    odd = sum(int(c) for c in digits[::-1][::2])
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[::-1][1::2])) % 10 == 0


def iban_holds(bare: str) -> bool:
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


_SCRIPTS = {"latin": regex.compile(r"\p{Latin}"), "cyrillic": regex.compile(r"\p{Cyrillic}"), "greek": regex.compile(r"\p{Greek}"), "armenian": regex.compile(r"\p{Armenian}"), "han": regex.compile(r"\p{Han}")}


def script(word: str) -> str:
    """The script of a word's first letter; of other scripts the block of 128 code points that the letter is in."""
    return next((name for name, letter in _SCRIPTS.items() if letter.match(word)), f"block{ord(word[0]) >> 7}")


@lru_cache(64)
def _sounds(letters: str) -> tuple[str, str]:
    """Consonants and vowels of a script; of one that isn't listed, lower-case or plain letters of its block stand for both."""
    if letters in SOUNDS:
        return SOUNDS[letters]
    first = int(letters.removeprefix("block")) << 7
    found = [chr(c) for c in range(first, first + 128) if chr(c).islower()] or [chr(c) for c in range(first, first + 128) if chr(c).isalpha()]
    return "".join(found), "".join(found)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _address(text: str) -> str | None:
    """The canonical form of a version-6 address with three groups that aren't 0 at least; None for other texts."""
    try:
        at = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    return at.compressed if sum(g != "0000" for g in at.exploded.split(":")) > 2 else None


def _person(parts: list[tuple[int, str]], gender: str, given: bool = False) -> list[tuple[int, str, str]]:
    """The parts of a name with their kinds: the last one is the surname, unless it is all there is and a given name."""
    out = []
    for k, (at, w) in enumerate(parts):
        first = w.capitalize() if w.isupper() else w
        if k + 1 < len(parts) or len(parts) == 1 and (given or first in GENDER_OF):
            out.append((at, w, f"given {GENDER_OF.get(first, gender)} {script(w)}"))
        else:
            out.append((at, w, f"surname {script(w)}"))
    return out


def detect(text: str | None) -> list[Span]:
    """The text's entities in order; of overlapping ones the earliest kind's counts."""
    if not text:
        return []
    found: list[Span] = []
    if _DIGIT.search(text):
        if "@" in text:
            found += [(m.start(), m.end(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
        found += [(m.start(), m.end(), "iban", m[0].replace(" ", "")) for m in _IBAN.finditer(text) if iban_holds(m[0].replace(" ", ""))]
        found += [(m.start(), m.end(), "ssn", _digits(m[0])) for m in _SSN.finditer(text)]
        found += [(m.start(), m.end(), "ip", m[0]) for m in _IP.finditer(text)]
        if ":" in text:
            for m in _IP6.finditer(text):
                if (at := _address(m[0])) is not None:
                    found.append((m.start(), m.end(), "ip", at))
        found += [(m.start(), m.end(), "phone", ("+" if m[0][0] == "+" else "+1") + _digits(m[0])) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]  # ten digits without a country are of +1
        found += [(m.start(), m.end(), "phone", _digits(m[0])) for m in _HOME_PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 12]
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if luhn(d):
                found.append((m.start(), m.end(), "card", d))
    people: list[tuple[int, str, str]] = []  # where, the part, its kind
    if not _NAME_WORDS.isdisjoint(_CAPITALIZED.findall(text)):  # a title or given name has no letter beside it, so it is such a run
        for m in _TITLED.finditer(text):
            people += _person([(m.start(2) + p.start(), p[0]) for p in _WHOLE_PART.finditer(m[2])], _TITLE_GENDER[m[1]])
        for m in _NAMED.finditer(text):
            people += _person([(m.start(1), m[1]), (m.start(2), m[2])], "n")
    if _INTRODUCED.search(text):
        for m in _INTRODUCED.finditer(text):
            parts = [(m.start(1) + p.start(), p[0]) for p in _WHOLE_PART.finditer(m[1])]
            people += _person(parts, "n", len(parts) == 1)
    if people:
        found += [(at, at + len(w), k, w.casefold()) for at, w, k in people]
        again = {w: k for _, w, k in people if k.startswith("surname") and len(w) > 2}
        again |= {w.upper(): k for w, k in again.items()}
        if again:
            words = regex.compile(rf"(?<!\p{{L}})(?:{'|'.join(map(regex.escape, sorted(again, key=len, reverse=True)))})(?!\p{{L}})")
            found += [(m.start(), m.end(), again[m[0]], m[0].casefold()) for m in words.finditer(text)]
    out, end = [], -1
    for s in sorted(dict.fromkeys(found), key=lambda s: (s[0], -s[1])):
        if s[0] >= end:
            out.append(s)
            end = s[1]
    return out


class _Draw:
    """A stream of numbers that key, kind, canonical form and attempt decide."""

    def __init__(self, key: bytes, kind: str, canon: str, attempt: int, redraw: int = 0):
        self.seed, self.n, self.pool = hmac.new(key, f"{kind}\0{canon}\0{attempt}\0{redraw}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 40:
            self.pool = int.from_bytes(hashlib.sha256(self.seed + self.n.to_bytes(4)).digest())
            self.n, self.left = self.n + 1, 256
        self.pool, out = divmod(self.pool, n)
        self.left -= max(1, n.bit_length())
        return out

    def one(self, items):
        return items[self.below(len(items))]

    def like(self, text: str) -> str:
        """Letters for letters and digits for digits, of the same case; other characters stay."""
        return "".join(self.one("0123456789") if c.isdigit() else self.one("bcdfghjklmnpqrstvwxz" if c.lower() not in "aeiou" else "aeiou") if c.isascii() and c.islower() else self.one("BCDFGHJKLMNPQRSTVWXZ") if c.isascii() and c.isupper() else c for c in text)


@lru_cache(64)
def _listed(kind: str) -> list[str]:
    sort, *rest = kind.split()
    if sort == "surname":
        return SURNAMES.get(rest[0], "").split()
    gender, letters = rest
    return [n for (g, s), names in GIVEN.items() if s == letters and gender in (g, "n") for n in names.split()]


def _ip4(draw: _Draw, canon: str, attempt: int) -> str:
    a, b, *_ = map(int, canon.split("."))
    fixed = [a] if a in (10, 127) else [a, b] if (a, b) in ((192, 168), (169, 254)) or a == 172 and 16 <= b < 32 else []
    if attempt >= WIDEST:
        return str(ipaddress.IPv6Address((0xFD << 120 if fixed else 0x20010DB8 << 96) + draw.below(1 << 38) * (1 << 32) + draw.below(1 << 32)))
    fixed = [10] if fixed and attempt >= WIDER else fixed
    if fixed:
        return ".".join(map(str, fixed + [draw.below(256) for _ in range(4 - len(fixed))]))
    first = draw.one([x for x in range(1, 223) if x not in (10, 127, 169, 172, 192)])
    return ".".join(map(str, [first, *(draw.below(256) for _ in range(3))]))


def surrogate(kind: str, canon: str, attempt: int, key: bytes) -> str:
    """The canonical form of the entity's replacement at an attempt. Never the entity's own: it is drawn again until it is another."""
    return next(new for redraw in itertools.count() if (new := _drawn(kind, canon, attempt, redraw, key)) != canon)


def _drawn(kind: str, canon: str, attempt: int, redraw: int, key: bytes) -> str:
    draw = _Draw(key, kind, canon, attempt, redraw)
    more = max(0, attempt - WIDER + 2) // 2  # characters that a wider format adds
    digits = lambda: "".join(draw.one("0123456789") for _ in range(more))
    if kind == "email":
        local, _, domain = canon.partition("@")
        labels = domain.split(".")
        host = _Draw(key, "domain", domain, 0)  # the same for all its addresses, unless an address collides
        return f"{draw.like(local)}{''.join(draw.one('bcdfghjklmnpqrstvwxz') for _ in range(more))}@{'.'.join([*map(host.like if attempt < LISTED_ATTEMPTS else draw.like, labels[:-1]), labels[-1]])}"
    if kind == "ip" and ":" in canon:
        groups = [g and "".join(draw.one("0123456789abcdef" if k else "123456789abcdef") for k in range(len(g) if attempt < WIDER else 4)) for g in canon.split(":")]
        if (at := ipaddress.IPv6Address(canon)).is_private:
            groups[0] = canon.split(":")[0]
        if attempt >= WIDEST:
            return str(ipaddress.IPv6Address(int(at) >> 112 << 112 | draw.below(1 << 38) << 64 | draw.below(1 << 32) << 32 | draw.below(1 << 32)))
        return ipaddress.IPv6Address(":".join(groups)).compressed
    if kind == "ip":
        return _ip4(draw, canon, attempt)
    if kind == "card":
        new = canon[0] + draw.like(canon[1:]) + digits()
        return new if luhn(new) == luhn(canon) else next(x for d in range(10) if luhn(x := new[:-1] + str((int(new[-1]) + d) % 10)) == luhn(canon))
    if kind == "iban":
        body = draw.like(canon[4:]) + digits()
        return next(x for c in range(2, 99) if iban_holds(x := f"{canon[:2]}{c:02d}{body}"))
    if kind == "phone":
        head = canon[:2] if canon[0] == "+" else ""
        return head + "".join(str(1 + draw.below(9)) if c != "0" and k == 0 else "0" if k == 0 and not head else draw.like(c) for k, c in enumerate(canon[len(head) :])) + digits()
    if kind == "ssn":
        return f"{1 + draw.below(665):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}{digits()}"
    letters = kind.split()[-1]
    if attempt < LISTED_ATTEMPTS and (names := _listed(kind)):
        return draw.one(names).casefold()
    end = {"given m latin": "o", "given f latin": "a", "given f cyrillic": "я", "given m greek": "ος", "given f greek": "α"}.get(kind, "")
    consonants, vowels = _sounds(letters)
    return ("".join(draw.one(consonants) + draw.one(vowels) for _ in range((1 if letters == "han" else 3) + attempt // 8)) + end).casefold()


def rendered(kind: str, mention: str, new: str) -> str:
    """The surrogate written as the mention is; what a wider format adds follows."""
    if kind == "email":
        local, _, domain = mention.partition("@")
        new_local, _, new_domain = new.partition("@")
        cased = lambda old, to: "".join(n.upper() if m.isupper() else n for m, n in itertools.zip_longest(old, to, fillvalue="") if n)
        return f"{cased(local, new_local)}@{cased(domain, new_domain)}"
    if kind == "ip":
        return new.upper() if any(c.isupper() for c in mention) else new
    if kind in ("card", "phone", "ssn", "iban"):
        it = iter(new[2:] if kind == "phone" and new[0] == "+" and mention[0] != "+" else new.lstrip("+"))
        return "".join(next(it) if c.isalnum() else c for c in mention) + "".join(it)
    return new.upper() if mention.isupper() and len(mention) > 1 else new[:1].upper() + new[1:]


def key_of(spark: SparkSession) -> bytes:
    """The key in the session's setting `KEY_CONF`. Where there is none, a random one is set for the session: its surrogates
    are the same in all its queries, and can't be drawn again by anyone."""
    if not spark.conf.get(KEY_CONF, None):
        spark.conf.set(KEY_CONF, secrets.token_hex(32))
    return spark.conf.get(KEY_CONF).encode()


def space(kind: Column) -> Column:
    """Within what an entity of a kind is one, and its surrogate distinct: the kind itself, of names the names of its script."""
    return F.regexp_replace(kind, r"^(given \w+|surname) ", "name ")


def settled(mentions: DataFrame) -> DataFrame:
    """space, canon and kind of each distinct entity in mentions (kind, canon). A name is a given name if any mention is, of the gender that its mentions
    agree on, else of none."""
    shown = lambda g: F.max(F.col("kind").startswith(f"given {g} "))
    each = mentions.groupBy(space(F.col("kind")).alias("space"), "canon").agg(F.min("kind").alias("any"), F.max(F.col("kind").startswith("given ")).alias("given"), shown("m").alias("m"), shown("f").alias("f"))
    gender = F.when(F.col("m") == F.col("f"), "n").when(F.col("m"), "m").otherwise("f")
    return each.select("space", "canon", F.when(F.col("given"), F.regexp_replace("space", "^name", F.concat(F.lit("given "), gender))).otherwise(F.col("any")).alias("kind"))


def surrogates(entities: DataFrame, key: bytes) -> tuple[DataFrame, list[DataFrame]]:
    """space, canon, kind, surrogate of distinct entities (space, canon, kind), and the written tables that this reads. No two of a space share one, and none
    is itself an entity of its space."""
    given: list[DataFrame] = []  # a table an attempt, each of those that are settled by it
    pending, attempt = entities.select("space", "canon", "kind"), 0
    while True:

        def run(batches, attempt=attempt):
            for b in batches:
                new = [surrogate(k, c, attempt, key) for k, c in zip(b.column("kind").to_pylist(), b.column("canon").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("space"), b.column("canon"), b.column("kind"), pa.array(new, pa.string())], names=["space", "canon", "kind", "surrogate"])

        drawn = persist(pending.mapInArrow(tidy(run), "space string, canon string, kind string, surrogate string"), "pii-drawn")
        sole = drawn.groupBy("space", "surrogate").agg(F.min(F.struct("canon", "kind")).alias("first")).select("space", "first.*", "surrogate")
        sole = sole.join(entities.select("space", F.col("canon").alias("surrogate")), ["space", "surrogate"], "left_anti")
        if given:
            sole = sole.join(reduce(DataFrame.union, given).select("space", "surrogate"), ["space", "surrogate"], "left_anti")
        given.append(persist(sole.select("space", "canon", "kind", "surrogate"), "pii-given"))
        left = persist(drawn.select("space", "canon", "kind").join(given[-1].select("space", "canon"), ["space", "canon"], "left_anti"), "pii-pending")
        discard(drawn, *([pending] if attempt else []))
        pending, attempt = left, attempt + 1
        if pending.isEmpty():
            discard(pending)
            return reduce(DataFrame.union, given), given


def replace_pii(df: DataFrame, key: bytes, text: str = "text", kinds_column: str | None = None) -> DataFrame:
    """df with every entity in `text` replaced; kinds_column: adds what was replaced, as in "card:1,email:2".

    Rows with entities are written with what was found in them; rows without, whose texts are searched again for that, pass as they are, so that
    the corpus isn't copied. df should give the same rows each time it is read."""
    small_batches(df.sparkSession)
    if kinds_column:
        df = df.withColumn(kinds_column, F.lit("").cast("string"))
    names, schema = df.columns, df.schema
    row, held, to = (free_name(n, *names) for n in ("pii_row", "pii_spans", "pii_new"))
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("canon", pa.string())]))
    spans_ddl = "array<struct<start:bigint,end:bigint,kind:string,canon:string>>"

    def marked(batches):
        for b in batches:
            spans = [detect(t) for t in b.column(names.index(text)).to_pylist()]
            some = [k for k, x in enumerate(spans) if x]
            if some:
                lists = [[dict(zip(("start", "end", "kind", "canon"), s, strict=True)) for s in spans[k]] for k in some]
                kept = b.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([uuid.uuid4().hex for _ in some]), pa.array(lists, spans_type)], names=[*names, row, held])

    def unmarked(batches):
        for b in batches:
            yield b.filter(pa.array([not detect(t) for t in b.column(names.index(text)).to_pylist()]))

    wide = T.StructType([*schema.fields, T.StructField(row, T.StringType()), T.StructField(held, T._parse_datatype_string(spans_ddl))])
    rows = persist(df.mapInArrow(tidy(marked), wide), "pii-rows")
    mentions = rows.select(row, F.posexplode(held).alias("pos", "s")).select(row, "pos", space(F.col("s.kind")).alias("space"), F.col("s.kind").alias("kind"), F.col("s.canon").alias("canon"))
    entities = persist(settled(mentions), "pii-entities")
    given, written = surrogates(entities, key)
    new = persist(mentions.join(given.drop("kind"), ["space", "canon"]).groupBy(row).agg(F.sort_array(F.collect_list(F.struct("pos", "surrogate"))).alias(to)), "pii-new")
    discard(entities, *written)
    joined = rows.join(new, row)

    def rewritten(batches):
        for b in batches:
            out, kinds = [], []
            for t, spans, new in zip(b.column(names.index(text)).to_pylist(), b.column(held).to_pylist(), b.column(to).to_pylist(), strict=True):
                parts, at, n = [], 0, {}
                for s, x in zip(spans, new, strict=True):
                    parts += [t[at : s["start"]], rendered(s["kind"], t[s["start"] : s["end"]], x["surrogate"])]
                    at = s["end"]
                    k = s["kind"].split()[0]
                    n[k] = n.get(k, 0) + 1
                out.append("".join(parts) + t[at:])
                kinds.append(",".join(f"{k}:{v}" for k, v in sorted(n.items())))
            cols = {c: b.column(k) for k, c in enumerate(names)}
            cols[text] = pa.array(out, cols[text].type)
            if kinds_column:
                cols[kinds_column] = pa.array(kinds, pa.string())
            if "n_chars" in cols and pa.types.is_integer(cols["n_chars"].type):
                cols["n_chars"] = pa.array([None if o is None else len(o) for o in out], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    return df.mapInArrow(tidy(unmarked), schema).union(joined.select(*names, held, to).mapInArrow(tidy(rewritten), schema))
