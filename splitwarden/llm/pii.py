"""Personal data replaced by keyed surrogates of the same type and shape.

1. Tasks detect entities: e-mail and IP addresses, phone, card, account and social security
   numbers, secrets behind a keyword or of a known form, and names behind a title in any case. The
   words of these names are then looked up in the whole document, so capitalised mentions without a
   title are the same entity. An entity is known by its kind and canonical form (digits of a number,
   lower-case address, single name word), so all its spellings, behind any title and in all
   documents, get one surrogate; the gender of a given name is what most of its titles say.
   A pattern is tried only where a cheap mark of it stands in the text.
2. A surrogate comes from HMAC-SHA256 of a key, the kind, the canonical form and an attempt.
   It keeps the shape: digits stay digits and letters letters, the country code, network
   digit, check digits that were right, address class and domain ending are kept, and a name
   keeps its script, gender (of surnames: that of their form) and case.
3. Collisions are checked over the whole corpus: a surrogate that equals an entity of its kind
   (names: of any name kind), or that another entity has too, is drawn again (the least entity keeps
   a shared one) until all are distinct. Distinct entities so stay distinct. Every ``SAME_FORM``
   attempts the form gets wider (a character more, the next address range), so a full form never
   blocks the end. A value without letters and digits, such as a masked password, is no secret.
4. Surrogates are joined back to the occurrences, and each document is rewritten once.

Names that never stand behind a title are not found: that would need a model of names.

Cases: a null text stays null and has no entities; empty texts stay empty; a null doc_id is
kept; rows with the same doc_id and text get the same text; very long texts are scanned in
full, one at a time; no entity at all leaves every text as it was; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitwarden.llm.text import slices
from splitwarden.operators.scale import materialise, release

# Titles that announce a name, by gender.
MALE_TITLES = ["Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra", "Doña", "Госпожа", "Κυρία"]
ANY_TITLES = ["Dr", "Prof", "Professor", "Doctor", "Доктор", "Профессор"]
# First choice of given names by script and gender.
GIVEN_NAMES = {
    ("latin", "male"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Julian", "Marco", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Victor"],
    ("latin", "female"): ["Alice", "Bianca", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Laura", "Maria", "Nina", "Olivia", "Sofia", "Vera"],
    ("cyrillic", "male"): ["Алексей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Максим", "Олег", "Павел"],
    ("cyrillic", "female"): ["Алина", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Юлия"],
    ("greek", "male"): ["Αλέξης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"],
    ("greek", "female"): ["Άννα", "Δήμητρα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία"],
}
# Syllables and endings of composed names.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga ge ka ke ki la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi".split(),
    "cyrillic": "ба бе би бо ва ве ви га да де ди ка ки ла ле ли ма ме ми на не ни ра ре ри са се си та те ти".split(),
    "greek": "βα βε γα γε δα δε κα κε λα λε λι μα με μι να νε νι ρα ρε ρι σα σε σι τα τε τι".split(),
}
ENDINGS = {
    ("latin", "male"): "n", ("latin", "female"): "a", ("latin", "any"): "r",
    ("cyrillic", "male"): "н", ("cyrillic", "female"): "я", ("cyrillic", "any"): "к",
    ("greek", "male"): "ς", ("greek", "female"): "α", ("greek", "any"): "ς",
}

# Country calling codes of one and two digits; all others have three.
SHORT_CODES = set(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
    "81 82 84 86 90 91 92 93 94 95 98".split()
)

SAME_FORM = 4  # attempts before the form of a surrogate gets wider

_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
# A quoted secret runs to its closing quote; without one, or without quotes, it ends at white space.
_SECRET = (
    r"""(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)(?:\\?["'])?[ \t]*[=:][ \t]*"""
    r"""(?:\\?(?P<quote>["'])(?P<quoted>(?:(?!\\?(?P=quote))[^\r\n]){6,})\\?(?P=quote)(?!\w)"""
    r"""|(?:\\?["'])?(?P<value>[^\s,;"']{6,}))"""
)
_TITLE = "|".join(sorted(MALE_TITLES + FEMALE_TITLES + ANY_TITLES, key=len, reverse=True))
_ANY_TITLE = "|".join(sorted(ANY_TITLES, key=len, reverse=True))
_GENDER = {t.lower(): g for g, ts in (("male", MALE_TITLES), ("female", FEMALE_TITLES)) for t in ts}
_NEXT_NAME = {t.lower() for t in MALE_TITLES + FEMALE_TITLES + ANY_TITLES} - {"don"}  # Don is a name too
# Titles without gender may follow a title, and initials may precede the words of a name; a line
# end may stand anywhere between them.
_GAP = r"(?:[^\S\r\n]+|[^\S\r\n]*\r?\n[^\S\r\n]*)"
PATTERNS = [
    ("email", re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+")),
    ("secret", re.compile(_SECRET)),
    ("key", re.compile(r"\b(?:A(?:KI|SI)A[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36})\b")),
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w]|\.[0-9])")),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("phone", re.compile(r"(?<!\w)(?:\+[0-9][0-9 ()./-]{6,20}[0-9]|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|0[0-9]{2,4}[-/ ][0-9]{5,8})(?!\w)")),
    ("card", re.compile(r"(?<![\w-])[3-6](?:[ -]?[0-9]){12,18}(?![\w-])")),
    ("name", re.compile(rf"\b(?P<title>(?i:{_TITLE}))\b\.?(?:\s+(?i:{_ANY_TITLE})\b\.?)*\s+(?P<value>(?:[^\W\d_]\.\s*)*{_WORD}(?:{_GAP}(?:[^\W\d_]\.\s*)*{_WORD}){{0,2}})")),
]
_DIGIT = re.compile("[0-9]")
_KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "api")
_TITLES_LOWER = sorted({t.lower() for t in MALE_TITLES + FEMALE_TITLES + ANY_TITLES})
_NUMERIC = {"iban", "ip", "ssn", "phone", "card"}
_ENTITY = pa.schema([("kind", pa.string()), ("entity", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])


def _script(word: str) -> str:
    if any("Ѐ" <= c <= "ӿ" for c in word):
        return "cyrillic"
    return "greek" if any("Ͱ" <= c <= "Ͽ" for c in word) else "latin"


def _luhn(digits: str) -> int:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10


def _name_parts(match: re.Match, lowered: Callable[[], set[str]]) -> Iterator[tuple[str, str, int, int]]:
    gender = _GENDER.get(match["title"].lower(), "any")
    words, end = [], 0
    for word in re.finditer(_WORD, match["value"]):
        if not word[0][0].isupper():  # the name ends at the first word in lower case
            break
        if len(word[0]) == 1 and match["value"][word.end() : word.end() + 1] == ".":
            continue
        if words and word[0].lower() in _NEXT_NAME:
            break
        gap = match["value"][end : word.start()]
        if words and "\n" in gap and word[0].lower() in lowered():
            break  # an ordinary word at the start of the next line
        end = word.end()
        words.append(word)
    base = match.start("value")
    for i, word in enumerate(words):
        stop = word.end() - (len(word[0]) > 2 and word[0][-2:] in ("'s", "’s", "'S", "’S")) * 2
        spelled = match["value"][word.start() : stop]
        given = i + 1 < len(words)
        kind = f"{'given' if given else 'surname'}:{_script(spelled)}:{gender if given else 'any'}"
        yield kind, spelled.lower(), base + word.start(), base + stop


def _mentions(text: str, named: list[tuple[str, str, int, int]]) -> list[tuple[str, str, int, int]]:
    """The titled names of a text and all other capitalised mentions of their words.

    A word has one kind in a text where it can: a given name whose gender a title tells has that
    gender throughout, and a mention without a title is what the first titled one is.
    """
    gendered: dict[str, str] = {}
    for kind, canonical, *_ in named:
        if kind.startswith("given") and not kind.endswith(":any"):
            gendered.setdefault(canonical, kind)
    named = [(gendered.get(c, k) if k.startswith("given") and k.endswith(":any") else k, c, s, e) for k, c, s, e in named]
    first: dict[str, str] = {}
    forms: dict[str, set[tuple[int, str]]] = {}  # by first run of letters: length, canonical form
    for kind, canonical, start, stop in named:
        if stop - start > 1:  # a letter alone names nobody elsewhere
            first.setdefault(canonical, kind)
            run = re.match(r"[^\W\d_]+", text[start:stop])[0].lower()
            forms.setdefault(run, set()).update({(stop - start, canonical), (len(canonical), canonical)})
    found, taken = list(named), {start for *_, start, _ in named}
    for run in re.finditer(r"[^\W\d_]+", text) if first else ():
        start = run.start()
        if run[0].lower() not in forms or not run[0][0].isupper() or start in taken:
            continue
        for length, canonical in sorted(forms[run[0].lower()], reverse=True):
            stop = start + length
            if text[start:stop].lower() == canonical and not text[stop : stop + 1].isalpha():
                found.append((first[canonical], canonical, start, stop))
                break
    return found


def _marked(text: str) -> set[str]:
    """The kinds whose mark stands in the text; a pattern of another kind cannot match."""
    low = text.lower()
    kinds = {"email"} if "@" in text else set()
    if _DIGIT.search(text):
        kinds |= _NUMERIC
    if any(k in low for k in _KEYWORDS):
        kinds.add("secret")
    if any(k in text for k in ("AKIA", "ASIA", "gh")):
        kinds.add("key")
    for title in _TITLES_LOWER:
        at = low.find(title)
        while at >= 0:
            before, after = low[at - 1 : at], low[at + len(title) : at + len(title) + 1]
            if not (before.isalnum() or before == "_" or after.isalnum() or after == "_"):
                return kinds | {"name"}
            at = low.find(title, at + 1)
    return kinds


def detect(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, canonical form, start, stop) of the entities of a text; they do not overlap."""
    marked = _marked(text)
    found: list[tuple[int, int, int, str, str]] = []
    named: list[tuple[str, str, int, int]] = []
    lowered = lru_cache(lambda: {w for w in re.findall(_WORD, text) if w.islower()})
    for rank, (kind, pattern) in enumerate(PATTERNS):
        if kind not in marked:
            continue
        at = 0
        while kind == "name" and (match := pattern.search(text, at)):
            # What was read but is no part of this name may begin the next.
            parts = list(_name_parts(match, lowered))
            named += parts
            at = parts[-1][3] if parts else match.start("value")
        for match in pattern.finditer(text) if kind != "name" else ():
            group = 0
            if kind == "secret":
                group = "quoted" if match["quoted"] else "value"
            value = match[group]
            if kind == "secret" and not any(c.isalnum() for c in value):
                continue
            canonical = value.lower() if kind == "email" else value
            if kind in ("phone", "card", "ssn"):
                canonical = "+" * value.startswith("+") + "".join(c for c in value if c.isdigit())
            elif kind == "iban":
                canonical = value.replace(" ", "")
            found.append((match.start(group), match.end(group), rank, "secret" if kind == "key" else kind, canonical))
    found += [(s, e, len(PATTERNS), k, c) for k, c, s, e in _mentions(text, named)] if named else []
    kept: list[tuple[str, str, int, int]] = []
    done = 0
    for start, stop, _, kind, canonical in sorted(found, key=lambda f: (f[0], f[2], -f[1])):
        if start >= done:
            kept.append((kind, canonical, start, stop))
            done = stop
    return kept


class _Draw:
    """A keyed stream of numbers."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.key, self.seed = key, f"{kind}\x00{entity}\x00{attempt}\x00".encode()
        self.block, self.left = 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            digest = hmac.new(self.key, self.seed + str(self.block).encode(), hashlib.sha256).digest()
            self.block, self.left = self.block + 1, self.left + digest
        number, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return number % n

    def like(self, text: str, letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
        """Characters of the same class in every place; a leading digit stays non-zero."""
        out = []
        for i, c in enumerate(text):
            if c.isdigit():
                lead = i == 0 and c != "0"
                out.append(str(1 + self.below(9)) if lead else str(self.below(10)))
            elif c.isalpha():
                pick = letters[self.below(len(letters))]
                out.append(pick.upper() if c.isupper() else pick)
            else:
                out.append(c)
        return "".join(out)


def _code_length(digits: str) -> int:
    """Digits of the country code of an international number."""
    return next((n for n in (1, 2) if digits[:n] in SHORT_CODES), 3)


def _iban_rest(account: str) -> int:
    """The account number modulo 97 with its letters as numbers; 1 where the check digits are right."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def surrogate(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """The canonical form of the replacement of an entity."""
    draw = _Draw(key, kind, entity, attempt)
    wider = attempt // SAME_FORM
    name = kind.split(":")
    if name[0] in ("given", "surname"):
        names = GIVEN_NAMES.get((name[1], name[2]), [])
        if names and attempt == 0:
            return names[draw.below(len(names))].lower()
        pool = SYLLABLES[name[1]]
        count = 2 + wider + draw.below(2)
        gender = name[2]
        if name[0] == "surname" and name[1] == "cyrillic":
            gender = "female" if entity.endswith(("а", "я")) else "male"
        elif name[0] == "surname" and name[1] == "greek":
            gender = "male" if entity.endswith("ς") else "female"
        return "".join(pool[draw.below(len(pool))] for _ in range(count)) + ENDINGS[name[1], gender]
    if kind == "email":
        local, _, domain = entity.partition("@")
        body, _, ending = domain.rpartition(".")
        longer = "".join("abcdefghij"[draw.below(10)] for _ in range(wider))
        return f"{draw.like(local)}{longer}@{draw.like(body)}.{ending}"
    if kind == "ip":
        parts = entity.split(".")
        # Network parts that stay, from the entity's own range to wider ones.
        ranges = [["10"], []] if parts[0] == "10" else [[]]
        if entity.startswith(("192.168.", "172.16.")):
            ranges = [parts[:2], ["10"], []]
        if wider > len(ranges):  # beyond the four-part addresses
            return ":".join(["fd00", *[f"{draw.below(1 << 16):04x}" for _ in range(7)]])
        kept = ranges[min(wider, len(ranges) - 1)]
        first = [n for n in range(1, 224) if n not in (10, 127, 172, 192)]
        fresh = [str(first[draw.below(len(first))])] + [str(draw.below(256)) for _ in range(3)]
        return ".".join(kept + fresh[len(kept) :])
    if kind == "card":
        body = entity[0] + draw.like("1" * (len(entity) - 2 + wider))
        valid = _luhn(entity) == 0
        check = (10 - _luhn(body + "0")) % 10
        return body + str(check if valid else (check + 1 + draw.below(9)) % 10)
    if kind == "phone":
        keep = 1 if len(entity) > 10 else 0
        if entity.startswith("+"):
            keep = 1 + _code_length(entity[1:])
        return entity[:keep] + draw.like(entity[keep:] + "0" * wider)
    if kind == "iban":
        body = draw.like(entity[4:] + "0" * wider)
        right = 98 - _iban_rest(f"{entity[:2]}00{body}")
        # Other remainders than the right one are drawn where the check digits were wrong.
        check = right if _iban_rest(entity) == 1 else 2 + (right - 2 + 1 + draw.below(96)) % 97
        return f"{entity[:2]}{check:02d}{body}"
    if kind == "ssn":
        return draw.like(entity + "0" * wider)
    hexadecimal = all(c in "0123456789abcdef" for c in entity)
    numeric = not any(c.isalpha() for c in entity)
    return draw.like(
        entity + ("0" if numeric else "a") * wider, "abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"
    )


def render(kind: str, raw: str, value: str) -> str:
    """A canonical replacement in the spelling of the occurrence it replaces."""
    if kind in ("phone", "card", "ssn", "iban"):
        signs = iter(value.removeprefix("+"))
        # A wider form is longer than what it replaces; its rest follows.
        return "".join([*(next(signs) if c.isalnum() else c for c in raw), *signs])
    if kind.startswith(("given", "surname")):
        if raw.isupper() and len(raw) > 1:
            return value.upper()
        return value[0].upper() + value[1:] if raw[0].isupper() else value
    return value.upper() if kind == "email" and raw.isupper() else value


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows, places = [], []
            for i, text in enumerate(part.column("text")):
                text = text.as_py()
                for entity in detect(text) if text else ():
                    rows.append(entity)
                    places.append(i)
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _ENTITY)] if rows else [
                pa.array([], f.type) for f in _ENTITY
            ]
            taken = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(taken), part.column("text_key").take(taken), *columns],
                names=["doc_id", "text_key", *_ENTITY.names],
            )


def _surrogates(key: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, entities, attempts = (c.to_pylist() for c in batch.columns[:3])
            drawn = [surrogate(key, k, e, a) for k, e, a in zip(kinds, entities, attempts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, pa.string())], names=[*batch.schema.names, "drawn"])

    return run


def _family(kind: Column) -> Column:
    """A kind without the gender of names."""
    return F.when(kind.rlike("^(given|surname):"), F.substring_index(kind, ":", 2)).otherwise(kind)


def assign_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, surrogate): all surrogates of a kind distinct and none an entity.

    Names of any kind are one space of forms. ``kind`` comes out without the gender of names,
    which is that of most mentions.
    """
    gender = F.substring_index("kind", ":", -1)
    entities = entities.groupBy(_family(F.col("kind")).alias("kind"), "entity").agg(
        F.count_if(gender == "male").alias("male"), F.count_if(gender == "female").alias("female")
    )
    is_name = F.col("kind").rlike("^(given|surname):")
    said = F.when(F.col("male") > F.col("female"), "male").when(F.col("male") < F.col("female"), "female").otherwise("any")
    entities = materialise(
        entities.select(
            "kind",
            "entity",
            F.when(is_name, "name").otherwise(F.col("kind")).alias("space"),
            F.when(is_name, F.concat_ws(":", "kind", said)).otherwise(F.col("kind")).alias("form_kind"),
        ),
        "entities",
    )
    # An entity met so far blocks its own form; a settled surrogate blocks it too.
    state = entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", F.lit(None).cast("string"))
    columns = ["kind", "entity", "space", "form_kind"]
    while True:
        waiting = state.filter("surrogate IS NULL").select("form_kind", "entity", "attempt", "space", "kind")
        drawn = waiting.mapInArrow(
            _surrogates(key), "form_kind string, entity string, attempt int, space string, kind string, drawn string"
        )
        owner = F.struct("entity", "kind")
        nobody = F.lit(None).cast("struct<entity:string,kind:string>")
        claims = drawn.select("space", F.col("drawn").alias("form"), owner.alias("owner"), F.lit(1).alias("claim"))
        blocks = entities.select("space", F.col("entity").alias("form"), nobody.alias("owner"), F.lit(0).alias("claim"))
        settled = state.filter("surrogate IS NOT NULL")
        blocks = blocks.union(settled.select("space", "surrogate", nobody, F.lit(0)))
        winners = (
            claims.union(blocks).groupBy("space", "form")
            .agg(F.min("claim").alias("claim"), F.min("owner").alias("owner"))
            .filter("claim = 1")
            .select("owner.entity", "owner.kind", F.col("form").alias("won"))
        )
        before = state
        state = materialise(
            state.join(winners, ["kind", "entity"], "left").select(
                *columns, (F.col("attempt") + 1).alias("attempt"), F.coalesce("surrogate", "won").alias("surrogate")
            ),
            "surrogates",
        )
        release(before)
        if state.filter("surrogate IS NULL").isEmpty():
            return state.select("kind", "entity", "surrogate")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "_text"):
            texts, changes = part.column("_text").to_pylist(), part.column("_changes").to_pylist()
            for i, text in enumerate(texts):
                if text and changes[i]:
                    parts, done = [], 0
                    for c in changes[i]:
                        parts += [text[done : c["start"]], render(c["kind"], text[c["start"] : c["stop"]], c["surrogate"])]
                        done = c["stop"]
                    texts[i] = "".join([*parts, text[done:]])
            names = part.schema.names[:-2]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in names], pa.array(texts, pa.string()), part.column("_changes")],
                names=part.schema.names,
            )


def replace_pii(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their columns, surrogates in ``text``, and the list ``pii_changes``.

    ``pii_changes`` holds (start, stop, kind, surrogate) by place in the original text. A
    column of that name in the input is replaced.
    """
    body = F.col(text).cast("string")
    narrow = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("text")
    )
    found = materialise(
        narrow.mapInArrow(
            _detect, "doc_id bigint, text_key bigint, kind string, entity string, start bigint, stop bigint"
        ),
        "pii",
    )
    named = found.distinct().withColumn("kind", _family(F.col("kind")))
    named = named.join(assign_surrogates(found, key), ["kind", "entity"])
    changes = named.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_list(F.struct("start", "stop", "kind", "surrogate"))).alias("_changes")
    )
    changes = changes.toDF("pii_id", "pii_key", "_changes")
    columns = [c for c in docs.columns if c != "pii_changes"]
    # The columns get numbers, so no name of the input can clash; the text travels once.
    place = {c: f"_k{i}" for i, c in enumerate(columns) if c != text}
    rows = docs.select(
        *[F.col(f"`{c}`").alias(p) for c, p in place.items()],
        F.xxhash64(body).alias("row_key"),
        F.col(doc_id).cast("bigint").alias("row_id"),
        body.alias("_text"),
    )
    joined = rows.join(
        changes, F.col("row_id").eqNullSafe(F.col("pii_id")) & (F.col("row_key") == F.col("pii_key")), "left"
    )
    shaped = joined.select(*place.values(), "_text", "_changes")
    done = shaped.mapInArrow(_rewrite, shaped.schema)
    empty = F.array().cast("array<struct<start:bigint,stop:bigint,kind:string,surrogate:string>>")
    return done.select(
        *[F.col(place.get(c, "_text")).alias(c) for c in columns],
        F.coalesce("_changes", empty).alias("pii_changes"),
    )
