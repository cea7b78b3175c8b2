"""Surrogates for personal data: keyed, of the same type, distinct, and the same for every mention.

A surrogate follows from a secret key, the kind, the canonical form and an attempt number, so tasks agree
on it without asking each other and all mentions of one thing get the same one, in their own layout.
Distinctness needs the corpus: the distinct entities are drawn together, and an entity whose surrogate
another one has, or that is itself some entity, draws again.  Attempts beyond the first are rare; only
they are brought to the documents that mention them.

A name is one entity in whatever place it stands: the corpus decides whether it counts as a given name
(and of which gender) or as a surname, and all names of a script share one pool of surrogates.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.pii_detect import GIVEN_NAMES, detect, script_of
from packetloom.llm.support import materialize, texts_of

#: The key of the query; a user passes their own secret.
DEMONSTRATION_KEY = "demonstration key, not secret"
# Attempts after which an entity of an exhausted format gets a numbered placeholder instead.
MOST_ATTEMPTS = 40
# Parts that names are made of when the lists are used up.
_PARTS = {"latin": "ba be bi do da el fa fe ga ha jo ka la le li lo ma me mi mo na ne ni no ra re ri ro sa se so ta te to va ve vi".split(),
          "cyrillic": "ба бе ва ви го да де жа за ка ки ла ли ма ми на не ни па ра ри са се та ти фа ха".split()}
_ENDS = {("f", "latin"): "a", ("m", "latin"): "o", ("f", "cyrillic"): "а", ("m", "cyrillic"): "й"}
SURNAMES = {
    "latin": (
        "Smith Miller Davis Wilson Moore Taylor Jackson White Harris Clark Lewis Walker Hall Young King Wright Hill Green Baker "
        "Nelson Carter Schneider Fischer Weber Wagner Becker Hoffmann Dubois Moreau Laurent Garcia Fernandez Lopez Torres Ruiz"
    ).split(),
    "cyrillic": "Иванов Смирнов Кузнецов Попов Соколов Лебедев Козлов Новиков Морозов Волков".split(),
}
_DIGITS = frozenset(("phone", "card", "ssn"))
_LETTERS = ("abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "абвгдежзийклмнопрстуфхцчшщъыьэюяё")
_NAME = r"^(given-.|surname)-"


class _Draw:
    """A keyed stream of numbers."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.seed, self.count, self.pool = key, "\x1f".join(parts).encode("utf-8", "surrogatepass"), 0, 0

    def below(self, limit: int) -> int:
        if self.pool < 1 << 64:
            digest = hmac.new(self.key, self.seed + self.count.to_bytes(4, "big"), hashlib.sha256).digest()
            self.pool, self.count = self.pool << 256 | int.from_bytes(digest, "big"), self.count + 1
        self.pool, value = divmod(self.pool, limit)
        return value

    def of(self, values: list[str] | str) -> str:
        return values[self.below(len(values))]


def _shaped(draw: _Draw, text: str, secret: bool = False) -> str:
    """Letters for letters of the same case, digits for digits, all else as it stands; a secret of
    hexadecimal digits stays one."""
    hexadecimal = secret and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) is not None
    out = []
    for c in text:
        if c.isascii() and c.isdigit():
            out.append(draw.of("0123456789abcdef" if hexadecimal and text.islower() else "0123456789"))
        elif c.isalpha() and hexadecimal:
            out.append(draw.of("0123456789abcdef" if c.islower() else "0123456789ABCDEF"))
        elif c.isalpha():
            letters = "абвгдежзиклмнопрстуфхцчшэюя" if script_of(c) == "cyrillic" else "abcdefghijklmnopqrstuvwxyz"
            chosen = draw.of(letters)
            out.append(chosen.upper() if c.isupper() else chosen)
        else:
            out.append(c)
    return "".join(out)


def _reach(first: int, second: int) -> str:
    """The range of addresses that the first two parts name."""
    if first in (10, 127):
        return str(first)
    if first == 172 and 16 <= second < 32:
        return "172.16/12"
    return f"{first}.{second}" if (first, second) in ((192, 168), (169, 254)) else "public" if 0 < first < 224 else "special"


def _address(draw: _Draw, norm: str) -> str:
    """Another address of the same range: private, loopback, link-local, special or public."""
    parts = [int(p) for p in norm.split(".")]
    reach = _reach(*parts[:2])
    while True:
        first, second = draw.below(256), draw.below(256)
        if reach != "public":
            first, second = parts[0], 16 + second % 16 if reach == "172.16/12" else second if reach in ("10", "127", "special") else parts[1]
        if _reach(first, second) == reach:
            return f"{first}.{second}.{draw.below(256)}.{1 + draw.below(254)}"


def luhn(digits: str) -> int:
    """Luhn sum modulo 10: 0 for a valid number."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10


@lru_cache(maxsize=1024)
def _initial(letter: str, key: bytes) -> str:
    """The letter after ``letter`` in a keyed circle of its alphabet: another one, and for each letter a different one."""
    letters = next(a for a in _LETTERS if letter in a)
    circle = sorted(letters, key=lambda c: hmac.new(key, b"initial\x1f" + c.encode(), hashlib.sha256).digest())
    return circle[(circle.index(letter) + 1) % len(circle)]


def surrogate(kind: str, norm: str, attempt: int, key: bytes) -> str:
    """The canonical form that replaces ``norm``: same kind, length and format, gender and script."""
    draw = _Draw(key, kind, norm, str(attempt))
    if attempt >= MOST_ATTEMPTS:
        return f"[{kind}-{draw.below(1 << 60):x}]"
    if kind == "phone" or kind == "ssn":
        keep = 1 if kind == "phone" and len(norm) > 10 else 0
        return norm[:keep] + "".join(draw.of("0123456789") for _ in norm[keep:])
    if kind == "card":
        digits = "".join(draw.of("0123456789") for _ in norm)
        if luhn(norm) == 0:
            digits = next(digits[:-1] + d for d in "0123456789" if luhn(digits[:-1] + d) == 0)
        return digits
    if kind == "ip":
        return _address(draw, norm)
    if kind == "email":
        local, domain = norm.rsplit("@", 1)
        host, end = domain.rsplit(".", 1)
        return f"{_shaped(draw, local)}@{_shaped(_Draw(key, 'domain', domain), host)}.{end}"
    if kind == "iban":
        body = norm[4:]
        drawn = "".join(draw.of("0123456789") if c.isdigit() else draw.of("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in body)
        number = int("".join(str(int(c, 36)) for c in drawn + norm[:2] + "00"))
        return f"{norm[:2]}{98 - number % 97:02d}{drawn}"
    if kind == "secret":
        return _shaped(draw, norm, secret=True)
    part, *gender, script = kind.split("-")
    if part == "initial":
        return _initial(norm, key)
    names = SURNAMES[script] if part == "surname" else [
        n for g in ("f", "m") for n in GIVEN_NAMES[g] if gender[0] in (g, "u") and script_of(n) == script
    ]
    if attempt < 1:
        return draw.of(names).lower()
    made = "".join(draw.of(_PARTS[script]) for _ in range(2 + attempt // 2))
    return made + (_ENDS.get((gender[0], script), "") if gender else "")


def rendered(kind: str, raw: str, replacement: str) -> str:
    """A canonical surrogate in the layout and case of a mention."""
    if replacement.startswith("["):
        return replacement
    if kind in _DIGITS:
        # A phone number without its country code takes what follows the code.
        digits = iter(replacement[-sum(c.isdigit() for c in raw) :])
        return "".join(next(digits) if c.isdigit() else c for c in raw)
    if kind == "iban":
        signs = iter(replacement)
        return "".join(c if c == " " else next(signs) for c in raw)
    if kind == "email":
        return "".join(b.upper() if a.isupper() else b for a, b in zip(raw, replacement)) if len(raw) == len(replacement) else replacement
    if kind.startswith(("given", "surname", "initial")):
        return replacement.upper() if len(raw) > 1 and raw.isupper() else replacement[:1].upper() + replacement[1:]
    return replacement


def _entities(rows: DataFrame) -> DataFrame:
    """``id, text_key, kind, norm``: each entity once per text and kind (initials need no table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, key, text in zip(*(batch.column(c) for c in ("id", "text_key", "text"))):
                found = {(m.kind, m.norm) for m in detect(text.as_py()) if not m.kind.startswith("initial")}
                out.extend((doc_id.as_py(), key.as_py(), *pair) for pair in found)
            ids, keys, kinds, norms = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(kinds, pa.string()), pa.array(norms, pa.string())],
                names=["id", "text_key", "kind", "norm"],
            )

    return rows.mapInArrow(run, "id long, text_key long, kind string, norm string")


def _drawn(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind, norm, attempt`` rows with their ``surrogate``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, norms, attempts = (batch.column(c) for c in ("kind", "norm", "attempt"))
            made = [surrogate(k.as_py(), n.as_py(), a.as_py(), key) for k, n, a in zip(kinds, norms, attempts)]
            yield pa.RecordBatch.from_arrays([kinds, norms, attempts, pa.array(made, pa.string())], names=["kind", "norm", "attempt", "surrogate"])

    return entities.mapInArrow(run, "kind string, norm string, attempt int, surrogate string")


def _pool(kind: Column) -> Column:
    """What surrogates are distinct in: the kind, for names all names of the script."""
    return F.regexp_replace(kind, _NAME, "name-")


def _settled(mentioned: DataFrame) -> DataFrame:
    """``kind, norm, mixed``: one kind for each entity, and whether texts say others.

    A name counts as what more texts have it as, a surname in a tie; its gender is the one that its given
    names list or titles say, none if they say both.
    """
    kind, last = F.col("kind"), F.max("kind")  # of both, the name of surnames is the last
    male, female = F.bool_or(kind.startswith("given-m-")), F.bool_or(kind.startswith("given-f-"))
    gender = F.when(male & ~female, "m").when(female & ~male, "f").otherwise("u")
    given = F.concat(F.lit("given-"), gender, F.lit("-"), F.substring_index(last, "-", -1))
    more = F.count_if(kind.startswith("given-")) > F.count_if(kind.startswith("surname-"))
    return mentioned.groupBy(_pool(kind).alias("pool"), "norm").agg(
        F.when(more, given).otherwise(last).alias("kind"), (F.min("kind") != last).alias("mixed")
    ).select("kind", "norm", "mixed")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind, norm, attempt, surrogate`` with distinct surrogates per kind (of all names together) that are
    no entity of that kind.

    Each round, of the entities that drew the same surrogate the smallest keeps it, unless it is taken, and
    the others draw again; rounds end when none has to.  A round writes what it settles and who draws again,
    and nothing of the rounds before.
    """
    pool = _pool(F.col("kind")).alias("pool")
    names = entities.select(pool, F.col("norm").alias("surrogate")).distinct()
    taken, settled, left, attempt = [names], [], entities.select("kind", "norm"), 0
    while True:
        drawn = materialize(_drawn(left.withColumn("attempt", F.lit(attempt)), key), "drawn")
        # The smallest of each value comes out of the aggregation itself, so no join meets a value that many drew.
        first = drawn.groupBy(pool, "surrogate").agg(F.min(F.struct("norm", "kind")).alias("first"))
        for held in taken:
            first = first.join(held, ["pool", "surrogate"], "left_anti")
        won = materialize(first.select("first.kind", "first.norm", F.lit(attempt).alias("attempt"), "surrogate"), "settled")
        settled.append(won)
        left = materialize(left.join(won, ["kind", "norm"], "left_anti"), "again")
        if left.isEmpty():
            return reduce(DataFrame.union, settled)
        taken.append(won.select(pool, "surrogate"))
        attempt += 1


def replace(docs: DataFrame, key: str = DEMONSTRATION_KEY) -> DataFrame:
    """``doc_id, text, n_entities, entities`` of every document: the text with surrogates, and what was
    replaced (``kind, start, end`` in the original text, ``surrogate``).

    Equal entities get equal surrogates throughout, different ones different ones.  NULL texts stay NULL,
    texts without entities as they are.  Repeated rows come back each, alike.  Other columns are ignored;
    an empty table gives an empty table.
    """
    secret = key.encode()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_key"), "text")
    mentioned = materialize(_entities(rows.where(F.col("text").isNotNull())), "mentioned")
    entities = materialize(_settled(mentioned), "entities")
    pool = _pool(F.col("kind")).alias("pool")
    later = (
        assign(entities.select("kind", "norm"), secret)
        .join(entities.where("mixed"), ["kind", "norm"], "left")
        .where("attempt > 0 or mixed").select(pool, "norm", "kind", "attempt")
    )
    overrides = materialize(
        mentioned.select("id", "text_key", pool, "norm").join(later, ["pool", "norm"])
        .groupBy("id", "text_key").agg(F.collect_set(F.struct("pool", "norm", "kind", "attempt")).alias("attempts"))
        .withColumnsRenamed({"id": "_id", "text_key": "_key"}),
        "overrides",
    )
    joined = rows.join(overrides, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return joined.select("id", "text", "attempts").mapInArrow(_replacing(secret), _RESULT)


_RESULT = "doc_id long, text string, n_entities long, entities array<struct<kind: string, start: int, end: int, surrogate: string>>"
_ENTITY = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))


def _replacing(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, entities = [], []
            for text, attempts in zip(batch.column("text"), batch.column("attempts")):
                text, parts, at, found = text.as_py(), [], 0, []
                tries = {(a["pool"], a["norm"]): (a["kind"], a["attempt"]) for a in attempts.as_py() or ()}
                for m in detect(text) if text else ():
                    kind, attempt = tries.get((re.sub(_NAME, "name-", m.kind), m.norm), (m.kind, 0))
                    new = rendered(kind, text[m.start : m.end], surrogate(kind, m.norm, attempt, key))
                    parts += [text[at : m.start], new]
                    at = m.end
                    found.append({"kind": kind, "start": m.start, "end": m.end, "surrogate": new})
                texts.append("".join(parts) + text[at:] if text is not None else None)
                entities.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(texts, pa.string()), pa.array([len(e) for e in entities], pa.int64()), pa.array(entities, _ENTITY)],
                names=["doc_id", "text", "n_entities", "entities"],
            )

    return run
