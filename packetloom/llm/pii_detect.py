"""Finds personal data and secrets in one text: kind, place and canonical form of every mention."""

from __future__ import annotations

import re
from typing import NamedTuple


class Mention(NamedTuple):
    start: int
    end: int
    kind: str
    #: Equal for mentions of the same thing, whatever their layout.
    norm: str


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_CLUSTER = re.compile(r"[+(]{0,2}\d[\d ().\-]{5,}")
_NUMBER = re.compile(
    rf"""(?<![\w.])(?P<ip>{_OCTET}(?:\.{_OCTET}){{3}})(?!\w|\.\d)
    |(?<![\w+])(?P<phone>\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,3}}
        |\(\d{{3}}\)[ ]?\d{{3}}[ .-]\d{{4}}|\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}})(?!\w)
    |(?<![\w-])(?P<ssn>\d{{3}}-\d{{2}}-\d{{4}})(?![\w-])
    |(?<![\w])(?P<card>\d(?:[ -]?\d){{12,18}})(?!\w)""",
    re.X,
)
_LOCAL = re.compile(r"[\w.%+\-]{1,64}$")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}")
_HEX = re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,128}(?![0-9A-Za-z])")
_SECRET = re.compile(r"""(?:token|secret|passw(?:or)?d|api[_\-]?key)["']?\s*[=:]\s*["']?(?P<value>[A-Za-z0-9_\-+/=.]{8,})""", re.I)
_SECRET_WORDS = ("token", "secret", "passw", "key")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_PIECE = re.compile(r"[^\-]+")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w’'\-]*")

# Forms of address with the gender they say (u: none), and given names.
TITLES = {
    **dict.fromkeys("Mr Herr Monsieur Señor Sr Don Господин".split(), "m"),
    **dict.fromkeys("Mrs Ms Miss Frau Madame Mme Mlle Señora Señorita Sra Srta Doña Госпожа".split(), "f"),
    **dict.fromkeys("Dr Prof Professor Doctor".split(), "u"),
}
GIVEN_NAMES = {
    "m": (
        "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Steven Paul Andrew Peter "
        "Hans Karl Heinrich Stefan Jürgen Wolfgang Pierre Jean Jacques François Olivier Juan Carlos José Luis Miguel Pablo "
        "Александр Сергей Дмитрий Андрей Иван Николай"
    ).split(),
    "f": (
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Emily Laura Emma Alice Helen "
        "Anna Greta Ursula Monika Ingrid Petra Marie Camille Sophie Claire Juliette María Carmen Lucía Elena Isabel Teresa "
        "Анна Мария Елена Ольга Наталья Татьяна"
    ).split(),
}
_GENDER = {name: gender for gender, names in GIVEN_NAMES.items() for name in names}
_GENDER_OF = {name.lower(): gender for name, gender in _GENDER.items()}


def script_of(word: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "latin"


def _emails(text: str) -> list[Mention]:
    found, at = [], text.find("@")
    while at >= 0:
        local, domain = _LOCAL.search(text, max(0, at - 64), at), _DOMAIN.match(text, at + 1)
        if local and domain:
            start = local.start() + len(local[0]) - len(local[0].lstrip(".-%+"))
            if start < at:
                found.append(Mention(start, domain.end(), "email", text[start : domain.end()].lower()))
        at = text.find("@", at + 1)
    return found


def _trimmed(word: str) -> str:
    """A word without a possessive ending or trailing hyphens and apostrophes."""
    word = word.rstrip("’'-")
    return word[:-2] if word[-2:] in ("'s", "’s", "'S", "’S") else word


def _names(text: str) -> list[Mention]:
    """Names after a title or a given name, with all capitalised words and initials that follow, and every
    other place where a part of one of them stands alone."""
    found: list[Mention] = []
    words = [(m.start(), _trimmed(m[0])) for m in _CAPITAL.finditer(text)]

    def end(i: int) -> int:
        return words[i][0] + len(words[i][1])

    def follows(i: int, dot: bool) -> bool:
        """Whether the next word is a further part of what word ``i`` belongs to."""
        if i + 1 >= len(words):
            return False
        between = text[end(i) : words[i + 1][0]]
        return between in ((" ", ". ", ".") if dot else (" ",))

    def part(i: int) -> bool:
        word = words[i][1]
        return word not in TITLES and (word != "I" or text[end(i) : end(i) + 1] == ".")

    def add(start: int, word: str, kind: str) -> None:
        found.append(Mention(start, start + len(word), f"{kind}-{script_of(word)}", word.lower()))

    i, alone = 0, []
    while i < len(words):
        first, gender = i, "u"
        while words[first][1] in TITLES and follows(first, True):
            gender = TITLES[words[first][1]] if gender == "u" else gender
            first += 1
        if not part(first) or first == i and not (words[i][1] in _GENDER and follows(i, False) and part(i + 1)):
            alone += words[i : first + 1]
            i = first + 1
            continue
        last = first
        while follows(last, len(words[last][1]) == 1) and part(last + 1):
            last += 1
        full = [k for k in range(first, last + 1) if len(words[k][1]) > 1]
        for k in range(first, last + 1):
            start, word = words[k]
            if k not in full:
                add(start, word, "initial")
            elif word.lower() in _GENDER_OF:
                add(start, word, f"given-{_GENDER_OF[word.lower()]}")
            else:
                add(start, word, f"given-{gender}" if k == full[0] and len(full) > 1 else "surname")
        i = last + 1

    own = {m.norm: m.kind.rsplit("-", 1)[0] for m in reversed(found) if not m.kind.startswith("initial")}
    for start, word in alone if own else ():
        if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
            continue
        pieces = [(start, word)]
        if word.lower() not in own:
            pieces = [(start + m.start(), _trimmed(m[0])) for m in _PIECE.finditer(word)]
        for at, piece in pieces:
            if piece.lower() in own and piece[0].isupper():
                add(at, piece, own[piece.lower()])
    return found


def detect(text: str) -> list[Mention]:
    """All mentions of a text in order, without overlap; of overlapping ones the first and longest stays."""
    found = _emails(text)
    for cluster in _CLUSTER.finditer(text):
        for match in _NUMBER.finditer(text, cluster.start(), min(len(text), cluster.end() + 1)):
            kind, raw = match.lastgroup, match[0]
            norm = raw if kind == "ip" else "".join(c for c in raw if c.isdigit())
            if kind == "phone" and not raw.startswith("+"):
                norm = "1" + norm  # ten digits of North America, which may stand with +1 elsewhere
            found.append(Mention(match.start(), match.end(), kind, norm))
    found += [Mention(m.start(), m.end(), "secret", m[0]) for m in _HEX.finditer(text)]
    lowered = text.lower() if len(text.lower()) == len(text) else text
    if any(w in lowered for w in _SECRET_WORDS):
        found += [Mention(m.start("value"), m.end("value"), "secret", m["value"]) for m in _SECRET.finditer(text)]
    for match in _IBAN.finditer(text):
        if sum(c.isdigit() for c in match[0]) >= 10:
            found.append(Mention(match.start(), match.end(), "iban", match[0].replace(" ", "")))
    found += _names(text)
    found.sort(key=lambda m: (m.start, m.start - m.end, m.kind))
    kept, end = [], 0
    for mention in found:
        if mention.start >= end:
            kept.append(mention)
            end = mention.end
    return kept
