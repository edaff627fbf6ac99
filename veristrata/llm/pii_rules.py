"""Forms of personal information, as patterns.

They have two uses: to label the texts the tagger of :mod:`veristrata.llm.pii` is trained on, and to settle the edges
of the places it finds. They propose and drop nothing themselves.
"""

from __future__ import annotations

import regex

KINDS = ("email", "phone", "id_number", "address", "name")

#: Endings of family names by which training texts are labelled, Latin and Cyrillic.
FAMILY = "mann|dahl|ack|vik|gard|moor|etti|wicz|sen"
FAMILY_CYRILLIC = "манн|даль|дал|ак|вик|гард|мур|етти|этти|вич|сен"
#: Titles before names; a title isn't part of the name.
TITLES = "Dr|Mr|Mrs|Ms|Prof|Frau|Herr|Herrn|Mme|Mlle|Sr|Sra|Srta|Don|Doña|Госпожа|Господин|Проф|डॉ|د|M"

_S = r"\s{1,2}"  # words may be parted by a wrapped line
_UP = r"\p{Lu}[\p{L}’']+"
_CODE = r"(?:[A-Z]{1,2}\d[A-Z\d]?\s\d[A-Z]{2}|\d{5})"
_TOWN = rf"{_UP}(?:\s{_CODE})?"

EMAIL = regex.compile(
    r"[\p{L}\p{N}][\p{L}\p{N}._%+\-]*(?:\s?[@＠]\s?|\s*[\[({]\s?at\s?[\])}]\s*)[\p{L}\p{N}\-]+(?:(?:\.|\s*[\[({]\s?dot\s?[\])}]\s*)[\p{L}\p{N}\-]*[\p{L}\p{N}])+"
    r"|[\p{L}\p{N}][\p{L}\p{N}._%+\-]*\sat\s[\p{L}\p{N}\-]+(?:\sdot\s[\p{L}\p{N}\-]+)+",
    regex.IGNORECASE,
)
_EXT = r"(?:,?\s(?:ext\.?|x|Durchwahl|poste|доб\.)\s?\d{1,5})?"
PHONE = regex.compile(
    r"(?<![\p{L}\p{N}.\-/])(?:"
    r"(?:\+|00)\d{1,3}(?:[\s.\-]?\(0\))?(?:[\s.\-]?\(?\d{1,5}\)?){2,6}"
    r"|\(\d{3,5}\)\s?\d{3}[\s.\-]\d{3,4}|\d{3}\.\d{3}\.\d{4}|0\d{3,4}\s\d{3}\s\d{3,4}|\d{3}-\d{3}-\d{4}|\d{3}-\d{4}(?=\s(?:ext|x))"
    r")" + _EXT + r"(?![\p{L}\p{N}])"
)
ID_NUMBER = regex.compile(
    r"(?<![\p{L}\p{N}.\-/@_])(?:"
    r"[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]|\d{3}([\s\-])\d{2}\1\d{4}|\d{7,8}[A-Z]?-[A-Z]|[A-Z]\d{7,8}(?:-?[A-Z])?|\d{2}-\d{6}-\d{3}/\d"
    r"|[A-Z]{2}\d{2}(?:\s?\d{4}){3,5}|\d{2}/\d{3}/\d{5}|\d{8}[A-Z]"
    r")(?![\p{L}\p{N}])"
)
ADDRESS = regex.compile(
    rf"(?:{_UP}\sHouse,\s|(?:Flat|Unit|Apt)\s\d+,\s)?\d+[a-z]?{_S}(?:St\.{_S})?{_UP}(?:{_S}{_UP})?{_S}(?:Street|Avenue|Lane|Close|Road|Drive|Way|Rd\.|Ave\.|St\.|Ln\.)(?:,{_S}(?:(?:Apt|Flat|Unit)\s\w+|{_UP}\s{_CODE}|{_UP}))?"
    rf"|(?:Calle|Avda\.|Avenida|Plaza|C/){_S}(?:de{_S})?{_UP},?\s\d+(?:,\s\d+\.[º°ª]\s\w)?(?:,{_S}\d{{5}}{_S}{_UP})?"
    rf"|\d+(?:\s(?:bis|ter))?,{_S}(?:rue|avenue|boulevard|place|allée|quai){_S}(?:(?:de|du|des){_S})?{_UP}(?:,{_S}\d{{5}}{_S}{_UP})?"
    rf"|\p{{Lu}}\p{{L}}+(?:straße|strasse|weg|gasse|platz|allee)\s\d+\s?[a-z]?\b(?:,{_S}\d{{5}}{_S}{_UP})?"
)
_GIVEN = r"\p{Lu}[\p{L}]*\p{L}(?:-\p{Lu}\p{L}+)?"
_FAMILY = rf"(?:\p{{Lu}}\p{{Ll}}+(?:{FAMILY})|\p{{Lu}}+(?:{FAMILY.upper()})|\p{{Lu}}\p{{Ll}}+(?:{FAMILY_CYRILLIC}))"
NAME = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}@_\-.+])(?:{_FAMILY},{_S}{_GIVEN}(?:{_S}\p{{Lu}}\.)?|{_GIVEN}{_S}(?:\p{{Lu}}\.{_S})?{_FAMILY}|\p{{Lu}}\.{_S}(?:\p{{Lu}}\.{_S})?{_FAMILY}|(?<=(?:name\sis)\s)\p{{L}}+{_S}(?:\p{{L}}\.{_S})?\p{{L}}+)(?![\p{{L}}\p{{N}}@_])"
)
#: A title and one or two words where no case or ending tells a name (Devanagari, Arabic).
TITLED = regex.compile(r"(?<=डॉ\.\s)[\p{L}\p{M}]+|(?<=(?<![\p{L}\p{M}])د\.\s)[\p{L}\p{M}]+")
_TITLE = regex.compile(rf"(?:{TITLES})\.?\s{{1,2}}(?=\p{{L}})", regex.IGNORECASE)

FORMS = {"email": (EMAIL,), "phone": (PHONE,), "id_number": (ID_NUMBER,), "address": (ADDRESS,), "name": (NAME, TITLED)}


def forms(text: str) -> list[tuple[int, int, str]]:
    """All places in text that have the form of a kind, in order; an earlier kind wins where two overlap."""
    taken: list[tuple[int, int, str]] = []
    for kind in ("email", "id_number", "phone", "address", "name"):
        for pattern in FORMS[kind]:
            for m in pattern.finditer(text):
                a, b = m.span()
                if kind == "name":
                    a = trim_title(text, a, b)
                if a < b and not any(a < y and x < b for x, y, _ in taken):
                    taken.append((a, b, kind))
    return sorted(taken)


def trim_title(text: str, a: int, b: int) -> int:
    """Start of the name without its title. "M." before given and family name is a title, before a family name an initial."""
    m = _TITLE.match(text, a, b)
    while m:
        if m.group()[0] in "Mm" and m.group()[1] in ". " and not regex.search(r"[\s,]\p{L}", text[m.end() : b]):
            break
        a = m.end()
        m = _TITLE.match(text, a, b)
    return a


#: How far beyond a proposed span its form may reach.
MARGIN = 72
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]")
_INITIAL = regex.compile(r"(?:^|[\s.])\p{L}\.$")


def _at_words(text: str, a: int, b: int, kind: str) -> tuple[int, int]:
    """[a, b) to whole words, without a name's titles and without white space and punctuation at its ends."""
    for _ in range(24):  # a proposal is off by a few characters at most
        if not (0 < a < b and _WORD.match(text[a]) and _WORD.match(text[a - 1])):
            break
        a -= 1
    for _ in range(24):
        if not (a < b < len(text) and _WORD.match(text[b]) and _WORD.match(text[b - 1])):
            break
        b += 1
    if kind == "name":
        a = trim_title(text, a, b)
    while a < b and not (_WORD.match(text[a]) or text[a] in "+("):
        a += 1
    while a < b and not _WORD.match(text[b - 1]) and not (text[b - 1] == ")" and "(" in text[a:b]) and not (kind == "name" and _INITIAL.search(text[a:b])):
        b -= 1
    return a, b


def edges(text: str, a: int, b: int, kind: str) -> tuple[int, int]:
    """The edges of the place proposed at [a, b): those of a form of its kind that shares more than half of both, else whole words.

    Forms are exact about where a number or an address ends; a name's form knows few endings, so it only counts there too.
    """
    at, to = max(0, a - MARGIN), min(len(text), b + MARGIN)
    # forms start at words, so a margin that begins within one doesn't hide them
    while at > 0 and not text[at - 1].isspace() and a - at < 2 * MARGIN:
        at -= 1
    best = (0.5, a, b)
    for pattern in FORMS[kind]:
        for m in pattern.finditer(text, at, to):
            x, y = m.span()
            if kind == "name":
                x = trim_title(text, x, y)
            common = min(b, y) - max(a, x)
            if common > 0:
                best = max(best, (min(common / (b - a), common / max(y - x, 1)), x, y))
    return best[1:] if best[0] > 0.5 else _at_words(text, a, b, kind)
