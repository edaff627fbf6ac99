"""P4: sentence units across languages and scripts.

Method: the Unicode sentence-break properties (STerm, ATerm, Close, SContinue, Lower, Upper, Numeric) decide where a
terminator of any script ends a sentence, with suppression of abbreviations and initials, German ordinals, quotations
and brackets as wholes, and Thai's rule of spaces. Lines come first: headings and list items are units of their own,
blank lines part paragraphs, single line breaks are white space.

Abbreviations go by the language around them, told by script and function words near the dot, as texts change language
from sentence to sentence; where these don't tell, all lists hold. One that is also an ordinary word only holds before
a token with a digit, and a street's or a single letter not before a word that begins sentences and no names (The, She, In).

Defined cases. Null and empty texts and texts of white space have no units. Offsets count code points; units have no
white space at their ends. Rows with one id are one record (the smallest text counts if its deliveries differ); a null
id is no record. A bracket or quote without its other half protects nothing, except in a fragment, where a half that
closes first protects from the start, and one left open protects to the end. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations that never end a sentence, by language (single letters don't either).
NEVER = {
    "en": "mr mrs ms dr prof st rev capt sgt fig figs vol vols pp sec secs no nos approx dept ext tel vs viz cf i.e e.g rd apt mt messrs",
    "de": "nr ca bzw hr tel vgl evtl ggf inkl bd hrsg abb d.h z.b u.a geb dipl ing str dr prof st",
    "fr": "mme mlle mm cf p.ex env boul chap fig tél c.-à-d dr st no",
    "es": "sr sra srta dra ud uds núm pág págs avda tfno aprox ej p.ej dr fig cf vol",
    "ru": "рис табл стр гл им ул просп проф акад доц тыс руб коп напр т.е тел кв корп см ср",
    "hi": "डॉ श्री प्रो",
}
#: Abbreviations that end a sentence where the next one may begin.
AT_END = "etc usw inc ltd co corp jr a.m p.m u.s u.k u.n др г гг al bros"
#: Abbreviations that are ordinary words too and only hold before a number.
BEFORE_NUMBER = {"en": "no nos sec secs fig figs", "de": "ca str", "fr": "mm no env", "es": "ej", "ru": "см", "hi": ""}
#: Words that begin sentences and no names, after a title or a single letter.
BEGIN = "the he she it we they this that these those a an in on at but and so then there if when what who your his her its our"
#: Frequent words that tell the language of a text.
TELLING = {
    "en": "the of and was is were that with for by it had this",
    "de": "der die das und ist nicht von mit den ein eine wurde im auf",
    "fr": "le la les des est une du dans et pas pour que un",
    "es": "el la los las del que una por con para se y es",
}

#: German words before or after an ordinal number.
BEFORE_ORDINAL = "am im der die das den dem des vom zum zur bis ab seit beim"
AFTER_ORDINAL = "januar februar märz april mai juni juli august september oktober november dezember fassung"

_BY_LANGUAGE = {k: frozenset(words.split()) for k, words in NEVER.items()}
_BY_LANGUAGE[""] = frozenset().union(*_BY_LANGUAGE.values())
_NUMBERED = {k: frozenset(words.split()) for k, words in BEFORE_NUMBER.items()}
_NUMBERED[""] = frozenset().union(*_NUMBERED.values())
_NEVER = _BY_LANGUAGE[""]
_BEGIN = frozenset(BEGIN.split())
#: Characters before and after a dot that tell the language.
BACK, AHEAD = 24, 48
_TELLING = {k: frozenset(words.split()) for k, words in TELLING.items()}
_LATIN_WORD = regex.compile(r"\p{Latin}+")
_SCRIPTS = [(regex.compile(r"\p{Cyrillic}{2}"), "ru"), (regex.compile(r"\p{Devanagari}{2}"), "hi")]
_AT_END = frozenset(AT_END.split())
_BEFORE = frozenset(BEFORE_ORDINAL.split())
_AFTER = frozenset(AFTER_ORDINAL.split())

_LINE = regex.compile(r"[^\n]*\n?")
_HEADING = regex.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]+|$)")
_ITEM = regex.compile(r"\s*(?:[-*+•]|(\d{1,3})[.)])(?:[ \t]+|\s*$)")
_END = regex.compile(r"[\p{SB=STerm}\p{SB=ATerm}…]+[\p{Pe}\p{Pf}\"'“]*|[\u0085\u2028\u2029]")
_STERM = regex.compile(r"\p{SB=STerm}")
_CONTINUE = regex.compile(r"[\p{SB=SContinue}\p{SB=STerm}\p{SB=ATerm}]")
_TOKEN = regex.compile(r"(?r)[\p{L}\p{M}\p{N}.\-’']+$")
_WORD_BEFORE = regex.compile(r"(?r)(\p{L}+)\s+\S*$")
_NEXT_WORD = regex.compile(r"\p{L}+")
_INITIALS = regex.compile(r"(?:\p{L}\.)+\p{L}")
_CASELESS = regex.compile(r"[\p{Lo}]")
_THAI_GAP = regex.compile(r"(?<=[฀-๿])(?<!\p{Nd})\s+(?=\S)(?!\p{Nd})")
_GLUED = regex.compile(r"\p{Ll}{2}$")
_MARKS = regex.compile(r"[\p{Ps}\p{Pe}\p{Pi}\p{Pf}\"„]")
_CLOSES = {")": "(", "]": "[", "}": "{", "）": "（", "」": "「", "』": "『", "】": "【", "》": "《", "〉": "〈", "»": "«", "›": "‹", "”": "“„", "“": "„"}
_OPENS = set("([{（「『【《〈«‹“„")


def language(around: str) -> str:
    """Language of a stretch of text; empty where neither its script nor its function words tell it from all others."""
    words = [w.lower() for w in _LATIN_WORD.findall(around)]
    scripts = [name for script, name in _SCRIPTS if script.search(around)]
    if scripts:
        return scripts[0] if len(scripts) == 1 and not words else ""
    told = [k for k, own in _TELLING.items() if any(w in own for w in words)]
    return told[0] if len(told) == 1 else ""


def _protected(text: str, fragment: bool) -> list[tuple[int, int]]:
    """Spans of outermost quotations and brackets of a paragraph; their ends are after the closing mark."""
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    for m in _MARKS.finditer(text):
        c, i = m.group(), m.start()
        if c == '"':
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
            before = text[i - 1] if i else " "
            if at is not None:
                spans.append((stack[at][1], i + 1))
                del stack[at:]
            elif fragment and not spans and not stack and not before.isspace() and before not in _OPENS and i:
                spans.append((0, i + 1))
            else:
                stack.append((c, i))
            continue
        if c in _CLOSES:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in _CLOSES[c]), None)
            if at is not None:
                spans.append((stack[at][1], i + 1))
                del stack[at:]
                continue
            if c != "“" or text[i + 1 : i + 2] in (",", " ", "."):
                if fragment and not spans and not stack and i:
                    spans.append((0, i + 1))
                continue
        if c in _OPENS:
            stack.append((c, i))
    if fragment and stack:
        spans.append((stack[0][1], len(text) + 1))
    spans.sort()
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _ends(text: str, m: regex.Match, stop: int) -> bool:
    """Whether the terminators of m (up to stop with closing marks) end a sentence inside a paragraph."""
    marks = m.group()
    if marks[0] in "\u0085\u2028\u2029":
        return True
    i = stop
    while i < len(text) and text[i].isspace():
        i += 1
    if i == len(text):
        return True
    gap, after = i > stop, text[i]
    closed = stop > m.start() and text[stop - 1] not in ".…" and not _STERM.match(text[stop - 1])
    if _CONTINUE.match(after) and not (after == "…" and gap):
        return False
    lower = after.islower() and not text[i + 1 : i + 2].isupper()
    if closed and (lower or _CASELESS.match(after)):
        return False
    if _STERM.search(marks):
        if not gap and all(c < "Ā" for c in marks):
            return after.isupper() or closed
        return True
    if "…" in marks or ".." in marks:
        return gap and not lower
    if not gap:
        if closed:
            return after.isupper()
        tail = text[max(0, m.start() - 40) : m.start()].rsplit(None, 1)[-1:] or [""]
        return after.isupper() and text[i + 1 : i + 2].islower() and bool(_GLUED.search(text[: m.start()][-2:])) and not any(c in "@/\\_." for c in tail[0])
    if closed:
        return True
    found = _TOKEN.search(text[max(0, m.start() - 24) : m.start()])
    token = found.group().lower().lstrip(".-'’") if found else ""
    if "." in token and token not in _NEVER and token not in _AT_END and not _INITIALS.fullmatch(token):
        token = token.rsplit(".", 1)[1]  # a sentence that began without a space
    letter = len(token) == 1 and token.isalpha()
    if letter or token in _NEVER:
        lang = language(text[max(0, m.start() - BACK) : m.start()] + " " + text[i : i + AHEAD])
        following = _NEXT_WORD.match(text, i)
        begins = bool(following) and gap and lang in ("en", "") and following.group().lower() in _BEGIN and following.group()[0].isupper() and len(following.group()) > 1
        if not letter and token not in _BY_LANGUAGE[lang]:
            return begins  # an abbreviation of other languages only
        if token in _NUMBERED[lang]:
            code = text[i : i + AHEAD].split(None, 1)[0]
            return not lower and not (any(c.isdigit() for c in code) or (len(code) > 1 and code.isupper()))
        return begins and (letter or token in ("st", "rd", "mt")) and "." not in text[max(0, m.start() - 3) : m.start()]
    if token in _AT_END or _INITIALS.fullmatch(token):
        return not lower
    if token.isdigit() and len(token) <= 3:
        before = _WORD_BEFORE.search(text[max(0, m.start() - 40) : m.start()])
        following = _NEXT_WORD.match(text, i)
        if lower or (before and before.group(1).lower() in _BEFORE) or (following and following.group().lower() in _AFTER):
            return False
    return True


def _sentences(text: str, a: int, b: int, fragment: bool) -> Iterator[tuple[int, int]]:
    part = text[a:b]
    guarded = _protected(part, fragment) if _MARKS.search(part) else []

    starts = [x for x, _ in guarded]  # sorted, without overlap

    def inside(i: int) -> bool:
        k = bisect.bisect_left(starts, i) - 1
        return k >= 0 and guarded[k][0] < i < guarded[k][1]

    opening = set(starts)
    cuts = set()
    for m in _END.finditer(part):
        stop = m.end()
        for k in range(m.start() + 1, m.end()):
            if k in opening:
                stop = k
                break
        if not inside(stop) and _ends(part, m, stop):
            cuts.add(stop)
    if regex.search(r"[฀-๿]", part):
        cuts.update(m.end() for m in _THAI_GAP.finditer(part) if not inside(m.start() + 1))
    start = 0
    for stop in [*sorted(cuts), len(part)]:
        piece = part[start:stop]
        body = piece.strip()
        if body:
            at = a + start + len(piece) - len(piece.lstrip())
            yield at, at + len(body)
        start = stop


def units(text: str | None, fragment: bool = False) -> list[tuple[int, int]]:
    """Start and end of each unit; fragment: the text may begin or end within a sentence."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    paragraph: list[int] = []

    def close() -> None:
        if paragraph:
            out.extend(_sentences(text, paragraph[0], paragraph[1], fragment))
            paragraph.clear()

    def alone(a: int, b: int) -> None:
        body = text[a:b].strip()
        if body:
            at = a + len(text[a:b]) - len(text[a:b].lstrip())
            out.append((at, at + len(body)))

    for m in _LINE.finditer(text):
        line, a, b = m.group(), m.start(), m.end()
        if not line.strip():
            close()
            continue
        if head := _HEADING.match(line):
            close()
            alone(a + head.end(), b)
            continue
        if (item := _ITEM.match(line)) and not (item.group(1) and _is_ordinal(text, line, item, paragraph)):
            close()
            alone(a + item.end(), b)
            continue
        if paragraph:
            paragraph[1] = b
        else:
            paragraph[:] = [a, b]
    close()
    return out


def _is_ordinal(text: str, line: str, item: regex.Match, paragraph: list[int]) -> bool:
    """A wrapped line that begins with an ordinal number and not with a list's marker."""
    following = _NEXT_WORD.match(line, item.end())
    if following and following.group().lower() in _AFTER:
        return True
    return bool(paragraph) and (text[paragraph[0] : paragraph[1]].rsplit(None, 1)[-1:] or [""])[-1].lower() in _BEFORE


def _split(fragment: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for record, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for s, e in units(text, fragment):
                    ids.append(record)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["record_id", "start_offset", "end_offset"])

    return run


def sentence_units(table: DataFrame, tab: str, text_col: str, fragment: bool = False) -> DataFrame:
    """tab, record_id, start_offset, end_offset of all units of every record."""
    one = table.where(F.col("id").isNotNull() & F.col(text_col).isNotNull()).groupBy("id").agg(F.min(text_col).alias("text"))
    schema = "record_id string, start_offset int, end_offset int"
    return one.select(F.col("id").cast("string"), "text").mapInArrow(_split(fragment), schema).select(F.lit(tab).alias("tab"), "record_id", "start_offset", "end_offset")
