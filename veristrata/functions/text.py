"""Text functions as Spark expressions: tokens, stems, normal forms, shapes and the proposition test. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.strip() of Python trims it, as a regular-expression class body.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: Function words that are no search or normal-form terms.
FUNCTION_WORDS = (
    "a an the and or but if then than as of at by for with about into from to in on is are was were be been being am do "
    "does did done have has had having it its this that these those there here which who whom whose what how when where "
    "why so such very too also s t re ve ll d m just"
).split()

#: Negating words; they decide polarity and are no terms.
NEGATORS = "not no never none neither nor without cannot cant wont doesnt didnt isnt arent wasnt werent hasnt havent hadnt nobody nothing".split()

#: Fixed value: control characters other than tab, line feed and carriage return.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{85}\x{9F}]"

#: Fixed value: punctuation that a sentence shape disregards.
SHAPE_PUNCTUATION = "[-.,;:!?\"'`()\\[\\]{}—–*…]"

MIN_PROPOSITION = 25


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def tokens(text: Column) -> Column:
    """Search terms: lower-case ASCII words and numbers without function words."""
    return F.filter(raw_tokens(text), lambda w: ~w.isin(FUNCTION_WORDS))


def _restored(base: Column) -> Column:
    """A base after its ending: one of a doubled last letter, or a silent e after some pairs, or as it is."""
    doubled = (F.length(base) >= 2) & base.rlike("([^aeiousl])\\1$")
    silent = (F.length(base) >= 4) & base.rlike("(nc|rc|ng|mg)$")
    return F.when(doubled, base.substr(F.lit(1), F.length(base) - 1)).when(silent, F.concat(base, F.lit("e"))).otherwise(base)


def stem(word: Column) -> Column:
    """Rule stemmer; the first rule that applies decides."""
    n = F.length(word)
    cut = lambda k: word.substr(F.lit(1), n - k)
    ed = cut(2)
    doubled = (F.length(ed) >= 2) & ed.rlike("([^aeiousl])\\1$")
    ed_base = (
        F.when(doubled, ed.substr(F.lit(1), F.length(ed) - 1))
        .when((F.length(ed) >= 3) & ed.endswith("i"), F.concat(ed.substr(F.lit(1), F.length(ed) - 1), F.lit("y")))
        .otherwise(_restored(ed))
    )
    return (
        F.when(n <= 3, word)
        .when((n > 4) & word.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(word.rlike("(ches|shes|sses|xes|zes)$"), cut(2))
        .when(word.endswith("ss"), word)
        .when(word.endswith("s"), cut(1))
        .when((n >= 6) & word.endswith("ly"), cut(2))
        .when((n > 5) & word.endswith("ing"), _restored(cut(3)))
        .when((n > 4) & word.endswith("ed"), ed_base)
        .otherwise(word)
    )


def sequence(text: Column) -> Column:
    """Stems in order, without negators and function words."""
    kept = F.filter(raw_tokens(text), lambda w: ~w.isin(NEGATORS + FUNCTION_WORDS))
    return F.transform(kept, stem)


def terms(seq: Column) -> Column:
    return F.array_sort(F.array_distinct(seq))


def polarity(text: Column) -> Column:
    """false without a negator, true with one (however often), null with several different ones."""
    n = F.size(F.array_distinct(F.filter(raw_tokens(text), lambda w: w.isin(NEGATORS))))
    return F.when(n == 0, F.lit(False)).when(n == 1, F.lit(True))


def shape(text: Column) -> Column:
    """Lower case, punctuation as spaces, white space collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(text), SHAPE_PUNCTUATION, " "), f"[{SPACE}]+", " "))


def contains_control(text: Column) -> Column:
    return text.rlike(CONTROL)


def is_proposition(text: Column) -> Column:
    body = strip(text)
    return (F.length(body) >= MIN_PROPOSITION) & ~contains_control(text) & body.rlike(r"\p{L}")


def contains_run(inner: Column, outer: Column) -> Column:
    """Whether one token array is a contiguous run of another; tokens hold no spaces, so padded strings decide."""
    pad = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return F.contains(pad(outer), pad(inner))


def json_string(text: Column) -> Column:
    """A JSON string literal: non-ASCII raw, short escapes where there are any, lower-case hex for other controls."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    controls = {chr(i): short.get(chr(i), f"\\u{i:04x}") for i in range(32)}
    full = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), controls.items(), plain)
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1F]"), full).otherwise(plain), F.lit('"'))


def json_array(strings: Column) -> Column:
    """A JSON array of an array of plain ids (no escapes needed beyond the string rule)."""
    return F.concat(F.lit("["), F.array_join(F.transform(strings, json_string), ","), F.lit("]"))


DOMAIN = "veristrata/v1"


def content_id(prefix: str, json: Column, domain: str = DOMAIN) -> Column:
    """prefix + SHA-256 of domain, NUL and canonical JSON. The prefix is not hashed. Another deployment's ids need its domain."""
    return F.concat(F.lit(prefix), F.sha2(F.concat(F.lit(domain), F.lit("\0"), json).cast("binary"), 256))


def canonical_path(path: Column) -> Column:
    """A path without empty and "." parts, each ".." taking the part before it.

    A ".." at the root stays there; one that leads out of a relative path is kept, so that it never falls inside a grant.
    """
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    rooted = path.startswith("/")

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        held = (F.size(acc) > 0) & (F.when(F.size(acc) > 0, last) != "..")
        up = F.when(held, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(rooted, acc).otherwise(F.concat(acc, F.array(p)))
        return F.when(p == "..", up).otherwise(F.concat(acc, F.array(p)))

    walked = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(walked, "/"))


def path_within(path: Column, prefix: Column) -> Column:
    """Whether a canonical path is the prefix or lies below it; /ab isn't below /a."""
    return (path == prefix) | path.startswith(F.concat(F.regexp_replace(prefix, "/+$", ""), F.lit("/")))
