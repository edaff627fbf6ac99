"""python -m veristrata.llm.pii_train DATA_DIR [OUT.npz]: trains the tagger of :mod:`veristrata.llm.pii`.

Labelled rows, a bounded sample (STAGES) of two kinds, seeded; later stages have more texts without any place and more made ones:

- windows of the texts of DATA_DIR, labelled by the forms of :mod:`veristrata.llm.pii_rules`. Most names in them are
  replaced by names of name_list, of the lists below and by invented ones with any ending, so that the tagger has to go
  by where a name stands and not by the endings that the forms know;
- sentences of the templates below, and frames of random common words, with slots filled by generators for each kind
  and with places, organisations, handles, versions, tickets, dates and record ids that are none.

Some windows change case.
"""

from __future__ import annotations

import random
import sys

import numpy as np
import pyarrow.parquet as pq
import regex

from veristrata.llm import pii_rules
from veristrata.llm.tagger import Tagger, classes_of, tags_of

WINDOW = 200
#: Stages: labelled rows, share of them made from templates and frames, share of texts without a place that are taken, epochs, rate.
STAGES = [(14000, 0.3, 0.3, 12, 0.012), (22000, 0.2, 0.8, 9, 0.008), (26000, 0.4, 0.6, 7, 0.008), (24000, 0.32, 0.9, 5, 0.006)]
_VOWELS = "aeiouy"
_ONSETS = "b br c ch cz d dr f fl g gh gl h j k kl kv kw l ll m mb n nd ng p pl r rr s sch sh sk st str sz t th tr ts v w y z".split()
_GIVEN_ENDINGS = "a ia ie ine ina etta elle ette ira isa ika as is us os an en in on ael iel ard rik do to ro vi ti li la na ne ra".split()
_ENDINGS = "a e i o s l r n th x ez ez ov ova ski ska son berg feld stein ini elli eau ier ard ton ley man ng ang wong ura moto ko ullah zadeh ian yan".split()

#: Given and family names in wide use, for training only.
GIVEN = (
    "Mary John Anna Peter Linda James Laura Robert Sofia David Olga Michael Elena Thomas Julia Daniel Ingrid Martin Claire Paul Amelie "
    "Pierre Lucia Carlos Rosa Miguel Ana Jorge Carmen Pablo Hans Greta Karl Heidi Lena Otto Yuki Hiroshi Mei Jun Priya Arjun Fatima Omar "
    "Layla Yusuf Aisha Ivan Dmitri Natalia Sergei Chidi Amara Kwame Zanele Noah Oliver Emma Grace Henry Alice Samuel Ruth Victor Nina"
).split()
FAMILY = (
    "Smith Jones Taylor Brown Williams Evans Walker Wright Green Baker Clark Hughes Turner Parker Cooper Morgan Bailey Reed Foster Bryant "
    "Müller Schmidt Schneider Fischer Weber Becker Hoffmann Koch Richter Wolf Dubois Moreau Laurent Lefebvre Roux Fournier Girard Bonnet "
    "Lopez Martinez Gonzalez Perez Sanchez Ramirez Torres Flores Rivera Gomez Diaz Morales Rossi Russo Ferrari Bianchi Romano Costa Silva "
    "Santos Oliveira Pereira Novak Kowalski Horvath Ivanov Petrov Sokolov Tanaka Suzuki Sato Watanabe Kim Park Lee Chen Wang Li Liu Zhao "
    "Khan Ahmed Ali Hussein Mehta Sharma Gupta Singh Patel Okafor Mensah Dlamini Nkosi Abara Lindqvist Nilsson Virtanen Korhonen Berg"
).split()
#: Sentences with slots. A slot in capitals is a place to find, one in small letters is none.
TEMPLATES = [
    "Please contact {NAME} about the {thing}.", "The {thing} was signed by {NAME} on {day}.", "{title} {NAME} called about the {thing}.",
    "{NAME} and {NAME} met in {town} to discuss the {thing}.", "Only {NAME} had seen the {thing} before {date}.", "I spoke with {NAME} yesterday, and {org} replied.",
    "According to {NAME}, the {thing} is closed.", "my name is {NAME} and i live in {town}", "The author, {NAME}, works for {org}.", "Interview with {NAME} ({date}).",
    "{NAME} <{EMAIL}> wrote:", "From: {NAME}", "Signed, {NAME}", "Thanks to {NAME} for the {thing}.", "Witness: {NAME}, {ADDRESS}.",
    "Write to {EMAIL} or call {PHONE}.", "E-mail: {EMAIL}", "mail me at {EMAIL} about version {version}", "Her address is {EMAIL}; the ticket is {ticket}.",
    "Call {PHONE} before {day}.", "Tel. {PHONE}", "Phone: {PHONE}, order {record}.", "Ring {NAME} on {PHONE}.", "fax {PHONE} or visit {org}",
    "Her passport {ID_NUMBER} expired on {date}.", "passport no. {ID_NUMBER}", "Tax number: {ID_NUMBER}", "National ID {ID_NUMBER}, case {ticket}.", "The identity card {ID_NUMBER} belongs to {NAME}.", "SSN {ID_NUMBER}",
    "She lives at {ADDRESS} with {NAME}.", "Deliver to {ADDRESS}.", "The office moved from {ADDRESS} to {town} in {year}.", "Address: {ADDRESS}",
    "Bitte wenden Sie sich an {NAME}.", "Herr {NAME} wohnt in der {ADDRESS}.", "Frau {NAME} aus {town} hat {date} angerufen.", "Mme {NAME} habite {ADDRESS}.", "Appelez {NAME} au {PHONE}.",
    "La señora {NAME} vive en {ADDRESS}.", "Escriba a {EMAIL} antes del {date}.", "El pasaporte {ID_NUMBER} es de {NAME}.",
    "The {place} lies near {town}.", "{org} opened the {place} in {year}.", "See {org}, version {version}, ticket {ticket}.", "Follow {handle} for news from {town}.", "Record {record} was changed on {date} by {handle}.",
    "{month} {year}: {org} moved to {town}.", "The {thing} of {town} names the {place}.", "On {day}, {town} and {town} closed the {place}.", "Release {version} fixes {ticket}, {ticket} and {ticket}.", "{org} v. {org}, {date}",
]


#: Common words that frames are made of, and words before a place or an organisation.
COMMON = (
    "the a and of to in that it was for on with as at by from this which had has not but they we she he you all can there been one more when who will would time "
    "about out up them then some into could other very first any new only over after now because work even most us through day before must through where much your "
    "way well down should people own just those how too little state good make world still see men work long here get both between life being under never day same "
    "another know while last might great old year off come since go against came right used take three report paper table water letter office house file line page "
    "asked told gave sent read wrote signed called met saw heard found kept left moved reached renewed checked agreed joined thanked today tomorrow yesterday soon again"
).split()
BEFORE_PLACE = "in at near from to across of through".split()
LABELS = {"PHONE": ["call", "phone", "ring", "tel.", "number is", "mobile:", "fax", "dial"], "ID_NUMBER": ["passport", "passport no.", "tax number", "SSN", "SSN is", "identity card", "id number", "insurance number:", "national id"], "EMAIL": ["mail", "e-mail:", "write to", "under", "contact", "send it to"], "ADDRESS": ["at", "lives at", "moved to", "address:", "deliver to", "from", "to"]}


def _stem(r: random.Random) -> str:
    return "".join(r.choice(_ONSETS) + r.choice(_VOWELS) for _ in range(r.choice((1, 2, 2, 3))))


def _word(r: random.Random) -> str:
    return (_stem(r) + r.choice(("", "n", "s", "l", "x", "m", "d"))).capitalize()


def _other_name(word: str, r: random.Random, given: list[str], family: list[str]) -> str:
    """Another name in the word's letter case."""
    draw = r.random()
    if draw < 0.35:
        ending = next((s for s in pii_rules.FAMILY.split("|") if word.lower().endswith(s)), r.choice(_ENDINGS))
        new = (_stem(r) + ending).capitalize()
    elif draw < 0.6:
        new = (_stem(r) + r.choice(_ENDINGS)).capitalize()
    else:
        new = r.choice(given if r.random() < 0.4 else family)
    return new.upper() if word.isupper() else new if word[0].isupper() else new.lower()


def _renamed(text: str, spans: list[tuple[int, int, str]], r: random.Random, given: list[str], family: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
    """Latin names replaced; all else stays."""
    out, kept, at, length = [], [], 0, 0
    for a, b, kind in spans:
        piece, head = text[a:b], text[at:a]
        if kind == "name" and r.random() < 0.7:
            piece = regex.sub(r"[A-Za-z]{3,}", lambda m: _other_name(m.group(), r, given, family), piece)
        out += [head, piece]
        length += len(head)
        kept.append((length, length + len(piece), kind))
        length += len(piece)
        at = b
    out.append(text[at:])
    return "".join(out), kept


def _digits(r: random.Random, form: str) -> str:
    """# as a digit, A as a capital."""
    return "".join(r.choice("0123456789") if c == "#" else r.choice("ABCDEFGHJKLMNPRSTVWXYZ") if c == "A" else c for c in form)


def _filled(slot: str, r: random.Random, given: list[str], family: list[str]) -> str:
    first = lambda: r.choice(given) if r.random() < 0.3 else (_word(r) if r.random() < 0.5 else (_stem(r) + r.choice(_GIVEN_ENDINGS)).capitalize())
    last = lambda: r.choice(family) if r.random() < 0.3 else (_stem(r) + r.choice(_ENDINGS)).capitalize()
    town = lambda: r.choice(("Springfield", "Lyon", "Kraków", "Sevilla", "Osaka", "Leeds")) if r.random() < 0.2 else _word(r)
    if slot == "NAME":
        a, b, c = first(), last(), r.choice("ABCDEFGHJKLMNPRSTW")
        return r.choice([f"{a} {b}"] * 6 + [f"{a} {c}. {b}", f"{c}. {b}", f"{b}, {a}", f"{b}, {a} {c}.", f"{a}-{first()} {b}", f"{a} {b}-{last()}"])
    if slot == "EMAIL":
        local = r.choice([f"{_stem(r)}.{_stem(r)}", f"{first().lower()}.{last().lower()}", _stem(r), f"{r.choice(given).lower()}.{r.choice('abcdkmst')}", f"{_stem(r)}_{r.randrange(99)}", f"{_stem(r)}+{_stem(r)}", f"{r.choice(given).lower()}{r.randrange(2000)}"])
        domain = r.choice((f"{_stem(r)}.com", "example.org", f"{_stem(r)}.co.uk", f"mail.{_stem(r)}.net", f"{_stem(r)}-{_stem(r)}.de", f"{_stem(r)}-mail.org", f"{_stem(r)[:3]}.no", f"{_stem(r)}.example.com", f"{_stem(r)}.fr"))
        return r.choice([f"{local}@{domain}"] * 5 + [f"{local} at {domain.replace('.', ' dot ')}", f"{local} [at] {domain.replace('.', ' [dot] ')}", f"{local}(at){domain}"])
    if slot == "PHONE":
        return _digits(r, r.choice(("+## ### ### ###", "+1 ###-###-####", "(###) ###-####", "0## #### ####", "###-###-####", "+##-##-###-####", "00## ## ### ## ##", "###.###.####", "0### ### ###", "+## (0)## #### ####", "+## ## ## ## ##", "(0##) ######## ext. ##"))).replace("+0", "+4")
    if slot == "ID_NUMBER":
        return _digits(r, r.choice(("#########", "A########", "AA#######", "###-##-####", "AA ## ## ## A", "########A", "## ### ### ###", "AA######A", "###########", "#######-A", "##-######-###/#", "## ######### #")))
    if slot == "ADDRESS":
        n, s, t, z = r.randrange(1, 400), _word(r), town(), _digits(r, "#####")
        return r.choice((f"{n} {s} {r.choice(('Street', 'Road', 'Avenue', 'Lane', 'Drive', 'St.', 'Way', 'Close'))}", f"{n} {s} {r.choice(('Street', 'Road', 'Avenue', 'Lane'))}, {t}", f"{n} {s} {s} Road, {t} {_digits(r, 'AA# #AA')}", f"Flat {r.randrange(40)}, {n} {s} Street, {t}", f"{s}straße {n}, {z} {t}", f"{s}weg {n}", f"{n} rue de {s}, {z} {t}", f"Calle {s} {n}, {z} {t}", f"Avenida de {s}, {n}", f"{n} Old {s} Lane, Apt {r.randrange(30)}"))
    small = {
        "thing": lambda: r.choice("audit report claim evidence transcript register letter meeting proposal archive".split()),
        "title": lambda: r.choice("Dr. Mr. Mrs. Ms. Prof. Dr Mr Ms".split()),
        "day": lambda: r.choice("Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()),
        "month": lambda: r.choice("January March April June July August October December".split()),
        "date": lambda: _digits(r, r.choice(("20##-0#-1#", "1#/0#/20##", "1# May 20##", "March 1#, 20##", "1#.0#.20##"))),
        "year": lambda: _digits(r, "20##"),
        "town": town,
        "place": lambda: r.choice((f"{_word(r)} Bridge", f"{_word(r)} {_word(r)} Park", f"Mount {_word(r)}", f"Lake {_word(r)}", f"{_word(r)} Hall", f"{_word(r)} Station", f"{_word(r)} Old Town")),
        "org": lambda: r.choice((f"{_word(r)} Inc.", f"{_word(r)} {_word(r)} Ltd", f"University of {_word(r)}", f"{_word(r)} Institute", f"the {_word(r)} Council", f"{_word(r)} GmbH", f"{_word(r)} & Sons", f"Bank of {_word(r)}", f"{_word(r)} Research Group")),
        "handle": lambda: f"@{_stem(r)}{r.choice(('', '_' + _stem(r), str(r.randrange(99))))}",
        "version": lambda: _digits(r, r.choice(("#.#.#", "v#.##", "#.#.#-rc#", "20##.#"))),
        "ticket": lambda: _digits(r, r.choice(("AAA-####", "#####", "AA-###", "AAAA-##"))),
        "record": lambda: r.choice(("clm-", "src-", "ev-", "#")) + "".join(r.choice("0123456789abcdef") for _ in range(r.choice((8, 12, 24)))),
    }
    return small[slot]()


def _frame(r: random.Random, given: list[str], family: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
    """Random common words with some places and some that are none between them."""
    out, spans, n = [], [], 0

    def put(piece: str, kind: str = "") -> None:
        nonlocal n
        if kind:
            spans.append((n, n + len(piece), kind))
        out.append(piece)
        n += len(piece)

    for _ in range(r.choice((1, 2, 2, 3))):
        start = len(out)
        for _ in range(r.randrange(0, 7)):
            put(r.choice(COMMON) + " ")
        slot = r.choice(("NAME",) * 5 + ("EMAIL", "EMAIL", "PHONE", "PHONE", "ID_NUMBER", "ID_NUMBER", "ADDRESS", "ADDRESS", "town", "town", "org", "place", "day", "date", "version", "ticket", "handle", "record", "month"))
        if slot in LABELS and (slot == "ID_NUMBER" or r.random() < 0.6):
            put(r.choice(LABELS[slot]) + " ")
        elif slot in ("town", "org", "place"):
            put(r.choice(BEFORE_PLACE) + " ")
        elif slot == "NAME" and r.random() < 0.15:
            put(r.choice(("Dr. ", "Mr. ", "Mrs ", "Prof. ", "Ms. ")))
        put(_filled(slot, r, given, family), slot.lower() if slot.isupper() else "")
        if slot == "NAME" and r.random() < 0.2:
            put(" and ")
            put(_filled(slot, r, given, family), "name")
        put(r.choice((" ", " ", " ", ", ", ". ")))
        for _ in range(r.randrange(0, 7)):
            put(r.choice(COMMON) + r.choice((" ", " ", " ", " ", ", ")))
        if out[-1][-1:] == " ":
            out[-1] = out[-1].rstrip(" ,")
            n = sum(map(len, out))
        put(r.choice((". ", ".\n", "; ", "! ")))
        first = out[start]
        if first[0].islower() and r.random() < 0.8:
            out[start] = first[0].upper() + first[1:]
    return "".join(out).rstrip(), spans


def _made(r: random.Random, given: list[str], family: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
    out, spans, n = [], [], 0
    for template in r.choices(TEMPLATES, k=r.choice((1, 1, 2, 3))):
        for i, piece in enumerate(regex.split(r"\{(\w+)\}", template + r.choice((" ", " ", "\n")))):
            if i % 2:
                kind = piece.lower() if piece.isupper() else ""
                piece = _filled(piece, r, given, family)
                if kind:
                    spans.append((n, n + len(piece), kind))
            out.append(piece)
            n += len(piece)
    return "".join(out).rstrip(), spans


def labelled(texts: list[str], names: dict[str, list[str]], count: int, made: float, empty: float, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    r = random.Random(seed)
    latin = regex.compile("[A-Za-z]{3,}")
    given = GIVEN * 3 + [n for n in names["given"] if latin.fullmatch(n)]
    family = FAMILY * 2 + [n for n in names["family"] if latin.fullmatch(n)]
    rows = []
    while len(rows) < count:
        if r.random() < made:
            text, spans = (_made if r.random() < 0.4 else _frame)(r, given, family)
        else:
            text = r.choice(texts)
            spans = pii_rules.forms(text)
            if not spans and r.random() >= empty:
                continue
            if len(text) > WINDOW:
                centre = r.choice(spans)[0] if spans and r.random() < 0.75 else r.randrange(len(text))
                a = max(0, min(len(text) - WINDOW, centre - r.randrange(WINDOW)))
                while 0 < a and any(x < a < y for x, y, _ in spans):
                    a -= 1
                b = min(len(text), a + WINDOW)
                ends = [x for x, y, _ in spans if x < b < y]
                b = ends[0] if ends else b
                spans = [(x - a, y - a, k) for x, y, k in spans if a <= x and y <= b]
                text = text[a:b]
            text, spans = _renamed(text, spans, r, given, family)
        change = r.random()
        for share, f in ((0.04, str.lower), (0.08, str.upper), (0.11, str.title)):
            if change < share:
                if len(f(text)) == len(text):
                    text = f(text)
                break
        if len(text) >= 3:
            rows.append((classes_of(text), tags_of(len(text), spans)))
    return rows


def main(data_dir: str, out: str) -> None:
    texts = []
    for table, column in (("sources", "content"), ("claims", "text")):
        texts += [t for t in pq.read_table(f"{data_dir}/{table}.parquet", columns=[column]).column(0).to_pylist() if t]
    names: dict[str, list[str]] = {"given": [], "family": []}
    for row in pq.read_table(f"{data_dir}/name_list.parquet").to_pylist():
        names.setdefault(row["name_kind"], []).append(row["name_text"])
    tagger = Tagger(hidden=20, embed=16)
    for i, (count, made, empty, epochs, rate) in enumerate(STAGES):
        tagger.fit(labelled(sorted(set(texts)), names, count, made, empty, 11 + i), epochs=epochs, batch=64, rate=rate, told=lambda x: print(x, flush=True))
    tagger.save(out)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2] if len(sys.argv) > 2 else __file__.replace("pii_train.py", "pii_weights.npz"))
