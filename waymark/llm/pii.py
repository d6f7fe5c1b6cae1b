"""Problem 6: personal information in free text, by a skip-chain conditional random field.

Every token of a text is a node whose label is nothing or one of the five types. A node's
own potentials come from its word (shape, ending, list membership, learned words), from
the words around it and from whether an exact form covers it; neighbours share potentials
along the chain, and repeated or similar words of one text, however far apart, share
potentials across it, so a name that is clear in one place is known in the other. Loopy
sum-product runs over all texts of a batch at once as array arithmetic. Runs of one label
become spans after an exact check of their form.

All potentials are trained here, by the gradient of the likelihood under the same loopy
messages. No labelled text exists, so the training set is a bounded sample of messages
that labelling rules have marked, and messages of the sample with generated personal data,
second mentions and decoys added at known places. The rules serve training only: a text is
labelled by the field.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field as having

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("email", "phone", "id_number", "address", "person_name")
PLACEHOLDERS = {t: f"[{t.upper()}]" for t in TYPES}
NOTHING, EMAIL, PHONE, ID_NUMBER, ADDRESS, NAME = range(6)
LABELS = len(TYPES) + 1

#: Rounds of messages; texts of the sample that the field is trained on at most; bytes of a text in it at most; steps of training, their size, the log odds by which missing something personal is worse than the reverse.
ROUNDS, SAMPLE, SAMPLE_BYTES, STEPS, RATE, MISSED = 4, 3_000, 2_000, 100, 0.25, 4.0
#: Log odds that must speak against every type at every word of a text before it is passed over without messages.
SURE = 6.5

#: Common given names, lower case.
GIVEN = frozenset((
    "aaron adam adrian agnes ahmed aisha akira alan albert alex alexander alice alicia alina amara amelia amina amir ana ana-maria andrea andreas andrew angela anja anna anne anthony antonio arjun arthur astrid axel barbara "
    "beatriz ben benjamin bjorn brian bruno camille carla carlos carmen caroline cecilia charles charlotte chen chiara chris christian christina claire clara daniel daniela david deepa diana diego dmitri edward elena eleni elias "
    "elif elisa elizabeth ella emil emilia emily emma eric erik ethan eva fatima felix fernando fiona francesca francois françoise frank freya gabriel george giulia grace greta gustav hana hannah hans harry hassan heidi helen helena "
    "henrik henry hiroshi hugo ibrahim igor ines ingrid irina isabel ivan jack jakob james jan jane jean jean-luc jennifer joana johan john jonas jose josé joseph juan julia julian julie jürgen karen karim karl kate katya kenji "
    "khalid lars laura layla leila leo liam lina linda louis luca lucas lucia luis lukas magnus maja marco marek maria marie mario marta martin mary mateo matthew max mei mehmet michael miguel mina mohammed nadia natalia nicolas nina noah "
    "noor nora olga olivia omar oskar pablo patrick paul paula paulo pedro peter petra philip pierre priya rachel rafael rahul raj rebecca ricardo robert rosa ruth samuel sara sarah sebastian sergei simon sofia sophie søren stefan "
    "susan sven tariq teresa thomas tim tom tomas valentina vera victor viktor wei william xavier yara yuki yusuf zainab zoe zoë"
).split())
TITLES = frozenset("dr prof mr mrs ms miss mx sir herr frau hr fr monsieur madame mme mlle señor señora sr sra srta don doña".split())
PARTICLES = frozenset("von van der den de la le du da dos di del al el bin ibn ter zu zur".split())
#: Words that no family name is, though they may follow or precede a given name.
COMMON = frozenset((
    "a about after again all also am an and any are as asked at be been before but by call can cannot check come could did do does done down for from get got had has have he her him his how i if in into is it its just keep know let like "
    "may me meeting might more must my need needs never no not now of off ok on once one only or our out over please said saw says see send sent she should since so some still such than thanks that the their them then there these they "
    "this those to told too until up us very was way we went were what when where which who why will with without would yes yet you your today tomorrow yesterday monday tuesday wednesday thursday friday saturday sunday tonight later soon "
    "page pages team teams project projects release cluster server build board room floor lane office desk ticket version commit invoice port host group channel und oder ist war hat mit für auf aus bei nach"
).split())
#: Words after which, or before which, a person is likely spoken of.
SIGNED = frozenset("cc regards name contact grüße dear signed customer client patient attn saludos".split())
BEFORE = SIGNED | frozenset("ask with from by von hi hello thanks spoke met bonjour".split())
AFTER = frozenset("will would is was has had can could should about went said says asked wrote called joined left".split())
ROADS = frozenset("street st road rd lane ln avenue ave drive dr way close court square crescent terrace boulevard blvd rue calle avenida plaza paseo place chemin impasse box postfach apartado".split())
#: Words of talk about machines and counts, in which numbers are nobody's.
COUNTS = frozenset("row count epoch build invoice ticket version part port host commit order iban ref swift isbn".split())

_W = r"[^\W\d_]"
_TOKEN = re.compile(r"\d+|[^\W\d_]+(?:['’][^\W\d_]+)*|[^\w\s]|_")
_DOT = r"(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\s+dot\s+)"
_LOCAL = rf"(?<![\w.+-])[\w][\w+-]*(?:{_DOT}[\w+-]+)*"
EMAILS = re.compile(rf"{_LOCAL}(?:@|\s?[(\[{{]\s?at\s?[)\]}}]\s?|\s@\s)[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[^\W\d_]{{2,}}(?![\w-])|{_LOCAL}\s+at\s+[\w-]+(?:\s+dot\s+[\w-]+)+(?![\w-])", re.I)
_AT = re.compile(r"@|\bat\b", re.I)
#: Where an address of that form leads to a machine and not to a person.
_NOT_MAIL = re.compile(r"^(?:git|hg|svn|ssh|root|www|pkg)\b", re.I)
PHONES = re.compile(
    r"(?<![\w.#/:-])(?:\+\d{1,3}[\s.-]?(?:\(\d{1,4}\)[\s.-]?)?\d[\d\s.-]{5,13}\d|(?<!\d\s)(?:00\d{2}\s\d{2,4}\s?\d[\d\s]{4,9}\d|\(0?\d{2,4}\)\s?\d{3,5}[\s.-]?\d{2,5}|0\d{1,4}[\s-]\d{3,4}[\s-]\d{3,4}|0\d{2,4}[\s-]\d{5,7}|0\d(?:[\s.]\d{2}){4}"
    r"|\d{3}[\s.-]\d{3}[\s.-]\d{4}|\d{3}[\s-]\d{4}|\d{3}\s\d{2}\s\d{2}|\d{3}-\d{4}))(?:\s?(?:ext|x)\.?\s?\d{1,5})?(?![\w-]|[.:]\d|\s\d{2})"
)
_PHONE_CUE = re.compile(r"\b(?:phone|tel|telefon|mobile|mobil|cell|call|ring|text|number|hotline|rückruf|fax|whatsapp|dial|reach|llama|appel\w*)\b[^\d\n]{0,25}$", re.I)
_NO_PHONE = re.compile(r"\b(?:row count|count|epoch|build|invoice|ticket|version|part no\.?|port|host|commit|order|id|ssn|security|steuer-?id|tax|passport|no\.|iban)[\s:#]*$|[-/#.]$", re.I)
#: What identity numbers are called.
_ID_CUE = re.compile(
    r"(?:\bssn\b|social security|\bnino\b|\bNI n(?:umber|o\.?)|national insurance|steuer-?id\w*|steuernummer|\btax (?:id|number|no\.?)|\btin\b|\bdni\b|\bnie\b|\bnif\b|passport|reisepass|pasaporte|passeport|personalausweis|ausweis\w*|identity card|\bid card|"
    r"licen[cs]e|führerschein|insurance n(?:umber|o\.?)|sozialversicherung\w*|numéro de sécurité sociale)(?:[\s:#,(]*(?:no\.?|nr\.?|number|on file|is|was|card|my|the)(?![\w]))*[\s:#,(]*$", re.I,
)
IDS = re.compile(
    r"(?<![\w.-])(?:(?P<ssn>\d{3}-\d{2}-\d{4})|(?P<nino>[A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D])|(?P<dni>\d{8}-?[A-HJ-NP-TV-Z]|[XYZ]-?\d{7}-?[A-Z])|(?P<other>[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]|[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]{1,3}\d{2}[A-Z0-9]{1,2}\d{3,7}|[A-Z]{1,2}\d{6,9}|\d{3}\s\d{2}\s\d{4}|\d{2}\s\d{3}\s\d{3}\s\d{3}|\d{9,11}))(?![\w-])",
    re.I,
)
_ROAD = r"(?:street|st\.?|road|rd\.?|lane|ln\.?|avenue|ave\.?|drive|dr\.|way|close|court|square|crescent|terrace|boulevard|blvd\.?)(?:\s[NSEW]{1,2}\.?)?"
_TOWN = rf"{_W}[\w'’-]+(?: (?-i:[A-ZÀ-ÖØ-Þ])[\w'’-]+| bay\b)?(?:,\s[A-Z]{{2}}\s\d{{5}})?"
ADDRESSES = re.compile(
    rf"(?<!\w)(?:(?:(?:flat|apt\.?|apartment|unit)\s\d+\w?,\s)?\d{{1,4}}[a-z]?\s(?:{_W}[\w'’-]*\s){{1,3}}{_ROAD},\s(?:\d{{4,5}}\s)?{_TOWN}(?:\s\d{{4,5}})?"
    rf"|(?:{_W}[\w'’-]*\s)?{_W}[\w'’-]*(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee)\s\d{{1,4}}[a-z]?,\s(?:\d{{4,5}}\s)?{_TOWN}"
    rf"|\d{{1,4}}(?:\s?bis)?,?\s(?:rue|avenue|boulevard|place|chemin|impasse)\s(?:de\s|des\s|du\s|de\sla\s|d['’])?{_W}[\w'’-]*(?:\s{_W}[\w'’-]*)?,\s(?:\d{{4,5}}\s)?{_TOWN}"
    rf"|(?:calle|avenida|plaza|paseo)\s(?:{_W}[\w'’-]*\s){{1,3}}\d{{1,4}}(?:,\s\d{{1,2}}[ºª°]\s?\w?)?,\s(?:\d{{4,5}}\s)?{_TOWN}"
    rf"|(?:p\.?\s?o\.?\sbox|postfach|apartado|boîte postale)\s\d+,\s(?:\d{{4,5}}\s)?{_TOWN})",
    re.I,
)
#: What a text must hold before those forms are looked for: a number and a comma; six digits near one another.
_NUMBERED, _DIGITS = re.compile(r"\d[^,\n]*,|,[^\n]*\d"), re.compile(r"\d(?:\D{0,3}\d){5}")

#: Exact forms that may cover a word, with the log odds by which the labelling rules weigh them.
FORMS = {
    "email": 6.0, "email_disguised": 0.0, "email_remote": -8.0,
    "id_ssn": 2.5, "id_formed": 1.5, "id_loose": -3.0, "id_cue": 4.5,
    "phone_firm": 2.5, "phone_long": 0.4, "phone_short": -1.0, "phone_cue": 2.5, "phone_counted": -4.0, "phone_id": -5.0,
    "address": 5.0,
}
_OF_FORM = {f: i for i, f in enumerate(FORMS)}
_LABEL_OF = {"email": EMAIL, "id": ID_NUMBER, "phone": PHONE, "address": ADDRESS}


def covered(text: str) -> list[tuple[int, int, int, tuple[str, ...]]]:
    """(start, end, label, names of FORMS) of every stretch that has the form of an address, number or mail; they may overlap."""
    out: list[tuple[int, int, int, tuple[str, ...]]] = []
    if _AT.search(text):
        for m in EMAILS.finditer(text):
            remote = text[m.end() : m.end() + 1] == ":" and text[m.end() + 1 : m.end() + 2].strip() != "" or _NOT_MAIL.match(m[0])
            out.append((m.start(), m.end(), EMAIL, ("email", *(("email_remote",) if remote else ()), *(() if re.fullmatch(r"\S+@\S+", m[0]) else ("email_disguised",)))))
    if not _DIGITS.search(text):
        return out if not _NUMBERED.search(text) else out + _addresses(text)
    for m in IDS.finditer(text):
        cue = _ID_CUE.search(text[max(0, m.start() - 48) : m.start()])
        out.append((m.start(), m.end(), ID_NUMBER, ("id_ssn" if m["ssn"] else "id_formed" if m["nino"] or m["dni"] else "id_loose", *(("id_cue",) if cue else ()))))
    for m in PHONES.finditer(text):
        ahead = text[max(0, m.start() - 40) : m.start()]
        digits = sum(c.isdigit() for c in m[0])
        firm = m[0][0] in "+(" or m[0].startswith("00") and digits > 10 or "ext" in m[0]
        found = ["phone_firm" if firm else "phone_long" if digits >= 7 else "phone_short"]
        found += ["phone_cue"] * bool(_PHONE_CUE.search(ahead)) + ["phone_counted"] * bool(_NO_PHONE.search(ahead)) + ["phone_id"] * bool(_ID_CUE.search(text[max(0, m.start() - 48) : m.start()]))
        out.append((m.start(), m.end(), PHONE, tuple(found)))
    return out + _addresses(text) if _NUMBERED.search(text) else out


def _addresses(text: str) -> list[tuple[int, int, int, tuple[str, ...]]]:
    return [(m.start(), m.end(), ADDRESS, ("address",)) for m in ADDRESSES.finditer(text)]


# What follows up to rule_labels marks names in the training sample; no text is labelled by it.

_U = r"[^\W\d_a-zß-öø-ÿćčđšž]"
_PART = rf"(?:(?i:von der|van der|van den|de la|von|van|v\.|del|de|di|da)\s|(?i:al-|O['’])|Ma?c(?={_U}))?{_W}[\w’']*"
_FAMILY = rf"{_PART}(?:-{_PART})*"
NAMES = re.compile(
    rf"(?<![\w@./+-])(?:(?P<title>(?i:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?\s)(?P<tfamily>(?:{_U}[\w’'-]*\s(?={_U}|(?:von|van|de|al)\b))?{_FAMILY})"
    rf"|(?P<last>{_FAMILY}),\s(?P<first>{_W}+(?:-{_W}+)?)(?![\w-])"
    rf"|(?P<given>{_W}+(?:-{_W}+)?)\s(?:(?P<initial>{_W}\.?)\s)?(?P<family>{_FAMILY}))(?![@\w]|\.\w|\+\w)"
)
_WORDS = re.compile(rf"{_W}+(?:-{_W}+)?")


def _family_word(family: str) -> str:
    """The word of a family name that carries it: without particles, before any hyphen."""
    words = [w for w in re.split(r"[\s-]", re.sub(r"^(?:O['’]|Mc|Mac)(?=[A-Z])", "", family)) if w.rstrip(".").lower() not in PARTICLES and w != "v."]
    return words[0] if words else ""


def _is_name(m: re.Match, text: str) -> bool:
    """Whether the rules take a name-like stretch for a name: by its form, the lists and the words around it."""
    if m["title"]:
        family = _family_word(m["tfamily"])
        return family.lower() not in COMMON and (family[:1].isupper() or m["title"].strip().isupper())
    given, family = (m["first"], m["last"]) if m["first"] else (m["given"], m["family"])
    word = _family_word(family)
    if len(word) < 2 or word.lower() in COMMON or given.lower() in COMMON or given.lower() in TITLES:
        return False
    known, cased = given.lower() in GIVEN, given[:1].isupper() and word[:1].isupper()
    if m["first"]:
        return known and cased and word.lower() not in GIVEN
    if cased:
        before = re.findall(r"[^\W\d_]+", text[max(0, m.start() - 24) : m.start()].lower())
        return known or bool(before) and before[-1] in SIGNED and len(given) > 1 and word.lower() not in GIVEN
    after = re.match(r"\s*([^\W\d_]+)", text[m.end() :])
    before = re.findall(r"[^\W\d_]+", text[max(0, m.start() - 24) : m.start()].lower())
    cue = bool(before) and before[-1] in BEFORE or after is not None and after[1] in AFTER
    return known and not given[:1].isupper() and not word[:1].isupper() and len(word) >= 4 and (cue or bool(m["initial"]))


def rule_labels(text: str) -> list[tuple[int, int, int]]:
    """(start, end, label) of what the rules mark in a text of the training sample."""
    out = [(a, b, t) for a, b, t, names in covered(text) if sum(FORMS[n] for n in names) > 0]
    at = 0
    for w in _WORDS.finditer(text):
        if w.start() >= at and (m := NAMES.match(text, w.start())) and _is_name(m, text):
            out.append((m.start(), m.end(), NAME))
            at = m.end()
    kept: list[tuple[int, int, int]] = []
    for a, b, t in sorted(out, key=lambda x: (x[0], -x[1])):
        if not any(a < y and x < b for x, y, _ in kept):
            kept.append((a, b, t))
    return kept


#: Kinds of edges: neighbours that touch, that stand apart, with a line end between; repeated words; words alike at their first five letters.
TOUCHING, APART, BROKEN, REPEATED, ALIKE = range(5)
#: Places around a word whose words speak for its label.
AROUND = (-2, -1, 0, 1, 2)
_MARKS = ".,@:/-+()[]<>|#'\"&=_*"


def word_class(w: str) -> str:
    """What a word is at first sight: how long a number, which mark, or its case and the lists it is in."""
    if w[0].isdigit():
        return f"d{min(len(w), 12)}"
    if not w[0].isalpha():
        return w if w in _MARKS else "mark"
    low = w.lower()
    case = "i" if len(w) == 1 and w.isupper() else "U" if w.isupper() else "C" if w[0].isupper() else "l"
    kind = (
        "given" if low in GIVEN else "title" if low in TITLES else "particle" if low in PARTICLES else "common" if low in COMMON else "road" if low in ROADS else "count" if low in COUNTS else "signed" if low in SIGNED
        else "before" if low in BEFORE else "after" if low in AFTER else "at" if low in ("at", "dot") else ""
    )
    return f"{case}:{kind}"


def word_features(w: str) -> tuple[list[str], list[str]]:
    """(features of a word for itself and its neighbours, features for itself only)."""
    if w[0].isdigit():
        return [word_class(w)], []
    low = w.lower()
    shared = [word_class(w), f"w={low}"]
    lists = [n for n, words in (("given", GIVEN), ("common", COMMON), ("before", BEFORE), ("after", AFTER), ("road", ROADS)) if low in words]
    own = [f"3={low[-3:]}", f"2={low[-2:]}", f"^{low[:2]}", f"n={min(len(w), 12)}", *lists] if w[0].isalpha() else []
    return shared, own


@dataclass
class Field:
    """The parameters: weights of features at each place around a word, of pairs of classes, of forms, and edge potentials.

    ``features`` and ``classes`` number what training saw; what it didn't see weighs nothing.
    """

    features: dict[str, int] = having(default_factory=dict)
    classes: dict[str, int] = having(default_factory=dict)
    words: np.ndarray = having(default_factory=lambda: np.zeros((len(AROUND), LABELS, 1), np.float32))
    pairs: np.ndarray = having(default_factory=lambda: np.zeros((3, LABELS, 1), np.float32))
    forms: np.ndarray = having(default_factory=lambda: np.zeros((LABELS, len(FORMS)), np.float32))
    edges: np.ndarray = having(default_factory=lambda: np.zeros((5, LABELS, LABELS), np.float32))

    def without_edges(self, *kinds: int) -> Field:
        """The same field with the edges of these kinds, or all, worth nothing."""
        edges = self.edges.copy()
        edges[list(kinds) or slice(None)] = 0
        return Field(self.features, self.classes, self.words, self.pairs, self.forms, edges)


class Vocabulary:
    """Different words numbered as they come, with what edges and features need of each."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.folds: dict[str, int] = {}
        self.fold: list[int] = []  # the same number for words that repeat each other, -1 for what links nothing
        self.start: list[int] = []  # the same number for words alike at their first five letters

    def of(self, words: list[str]) -> np.ndarray:
        number = self.number
        out = [number.get(w, -1) for w in words]
        if -1 in out:
            out = [self._add(w) if k < 0 else k for w, k in zip(words, out, strict=True)]
        return np.array(out, np.int64)

    def _add(self, w: str) -> int:
        if w in self.number:
            return self.number[w]
        k = self.number[w] = len(self.number)
        low = w.casefold()
        links = len(w) > 2 and w[0].isalpha() and low not in COMMON
        self.fold.append(self.folds.setdefault(low, len(self.folds)) if links else -1)
        self.start.append(self.folds.setdefault("^" + low[:5], len(self.folds)) if links and len(w) > 5 else -1)
        self.add(k, w)
        return k

    def add(self, k: int, w: str) -> None:
        """What more is kept of word ``w``, number ``k``."""


class _Words(Vocabulary):
    """The vocabulary of a task, with the potentials that words bring at each place around a word."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field
        self.tables = np.zeros((len(AROUND), LABELS, 1 << 10), np.float32)
        self.classes = np.zeros(1 << 10, np.int64)

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.number) > 500_000:
            self.__init__(self.field)
        return super().of(words)

    def add(self, k: int, w: str) -> None:
        f = self.field
        if k == len(self.classes):
            self.tables, self.classes = np.concatenate([self.tables, np.zeros_like(self.tables)], 2), np.concatenate([self.classes, np.zeros_like(self.classes)])
        shared, own = word_features(w)
        known = [f.features[x] for x in shared if x in f.features]
        self.tables[:, :, k] = f.words[:, :, known].sum(2)
        self.tables[AROUND.index(0), :, k] += f.words[AROUND.index(0)][:, [f.features[x] for x in own if x in f.features]].sum(1)
        self.classes[k] = f.classes.get(word_class(w), 0)


@dataclass
class Graph:
    """Tokens of several texts as nodes: where each text's begin, their places, words, edges (sorted by kind) and the forms that cover them."""

    begins: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    a: np.ndarray
    b: np.ndarray
    kind: np.ndarray
    form_at: np.ndarray
    form: np.ndarray
    found: list[list]

    def __len__(self) -> int:
        return len(self.ids)


def _links(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node with a key and the next one of its text with the same key."""
    at = np.flatnonzero(key >= 0)
    at = at[np.lexsort((at, key[at], text[at]))]
    same = (text[at[1:]] == text[at[:-1]]) & (key[at[1:]] == key[at[:-1]])
    return at[:-1][same], at[1:][same]


def build_graph(texts: Sequence[str], words: Vocabulary) -> Graph:
    found, counts, places, tokens = [], [], [], []
    for text in texts:
        mine = [m.span() for m in _TOKEN.finditer(text)]
        places += mine
        tokens += [text[x:y] for x, y in mine]
        counts.append(len(mine))
        found.append(covered(text))
    ids, n = words.of(tokens), len(tokens)
    begins = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    place = np.array(places, np.int64).reshape(-1, 2)
    starts, ends, text = place[:, 0], place[:, 1], np.repeat(np.arange(len(texts)), counts)
    form_at, form = [], []
    for i, stretches in enumerate(found):
        for x, y, _, names in stretches:
            lo, hi = begins[i], begins[i + 1]
            inside = range(lo + np.searchsorted(starts[lo:hi], x), lo + np.searchsorted(starts[lo:hi], y))
            for name in names:
                form_at.extend(inside), form.extend([_OF_FORM[name]] * len(inside))
    a = np.flatnonzero(text[1:] == text[:-1])
    kind = np.where(starts[a + 1] == ends[a], TOUCHING, APART)
    lined = np.array(["\n" in t for t in texts], bool)
    for j in np.flatnonzero(lined[text[a]] & (kind == APART)) if n else ():
        k = a[j]
        if "\n" in texts[text[k]][ends[k] : starts[k + 1]]:
            kind[j] = BROKEN
    fold, start = np.array(words.fold, np.int64)[ids], np.array(words.start, np.int64)[ids]
    again, alike = _links(text, fold), _links(text, start)
    other = fold[alike[0]] != fold[alike[1]]
    a, b = np.concatenate([a, again[0], alike[0][other]]), np.concatenate([a + 1, again[1], alike[1][other]])
    kind = np.concatenate([kind, np.full(len(again[0]), REPEATED), np.full(int(other.sum()), ALIKE)])
    order = np.argsort(kind, kind="stable")
    return Graph(begins, starts, ends, ids, a[order], b[order], kind[order], np.array(form_at, np.int64), np.array(form, np.int64), found)


def _shift(n: int, begins: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes that have a word ``by`` places on in their text, that word's node)."""
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    at = np.arange(max(0, -by), min(n, n - by))
    at = at[text[at] == text[at + by]]
    return at, at + by


def potentials(g: Graph, field: Field, words: _Words) -> np.ndarray:
    """What each node's own evidence says for each label: a row per label."""
    n, ids = len(g), g.ids
    near = {by: _shift(n, g.begins, by) for by in AROUND if by}
    near[0] = (np.arange(n), np.arange(n))
    out = np.take(words.tables[AROUND.index(0)], ids, 1)
    for p, by in enumerate(AROUND):
        if by:
            at, other = near[by]
            out[:, at] += np.take(words.tables[p], ids[other], 1)
    c, wide = words.classes[ids], math.isqrt(field.pairs.shape[2])
    for p, (left, right) in enumerate(((-1, 0), (0, 1), (-1, 1))):
        out += np.take(field.pairs[p], _pairs(n, c, near, left, right, wide), 1)
    return out + _sums(g.form_at, field.forms[:, g.form], n)


def _pairs(n: int, c: np.ndarray, near: dict, left: int, right: int, wide: int) -> np.ndarray:
    """Each node's number of the pair of classes at two places around it; a place outside the text has class 0."""
    side = []
    for by in (left, right):
        v = np.zeros(n, np.int64)
        at, other = near[by]
        v[at] = c[other]
        side.append(v)
    return side[0] * wide + side[1]


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The columns of ``values`` summed by the number in ``at``."""
    return np.stack([np.bincount(at, weights=row, minlength=n) for row in values]).astype(np.float32)


def _groups(kind: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, first, after last) of the stretches of a sorted array."""
    cuts = np.searchsorted(kind, np.arange(6))
    return [(k, int(cuts[k]), int(cuts[k + 1])) for k in range(5) if cuts[k] < cuts[k + 1]]


def propagate(unary: np.ndarray, a: np.ndarray, b: np.ndarray, kind: np.ndarray, edges: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(beliefs, messages) after ``rounds`` of sum-product over the edges a - b: log, a row per label, beliefs unnormalised.

    Edges are sorted by kind; ``edges`` holds of each kind the log potentials (label of a, label of b).
    Messages are those towards b, then those towards a.
    """
    e = len(a)
    message = np.zeros((LABELS, 2 * e), unary.dtype)
    if not e:
        return unary, message
    psi = np.exp(edges).astype(unary.dtype)
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    groups = _groups(kind)
    belief = unary
    for _ in range(rounds):
        out = np.take(belief, src, 1)
        out[:, :e] -= message[:, e:]
        out[:, e:] -= message[:, :e]
        out -= out.max(0)
        np.exp(out, out)
        for k, lo, hi in groups:
            message[:, lo:hi] = psi[k].T @ out[:, lo:hi]
            message[:, e + lo : e + hi] = psi[k] @ out[:, e + lo : e + hi]
        message /= message.max(0)
        np.log(message, message)
        belief = unary + _sums(dst, message, unary.shape[1])
    return belief, message


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(0))
    return x / x.sum(0)


def _few(g: Graph, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, a, b, kind) of the texts kept, nodes renumbered."""
    nodes = np.flatnonzero(np.repeat(keep, np.diff(g.begins)))
    to = np.full(len(g), -1)
    to[nodes] = np.arange(len(nodes))
    on = to[g.a] >= 0
    return nodes, to[g.a[on]], to[g.b[on]], g.kind[on]


def label_texts(texts: Sequence[str], field: Field, words: _Words | None = None) -> list[list[tuple[int, int, str]]]:
    """Of every text the decided spans (start, end, type), by loopy sum-product over all of them.

    Texts in which every word's own evidence is at least SURE against every type get no
    messages and have no spans.
    """
    words = words or _Words(field)
    g = build_graph(texts, words)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not len(g):
        return out
    unary = potentials(g, field, words)
    margin = unary[1:].max(0) - unary[0]
    size = np.diff(g.begins)
    keep = np.zeros(len(texts), bool)
    some = np.flatnonzero(size)
    keep[some] = np.maximum.reduceat(margin, g.begins[some]) > -SURE
    nodes, a, b, kind = _few(g, keep)
    belief, _ = propagate(unary[:, nodes], a, b, kind, field.edges)
    label = np.zeros(len(g), np.int64)
    label[nodes] = belief.argmax(0)
    for i in np.unique(np.searchsorted(g.begins, np.flatnonzero(label), side="right") - 1):
        lo, hi = g.begins[i], g.begins[i + 1]
        out[i] = spans(texts[i], g.starts[lo:hi].tolist(), g.ends[lo:hi].tolist(), label[lo:hi].tolist(), g.found[i])
    return out


def spans(text: str, starts: list[int], ends: list[int], label: list[int], found: list) -> list[tuple[int, int, str]]:
    """The spans of a text from its tokens' labels: forms most of whose tokens are of their type, then runs of one label that pass an exact check."""
    chosen: list[tuple[int, int, int]] = []
    free = lambda a, b: not any(a < y and x < b for x, y, _ in chosen)
    for a, b, t, _ in sorted(found, key=lambda x: (x[0], -x[1])):
        own = [k for k in range(len(label)) if starts[k] >= a and ends[k] <= b]
        if own and sum(label[k] == t for k in own) * 2 > len(own) and free(a, b):
            chosen.append((a, b, t))
    runs, k = [], 0
    while k < len(label):
        t, first = label[k], k
        while k < len(label) and label[k] == t and (k == first or "\n" not in text[ends[k - 1] : starts[k]]):
            k += 1
        if t:
            run = [j for j in range(first, k) if free(starts[j], ends[j])]
            while run and not text[starts[run[0]]].isalnum() and text[starts[run[0]]] not in "+(":
                run.pop(0)
            while run and not text[starts[run[-1]]].isalnum() and not (t == NAME and text[starts[run[-1]]] == "." and ends[run[-1]] - starts[run[-2]] == 2):
                run.pop()
            if run:
                runs.append((t, run))
    named: set[str] = set()
    for t, run in runs:
        if t == NAME and _whole_name([text[starts[j] : ends[j]] for j in run]):
            named.update(w for j in run if len(w := text[starts[j] : ends[j]].casefold()) > 2 and w not in TITLES and w not in PARTICLES)
    for t, run in runs:
        a, b = starts[run[0]], ends[run[-1]]
        words = [text[starts[j] : ends[j]] for j in run]
        if _passes(t, text[a:b], words) or t == NAME and any(w.casefold() in named for w in words):
            chosen.append((a, b, t))
    return [(a, b, TYPES[t - 1]) for a, b, t in sorted(chosen)]


def _whole_name(words: list[str]) -> bool:
    """Whether a run holds a title or a given name, and a family name beside it: two words other than particles, the last of them longer than a letter."""
    own = [w for w in words if w[0].isalpha() and w.lower() not in PARTICLES]
    return len(own) > 1 and len(own[-1]) > 1 and any(w.lower() not in TITLES for w in own)


def _passes(label: int, span: str, words: list[str]) -> bool:
    """The exact check of a run that no form covers."""
    digits = sum(c.isdigit() for c in span)
    if label == NAME:
        return _whole_name(words)
    if label == EMAIL:
        return re.fullmatch(r"(?s)[^@]+(?:@|\W(?:at|AT)\W)[^@]*(?:\.|dot|DOT)[^@]+", span) is not None
    if label == PHONE:
        return 7 <= digits <= 17 and not any(c.isalpha() for c in span)
    if label == ID_NUMBER:
        return digits >= 5 and len([c for c in span if c.isalnum()]) <= 16
    return digits > 0 and sum(w[0].isalpha() for w in words) > 1


def mask(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with the spans replaced by their placeholders, the rest unchanged."""
    out, at = [], 0
    for a, b, t in found:
        out += [text[at:a], PLACEHOLDERS[t]]
        at = b
    return "".join([*out, text[at:]])


_BEGIN = "Ab Ad Bar Bel Cor Dal Del Eri Fen Gor Hal Ib Jen Kal Kwa Lin Mor Nor Ob Pel Qui Ros Sen Sio Tor Ul Vel Wen Xi Yo Zan".split()
_END = "berg dahl en ez field ini ka kov la lund mann ma na ova que ric sen stein ton u vik wood yn zo".split()
#: Frames for names, and whether a name in small letters may stand there.
_FRAMES = [
    ("regards, {}", True), ("cc {}", True), ("ask {} about it", True), ("spoke with {} today", True), ("meet with {} later", True), ("talk to {}", False), ("{} will call", False), ("{} joined", False), ("{} is out until friday", True), ("{} said ok", False),
    ("customer name: {}", True), ("with {} from the other team", True), ("by {}", True), ("I met {} and we agreed", False), ("{}", False), ("thanks {}", False), ("the form went to {}", False), ("{} wrote again", False),
]


class _Made:
    """Generated pieces of text with the places of what is personal in them."""

    def __init__(self, rng: random.Random, words: Sequence[str]):
        self.rng, self.known = rng, sorted(GIVEN)
        self.words = [w for w in words if w not in GIVEN and w not in COMMON and len(w) > 3] or ["lamp", "table", "window", "folder", "pencil"]

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def family(self) -> str:
        r = self.rng
        plain = r.choice(_BEGIN) + r.choice(_END)
        return r.choice([plain] * 5 + [f"O'{plain}", f"Mc{plain}", f"van {plain}", f"van der {plain}", f"von {plain}", f"de {plain}", f"al-{plain}", f"{plain}-{r.choice(_BEGIN)}{r.choice(_END)}"])

    def given(self, known: bool) -> str:
        r = self.rng
        return "-".join(x.capitalize() for x in r.choice(self.known).split("-")) if known else r.choice(_BEGIN) + r.choice(_END)

    def cap(self) -> str:
        return self.rng.choice(self.words).capitalize()

    def name(self) -> tuple[str, list[tuple[int, int, int]]]:
        """A name in a frame; often its parts come again further on, where only the first mention tells that they are a name."""
        r = self.rng
        known, family = r.random() < 0.6, self.family()
        given = self.given(known)
        frame, small = r.choice(_FRAMES)
        form = r.random()
        if form < 0.15:
            shown = f"{r.choice(['Dr.', 'Mr', 'Ms', 'Herr', 'Frau', 'Prof.', 'Mrs.'])} {family}"
        elif form < 0.27 and known:
            shown = f"{family}, {given}"
        elif form < 0.34:
            shown = f"{given} {r.choice('ABKRTdhv')}. {family}"
        elif form < 0.40:
            shown = f"{given} {self.given(False)} {family}"
        elif form < 0.48:
            shown = f"{given} {family}".upper()
        elif form < 0.68 and small and known:
            shown = f"{given} {family}".lower()
        else:
            shown = f"{given} {family}"
        text = frame.format(shown)
        at = text.index(shown)
        spans = [(at, at + len(shown), NAME)]
        if r.random() < 0.35 and family[0].isupper() and "-" not in family and "'" not in family:
            again = r.choice([family, family, f"{given} {family}", given if known else family])
            again = again.lower() if r.random() < 0.2 else again
            tail = r.choice(["later {} came", "so {} was there", "it was {} again", "{} left", "not before {} has read it", "I gave {} the key"])
            text += r.choice([". ", ", ", " and ", "; "])
            a = len(text) + tail.index("{}")
            text += tail.format(again)
            spans.append((a, a + len(again), NAME))
        return text, spans

    def personal(self) -> tuple[str, list[tuple[int, int, int]]]:
        r, d = self.rng, self.digits
        kind = r.choice([EMAIL, PHONE, ID_NUMBER, ADDRESS, NAME, NAME, NAME])
        if kind == NAME:
            return self.name()
        town, street, road = r.choice(_BEGIN) + r.choice(_END), self.cap(), r.choice("Street Road Lane Avenue Drive Court Close Way Square St. Rd.".split())
        if kind == EMAIL:
            host = r.choice(["mail.example", "post.test", "firm.example.org"])
            user = r.choice([f"{self.given(True)}.{town}".lower(), f"{self.given(True)}_{d(2)}".lower(), f"{town}{d(2)}".lower(), f"{town}+news".lower()])
            shown = r.choice([f"{user}@{host}", f"{user} (at) {host}", f"{user} [at] {host.replace('.', ' [dot] ')}", f"{user} @ {host}", f"{user.replace('.', ' dot ')} at {host.replace('.', ' dot ')}"])
            frame = r.choice(["mail {}", "{} bounced", "contact: {}", "write to {} please"])
        elif kind == PHONE:
            firm = [f"+44 20 {d(4)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"+49-{d(2)}-{d(5)}-{d(3)}", f"+1{d(10)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"0049 30 {d(8)}"]
            loose = [f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(4)} {d(6)}", f"{d(3)} {d(3)} {d(4)}", f"{d(3)} {d(2)} {d(2)}", f"({d(3)}) {d(5)} {d(3)}"]
            shown = r.choice(firm + loose)
            frame = r.choice(["call {}", "my number is {}", "tel. {}", "reach me on {}", "phone {}", "mobile: {}", "text me on {}", *(["{}", "it is {} now"] if shown in firm else [])])
        elif kind == ID_NUMBER:
            cue, shown = r.choice([("SSN ", f"{d(3)}-{d(2)}-{d(4)}"), ("passport no. ", f"{r.choice('XC')}{d(8)}"), ("NINO ", f"AB{d(6)}C"), ("tax id ", f"{d(2)} {d(3)} {d(3)} {d(3)}"), ("DNI ", f"{d(8)}T"), ("licence ", f"F{d(3)}-{d(4)}-{d(4)}"), ("social security ", d(9))])
            frame = cue + "{}"
        else:
            shown = r.choice([
                f"{d(2)} {street} {road}, {town} {d(5)}", f"{d(3)} {street} {road}, {town}", f"{d(2)} {street} {self.cap()} {road}, {town}", f"{street}weg {d(2)}, {d(5)} {town}", f"{d(2)} rue des {street}, {d(5)} {town}", f"PO Box {d(3)}, {town}", f"{d(4)} {street} Avenue NW, {town}, DC {d(5)}", f"Flat {d(1)}, {d(2)} {street} {self.cap()} Road, {town}", f"Calle {street} {d(2)}, {town}",
            ])
            shown = shown.lower() if r.random() < 0.25 else shown
            frame = r.choice(["ship it to {}", "we live at {} now", "new office: {}", "{}"])
        text = frame.format(shown)
        at = text.index(shown)
        return text, [(at, at + len(shown), kind)]

    def decoy(self) -> str:
        """What looks personal and isn't: numbers of things, single given names, capitals of pages and teams, lone family names."""
        r, d = self.rng, self.digits
        given, lone = self.given(True), r.choice(_BEGIN) + r.choice(_END)
        tail = r.choice(["later {} came", "so {} was there", "it was {} again", "{} left", "not before {} has read it", "I gave {} the key"])
        return r.choice([
            f"row count {d(3)} {d(3)} {d(3)}", f"invoice {d(4)}-{d(5)}", f"build {d(3)}-{d(2)}-{d(1)}", f"order {d(9)}", f"version {d(1)}.{d(2)}.{d(1)}", f"on 2024-0{r.randint(1, 9)}-1{d(1)} at 1{d(1)}:30", f"part no. QX-{d(5)}",
            f"epoch {d(10)}", f"git@{self.cap().lower()}.example:team/repo.git", f"{given} is fine with that", f"thanks {given}", f"room {d(2)}, floor {d(1)}", f"ticket OPS-{d(4)}", f"ref {r.choice('QX')}{d(7)}",
            f"ask {given.lower()} about it", f"{given.lower()} will do it", f"host 10.{d(2)}.{d(1)}.{d(2)} port {d(4)}", f"IBAN DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", f"we had {d(3)} {d(2)} of {d(4)}",
            tail.format(lone), tail.format(self.cap()), tail.format(lone), tail.format(self.cap()),
            f"the {self.cap()} {self.cap()} {r.choice(['page', 'release', 'board', 'team', 'cluster', 'group'])} is late", f"{self.cap()} {self.cap()} {r.choice(['cluster', 'page', 'release', 'server'])} shows it", f"Project {self.cap()} needs it", f"Team {self.cap()} and Team {self.cap()} agreed",
            f"{r.choice(['Monday', 'Friday', 'Today', 'Later'])} {self.cap()} is skipped", f"see {self.cap()} {self.cap()} for it", f"{self.cap()} first, {self.cap()} later",
        ])


def training_texts(texts: Sequence[str], seed: int = 0) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, places of what is personal): the sample as the rules mark it, to two thirds of which generated pieces are added."""
    rng = random.Random(seed)
    plain = [t for t in texts if t and t.strip()] or ["ok"] * 800
    made = _Made(rng, sorted({w for t in plain for w in re.findall(r"\b[a-z]{4,12}\b", t)}))
    out = []
    for t in plain:
        whole, spans = t, rule_labels(t)
        for _ in range(rng.choice([0, 1, 1, 2])):
            piece, mine = (made.decoy(), []) if rng.random() < 0.4 else made.personal()
            piece += rng.choice(["", "", "", "", " ok", " ...", "!", " (edited)"])
            between = rng.choice([", ", ". ", ": ", "\n", " - "])
            if rng.random() < 0.3:  # ahead of the text
                spans = [(a + len(piece + between), b + len(piece + between), k) for a, b, k in spans] + mine
                whole = piece + between + whole
            else:
                spans += [(a + len(whole + between), b + len(whole + between), k) for a, b, k in mine]
                whole += between + piece
        out.append((whole, spans))
    return out


def gold_labels(g: Graph, marked: Sequence[list[tuple[int, int, int]]]) -> np.ndarray:
    """The true label of every node: that of the place it lies in."""
    gold = np.zeros(len(g), np.int64)
    for i, places in enumerate(marked):
        lo, hi = g.begins[i], g.begins[i + 1]
        for a, b, t in places:
            gold[lo + np.searchsorted(g.starts[lo:hi], a) : lo + np.searchsorted(g.starts[lo:hi], b)] = t
    return gold


def _columns(lists: list[list[int]]) -> np.ndarray:
    """Lists of numbers as rows of one width, filled up with 0."""
    out = np.zeros((len(lists), max((len(x) for x in lists), default=0)), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _expected(belief: np.ndarray, message: np.ndarray, a: np.ndarray, b: np.ndarray, kind: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How often each kind of edge is believed to join each pair of labels."""
    e, out = len(a), np.zeros_like(edges)
    left, right = _softmax(np.take(belief, a, 1) - message[:, e:]), _softmax(np.take(belief, b, 1) - message[:, :e])
    for k, lo, hi in _groups(kind):
        psi = np.exp(edges[k])
        z = ((psi.T @ left[:, lo:hi]) * right[:, lo:hi]).sum(0)
        out[k] = psi * ((left[:, lo:hi] / z) @ right[:, lo:hi].T)
    return out


def fit_field(texts: Sequence[str], seed: int = 0, steps: int = STEPS, ridge: float = 1.0) -> Field:
    """A field trained on a sample of texts: Adam steps up the likelihood, its gradient by loopy messages as in labelling.

    While training, nothing has a head start of MISSED over what is personal, so that is
    told apart by a margin. Words count as features if training saw them three times.
    """
    examples = training_texts(texts, seed)
    vocabulary = Vocabulary()
    g = build_graph([t for t, _ in examples], vocabulary)
    gold = gold_labels(g, [m for _, m in examples])
    ids, n, number = g.ids, len(g), vocabulary.number
    seen = np.bincount(ids, minlength=len(number))
    each, count = [word_features(w) for w in number], {}
    for (shared, own), k in zip(each, seen.tolist(), strict=True):
        for x in (*shared, *own):
            count[x] = count.get(x, 0) + k
    features = {x: i for i, x in enumerate((x for x, k in sorted(count.items()) if k >= 3), 1)}
    classes = {c: i for i, c in enumerate(sorted({word_class(w) for w in number}), 1)}
    wide, many = len(classes) + 1, len(features) + 1
    field = Field(features, classes, np.zeros((len(AROUND), LABELS, many), np.float32), np.zeros((3, LABELS, wide * wide), np.float32))
    shared = _columns([[features[x] for x in s if x in features] for s, _ in each])
    own = _columns([[features[x] for x in (*s, *o) if x in features] for s, o in each])
    columns = [own if by == 0 else shared for by in AROUND]
    near = {by: _shift(n, g.begins, by) for by in AROUND if by}
    near[0] = (np.arange(n), np.arange(n))
    c = np.array([classes[word_class(w)] for w in number])[ids]
    codes = [_pairs(n, c, near, left, right, wide) for left, right in ((-1, 0), (0, 1), (-1, 1))]
    truth = np.eye(LABELS, dtype=np.float32)[:, gold]
    cost = np.zeros_like(truth)
    cost[NOTHING, gold != NOTHING] = MISSED
    joined = np.zeros((5, LABELS, LABELS), np.float32)
    np.add.at(joined, (g.kind, gold[g.a], gold[g.b]), 1)
    for name, i in _OF_FORM.items():
        field.forms[_LABEL_OF[name.split("_")[0]], i] = FORMS[name]
    given = {"forms": field.forms.copy()}  # what the weights are drawn towards, nothing for the others
    parts = ("words", "pairs", "forms", "edges")
    first, second = ({p: np.zeros_like(getattr(field, p)) for p in parts} for _ in range(2))
    for step in range(1, steps + 1):
        unary = _sums(g.form_at, field.forms[:, g.form], n)
        for p, by in enumerate(AROUND):
            at, other = near[by]
            unary[:, at] += np.take(field.words[p][:, columns[p]].sum(2), ids[other], 1)
        for p, code in enumerate(codes):
            unary += np.take(field.pairs[p], code, 1)
        belief, message = propagate(unary + cost, g.a, g.b, g.kind, field.edges)
        off = truth - _softmax(belief)
        up = {"edges": joined - _expected(belief, message, g.a, g.b, g.kind, field.edges), "forms": _sums(g.form, off[:, g.form_at], len(FORMS)), "pairs": np.stack([_sums(code, off, wide * wide) for code in codes])}
        words = []
        for p, by in enumerate(AROUND):
            at, other = near[by]
            per_word = _sums(ids[other], off[:, at], len(number))
            words.append(_sums(columns[p].ravel(), np.repeat(per_word, columns[p].shape[1], 1), many))
        up["words"] = np.stack(words)
        up["words"][:, :, 0] = 0  # what fills up the columns
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for p in parts:
            d = up[p] - ridge * (getattr(field, p) - given.get(p, 0))
            first[p] = 0.9 * first[p] + 0.1 * d
            second[p] = 0.98 * second[p] + 0.02 * d * d
            setattr(field, p, getattr(field, p) + rate * (first[p] / (1 - 0.9**step)) / (np.sqrt(second[p] / (1 - 0.98**step)) + 1e-3))
    return field


def sample_texts(messages: DataFrame, text: str = "text", most: int = SAMPLE) -> list[str]:
    """At most ``most`` different texts, those of the least hashes: rows below a hash threshold are read, and only they are compared.

    The threshold follows from the number of rows, and is raised where repeated texts leave too few below it.
    """
    rows = messages.where(F.col(text).isNotNull()).select(F.col(text).alias("_text"), F.shiftrightunsigned(F.xxhash64(text), 1).alias("_hash"))
    rows, n = rows.where((F.octet_length("_text") <= SAMPLE_BYTES) & (F.trim("_text") != "")), messages.count()
    share = min(1.0, 4 * most / max(n, 1))
    while True:
        below = rows.where(F.col("_hash") <= min(int(share * 2**63), 2**63 - 1)).groupBy("_hash", "_text").agg(F.lit(1)).orderBy("_hash", "_text").limit(most).select("_text")
        got = [r[0] for r in below.collect()]
        if len(got) == most or share >= 1.0:
            return got
        share = min(1.0, share * 4)


def train(messages: DataFrame, text: str = "text") -> Field:
    """The field for these texts, trained on at most SAMPLE of them, none longer than SAMPLE_BYTES."""
    return fit_field(sample_texts(messages, text))


def find_and_mask(messages: DataFrame, keys: Sequence[str], text: str = "text", field: Field | None = None) -> DataFrame:
    """``keys`` with masked (the text with placeholders) and pii_types (the types found, in order, once each).

    Null texts stay null and have no types; repeated rows stay repeated; extra columns aren't read.
    """
    shared = messages.sparkSession.sparkContext.broadcast(field or train(messages, text))  # a few MB, bounded by the sample
    picked = messages.select(*keys, F.col(text).alias("_text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.drop("_text").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(shared.value)
        found: dict[str, list] = {}  # of the texts that a task has met, while they are few
        for whole in batches:
            for lo in range(0, whole.num_rows, 5_000):
                b = whole.slice(lo, 5_000)
                texts = b.column("_text").to_pylist()
                if len(found) > 200_000:
                    found.clear()
                different = list(dict.fromkeys(t for t in texts if t and t not in found))
                found.update(zip(different, label_texts(different, words.field, words), strict=True))
                masked = [mask(t, found[t]) if t and found[t] else t for t in texts]
                kinds = [[x for x in TYPES if t and any(x == y for _, _, y in found[t])] for t in texts]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(masked, pa.string()), pa.array(kinds, pa.list_(pa.string()))], [*keys, "masked", "pii_types"])

    return picked.mapInArrow(run, f"{types}, masked string, pii_types array<string>")
