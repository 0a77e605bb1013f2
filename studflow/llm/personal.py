"""Problem 9: personal information in free text, found in a normalised copy and mapped back to the source.

Transducers rewrite each text into a plainer one and keep, for each character, where it came from: homoglyphs and full
width forms become ASCII, invisible characters vanish, runs of blanks and line ends become one blank, spelled digits
become digits, and at/dot disguises become @ and dots. Identifiers are detected in the plain text, and their spans are
mapped back, so that a value is always a piece of the source.

Towns of two words are told from a town and the next sentence's first word by a lexicon of towns, counted over all
documents from places where nothing else can follow. Each document is looked at once; where its spans depend on the
lexicon, both ends are kept and the lexicon, a table of any size, is joined to them.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import checkpointed, spread

KINDS = ("email", "phone", "id_number", "address", "name")
#: A learned town must have been seen so often.
SEEN = 2
#: Two words aren't a town if their first word alone is seen so many times as often.
RARER = 5

# --- transducers -----------------------------------------------------------------------------------------------

#: Look-alikes of ASCII letters (fixed values): Cyrillic and Greek.
HOMOGLYPHS = dict(zip("АВЕКМНОРСТХУІЈЅаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTXYIJSaeopcyxijsdqwABEZHIKMNOPTYXo"))
DASHES = "‐‑‒–—−﹣－"
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
#: Spelled digits in four languages (fixed values).
DIGITS = {w: str(d) for d, ws in enumerate(("zero null cero zéro", "one eins uno un", "two zwei zwo dos deux", "three drei tres trois", "four vier cuatro quatre", "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept", "eight acht ocho huit", "nine neun nueve neuf")) for w in ws.split()} | {"oh": "0"}


def _table() -> dict[int, str]:
    out = {ord(a): b for a, b in HOMOGLYPHS.items()} | {ord(c): "-" for c in DASHES} | {ord(c): "" for c in INVISIBLE}
    out |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {ord("’"): "'", ord("﹫"): "@"}
    # digits of other scripts
    return out | {c: str(unicodedata.digit(chr(c))) for base in (0x660, 0x6F0, 0x966) for c in range(base, base + 10)}


PLAIN = _table()
_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in PLAIN) + "]")
_BLANKS = re.compile(r"[^\S ]\s*| \s+")
_SPELLED = re.compile(r"(?<![^\W\d_])(?:(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + r")(?:[ -]|(?![^\W\d_]))){5,}", re.I)
_AT = r"(?: ?[\[({<] ?(?:at|arroba|arobase|ät) ?[\])}>] ?| AT |_(?:AT|at)_|-(?:AT|at)-| ?@ ?)"
_DOT = r"(?: ?[\[({<] ?(?:dot|punkt|punto|point) ?[\])}>] ?| DOT |_(?:DOT|dot)_|-(?:DOT|dot)-|\.)"
_LOCAL, _LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*?[A-Za-z0-9])?", r"[A-Za-z0-9](?:[A-Za-z0-9-]*?[A-Za-z0-9])?"
#: An address in disguise: either the at or a dot isn't plain. Both written as lower-case words, or either otherwise.
_DISGUISED = re.compile(rf"(?<![A-Za-z0-9._%+-])(?:{_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})+(?![A-Za-z0-9])|[A-Za-z0-9][A-Za-z0-9._%+-]*(?: dot [A-Za-z0-9][A-Za-z0-9._%+-]*)* at [A-Za-z0-9][A-Za-z0-9-]*(?: dot [A-Za-z0-9][A-Za-z0-9-]*)+)")
_BRACKETED_AT = re.compile(r"[\[({<] ?(?:at|arroba|arobase|ät)")
#: Any of these, or an at in brackets, is in every address in disguise.
_MAYBE_AT = ("@", " dot ", " AT ", "_AT_", "_at_", "-AT-", "-at-")


class Edits(NamedTuple):
    """Pieces of a text that were replaced: where each begins in the new and in the old text, and their lengths."""

    new: list[int]
    new_size: list[int]
    old: list[int]
    old_size: list[int]

    def old_place(self, at: int, end: bool) -> int:
        """The old place of a new character, or the place behind it. What was written anew has its origin as a whole."""
        k = bisect.bisect_right(self.new, at) - 1
        if k < 0:
            return at + end
        if at < self.new[k] + self.new_size[k]:
            return self.old[k] + self.old_size[k] * end
        return at - self.new[k] - self.new_size[k] + self.old[k] + self.old_size[k] + end


class Plain:
    """A text rewritten step by step, with the edits of each step."""

    def __init__(self, text: str):
        self.source, self.text = text, text
        self.edits: list[Edits] = []
        if not text.isascii() and _ODD.search(text):
            self.rewrite(_ODD, lambda m: PLAIN[ord(m[0])])
        self.rewrite(_BLANKS, lambda m: " ")
        # the rewritings that most texts don't need are tried only where their words occur
        words = self.text.lower().replace("-", " ").split()
        if not DIGITS.keys().isdisjoint(words) and sum(w in DIGITS for w in words) >= 4:
            self.rewrite(_SPELLED, self._digits)
        if any(x in self.text for x in _MAYBE_AT) or _BRACKETED_AT.search(self.text):
            self.rewrite(_DISGUISED, self._undisguised)

    @staticmethod
    def _digits(m: re.Match) -> str:
        words = re.findall(r"[^\W\d_]+", m[0])
        return "".join(DIGITS[w.lower()] for w in words) + (" " if m[0][-1] == " " else "")

    @staticmethod
    def _undisguised(m: re.Match) -> str:
        if " at " in m[0] and not re.search(_AT, m[0]):
            return m[0].replace(" at ", "@").replace(" dot ", ".")
        head, tail = re.split(_AT, m[0], maxsplit=1)
        return f"{head}@{re.sub(_DOT, '.', tail)}"

    def rewrite(self, pattern: re.Pattern, new) -> None:
        out, last, size, e = [], 0, 0, Edits([], [], [], [])
        for m in pattern.finditer(self.text):
            x = new(m)
            if x == m[0]:
                continue
            a, b = m.span()
            out += self.text[last:a], x
            size += a - last
            for column, v in zip(e, (size, len(x), a, b - a)):
                column.append(v)
            size += len(x)
            last = b
        if out:
            self.text = "".join(out) + self.text[last:]
            self.edits.append(e)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a plain span; its last character's whole origin is part of it."""
        a, z = start, end - 1
        for e in reversed(self.edits):
            a, z = e.old_place(a, False), e.old_place(z, True) - 1
        b = z + 1
        while b > a and self.source[b - 1].isspace():
            b -= 1
        return a, b


# --- detectors -------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9](?:[A-Za-z0-9._%+'-]*[A-Za-z0-9_+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![A-Za-z0-9@])")
_L, _R = r"(?<![\w.,/+-])", r"(?![\w]|[-/.,]\d)"
#: Shapes of national, tax, passport and card numbers (fixed formats).
ID = re.compile(_L + r"(?:\d{3}([- ])\d{2}\1\d{4}|\d{8}-[A-Z]|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{2} \d{3} \d{3} \d{3}|[A-Z]{2}\d{7})" + _R)
#: After these words a number of another shape is one, too.
ID_CUE = re.compile(r"(?i:\b(?:SSN(?: on file)?|social security (?:number|no\.)|(?:national|tax|passport|identity|insurance) (?:number|no\.|ID|card)(?: (?:number|no\.))?|ID no\.|Steuer-?(?:ID|nummer)|Ausweis(?:nummer|-Nr\.)|Reisepass|Personalausweis|documento de identidad|DNI|NIF|NIE|pasaporte|pièce d'identité(?: n°)?|numéro fiscal|passeport(?: n°)?|Ausweis|passport)(?: ?[:,]| is| lautet| ist| es| est)? )(?P<v>[A-Z0-9](?:[ -]?[A-Z0-9]){5,15})(?![\w])")
#: One of these is in every such cue, in lower case.
_ID_WORDS = "ssn;social sec;national;tax;passport;identity;insurance;id no.;steuer;ausweis;reisepass;documento de;dni;nif;nie;pasaporte;pièce d'id;numéro fiscal;passeport".split(";")
_SIX_DIGITS, _POSTCODE = re.compile(r"\d(?:[ ./()-]{0,3}\d){5}"), re.compile(r", \d{5} ")
PHONE = re.compile(
    r"(?<![\w.,/+-])(?:"
    r"\+\d{1,3}[ .-]?\([1-9]\d{1,3}\)(?:[ ./-]?\d{2,5}){2,4}|\+\d{1,3}[ .-]?(?:\(0\) ?)?\d{1,4}(?:[ ./-]\d{2,8}){1,5}|\+\d{8,14}"  # international
    r"|00\d{1,3}(?:[ .-]\d{1,4}){3,6}|00\d{2,3} \d{1,4} \d{5,8}|00\d{9,13}"
    r"|\(\d{3}\) ?\d{3}[ -]\d{4}|\d{3}([-.])\d{3}\1\d{4}"  # three, three and four digits
    r"|\(0[1-9]\d{1,3}\) ?\d{3,8}(?:[ -]\d{2,5})?|0[1-9]\d{0,3}[ /-]\d{3,8}(?:[ -]\d{2,5}){0,2}|0[1-9](?:[ .]\d{2}){4}|0[1-9]\d{8,9}"
    r")(?![\w]|[-/.,]\d)"
)
_W = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'A-ZÀ-ÖØ-Þ]*(?:-[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)*"
_TOWN = rf"(?P<town>{_W}(?: {_W}(?!\w))?)"
_OF = r"(?:(?:de la|de los|de las|de l'|del|des|du|de|d'|der|den|dem) ?)?"
_EN = rf"\d{{1,5}}[A-Za-z]? (?:{_W} ){{1,3}}(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Row|Avenue|Ave\.?|Drive|Dr\.?|Court|Ct\.?|Close|Way|Square|Terrace|Place|Boulevard|Blvd\.?)(?:,? (?:Apt\.?|Unit|Flat|Suite|Ste\.?|No\.) ?[\dA-Z]+|,? #\d+)?, {_TOWN}(?P<rest>,? [A-Z]{{2}} \d{{5}}(?:-\d{{4}})?| \d{{5}}|,? [A-Z]{{1,2}}\d[A-Z\d]? \d[A-Z]{{2}}(?!\w)|, [A-Z]{{2}}(?![A-Za-z]))?"
_FR = rf"\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:rue|quai|avenue|impasse|boulevard|place|allée|chemin|cours|route|passage|square) {_OF}{_W}(?: {_OF}{_W})*, \d{{5}} {_TOWN}"
_DE = rf"(?:[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer|hof|markt|stieg|pfad)|(?:[A-ZÄÖÜ][\wäöüß]+[ -])?(?:Straße|Str\.|Weg|Gasse|Platz|Allee|Ring)|(?:Am|Im|An der|Zum|Zur|Auf dem|In der|Unter den|Beim|Hinter dem) {_W}(?: {_W})?) \d{{1,4}} ?[a-z]?, \d{{5}} {_TOWN}"
_ES = rf"(?:Via|Viale|Piazza|Corso|Calle|Plaza|Avenida|Paseo|Camino|Ronda|Travesía|Carrera|C/|Avda\.) ?{_OF}{_W}(?: {_OF}{_W})*,? (?:n\.?º ?)?\d{{1,4}}(?:, (?:\d{{1,2}}\.?º ?(?:[A-Z]|dcha\.?|izq\.?)?|bajo|ático|entresuelo))?, \d{{5}} {_TOWN}"
# the first character is sought before what's in front of it is looked at, which is several times as fast
ADDRESS = tuple(re.compile(p) for p in (r"\d(?<![\w-]\d)" + _EN.replace(r"\d{1,5}", r"\d{0,4}", 1), r"\d(?<![\w-]\d)" + _FR.replace(r"\d{1,4}", r"\d{0,3}", 1), r"(?<![\w-])" + _DE, r"(?<![\w-])" + _ES))
#: What can't follow the first word of a sentence that stands behind a town.
_CLEAR = re.compile(r"[.,;:!?)\"]|$| ?\d")

_PART = r"(?:(?:de la|de|van der|van den|van|von|du|della|di|da|dos|DE LA|DE|VAN|VON|DU) )?"
_GIVEN = r"[A-ZÀ-ÖØ-Þ](?:[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+)(?:-[A-ZÀ-ÖØ-Þ](?:[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+))?"
_SUR = rf"{_PART}(?:[A-ZÀ-ÖØ-Þ]'|Mc|Mac)?{_GIVEN}"
_INIT = r"[A-ZÀ-ÖØ-Þ]\."
NAME = rf"(?:{_INIT}(?: ?{_INIT})* {_SUR}|{_SUR}, (?:{_GIVEN}|{_INIT})(?: {_INIT}(?! {_SUR}))*|{_GIVEN}(?: {_INIT})* {_SUR})"
_TITLE = r"(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Herrn|Frau|Mme|Mlle|Sr|Sra|Srta|Don|Doña|Señor|Señora|Monsieur|Madame)\.? )"
#: What stands before a name, in lower case (fixed phrases): thanks, greetings, senders and receivers, meetings.
CUES = (
    "thanks to;thank you;thank you,;dear;hello;hi;hey;ask;submitted by;checked by;sent by;written by;built by;signed by;reviewed by;posted by;photographed by;drawn by;designed by;signed:;from:;to:;cc:;by:;author:;contact:;kind regards,;kind regards;best regards,;best regards;regards,;regards;best,;sincerely,;sincerely;cheers,;yours,;yours truly,;at the club,;attn.;attn:;c/o;my friend;my name is;i am called;i met;we met;talked to;spoke with;spoke to;call;met with;according to;neighbour;neighbor;colleague;"
    "danke an;rückfragen an;gez.;grüße,;grüßen,;gruß,;liebe;lieber;hallo;sehr geehrte;sehr geehrter;eingereicht von;eingesandt von;vorschlag von;gebaut von;unterschrieben von;im club haben;im club hat;mein freund;meine freundin;ich heiße;mein name ist;kollege;kollegin;laut;"
    "merci à;proposé par;envoyé par;vérifié par;construit par;cher;chère;bonjour;signé;signé :;signé:;cordialement,;cordialement;au club,;mon ami;mon amie;je m'appelle;selon;amicalement,;"
    "gracias a;enviado por;propuesto por;revisado por;construido por;estimado;estimada;hola;firmado:;fdo.;saludos,;saludos;atentamente,;en el club,;mi amigo;mi amiga;me llamo;según;querido;querida"
)
CUES_BY_LAST: dict[str, list[str]] = {}
for _cue in CUES.split(";"):
    CUES_BY_LAST.setdefault(_cue.rpartition(" ")[2], []).append(_cue)
TITLES = frozenset("mr mrs ms miss dr prof herr herrn frau mme mlle sr sra srta don doña señor señora monsieur madame".split())
#: Given names that make the capitalised words behind them a person without any cue (fixed values, common ones).
GIVEN = frozenset(
    "Adam Alan Albert Alejandro Alice Amanda Amélie Amy Ana Andrea Andreas Andrew Angela Anna Anne Antoine Antonio Arthur Barbara Ben Benjamin Bernard Birgit Brian Camille Carla Carlos Carmen Caroline Catherine Céline Charles Charlotte Chloé Chris Christian Christine Claire Claudia Daniel David Diego Dieter Dominique Elena Élodie Elisabeth Elizabeth Emily Emma Enrique Eric Eva Fernando Florian François Frank Franz Frédéric Gabriel George Gerhard Gonzalo Grace Günter Hannah Hans Heike Heinrich Helen Helga Hélène Henri Henry Holger Ines Isabel Isabelle Jack Jacques James Jan Jane Javier Jean Jennifer Jens Jessica Joachim Johann Johannes John Jonas Jorge José Joseph Juan Julia Julie Julien Jürgen Karen Karin Karl Katharina Katrin Kevin Klaus Laura Lea Léa Linda Lisa Louis Louise Lucía Lukas Manfred Manon Manuel Marco Margaret María Maria Marie Mark Markus Marta Martin Martina Mary Matthew Matthias Max Michael Michel Miguel Monika Nathalie Nicolas Nicole Olivia Oliver Pablo Patrick Paul Paula Pedro Peter Petra Philippe Pierre Rachel Rafael Ralf Raúl Rebecca Richard Robert Rosa Ruth Sabine Samuel Sandra Sara Sarah Sergio Simon Sofía Sophie Stefan Stephen Susan Susanne Sylvie Thomas Tom Ursula Uwe Walter Werner William Wolfgang Yves".split()
)
NAMED = re.compile(rf"{NAME}(?![\w@])")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ](?<![\w'.@-][A-ZÀ-ÖØ-Þ])")
PARTICLES = frozenset("de van von du della di da dos".split())
_WORD = re.compile(r"[^\W\d_]+")
_SECOND = re.compile(rf" (?:and|und|et|y|&) (?:{_TITLE})?(?P<b>{NAME})(?![\w@])")
#: What only persons do, or an address in angle brackets, behind a name.
DOES = re.compile(r"[A-ZÀ-ÖØ-Þ][^\W\d_]*(?P<v> (?:(?=<\S)|(?:(?:has |have )?(?:rebuilt|wrote|asked|called|mailed|answered|reported|says|said|thinks|built|sorted|scanned|checked|lives|told)|hat (?:das|die|den)|schrieb|baute|sagte|wohnt|meinte|a (?:refait|reconstruit|écrit|construit|dit)|habite|pense|ha reconstruido|a rehecho|rehizo|reconstruyó|escribió|construyó|vive|dijo|dice) ))")
_BEFORE = re.compile(rf"(?:^|(?<=[^\w'.@-]))(?P<a>{NAME})$")
#: Names as signatures behind a dash, on their own line or before the next sentence.
SIGNED = re.compile(rf"[-–—]{{1,2}} (?P<a>{NAME})(?![\w@])")
#: Words of the four languages that begin sentences, and of headings and streets; they are no part of a name.
NOT_NAMES = frozenset("Write Call Text Thanks Dear Submitted Contact Questions Reply Merci Gracias Danke Bitte Llamar Appeler End Not Nothing One Sehr He She It We They You Er Sie Es Wir Elle Ils Nous Ella The This That These A An At In On By For With From If As And But Or To Note Sadly Oddly Looking Compared Step Please My Our Somebody Nobody Two Street Road Lane Row Avenue Tel Checksum Version Ref Order Seed Handle Turn See Die Der Das Im Am Ich Für La Le Les Il On El En Según Faltan Cette À".split())
_LOWERED = frozenset(w.lower() for w in NOT_NAMES)


def _person(name: str, other: frozenset[str] = frozenset()) -> bool:
    """Whether none of the words is one that can't be part of a name; other: more of those, in lower case."""
    words = [w.lower() for w in re.findall(r"[^\W\d_]{2,}", name)]
    return not any(w in _LOWERED or w in other for w in words if w not in ("de", "la"))


def _shouted(text: str, start: int, end: int) -> bool:
    """Whether a name in capitals is only part of a sentence in capitals."""
    if not text[start:end].isupper():
        return False
    before = re.findall(r"[^\W\d_]{2,}", re.split(r"[.!?;…] ", text[max(0, start - 60) : start])[-1])[-3:]
    after = re.findall(r"[^\W_]+", text[end : end + 60])[:3]
    return any(len(words) == 3 and all(w.isupper() or w.isdigit() for w in words) for words in (before, after))


TAIL = -2


class Span(NamedTuple):
    """A piece of personal information in the source. An address whose town may be one word or two has both ends, the
    two words, and what is to be taken if the lexicon has neither. A name that may begin with the second of them has
    TAIL for a shorter end, and is none if the address is the longer one."""

    start: int
    end: int
    kind: str
    short: int = -1
    town: str = ""
    long: bool = True
    proven: bool = False  # nothing can belong to the town's name but the town


def _addresses(p: str) -> Iterator[tuple[int, int, int, str, bool, bool]]:
    """(start, end, shorter end or -1, town, long by default, proven)."""
    for pattern in ADDRESS if _POSTCODE.search(p) else ADDRESS[:1]:
        for m in pattern.finditer(p):
            first, _, second = m["town"].partition(" ")
            rest, clear = bool(m.groupdict().get("rest")), bool(_CLEAR.match(p, m.end("town")))
            if rest or not second:
                yield m.start(), m.end(), -1, m["town"], True, rest or clear
            else:
                yield m.start(), m.end(), m.start("town") + len(first), m["town"], clear or second.lower() not in _LOWERED, clear


def _cued(p: str, start: int) -> bool:
    """Whether a cue or a title ends just before a word."""
    if start < 2 or p[start - 1] != " ":
        return False
    word = p[p.rfind(" ", 0, start - 1) + 1 : start - 1].lower().lstrip("\"'([«„“")
    if word.rstrip(".") in TITLES:
        return True
    for cue in CUES_BY_LAST.get(word, ()):
        a = start - 1 - len(cue)
        if a >= 0 and p[a : start - 1].lower() == cue and (a == 0 or not (p[a - 1].isalnum() or p[a - 1] == "_")):
            return True
    return False


def _names(p: str, other: frozenset[str]) -> Iterator[tuple[int, int]]:
    """Places of names, by their cues, signatures, deeds and given names; some more than once."""
    behind = 0
    for m in _CAPITAL.finditer(p):
        at = m.start()
        if at < behind:
            continue
        word = _WORD.match(p, at)[0]
        if word.lower() in TITLES:
            continue
        cued = _cued(p, at)
        if not cued and at > 3 and p[at - 1] == " ":  # a particle may come first
            before = p.rfind(" ", 0, at - 1) + 1
            if p[before : at - 1] in PARTICLES and _cued(p, before):
                at, cued = before, True
        if not cued and word not in GIVEN:
            continue
        n = NAMED.match(p, at)
        if n and _person(n[0], other) and not _shouted(p, *n.span()):
            if not cued and (word in n[0].partition(",")[2] or _PLACE.match(p, n.end())):
                continue
            yield n.span()
            behind = n.end()
            if cued and (second := _SECOND.match(p, behind)) and _person(second["b"], other) and not _shouted(p, *second.span("b")):
                yield second.span("b")
    for m in SIGNED.finditer(p):
        at = m.start()
        if (at == 0 or p[at - 1] in " .!?;…" or p[max(0, at - 2) : at] == "--") and _person(m["a"], other) and not _shouted(p, *m.span("a")):
            yield m.span("a")
    for m in DOES.finditer(p):
        n = _BEFORE.search(p, max(0, m.start("v") - 60), m.start("v"))
        while n:  # the longest first; shorter ones count where it runs into another span
            if _person(n["a"], other) and not _shouted(p, *n.span("a")):
                yield n.span("a")
            n = _BEFORE.search(p, n.start() + 1, m.start("v"))


#: What makes the words before it a place.
_PLACE = re.compile(r",? (?:Street|St\.|Road|Rd|Lane|Avenue|Ave|Drive|Court|Square|Bridge|School|Church|Hall|Park|Castle|House|Museum|Station)\b")


def detect(text: str, other: frozenset[str] = frozenset()) -> list[Span]:
    """All personal information in the source text, in order and without overlaps. other: words, in lower case, that
    are no names here, such as those of a catalogue."""
    plain = Plain(text)
    p = plain.text
    found: list[tuple] = []

    def add(start: int, end: int, kind: str, *more) -> None:
        for f in found:
            if start < f[1] and end > f[0]:
                if len(f) < 5 or f[3] < 0 or start < f[3] or more:
                    return
                more = TAIL, f[4], f[5], False
        found.append((start, end, kind, *more))

    if "@" in p:
        for m in EMAIL.finditer(p):
            add(*m.span(), "email")
    if _DIGIT.search(p):
        for start, end, short, *more in _addresses(p):
            add(start, end, "address", short, *more)
        low = p.lower()
        if any(w in low for w in _ID_WORDS):
            for m in ID_CUE.finditer(p):
                if sum(c.isdigit() for c in m["v"]) >= 5 and not any(m.end("v") > f[0] and m.start("v") < f[1] for f in found):
                    shape = ID.match(p, m.start("v"))
                    add(*(shape.span() if shape else m.span("v")), "id_number")
        if _SIX_DIGITS.search(p):
            for m in ID.finditer(p):
                add(*m.span(), "id_number")
            for m in PHONE.finditer(p):
                add(*m.span(), "phone")
    for span in _names(p, other):
        add(*span, "name")
    out = []
    for start, end, kind, *more in sorted(found):
        a, b = plain.span(start, end)
        out.append(Span(a, b, kind, *([plain.span(start, more[0])[1] if more[0] >= 0 else more[0], *more[1:]] if more else [])))
    return out


_DIGIT = re.compile(r"\d")


def resolved(spans: list[Span], towns: frozenset[str] | set[str]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of spans, with the towns of a lexicon."""
    whole = lambda s: s.town in towns or (s.long and s.town.partition(" ")[0] not in towns)
    return [(s.start, s.short if s.short >= 0 and not whole(s) else s.end, s.kind) for s in spans if s.short != TAIL or not whole(s)]


def value(text: str) -> str:
    return re.sub(r"\s+", " ", text)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a placeholder such as [EMAIL] for each span, all else unchanged."""
    out, last = [], 0
    for a, b, kind in spans:
        out += text[last:a], f"[{kind.upper()}]"
        last = b
    return "".join(out) + text[last:]


# --- Spark -----------------------------------------------------------------------------------------------------


SPAN = "array<struct<start:int,end:int,kind:string,short:int,town:string,long:boolean,proven:boolean>>"


def catalogue_words(parts: DataFrame) -> frozenset[str]:
    """The words of part names: as many as a vocabulary has, whatever the documents."""
    words = parts.select(F.explode(F.split(F.lower("name"), r"[^\p{L}]+")).alias("w")).where(F.length("w") > 2).distinct()
    return frozenset(r["w"] for r in words.toLocalIterator())


def _detected(docs: DataFrame, key: str, text: str, parts: DataFrame | None, with_value: bool) -> DataFrame:
    """key, h (the text's hash), spans of each document that has any, and their values; checkpointed."""
    x = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    other = docs.sparkSession.sparkContext.broadcast(catalogue_words(parts) if parts is not None else frozenset())
    kind = x.schema["key"].dataType.simpleString()
    fields = [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("short", pa.int32()), ("town", pa.string()), ("long", pa.bool_()), ("proven", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            found = [detect(t, other.value) for t in texts]
            at = [k for k, s in enumerate(found) if s]
            counts = np.array([len(found[k]) for k in at], dtype=np.int32)
            all_ = [s for k in at for s in found[k]]
            struct = pa.StructArray.from_arrays([pa.array([s[i] for s in all_], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            take = pa.array(at, pa.int64())
            out = [b.column(0).take(take), b.column(1).take(take), pa.ListArray.from_arrays(offsets, struct)]
            if with_value:
                values = [(value(texts[k][s.start : s.end]), value(texts[k][s.start : s.short]) if s.short >= 0 else None) for k in at for s in found[k]]
                out += [pa.ListArray.from_arrays(offsets, pa.array([v[i] for v in values], pa.string())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(out, names=["key", "h", "spans", "values", "shorts"][: len(out)])

    schema = f"key {kind}, h bigint, spans {SPAN}" + ", values array<string>, shorts array<string>" * with_value
    return checkpointed(spread(x).mapInArrow(run, schema))


def lexicon(spans: DataFrame) -> DataFrame:
    """town: the towns that are proven often enough; of two words those that aren't a town and a sentence's first word,
    which are much rarer than the town. spans: town, proven of each address."""
    n = spans.where("proven and town <> ''").groupBy("town").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN)
    one = n.where(~F.col("town").contains(" ")).select(F.col("town").alias("first"), F.col("n").alias("n_first"))
    x = n.withColumn("first", F.when(F.col("town").contains(" "), F.substring_index("town", " ", 1))).join(one, "first", "left")
    return x.where(F.coalesce(F.col("n") * RARER > F.col("n_first"), F.lit(True))).select("town")


def _ended(rows: DataFrame) -> DataFrame:
    """rows with `whole`: whether the span's longer end is right. Only the doubtful ones meet the lexicon, by town."""
    towns = lexicon(rows.where("kind = 'address'"))
    doubtful = rows.where("short <> -1")
    pairs = doubtful.select("town", F.substring_index("town", " ", 1).alias("first"), "long").distinct()
    known = pairs.join(towns.select("town", F.lit(True).alias("is_town")), "town", "left").join(towns.select(F.col("town").alias("first"), F.lit(True).alias("is_first")), "first", "left")
    known = known.select("town", "long", (F.col("is_town").isNotNull() | (F.col("long") & F.col("is_first").isNull())).alias("whole"))
    # names that are part of the town aren't names
    settled = doubtful.join(known, ["town", "long"]).where(f"short <> {TAIL} or not whole").withColumn("whole", F.col("whole") | (F.col("short") == TAIL))
    return rows.where("short = -1").withColumn("whole", F.lit(True)).unionByName(settled.select(*rows.columns, "whole"))


def spans(docs: DataFrame, key: str, text: str, parts: DataFrame | None = None) -> DataFrame:
    """key, kind, start, end, value of each occurrence; places are characters of the source. Null keys or texts give
    none. parts: a catalogue whose words are no names."""
    x = _detected(docs, key, text, parts, True).select("key", F.explode(F.arrays_zip("spans", "values", "shorts")).alias("s")).select("key", "s.spans.*", "s.values", "s.shorts")
    x = _ended(x)
    return x.select("key", "kind", "start", F.when(F.col("whole"), F.col("end")).otherwise(F.col("short")).alias("end"), F.when(F.col("whole"), F.col("values")).otherwise(F.col("shorts")).alias("value"))


def found(docs: DataFrame, key: str, text: str, parts: DataFrame | None = None) -> DataFrame:
    """key, kind, value: one row for each distinct value of a document. Null keys or texts give none."""
    return spans(docs, key, text, parts).select("key", "kind", "value").distinct()


def redact(docs: DataFrame, key: str, text: str, parts: DataFrame | None = None) -> DataFrame:
    """key, text, n_found: each text with typed placeholders; rows of a repeated key are redacted each."""
    x = _detected(docs, key, text, parts, False).select("key", "h", F.explode("spans").alias("s")).select("key", "h", "s.*").distinct()
    x = _ended(x).select(F.col("key").alias("k"), F.col("h").alias("kh"), F.struct("start", F.when(F.col("whole"), F.col("end")).otherwise(F.col("short")).alias("end"), "kind").alias("s"))
    per = x.groupBy("k", "kh").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    all_ = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    all_ = all_.withColumn("h", F.xxhash64("text"))
    both = all_.join(per, (all_["key"] == per["k"]) & (all_["h"] == per["kh"]), "left").select("key", "text", "spans")
    kind = both.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [[(r["start"], r["end"], r["kind"]) for r in rows or ()] for rows in b.column(2).to_pylist()]
            out = [redacted(t, x) for t, x in zip(b.column(1).to_pylist(), s)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array([len(x) for x in s], pa.int32())], names=["key", "text", "n_found"])

    return both.mapInArrow(run, f"key {kind}, text string, n_found int")
