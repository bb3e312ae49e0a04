"""Personal information in free text: spans, and texts with typed placeholders.

Patterns propose spans, validators (Luhn, mod 97, control letters) raise or lower their score, and so do words around
them. A span counts from a threshold on; of overlapping spans the better one stays.

Identity numbers: a word that names a document (passport, tax number) gives 0.6, a bare "ID" or "number" 0.4, none 0; a known
national form adds 0.2; a control that holds adds 0.3 and one that fails takes 0.3 away. So a control decides wherever no
word names the document, or the form is not a known one. Persons: a known given name gives 0.6; two capitalised words that
are no common words give 0.2, to which a word that leads up to a name (thanks to, dear, met) or personal information
right behind it adds 0.35; an article before or a number behind takes 0.5 away.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "identity", "address", "person")

# Given names that are common in the texts' languages.
GIVEN_NAMES = frozenset(
    """
    Adam Ahmed Aiko Alejandro Alexander Alice Alina Amelie Amina Ana Anders Andrea Andreas Angela Anita Anna Anne Anouk Anton Antonio Arthur Astrid Barbara
    Beatriz Ben Bernard Bjorn Brigid Camille Carla Carlos Carmen Caroline Catherine Charlotte Chloe Christian Claire Clara Claudia Daniel Daniela Dario David
    Diego Dmitri Elena Elin Elisa Elizabeth Ella Emily Emma Erik Eva Fatima Felix Fernando Florian Francois Frank Freya Gabriel George Grace Hana Hannah Hans
    Helena Henry Hugo Ibrahim Ilse Ines Ingrid Irina Isabel Ivan Jack Jan Javier Jean Jonas Jose Juan Julia Julie Karin Karl Katarina Kenji Kevin Kofi Lars
    Laura Leila Lena Leo Lina Lisa Louis Lucas Lucia Luis Lukas Manuel Marco Maria Marie Marta Martin Mateo Max Maya Mehmet Mia Michael Miguel Mohammed Monika
    Nadia Natalia Nils Nina Noah Olga Oliver Olivia Omar Oscar Pablo Patricia Paul Pavel Pedro Peter Petra Philip Pierre Priya Rachel Rafael Robert Rosa Ruben
    Salome Samuel Sara Sarah Sofia Sophie Stefan Sven Tariq Thomas Tomasz Victor Wei Yuki Yusuf Zoe
    """.split()
)

_CAP = r"\p{Lu}[\p{L}'’]*\p{Ll}[\p{L}'’]*"
_UP = r"\p{Lu}[\p{Lu}'’]+"
_PARTICLE = r"(?:(?:van(?: der| den)?|von|de|del|de la|di|da|du|le|bin|al)\s)"
_NAME = rf"(?:{_CAP}|{_UP})(?:-(?:{_CAP}|{_UP}))*"
_AT = r"(?:\s?@\s?|\s?[\[(]\s?(?:at|arroba|ät|chez)\s?[\])]\s?|\s+(?:at|arroba)\s+(?=[\w-]+(?:\s+(?:dot|punto|point|punkt)\s+[\w-]+)+))"
_DOT = r"(?:\.|\s?[\[(]\s?(?:dot|punto|point|punkt)\s?[\])]\s?|\s+(?:dot|punto|point|punkt)\s+)"

EMAIL = regex.compile(rf"(?<![\w.+-])[\p{{L}}\p{{N}}_%+-]+(?:\.[\p{{L}}\p{{N}}_%+-]+)*{_AT}[\p{{L}}\p{{N}}-]+(?:{_DOT}[\p{{L}}\p{{N}}-]*\p{{L}}[\p{{L}}\p{{N}}-]*)+", regex.I)
#: What every address has: the alternatives of ``_AT``.
_HAS_AT = regex.compile(r"@|[\[(]\s?(?:at|arroba|ät|chez)\s?[\])]|\s(?:at|arroba)\s+[\w-]+\s+(?:dot|punto|point|punkt)\s", regex.I)

_EXT = r"(?:,?\s?(?:ext\.?|x|extension|durchwahl|poste|int\.)\s?\d{1,5}\b)?"
#: Pattern and how sure it is without any word that speaks of calling; the first that fits counts.
_PHONES = (
    (r"\+\d{1,3}(?:[ .\-/]?\(0?\d{0,4}\))?(?:[ .\-/]?\d{1,8}){1,6}", 0.8),
    (r"00[1-9]\d{0,2}[ .\-/]?(?:\(0\)[ .\-/]?)?\d{1,5}(?:[ .\-/]\d{2,8}){1,5}", 0.7),
    (r"\(\d{2,5}\)[ .\-/]?\d{3,4}[ .\-]?\d{3,5}", 0.7),
    (r"0[1-9](?:[ .\-]\d{2}){4}", 0.7),
    (r"(?:1[ .\-])?[2-9]\d{2}(?: \d{3} |\.\d{3}\.|-\d{3}-)\d{4}", 0.6),
    (r"0[1-9]\d{1,4}[ /\-]\d{5,9}(?:-\d{1,4})?", 0.6),
    (r"0[1-9]\d{1,3}(?:[ .\-]\d{2,4}){3,4}", 0.6),
    (r"1[2-9]\d{9}", 0.5),
    (r"\d{10,13}", 0.2),
)
PHONE = regex.compile(rf"(?<![\w#+.,/-])(?=[+(\d])(?:{'|'.join(f'(?:{p}){_EXT}(?![\\w]|[-/.]\\d)(?P<k{i}>)' for i, (p, _) in enumerate(_PHONES))})", regex.I)
_CALL = regex.compile(
    r"\b(?:tel|tél|telephone|teléfono|telefon|phone|call|mobile|mobil|cell|fax|text|sms|whatsapp|ring|rang|reach|anruf\w*|unter|appel\w*|téléphone\w*|llam\w*|contact|kontakt|hotline|móvil|portable|handy)\b",
    regex.I,
)
_NOT_CALL = regex.compile(r"\b(?:order|bestellung|commande|pedido|tracking|sendung|colis|envío|batch|charge|serial|spare code|model\w*|modell|modèle|modelo|code|isbn|ean|sku|invoice|rechnung|paid|pagué|payé|preis)\b[^.!?]{0,12}$", regex.I)

#: Words that name a document of a person, and words that may.
_CUE = (
    r"passport|passeport|pasaporte|passaporto|paspoort|reisepass\w*|(?:personal)?ausweis\w*|steuer(?:nummer|-?id\w*|identifikationsnummer)|sozialversicherungs\w*|rentenversicherungs\w*"
    r"|national(?:\s+id(?:entity)?|\s+insurance)(?:\s+(?:card|number))?|id(?:entity)?\s+card|carte\s+d['’]identité|carta\s+d['’]identità|documento\s+de\s+identidad|cédula"
    r"|(?:numéro|número)\s+(?:fiscal|de\s+sécu\w*|de\s+la\s+seguridad\s+social|de\s+identi\w+)|sécurité\s+sociale|seguridad\s+social|codice\s+fiscale|burgerservicenummer|bsn"
    r"|social\s+security(?:\s+(?:number|no))?|ssn|tax(?:payer)?\s+(?:id|number|no|code)|tin|dni|nie|nif|cif|nir|iban|driv(?:er['’]?s?|ing)\s+licen[cs]e|führerschein\w*"
)
_WEAK_CUE = r"id(?:entity)?\s+number|ID|id(?=\s?[:#.])"
_VALUE = r"(?:[A-Z]{1,3}[- ]?)?\d[\dA-Z]*+(?:[-/ .](?=[\dA-Z]*\d)[\dA-Z]++|[-/ .]?[A-Z]{1,2}(?![\p{L}\d]))*"
IDENTITY = regex.compile(
    rf"(?<![\p{{L}}\d])(?:(?P<named>(?i:{_CUE}))|{_WEAK_CUE})(?![\p{{L}}\d])(?i:[\s:#.,(\"'«-]*(?:(?:is|was|card|number|no|nr|nº|n°|num|número|numéro|nummer|lautet|es|est|ist|è)(?![\p{{L}}\d])[\s:#.,°º(-]*)*)(?P<v>{_VALUE})"
)
#: Words, or else parts of words, in lower case, of which every cue has one.
_CUE_WORDS = frozenset({"id", "tin", "nie", "nif", "cif", "nir", "bsn", "ssn", "dni", "iban"})
_CUE_PARTS = (
    "passp", "passe", "pasap", "passa", "paspo", "reisepass", "ausweis", "steuer", "versicherung", "national id", "national insurance", "identi", "cédula", "numéro ", "número ", "sécu", "segur", "codice", "burger", "social", " tax", "licen", "führer",
)
#: Values whose own form says what they are, without a word before them: a control decides.
IBAN = regex.compile(r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[\dA-Z]{4}){2,7}(?: ?[\dA-Z]{1,4})?(?![\p{L}\d])")
CARD = regex.compile(r"(?<![\p{L}\d#-])(?:\d{4}[ -]){3}\d{4}(?![\p{L}\d-])")

_NO = r"\d{1,5}(?:\s?[a-zA-Z](?![\p{L}]))?"
_WORDS = rf"(?:{_NAME}\s){{0,2}}{_NAME}"
_FLAT = r"(?:(?:flat|apt\.?|apartment|unit|suite|wohnung|appartement|appt\.?|piso)\s?#?\w{1,4}(?:,?\s|\s?/\s?))?"
# Words that open the next sentence where a full stop is missing.
_OPENERS = r"(?:Les?|La|L|Une?|Mon|Ma|Mes|Je|Nous|Très|Merci|Cordialement|On|Elle|Ils?|À|Et|Mais|Pour|Avec|Il)(?![\p{L}])"
_STREET = r"(?:street|st|road|rd|lane|ln|avenue|ave|drive|dr|court|ct|way|close|place|pl|terrace|boulevard|blvd|square|sq|crescent|row|walk|gardens|grove|hill|mews|parade)"
#: Pattern, how sure it is, and what a text with a match has, in lower case and without marks: one of some words, and a word with
#: one of some ends.
_NONE: frozenset[str] = frozenset()
_GERMAN = ("straße", "strasse", "str", "weg", "platz", "gasse", "allee", "ring", "damm", "ufer", "hof", "markt")
_DUTCH = ("straat", "laan", "gracht", "plein", "kade", "steeg")
_LAND = ("berg", "bach", "wald", "graben", "tor", "feld", "park")
_TAILS = (*_GERMAN, *_LAND, *_DUTCH)
_AT_PLACE = frozenset({"am", "an", "im", "in", "zum", "zur", "auf", "unter"})
ADDRESSES = tuple(
    (regex.compile(p), s, frozenset(own), ends)
    for p, s, own, ends in (
        (rf"(?<![\w#-])(?i:{_FLAT})(?<![\w#.,-]){_NO}\s{_WORDS}\s(?i:{_STREET})(?![\p{{L}}\d])", 0.7,
         _STREET[3:-1].split("|"), ()),
        (rf"(?<![\w#-]){_NO}(?:\s(?i:bis|ter|quater))?,?\s(?i:rue|avenue|av\.|boulevard|bd|place|chemin|impasse|allée|quai|cours|route|square|passage)\s(?i:(?:de\s(?:la\s|l['’])?|du\s|des\s|d['’]))?{_NAME}(?:\s(?!{_OPENERS}){_NAME})?", 0.8,
         "rue avenue av boulevard bd place chemin impasse allée quai cours route square passage".split(), ()),
        (rf"(?<![\w#-])(?i:calle\s|c/\s?|avenida\s|avda\.?\s|av\.\s?|plaza\s|paseo\s|camino\s|ronda\s|carrera\s|travesía\s)(?i:(?:de\s(?:la\s|las\s|los\s)?|del\s))?{_WORDS},?\s(?:(?i:n\.?º)\s?)?{_NO}", 0.8,
         "c av calle avenida avda plaza paseo camino ronda carrera travesía".split(), ()),
        (rf"(?<![\w#-])(?:{_CAP}[\s-])?\p{{Lu}}[\p{{L}}'’]*?(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm|ufer|hof|markt)\s{_NO}", 0.8, _NONE, _GERMAN),
        (rf"(?<![\w#-])(?:{_UP}[\s-])?\p{{Lu}}[\p{{Lu}}ß]*(?:STRASSE|STRAßE|STR\.|WEG|PLATZ|GASSE|ALLEE|RING|DAMM|UFER|HOF)\s{_NO}", 0.8, _NONE, _GERMAN),
        (rf"(?<![\w#-])(?i:am|an\sder|an\sden|im|in\sder|zum|zur|auf\sdem|auf\sder|unter\sden)\s{_NAME}(?<=(?i:hof|weg|platz|gasse|allee|ring|damm|ufer|markt|berg|bach|wald|graben|tor|feld|park|straße|strasse))\s{_NO}", 0.9, _AT_PLACE, (*_GERMAN, *_LAND)),
        (rf"(?<![\w#-])(?:Am|An der|Im|Zum|Zur|Auf dem)\s{_NAME}\s\d{{1,4}}[a-z]?(?=,)", 0.6, _AT_PLACE, ()),
        (rf"(?<![\w#-])(?i:via|viale|piazza|corso|largo|rua|avenida|travessa)\s(?i:(?:d[aeio]{{1,2}}|d[eo]s|della|dei|delle)\s)?{_WORDS},?\s{_NO}", 0.7,
         "via viale piazza corso largo rua avenida travessa".split(), ()),
        (rf"(?<![\w#-])\p{{Lu}}[\p{{L}}'’]*?(?:straat|laan|gracht|plein|kade|steeg)\s{_NO}", 0.8, _NONE, _DUTCH),
    )
)

PERSON = regex.compile(rf"(?<![\p{{L}}\d@._'’-])(?P<given>{_NAME})\s(?:\p{{Lu}}\.\s){{0,2}}(?P<particle>{_PARTICLE}|(?i:{_PARTICLE}))?(?P<family>(?:[OD]['’])?{_NAME})(?![\p{{L}}\d@])")
#: Words that lead up to a name.
_BEFORE_PERSON = regex.compile(
    r"\b(?:thanks to|thank you|thank|thanks|ask(?:ed)? for|signed(?: by)?|dear|hello|hi|mr|mrs|ms|dr|prof|neighbou?r|colleague|sister|brother|friend|husband|wife|manager|mother|father|refund for|reply to|regards|yours|cheers|sincerely|best|love"
    r"|met|told|spoke (?:to|with)|talked to|named|called|attn|name is|merci à|bonjour|cher|chère|cordialement|amicalement|bien à vous|madame|monsieur|mme|rencontré|voisine?|collègue|je m['’]appelle|gracias a|gracias|hola|estimad[oa]|saludos|atentamente"
    r"|señora?|sra?|llamad[oa]|vecin[oa]|me llamo|conocí a|frau|herrn?|hallo|gruß|grüße|danke an|danke|liebe|lieber|heiße|nachbarin?|kollegin?|getroffen|grazie a|gentile|signora?|cordiali saluti|mi chiamo|dank aan|beste|groeten|mevrouw|meneer|ik heet"
    r"|obrigad[oa] a|atenciosamente|senhora?|chamo-me)\b\.?,?:?\s*$",
    regex.I,
)
#: Articles and the like: what follows is a thing.
_ARTICLE = regex.compile(r"\b(?:a|an|the|this|that|my|our|your|der|die|das|den|dem|des|ein|eine[nmrs]?|mein(?:e[nmrs]?)?|le|la|les|un|une|mon|ma|el|los|las|una|mi|il|lo|gli|uno|het|een|de|o|os|as|um|uma)\s+$", regex.I)


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """The control digit of payment cards and of many national numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(value: str) -> bool:
    """The control of ISO 13616 account numbers."""
    v = value.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


# Letters of the Spanish control (number mod 23).
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"
#: Known national forms, on values without blanks, hyphens, dots and slashes; and the control that a form has.
_FORMS = tuple(
    (regex.compile(p), check)
    for p, check in (
        (r"[A-Z]{2}\d{2}[\dA-Z]{11,30}", mod97),
        (r"\d{8}[A-Z]", lambda v: _DNI[int(v[:8]) % 23] == v[8]),
        (r"[XYZ]\d{7}[A-Z]", lambda v: _DNI[int(str("XYZ".index(v[0])) + v[1:8]) % 23] == v[8]),
        (r"[12]\d{4}(?:\d{2}|2[AB])\d{8}", lambda v: (int(v[:13].replace("2A", "19").replace("2B", "18")) + int(v[13:])) % 97 == 0),
        (r"[A-Z]{2}\d{6}[A-Z]", None), (r"\d{9}", None), (r"\d{10,12}", None), (r"[A-Z]\d{7,8}", None), (r"[A-Z]\d{2}[A-Z]\d{2}[A-Z]\d{2,4}", None),
        (r"[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ\d]{8}\d?", None), (r"[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]", None),
    )
)
_CONTROLLED = _FORMS[:4]


def _identity_score(value: str, named: bool) -> float:
    """Score of a value after a word that names a document (``named``) or may do so."""
    v = regex.sub(r"[-/ .]", "", value).upper()
    digits = sum(c.isdigit() for c in v)
    if not 5 <= digits <= 24:
        return 0.0
    score = 0.6 if named else 0.4
    form = next((f for f in _FORMS if f[0].fullmatch(v)), None)
    if form is not None:
        score += 0.2
        if form[1] is not None:
            score += 0.3 if form[1](v) else -0.3
    elif v.isdigit() and digits >= 8:
        score += 0.3 if luhn(v) else -0.3 * (not named)
    return score - 0.4 * (len(set(v)) == 1)


def _numbers(text: str, low: str, bag: set[str], found: list[Span]) -> None:
    """Phone and identity numbers of a text that has digits."""
    if _DIGITS.search(text):
        for m in PHONE.finditer(text):
            digits = sum(c.isdigit() for c in _EXT_END.sub("", m.group()))
            if 8 <= digits <= 16:
                before, after = text[max(0, m.start() - 32) : m.start()], text[m.end() : m.end() + 24]
                score = _PHONES[int(m.lastgroup[1:])][1] + 0.4 * bool(_CALL.search(before) or _CALL_AFTER.match(after)) - 0.5 * bool(_NOT_CALL.search(before))
                found.append(Span("phone", m.start(), m.end(), min(score, 0.95)))
        for m in IBAN.finditer(text):
            if mod97(m.group()):
                found.append(Span("identity", m.start(), m.end(), 1.0))
        for m in CARD.finditer(text):
            if luhn(regex.sub(r"\D", "", m.group())):
                found.append(Span("identity", m.start(), m.end(), 0.9))
        for m in CONTROLLED.finditer(text):
            v = regex.sub(r"[-/ .]", "", m.group())
            if any(f.fullmatch(v) and check(v) for f, check in _CONTROLLED[1:]) and not _NOT_CALL.search(text[max(0, m.start() - 32) : m.start()]):
                found.append(Span("identity", m.start(), m.end(), 0.6))
    if not bag.isdisjoint(_CUE_WORDS) or any(k in low for k in _CUE_PARTS):
        for m in IDENTITY.finditer(text):
            found.append(Span("identity", m.start("v"), m.end("v"), _identity_score(m["v"], m["named"] is not None)))


def _addresses(text: str, bag: set[str], found: list[Span]) -> None:
    tails = [w for w in bag if w.endswith(_TAILS)]
    for pattern, base, own, ends in ADDRESSES:
        if (not own or not bag.isdisjoint(own)) and (not ends or any(w.endswith(ends) for w in tails)):
            for m in pattern.finditer(text):
                found.append(Span("address", m.start(), m.end(), base))


def _emails(text: str, found: list[Span]) -> None:
    """Each at-sign, spelled out or not, is looked at from the start of the word before it."""
    end = 0
    for m in _HAS_AT.finditer(text):
        a = m.start()
        while a and text[a - 1].isspace():
            a -= 1
        while a > end and (text[a - 1].isalnum() or text[a - 1] in "_%+-."):
            a -= 1
        e = EMAIL.match(text, a)
        if e:
            found.append(Span("email", e.start(), e.end(), 1.0))
            end = e.end()


def _persons(text: str, found: list[Span], given_names: frozenset[str]) -> None:
    starts = [s.start for s in found if s.score >= 0.5]
    ends = [s.end for s in found if s.kind == "address"]
    for m in PERSON.finditer(text, overlapped=True):
        given, particle, family = m.group("given", "particle", "family")
        if particle and particle.isupper() and not given.isupper():
            continue
        if given.title() in _COMMON or family.title() in _COMMON:
            continue
        a, z = m.span()
        known = given.title() in given_names or given.split("-")[0].title() in given_names
        before = text[max(0, a - 24) : a]
        led = bool(_BEFORE_PERSON.search(before))
        # Personal information right behind: after a comma, a bracket, "at", or a word for a phone or document.
        follows = _BEHIND.match(text, z)
        close = bool(follows) and any(follows.start() < k <= follows.end() for k in starts)
        if close and not known and any(k <= a <= k + 40 for k in ends):
            continue  # the place that an address goes on with
        score = 0.6 * known + 0.35 * led + 0.35 * close
        if score == 0:
            continue
        score += 0.2 * (not known)
        if _THING_BEHIND.match(text, z) or (not led and _ARTICLE.search(before)):
            score -= 0.5
        found.append(Span("person", a, z, score))


def find(text: str | None, given_names: frozenset[str] = GIVEN_NAMES, threshold: float = 0.5) -> list[Span]:
    """Spans of personal information in order, without overlaps; positions in code points. Null and empty text has none."""
    if not text:
        return []
    found: list[Span] = []
    words = _WORD.findall(text.lower())  # only to see quickly what cannot be there
    low, bag = f" {' '.join(words)} ", set(words)
    if "@" in text or not bag.isdisjoint(_AT_WORDS):
        _emails(text, found)
    if _DIGIT.search(text):
        _numbers(text, low, bag, found)
        _addresses(text, bag, found)
    _persons(text, found, given_names)
    out: list[Span] = []
    taken: list[tuple[int, int]] = []  # disjoint, in order
    for s in sorted((s for s in found if s.score >= threshold), key=lambda s: (-s.score, KINDS.index(s.kind), s.start - s.end, s.start)):
        i = bisect.bisect_left(taken, (s.start, s.end))
        if (i == 0 or taken[i - 1][1] <= s.start) and (i == len(taken) or taken[i][0] >= s.end):
            taken.insert(i, (s.start, s.end))
            out.append(s)
    return sorted(out, key=lambda s: s.start)


_DIGIT, _DIGITS = regex.compile(r"\d"), regex.compile(r"\d(?:\D{0,3}\d){6}")
_AT_WORDS = frozenset({"at", "arroba", "ät", "chez"})
_WORD = re.compile(r"[^\W_]+")
_EXT_END = regex.compile(rf"{_EXT}$", regex.I)
_CALL_AFTER = regex.compile(r"\s?(?:anrufen|back\b|gern\b|any evening|\(?mobil)")
#: Numbers that a control can confirm without a word before them.
CONTROLLED = regex.compile(r"(?<![\p{L}\d#.,/-])(?:\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|[12] ?\d{2} ?\d{2} ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3} ?\d{2})(?![\p{L}\d-])")
_BEHIND = regex.compile(r"(?:,|\s?[(–-]|:|\sat|\sunter|\sà)?\s{0,2}(?:\(?(?:id|mail|e-?mail|tel|tél|phone|dni|passport|ausweis)\b[.:]?\s?(?:no\.?|nr\.?)?\s?)?", regex.I)
_THING_BEHIND = regex.compile(r"\s\d")


# Capitalised words that are no names: sentence openers, courtesy, days, trade and contact words.
_COMMON = frozenset(
    """
    The A An This That These Those My Our Your His Her Their We I You It He She They Visit Open Order Batch Bought Contact Call Text Write Ask Thanks Thank
    Refund Ship Passport Tracking Model Serial Spare Software Never Great Would Signed Dear Support Team Service Customer Shop Street Der Die Das Ein Eine
    Unser Unsere Mein Meine Frau Herr Herrn Bitte Tel Kontakt Steuernummer Modell Sendung Bestellung Le La Les Un Une Mon Ma Merci Appelez Commande Livré El
    Los Las Una Mi Gracias Pedido Llamen Calle Avenida Monday Tuesday Wednesday Thursday Friday Saturday Sunday Mr Mrs Ms Dr Prof Hello Hi Hallo Bonjour Hola
    January February March April May June July August September October November December Yours Best Kind Regards Cheers Liebe Lieber Grüße Gruß Reply Mail
    And But Or If When With For From Und Aber Ich Wir Sie Et Mais Je Nous Vous Y Pero Yo Per Con Il Lo Not No Yes Very Straße Road Lane Avenue Saint
    """.split()
)


_SPANS = "id bigint, pii_kind string, start_char int, end_char int, score double"


def spans(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", given_names: frozenset[str] = GIVEN_NAMES, threshold: float = 0.5) -> DataFrame:
    """One row per occurrence: (``doc_id``, ``pii_kind``, ``start_char``, ``end_char``, ``score``), from the whole text.

    Rows equal in id and text count once. Null and empty texts give no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, s.kind, s.start, s.end, s.score) for i, t in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True) for s in find(t, given_names, threshold)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "pii_kind", "start_char", "end_char", "score"])

    docs = documents.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return docs.mapInArrow(work, _SPANS).withColumnRenamed("id", doc_id).distinct()


def replace(text: str | None, found: list[Span]) -> str | None:
    """The text with each span replaced by its kind in brackets; all else as it was."""
    if text is None:
        return None
    out, last = [], 0
    for s in found:
        out += [text[last : s.start], f"[{s.kind.upper()}]"]
        last = s.end
    return "".join([*out, text[last:]])


def redacted(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", given_names: frozenset[str] = GIVEN_NAMES, threshold: float = 0.5) -> DataFrame:
    """(``doc_id``, ``clean_text``, ``n_spans``) for every document; null text stays null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["text"].to_pylist()
            each = [find(t, given_names, threshold) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b["id"], pa.array([replace(t, s) for t, s in zip(texts, each, strict=True)], pa.string()), pa.array([len(s) for s in each], pa.int32())],
                names=[doc_id, "clean_text", "n_spans"],
            )

    docs = documents.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return docs.mapInArrow(work, f"`{doc_id}` bigint, clean_text string, n_spans int")
