"""Spans of one text that are, or may be, personal information.

E-mail and street addresses have a form of their own. Numbers and names have none: every run of digits with the length
of a phone or identity number, and every run of capitalised words, comes out as a candidate with the terms (words,
shape, context) by which the corpus decides on it. A few plainly declared ones are seeds.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator

U = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĘĚĞĢĪİĶĹĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŴŶŹŻŽ"
BLANKS = " \u00a0\u2009\u202f"
S = f"[{BLANKS}]"
H = r"[-\u2010\u2011]"
WORD = rf"(?:(?:O['’]|Ma?c|D['’])[{U}]\w+|[{U}][^\W\d_]+)(?:{H}(?:O['’]|Ma?c)?[^\W\d_]+)*"
INITIAL = rf"[{U}]\."
PARTICLE = rf"(?:[Vv]an{S}de[rn]|[Vv]an{S}de|[Vv]on{S}der|[Vv]on|[Vv]an|[Dd]e{S}la|[Dd]el|[Dd]e|da|di|du|af)"
NAME = rf"(?:(?:{INITIAL}{S}?)+(?:{PARTICLE}{S})?{WORD}|{PARTICLE}{S}{WORD}|{WORD}(?:{S}{INITIAL})*(?:{S}(?:{PARTICLE}{S})?{WORD}){{0,2}})"
TURNED = rf"(?:(?:{PARTICLE}{S})?{WORD}(?:{S}{WORD})?,{S}(?:{WORD}(?:{S}{INITIAL})*|(?:{INITIAL}{S}?)+))"
TITLE = rf"(?:(?:Mr|Mrs|Ms|Dr|Prof|Herrn?|Frau|Hr|Fr|Sr|Sra|Mme|Mlle|M|Señora?|Don|Doña|Monsieur|Madame)\b\.?{S})"
ANYCASE = r"[^\W\d_][^\W\d_.'’-]*(?:[.'’ -]+[^\W\d_]+)*\.?"

EMAIL = re.compile(r"[^\W_][\w.+%-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w@])(?!:/)")
_AT, _DOT = r"\s?(?:\[at\]|\(at\)|\{at\}|\bat\b)\s?", r"\s?(?:\[dot\]|\(dot\)|\{dot\}|\bdot\b)\s?"
SPELLED = re.compile(rf"(?i)[^\W_][\w+-]*(?:(?:\.|{_DOT})[\w+-]+)*{_AT}[a-z0-9-]+(?:(?:{_DOT}|\.)[a-z0-9-]+)*{_DOT}[a-z]{{2,}}\b")
BRACKETED = re.compile(r"(?i)[^\W_][\w.+%-]*\s?[\[({]at[\])}]\s?(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}(?![\w@])")
_G = rf"[{BLANKS}.\-\u2010\u2011/]"
PHONE = re.compile(
    rf"(?<![\w.+/@-])(?:\+\d{{1,3}}{_G}?(?:\(\d{{1,4}}\){_G}?)?\d{{1,5}}(?:{_G}?\d{{2,5}}){{1,6}}|(?:1{S})?\(\d{{3,5}}\){S}?\d{{3,7}}(?:{_G}\d{{2,4}})*|00[1-9]\d{{8,12}}"
    rf"|0\d{{1,4}}(?:{S}\d{{2}}){{3,4}}|0\d(?:\.\d{{2}}){{4}}|0\d(?:{S}\d{{2}}){{4}}|0\d{{2,4}}{S}\d{{3,4}}{S}\d{{4}}|0\d{{2,4}}/\d{{5,9}}(?:-\d+)?|(?:1{_G})?\d{{3}}(?P<s>[.\-\u2010\u2011{BLANKS}])\d{{3}}(?P=s)\d{{4}}|555{H}\d{{4}})"
    rf"(?:,?{S}?(?:ext\.?|extension|x|Durchwahl|DW|poste|extensi[oó]n|anexo|Apparat|App\.|int\.){S}?\d{{1,6}})?(?![\w]|[.\-/]\d)"
)
ID = rf"(?:[A-Z]{{1,3}}{H}?\d{{6,9}}(?:{H}[A-Z])?|\d{{8}}{H}?[A-Z]|\d{S}\d{{2}}{S}\d{{2}}{S}\d{{2}}{S}\d{{3}}{S}\d{{3}}{S}\d{{2}}|\d{{2}}{S}\d{{3}}{S}\d{{3}}{S}\d{{3}}|\d{{6}}{H}\d{{4}}|\d{{3}}{S}\d{{2}}{S}\d{{4}}|\d{{3}}{H}\d{{2}}{H}\d{{4}}|\d{{9,13}})"
ID_LABEL = r"(?:passport(?: number| no\.?)?|badge(?: number| no\.?)?|SSN|social security(?: number)?|National ID|Steuer-ID|Ausweis(?:nummer|-?Nr\.?)|Personal(?:nummer|-?Nr\.?)|Sozialversicherungsnummer|DNI|NIF|pasaporte(?: número)?|número de (?:empleado|identidad|personal)|numéro de sécurité sociale|matricule|carte d'identité(?: numéro)?|passeport(?: numéro)?|badge numéro|staff (?:number|no\.?|ID)|employee (?:number|no\.?|ID)|personnel number|tax ID|ID card|driver'?s licen[cs]e)"
IDENTITY = re.compile(rf"(?i:{ID_LABEL})(?::|(?:{S}(?:von|de|of|für|for|del?){S}(?:{TITLE})*(?:{TURNED}|{NAME})){S}?(?::|es|est|ist|is|lautet)?|{S}?(?:ist|is|es|est|lautet|número|numéro|no\.|Nr\.))?{S}?(?:n\.?º{S}?)?(?P<item>{ID})(?![\w]|[.\-]\d)")
RECORD_ID = re.compile(rf";{S}(?P<item>{ID})(?![\w]|[.\-]\d)(?={S}|$|[;,.])")

_CAPS = rf"[{U}][\w'’.-]+"
_TOWN = rf"[{U}][^\W\d_]+(?:{H}[{U}][^\W\d_]+)*"
_MORE = rf"[{U}][a-zß-öø-ÿāăąćčďđęěğłńňőœřśşšţťůűźżž]+"
_POST = rf"(?:,?{S}(?:QX{S}\d{{5}}|[A-Z]{{2}}{S}\d{{5}}|[A-Z]{{1,2}}\d{{1,2}}[A-Z]?{S}\d[A-Z]{{2}})(?!\w))"
_KINDS = r"(?:Street|St\.|Road|Rd\.|Lane|Ln\.|Court|Ct\.|Crescent|Cres\.|Close|Way|Terrace|Avenue|Ave\.|Boulevard|Blvd\.?|Drive|Dr\.|Place|Square|Sq\.)"
_UNIT = rf"(?:Flat|Apt\.?|Apartment|Unit|Suite){S}\d+[A-Za-z]?"
ADDRESS = re.compile(
    rf"(?:(?<!\w)(?:{_UNIT},{S})?\d+[a-z]?{S}(?:{_CAPS}{S}){{1,3}}{_KINDS}(?:,{S}{_UNIT})?(?:,{S}?|,?\n)(?P<town>{_TOWN})(?P<more>{S}{_MORE})?(?P<post>{_POST})?"
    rf"|(?:(?:Unterer?|Oberer?|Am|An{S}der|Im|Zum|Alte[rn]?|Neue[rn]?|Kleine[rn]?|Große[rn]?){S}){{0,3}}(?:[{U}]\w*(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring)|[{U}]\w+[- ](?:Straße|Str\.|Weg|Platz|Allee)|(?<=Alten )(?:Str\.|Weg|Straße|Platz)){S}\d+[a-z]?,?(?:{S}|\n)(?:[A-Z]{{1,2}}-)?\d{{5}}{S}(?P<town2>{_TOWN})(?P<more2>{S}{_MORE})?"
    rf"|\d+[a-z]?(?:{S}(?:bis|ter|quater))?,?{S}(?:rue|avenue|place|quai|impasse|chemin|boulevard|allée|cours|square|passage){S}[^,\n;]{{2,40}}(?:,{S}[^,\n;]{{2,20}})?,?(?:{S}|\n)(?:[A-Z]-)?\d{{5}}{S}(?P<town3>{_TOWN})(?P<more3>{S}{_MORE})?"
    rf"|(?:Calle|C/|Plaza|Camino|Avenida|Avda?\.|Paseo|Ronda|Travesía|Callejón){S}[^,\n;]{{2,40}}?,?{S}(?:n\.?º{S}?)?\d+[a-z]?(?:,{S}[^,\n;]{{1,16}})?,?(?:{S}|\n)\d{{5}}{S}(?P<town4>{_TOWN})(?P<more4>{S}{_MORE})?)"
)

#: The seeds, all that is told beforehand: words before a person, labels of persons, phones and identity numbers, closings of letters.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Herrn", "Frau", "Sr", "Sra", "Mme", "Mlle", "Señor", "Señora", "Don", "Doña", "Monsieur", "Madame")
GREETINGS = ("Dear", "Hello", "Hi", "Hallo", "Liebe", "Lieber", "Bonjour", "Cher", "Chère", "Hola", "Estimado", "Estimada")
LABELS = ("Name:", "Nom:", "Nombre:", "From:", "Author:", "Contact:", "Kontakt:", "Contacto:")
CLOSINGS = {
    "Cheers", "Best", "Best regards", "Best wishes", "Kind regards", "Regards", "Thanks", "Sincerely", "Gruß", "Grüße", "Viele Grüße", "Beste Grüße", "Liebe Grüße", "MfG", "Danke", "Cordialement", "Amicalement", "Bien à vous", "Merci",
    "Atentamente", "Saludos", "Saludos cordiales", "Un saludo", "Gracias", "—", "–", "--",
}
PHONE_LABEL = re.compile(r"(?i)(?<!\w)(?:phone|telephone|tel|mobile|cell|fax|call|telefon|telefonisch|handy|téléphone|portable|télécopie|teléfono|móvil)(?!\w)")
ID_LABELLED = re.compile(rf"(?i:(?<!\w){ID_LABEL})")
STREETS = (
    " Street", " St.", " Road", " Rd.", " Lane", " Ln.", " Court", " Ct.", " Crescent", " Cres.", " Close", " Way", " Terrace", " Avenue", " Ave.", " Boulevard", " Blvd", " Drive", " Dr.", " Place", " Square", " Sq.",
    "straße ", "strasse ", "str. ", "weg ", "gasse ", "platz ", "allee ", "ufer ", "damm ", "ring ", "Straße ", "Str. ", "Weg ", "Platz ", "Allee ",
    "rue ", "avenue ", "place ", "quai ", "impasse ", "chemin ", "boulevard ", "allée ", "cours ", "square ", "passage ", "Calle ", "C/ ", "Plaza ", "Camino ", "Avenida ", "Avda", "Paseo ", "Ronda ", "Travesía ", "Callejón ",
)

#: Ends and starts of runs of capitalised words that may be streets.
_STREET_ENDS = tuple({x.strip().rstrip(".") for x in STREETS if x.startswith(" ")} | {x.strip().rstrip(".") for x in STREETS if not x.startswith(" ") and x[0] in "swgpaudrS WPA" and x.strip() not in ("rue", "avenue", "place", "quai", "allée", "square", "passage")})
_STREET_STARTS = ("Calle", "Plaza", "Camino", "Avenida", "Avda", "Paseo", "Ronda", "Travesía", "Callejón")
_FRENCH_KINDS = ("rue", "avenue", "place", "quai", "impasse", "chemin", "boulevard", "allée", "cours", "square", "passage")
#: The house number before such a kind and its blank.
_FRENCH = re.compile(r"\d[a-z]?(?:\s(?:bis|ter|quater))?,?\s\Z")
#: House number, capitalised words, and a town: whether this is an address is for the corpus to say.
OPEN_ADDRESS = re.compile(rf"(?<![\w.])(?:{_UNIT},{S})?\d+[a-z]?{S}(?:{_CAPS}{S}){{1,3}}[{U}][^\W\d_]+(?:,{S}{_UNIT})?(?:,{S}?|,?\n)(?P<town>{_TOWN}(?:{S}{_MORE})?)(?P<post>{_POST})?")
#: What every such address has: the first letter after its house number.
_HOUSE = re.compile(rf"[{U}](?:(?<=\d{S}.)|(?<=\d[a-z]{S}.))(?=[\w'’.-]+{S}[{U}])")
_UNITS = ("Flat", "Apt", "Apt.", "Apartment", "Unit", "Suite")
_CUES = "|".join((*TITLES, *GREETINGS))
CUES = {*TITLES, *GREETINGS}
_CUT = re.compile(rf"(?<![^\W_])(?:{_CUES})\.?{S}")
#: INITIAL, PARTICLE and WORD after their first character. A pattern that starts with a set of characters skips to these, one that starts by looking back is tried everywhere.
_INITIAL_REST = rf"(?<=[{U}])\."
_PARTICLE_REST = rf"(?:(?<=[Vv])(?:an{S}de[rn]|an{S}de|on{S}der|on|an)|(?<=[Dd])(?:e{S}la|el|e)|(?<=d)(?:a|i|u)|(?<=a)f)"
_WORD_REST = rf"(?:(?:(?<=[OD])['’]|(?<=M)a?c)[{U}]\w+|(?<=[{U}])[^\W\d_]+)(?:{H}(?:O['’]|Ma?c)?[^\W\d_]+)*"
SEQUENCE = re.compile(
    rf"[{U}vda](?<![\w@.)].)(?:{_INITIAL_REST}{S}?(?:{INITIAL}{S}?)*(?:{PARTICLE}{S})?{WORD}|{_PARTICLE_REST}{S}{WORD}|{_WORD_REST})(?:{S}(?:{INITIAL}{S}?)*(?:{PARTICLE}{S})?{WORD}){{0,3}}(?!\w)"
)
_TURNED = re.compile(TURNED)
_LEADING = re.compile(rf"(?:de|di|da|du|del){S}")
_WORDS = re.compile(rf"(?<![^\W_])[{U}](?:\.|[\w'’]*(?:{H}[\w'’]+)*)")
_AT_MARK = re.compile(r"[\[({](?:at|AT|At)[\])}]")
#: What every spelled mail has after its local part.
_SPELLED_AT = re.compile(rf"[aA](?i:t(?:[\])}}]|\b)\s?[a-z0-9-]+(?:(?:{_DOT}|\.)[a-z0-9-]+)*{_DOT}[a-z]{{2,}}\b)")
_DOTS = (" dot ", " DOT ", " Dot ", "(dot)", "[dot]", "{dot}", "(DOT)", "[DOT]", "{DOT}")
_DIGIT = re.compile(r"\d")
_NINES = str.maketrans("012345678", "999999999")
_MARKS = {",", ";", ":", "<", "("}
_DIGITS = re.compile(rf"\d(?:[{BLANKS}.\-‐‑/()]{{0,3}}\d){{5,}}")
_AFTER_BY = re.compile(rf"(?<!\w)(?i:(?:reported|written|signed|sent|approved) by){S}(?:{_CUT.pattern})*(?P<n>[^\W\d_][^\W\d_.'’-]*(?:[.'’-]?{S}?[^\W\d_]+){{0,4}})(?=,)")
_BY = ("reported by", "written by", "signed by", "sent by", "approved by")
_LEFT = re.compile(r"(?:[\w'’-]+|[^\w\s])")
_NUMBER = re.compile(rf"(?:{PHONE.pattern})|(?<![\w.+/@-])(?P<id>{ID})(?![\w]|[.\-]\d)")
#: Where a number may start. It is tried there only, as the whole pattern takes long at every place.
_NUMBER_START = re.compile(r"(?<![\w.+/@-])[\d+(A-Z]")
#: How every number of six digits or more starts. Most digits stand in tables, whose lines have no such place and are passed over.
#: The set is a wide one, without classes, as it is looked up in a table then.
_P = rf"[.\-\u2010\u2011{BLANKS}]"
_NUMBER_HINT = re.compile(
    rf"[0-9+(A-Z\u0660-\U0010ffff](?<![\d\w.+/@-].)(?:(?<=\d)(?:\d{{7}}(?:\d|{H}?[A-Z])|\d{{5}}{H}\d{{4}}|\d\d(?:{_P}\d{{3}}{_P}\d{{4}}|{S}\d\d{S}\d{{4}}|{H}\d\d{H}\d{{4}}|{H}\d{{4}})|\d{S}\d{{3}}{S}\d{{3}}{S}\d{{3}}|{S}\d\d{S}\d\d{S}\d\d{S}"
    rf"|(?<=0)\d|(?<=1)(?:{_G}\d{{3}}{_P}\d{{3}}{_P}\d{{4}}|{S}\(\d))|(?<=[A-Z])[A-Z]{{0,2}}{H}?\d{{6}}|(?<=[+(])(?:(?<=\+)\d|\d{{3,5}}\)))"
)


def _town(m: re.Match) -> tuple[str, str | None, str | None]:
    """The address, and if the town may or may not have a second word, the address and the town with it."""
    for k in ("", "2", "3", "4"):
        if m["town" + k]:
            more = m["more" + k]
            if more is None or (k == "" and m["post"]):
                return m.group(), None, None
            if m.string[m.end("more" + k) : m.end("more" + k) + 1] in ("", "\n", ".", ",", ";", ")"):
                return m.string[m.start() : m.end("more" + k)], None, None
            short = m.string[m.start() : m.end("town" + k)]
            return short, m.string[m.start() : m.end("more" + k)], m["town" + k] + more
    return m.group(), None, None


def _find(text: str, word: str) -> list[int]:
    out, at = [], text.find(word)
    while at >= 0:
        out.append(at)
        at = text.find(word, at + len(word))
    return out


def _french(text: str) -> Iterator[int]:
    """Last digits of house numbers before a French kind of street."""
    for kind in _FRENCH_KINDS:
        for at in _find(text, kind) if kind in text else ():
            end = at + len(kind)
            if text[at - 1 : at].isspace() and text[end : end + 1].isspace() and (m := _FRENCH.search(text, max(0, at - 12), at)):
                yield m.start()


def _open_addresses(text: str) -> Iterator[re.Match]:
    """The matches of OPEN_ADDRESS, which is tried only where a house number with two capitalised words begins, or its unit."""
    done = 0
    for house in _HOUSE.finditer(text):
        at = house.start() - 1
        at -= not text[at - 1].isdecimal()
        while at and text[at - 1].isdecimal():
            at -= 1
        starts = [at]
        if at > 1 and text[at - 2] == "," and text[at - 1] in BLANKS:
            end = at - 2
            if text[end - 1 : end].isascii() and text[end - 1 : end].isalpha():
                end -= 1
            unit = end
            while unit and text[unit - 1].isdecimal():
                unit -= 1
            if 0 < unit < end and text[unit - 1] in BLANKS:
                before = text[max(0, unit - 12) : unit - 1]
                starts = [unit - 1 - len(x) for x in _UNITS if before.endswith(x)] + starts
        for start in starts:
            if start >= done and (m := OPEN_ADDRESS.match(text, start)):
                done = m.end()
                yield m
                break


class _Taken:
    """Disjoint intervals."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def hit(self, a: int, b: int) -> tuple[int, int] | None:
        k = bisect(self.starts, a) - 1
        if k >= 0 and self.ends[k] > a:
            return self.starts[k], self.ends[k]
        if k + 1 < len(self.starts) and self.starts[k + 1] < b:
            return self.starts[k + 1], self.ends[k + 1]
        return None

    def add(self, a: int, b: int) -> None:
        k = bisect(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def _shape(item: str) -> str:
    """The form of a number: digits as 9, letters as A, and its separators."""
    return re.sub(r"[^\W\d_]", "A", re.sub(r"\d", "9", re.sub(rf"[{BLANKS}]", " ", re.sub(r"[\u2010\u2011]", "-", item))))


def _left(text: str, a: int) -> tuple[str, bool]:
    """What stands before a span on its line, as far as it matters, and whether the span starts the line."""
    left = text[max(0, a - 48) : a]
    cut = left.rfind("\n")
    left = left[cut + 1 :]
    return left, (cut >= 0 or a <= 48) and (not left or left.isspace())


def _context(text: str, words: list[str], b: int) -> list[str]:
    """The two words before a span, the last of them alone, and the word or mark after it; ^ and $ are the ends of a line."""
    words = [w.lower() if w.isalpha() else w.lower().translate(_NINES) for w in words[-2:]] or ["^"]
    after = text[b : b + 1]
    if after and after in BLANKS:
        after = (text[b + 1 : b + 25].split(None, 1) or "$")[0].lower().rstrip(",.;:!?")
    return [f"l2:{' '.join(words)}", f"l1:{words[-1]}", f"r1:{after if after and after != chr(10) else '$'}"]


def spans(text: str, common: frozenset[str] | set[str] = frozenset()) -> list[tuple]:
    """(group, kind, item, start, end, longer, terms, words), mostly without overlaps.

    group: form (kind holds), number or name (the corpus decides; kind is that of a seed, else null). longer: an address
    with a town of two words where this is open. common: words in small letters that are cut off the ends of a name; a name of nothing else is none. words: of a name, (word, start, end in the item) of each, so that the corpus can cut it.
    """
    out: list = []
    taken = _Taken()

    def put(kind: str, a: int, b: int, item: str | None = None, longer: str | None = None, terms: list[str] | None = None) -> None:
        if taken.hit(a, b) is None:
            taken.add(a, b)
            out.append(("form", kind, item or text[a:b], a, b, longer, terms or [], []))

    at = text.find("@")
    while at >= 0:
        a = at
        while a and (text[a - 1].isalnum() or text[a - 1] in "_.+%-"):
            a -= 1
        while a < at and not text[a].isalnum():
            a += 1
        if a < at and (m := EMAIL.match(text, a)):
            put("email", *m.span())
        at = text.find("@", at + 1)
    if _AT_MARK.search(text):
        for m in BRACKETED.finditer(text):
            put("email", *m.span())
    if ("dot" in text or "DOT" in text or "Dot" in text) and any(x in text for x in _DOTS) and _SPELLED_AT.search(text):
        for m in SPELLED.finditer(text):
            put("email", *m.span())
    done = 0
    digits = _DIGIT.search(text)
    sequences = [(m[0], m.start()) for m in SEQUENCE.finditer(text)]
    starts = [a for x, a in sequences if x.endswith(_STREET_ENDS) or x.startswith(_STREET_STARTS) and x.split(" ", 1)[0] in _STREET_STARTS] if digits else []
    if digits:
        starts += _french(text)
        starts += _find(text, "C/ ")
    for at in sorted(starts):
        if at < done:
            continue
        for m in ADDRESS.finditer(text, max(done, at - 40), min(len(text), at + 400)):
            if m.start() > at + 12:
                break
            if m.end() > at:
                item, longer, town = _town(m)
                put("address", m.start(), m.start() + len(longer or item), item, longer, [f"t:{town}"] if town else None)
                done = m.end()
                break
    for m in _open_addresses(text) if digits else ():
        if taken.hit(*m.span()) is None:
            out.append(("open", "address", m.group(), *m.span(), None, [f"t:{m['town']}"], []))
    done = 0
    for run in _runs(text) if digits else ():
        g, a = run.group(), run.start()
        if g.replace(".", "", 1).isdigit() and (len(g) < 9 or "." in g) and not (a and (text[a - 1].isalpha() or text[a - 1] in "+-(")) and not text[run.end() : run.end() + 2].lstrip("-‐‑")[:1].isalpha():
            continue  # a step or a decimal number
        end, last = run.end(), min(len(text), run.end() + 48)
        for start in _NUMBER_START.finditer(text, max(done, a - 6), end):
            if start.start() >= done and (m := _NUMBER.match(text, start.start(), last)):
                done = m.end()
                _number(text, m, out, taken)
    _names(text, sequences, out, taken, common)
    return out


def _runs(text: str) -> Iterator[re.Match]:
    """The runs of digits, which never pass a line, on those lines that may have a number."""
    end = -1
    for hint in _NUMBER_HINT.finditer(text):
        if hint.start() > end:
            end = text.find("\n", hint.start())
            end = len(text) if end < 0 else end
            yield from _DIGITS.finditer(text, text.rfind("\n", 0, hint.start()) + 1, end)


def _number(text: str, m: re.Match, out: list, taken: _Taken) -> None:
    a, b = m.span()
    if sum(map(str.isdigit, m.group())) >= 6 and not taken.hit(a, b):
        line = text.rfind("\n", 0, a) + 1
        near = text[max(line, a - 160) : a]
        # The nearest label on the line, with no number and few words between.
        cue, label = ([near[x.end() :] for x in p.finditer(near)][-1:] for p in (PHONE_LABEL, ID_LABELLED))
        cue, label = ([x for x in y if not re.search(r"[\d;]", x) and len(x.split()) < 7] for y in (cue, label))
        kind = "id_number" if label and not (cue and len(cue[0]) < len(label[0])) else "phone" if cue else None
        taken.add(a, b)
        digits = re.match(r"[+(]*\d{1,3}", m.group())
        out.append(("number", kind, m.group(), a, b, None, [f"s:{_shape(m.group())}", *([f"p:{digits.group()}"] if digits else []), *_context(text, _left(text, a)[0].split(), b)], []))


SKIP = CUES | CLOSINGS
#: For the first count of words, as a pattern of the JVM: a run of capitalised words. The capital is looked for first, as looking back takes long at every place.
RUN_PATTERN = r"(?=\p{Lu})(?<![\p{L}\p{N}_@-])\p{Lu}[\p{L}'’‐‑-]*+[.:,]?+(?:[ \u00a0]\p{Lu}[\p{L}'’‐‑-]*+[.:,]?+)*+"


def _by(text: str) -> bool:
    low = text.casefold()
    return any(x in low for x in _BY)


def _names(text: str, sequences: list, out: list, taken: _Taken, common: frozenset[str] | set[str]) -> None:
    small: dict[str, bool] = {}
    found: list[tuple[int, int, str]] = []
    if " by" in text and _by(text):
        found += [(*m.span("n"), "any") for m in _AFTER_BY.finditer(text) if not SEQUENCE.fullmatch(m["n"])]
    for m in re.finditer(rf":{S}", text):
        if x := _TURNED.match(text, m.end()):
            found.append((*x.span(), "turned"))
    found = [x for x in found if taken.hit(x[0], x[1]) is None]
    for a, b, _ in found:
        taken.add(a, b)
    for a, b, form in found:
        words = [(w.group(), w.start(), w.end()) for w in (re.finditer(r"[^\W\d_]+", text[a:b]) if form == "any" else _WORDS.finditer(text[a:b]))]
        if any(len(w) > 2 for w, _, _ in words):
            out.append(_name(text, a, b, form, words, taken))
    busy = bool(taken.starts)
    for item, a in sequences:
        b = a + len(item)
        if item.isalpha():
            if item.lower() in common:
                continue
        else:
            if item[0].islower() and (lead := _LEADING.match(text, a, b)):
                # "de" before a full name, or after a small word, is the preposition.
                rest, before = text[lead.end() : b], text[max(0, a - 24) : a].split()
                if " " in rest.replace(". ", ".") or before and before[-1].islower():
                    a = lead.end()
            if " " in item or "\u00a0" in item:
                for cut in _CUT.finditer(text, a, b):
                    a = cut.end()
            if text[a + 1 : a + 2] == "." and re.search(rf"[\d/]{S}?$", text[max(0, a - 2) : a]):
                continue
            item = text[a:b]
        if busy:
            while a < b and (x := taken.hit(a, b)):
                if x[0] <= a:
                    a = b
                else:
                    b = x[0]
                    while b > a and not text[b - 1].isalnum() and text[b - 1] != ".":
                        b -= 1
                item = text[a:b]
        if len(item) < 3 or item in SKIP:
            continue
        if item.isalpha():
            words = [(item, 0, b - a)]
            if text[b + 1 : b + 2].islower() and text[b : b + 1] in BLANKS and (a < 2 or text[a - 1] == "\n" or text[a - 2] in ".!?:\n"):
                # A word that starts a sentence, and stands in lower case elsewhere in the text, is written large for that.
                if item not in small:
                    small[item] = f" {item.lower()} " in text
                if small[item]:
                    continue
        else:
            words = [(w.group(), w.start(), w.end()) for w in _WORDS.finditer(item)]
            if common and words:
                low, high = 0, len(words)
                while low < high and words[low][0].lower() in common:
                    low += 1
                while high > low and words[high - 1][0].lower() in common:
                    high -= 1
                if high - low < len(words):
                    start, end = words[low][1] if low and low < len(words) else 0, words[high - 1][2] if high < len(words) else b - a
                    words = [(w, x - start, y - start) for w, x, y in words[low:high]]
                    a, b = a + start, a + end
            if not any(len(w) > 2 for w, _, _ in words):
                continue
        out.append(_name(text, a, b, "", words, taken))


def _name(text: str, a: int, b: int, form: str, words: list, taken: _Taken) -> tuple:
    """A name as a candidate: a seed by the cue before it, or as all that a line holds under the closing of a letter."""
    left, starts = _left(text, a)
    before = left.rsplit(None, 2)
    last = before[-1] if before else ""
    seed = last in CUES or last in LABELS or last[-1:] == "." and last[:-1] in CUES
    near = None
    place = "f:" + form
    if b == len(text) or text[b] == "\n" or text[b] in BLANKS and text[b : b + 24].strip(BLANKS)[:1] in ("", "\n"):
        if not seed and last and left.strip().rstrip(",") in CLOSINGS:
            seed = True
        if starts:
            place += "line"
            line = a - len(left)
            above = text[max(0, line - 48) : max(0, line)].rstrip("\n" + BLANKS).rsplit("\n", 1)[-1].strip(BLANKS)
            seed = seed or above.rstrip(",") in CLOSINGS
            near = taken.hit(max(0, line - 30), line) or taken.hit(b, b + 12)
    elif text[b] in _MARKS:
        near = taken.hit(b, b + 4)
    return ("name", "name" if seed else None, text[a:b], a, b, None, [place, *(["c:near"] if near else []), *_context(text, before, b)], words)
