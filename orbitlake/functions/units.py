"""Units as people write them.

``parse_unit`` turns a free spelling into base symbols with exponents and a power of ten; ``UnitBook`` matches the
result with the units of a reference table; ``unit_in_note`` finds the statement of a unit in a free-text remark.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import takewhile

# Decimal prefixes of the SI.
PREFIX_SYMBOLS = {"T": 12, "G": 9, "M": 6, "k": 3, "h": 2, "da": 1, "d": -1, "c": -2, "m": -3, "μ": -6, "u": -6, "n": -9, "p": -12, "f": -15}
PREFIX_NAMES = {"tera": 12, "giga": 9, "mega": 6, "kilo": 3, "hecto": 2, "deca": 1, "deci": -1, "centi": -2, "milli": -3, "micro": -6, "nano": -9, "pico": -12, "femto": -15}
# Symbols in their exact case, and names in any case. A base "m" or "g" keeps its prefix apart.
SYMBOLS = {
    "V": "V", "J": "J", "C": "C", "N": "N", "F": "F", "K": "K", "Pa": "Pa", "bar": "bar", "eV": "eV", "Ha": "hartree", "Eh": "hartree", "E_h": "hartree",
    "Ry": "rydberg", "cal": "cal", "g": "g", "m": "m", "L": "L", "l": "L", "mol": "mol", "e": "e", "e-": "e", "|e|": "e", "el": "e", "q": "e",
    "μB": "mub", "μ_B": "mub", "muB": "mub", "mu_B": "mub", "A": "angstrom", "Å": "angstrom", "Ang": "angstrom", "a0": "bohr", "a_0": "bohr",
    "u": "amu", "Da": "amu", "amu": "amu", "atm": "atm", "psi": "psi", "cc": "cc", "lbf": "lbf", "in": "inch", "°C": "celsius", "°F": "fahrenheit", "°K": "K",
}
NAMES = {
    "volt": "V", "joule": "J", "coulomb": "C", "newton": "N", "kelvin": "K", "pascal": "Pa", "bar": "bar", "electronvolt": "eV", "electron-volt": "eV", "hartree": "hartree",
    "rydberg": "rydberg", "calorie": "cal", "gram": "g", "gramme": "g", "metre": "m", "meter": "m", "litre": "L", "liter": "L", "mole": "mol", "electron": "e", "charge": "e",
    "mub": "mub", "mu_b": "mub", "angstrom": "angstrom", "ångström": "angstrom", "ångstrom": "angstrom", "ang": "angstrom", "bohr": "bohr", "dalton": "amu", "amu": "amu",
    "atm": "atm", "atmosphere": "atm", "psi": "psi", "celsius": "celsius", "fahrenheit": "fahrenheit", "degc": "celsius", "degf": "fahrenheit", "degk": "K", "inch": "inch", "pound": "lbf",
}
TAKES_PREFIX = {"V", "J", "N", "Pa", "bar", "eV", "hartree", "rydberg", "cal", "g", "m", "L", "K", "amu", "atm", "mol", "C"}
PHRASES = [
    (r"(?i)\batomic mass units?\b", "amu"), (r"(?i)\bbohr[ -]magnetons?\b", "mub"), (r"(?i)\b(?:pounds?|lbf) per square inch\b|\blbf/in(?:\^|\*\*)?2", "psi"), (r"(?i)\bstandard atmospheres?\b", "atm"),
    (r"(?i)\b(?:elementary|electron(?:ic)?) charges?\b", "e"), (r"(?i)\bdeg(?:rees?)?\.? ?celsius\b|\bdeg\.? ?C\b", "celsius"), (r"(?i)\bdeg(?:rees?)?\.? ?fahrenheit\b|\bdeg\.? ?F\b", "fahrenheit"),
    (r"(?i)\bdeg(?:rees?)?\.? ?k(?:elvins?)?\b", "kelvin"), (r"(?i)\bper mole and charge\b", "/mol/e"), (r"(?i)\b(per|and) (?=\S)", "/"), (r"(?i)\bcubic ([^\s*/·()]+)", r"\1^3"), (r"(?i)\bsquare ([^\s*/·()]+)", r"\1^2"),
]
NOT_STATED = {"", "n/a", "na", "none", "null", "-", "--", "?", "??", "unknown", "see note", "see notes", "tbd"}
ATOMIC = re.compile(r"(?i)^(?:a\. ?u\.?|at\. ?u\.?|au|atomic units?)$")
_SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")
_POW = r"(?:10\s*(?:\^|\*\*)\s*\(?\s*([+-]?\d+)\s*\)?|1(?:\.0*)?[eE]([+-]?\d+)|(10+)(?![\d.]))"
_LEAD = re.compile(rf"^{_POW}\s*(?:[x×*·]\s*)?(?=[^\d\s])")
_TRAIL = re.compile(rf"\s*(?:\(\s*[x×*·]?\s*{_POW}\s*\)|[x×*·]\s*{_POW})$")
_TERM = re.compile(r"\s*(?:(?:\*\*|\^)\s*\(\s*([+-]?\d+)\s*\)|(\()|(\))|(?:\*\*|\^)?\s*([+-]?\d+)(?![A-Za-z])|([*·×/])|(\|e\||e-(?!\d)|a_?0|E_h|mu_?B|μ_?B|°[CFK]|[^\W\d]+(?:-volts?)?))")


def _wrapped(text: str) -> bool:
    """Whether one pair of brackets holds the whole text."""
    if len(text) < 2 or text[0] + text[-1] not in ("()", "[]", "{}"):
        return False
    depth = 0
    for at, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if not depth and at < len(text) - 1:
            return False
    return not depth


def _tidy(text: str) -> str:
    text = re.sub(r"[⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺]+", lambda x: "^" + x.group().translate(_SUPER), text)
    text = unicodedata.normalize("NFKC", text).replace("−", "-").replace("–", "-").replace("µ", "μ").replace("⋅", "·").replace("•", "·")
    text = re.sub(r"\s+", " ", text).strip()
    while _wrapped(text):
        text = text[1:-1].strip()
    return text


def _symbol(word: str) -> list[tuple[str, int, int]] | None:
    """(base, exponent, power of ten) of one symbol or name."""

    def known(w: str, prefixed: bool) -> str | None:
        base = SYMBOLS.get(w)
        if base is None:
            low = w.lower()
            base = NAMES.get(low) or (NAMES.get(low[:-1]) if low.endswith("s") else None)
        return base if base and (not prefixed or base in TAKES_PREFIX) else None

    def built(base: str, power: int) -> list[tuple[str, int, int]]:
        if base == "m":
            return [(f"m{power:+d}", 1, 0)]
        if base == "L":
            return [("m-1", 3, 0)] if power == 0 else [("m-2", 3, 0)] if power == -3 else [("m+0", 3, power - 3)]
        if base == "cc":
            return [("m-2", 3, 0)]
        if base == "eV":
            return [("V", 1, power), ("e", 1, 0)]
        return [(base, 1, power)]

    if base := known(word, False):
        return built(base, 0)
    for n in (2, 1):
        if word[:n] in PREFIX_SYMBOLS and len(word) > n and word[n:] in SYMBOLS and (base := known(word[n:], True)):
            return built(base, PREFIX_SYMBOLS[word[:n]])
    low = word.lower()
    for name, power in PREFIX_NAMES.items():
        if low.startswith(name) and (base := known(word[len(name) :], True)):
            return built(base, power)
    if word.isupper() and len(word) > 2 and (base := known(word.lower(), False)):
        return built(base, 0)
    for n in (2, 1):
        if low[:n] in PREFIX_SYMBOLS and len(low) > n and low[n:] in NAMES and (base := known(low[n:], True)):
            return built(base, PREFIX_SYMBOLS[low[:n]])
    return None


@lru_cache(maxsize=200_000)
def parse_unit(text: str | None) -> tuple[tuple[tuple[str, int], ...], int] | None:
    """Exponents of the base symbols, and the power of ten; None if the text isn't a unit. "atomic" stands for atomic units."""
    if text is None:
        return None
    s, power = _tidy(text), 0
    for _ in range(2):
        for pattern in (_LEAD, _TRAIL):
            if x := pattern.search(s):
                got = [g for g in x.groups() if g]
                power += len(got[0]) - 1 if got[0].startswith("10") and set(got[0]) <= {"1", "0"} and x.re is _LEAD and "^" not in x.group() and "*" not in x.group()[:-1] and "e" not in x.group().lower() else int(got[0])
                s = (s[: x.start()] + s[x.end() :]).strip()
        s = _tidy(s)
    if s.lower() in NOT_STATED:
        return None
    if ATOMIC.match(s):
        return (("atomic", 1),), power
    for pattern, by in PHRASES:
        s = re.sub(pattern, by, s)
    terms: dict[str, int] = {}
    at, sign, signs, last, seen = 0, 1, [1], [], False
    while at < len(s):
        if not s[at:].strip():
            break
        x = _TERM.match(s, at)
        if not x:
            return None
        at = x.end()
        wrapped, opened, closed, digits, op, word = x.groups()
        digits = digits or wrapped
        if opened:
            signs.append(signs[-1] * sign)
            sign, last = 1, []
        elif closed:
            if len(signs) == 1:
                return None
            signs.pop()
            sign, last = 1, []
        elif digits is not None:
            if not last:
                if digits == "1" and not seen:
                    continue
                return None
            for base, exponent, p in last:
                terms[base] += exponent * (int(digits) - 1)
                power += p * (int(digits) - 1) * (1 if exponent > 0 else -1)
            last = []
        elif op:
            sign, last = (-1 if op == "/" else 1), []
        else:
            got = _symbol(word)
            if got is None:
                return None
            direction, sign, seen = sign * signs[-1], 1, True
            last = [(base, exponent * direction, p) for base, exponent, p in got]
            for base, exponent, p in last:
                terms[base] = terms.get(base, 0) + exponent
                power += p * direction
    if len(signs) != 1 or not seen:
        return None
    return tuple(sorted((b, n) for b, n in terms.items() if n)), power


def _same(terms: tuple[tuple[str, int], ...], quantity: str) -> tuple[tuple[str, int], ...]:
    """One form for units that are equal by definition."""
    if quantity == "temperature" and terms in ((("C", 1),), (("F", 1),)):
        return (("celsius", 1),) if terms[0][0] == "C" else (("fahrenheit", 1),)
    return {
        (("C", -1), ("J", 1)): (("V", 1),), (("N", 1), ("m+0", -2)): (("Pa", 1),), (("J", 1), ("m+0", -3)): (("Pa", 1),), (("inch", -2), ("lbf", 1)): (("psi", 1),),
    }.get(terms, terms)


def _metres(terms: tuple[tuple[str, int], ...], power: int) -> tuple[tuple[tuple[str, int], ...], int]:
    out: dict[str, int] = {}
    for base, n in terms:
        if re.fullmatch(r"m[+-]\d+", base):
            power, base = power + int(base[1:]) * n, "m+0"
        out[base] = out.get(base, 0) + n
    return tuple(sorted(out.items())), power


_PHRASE_WORDS = set("au at atomic mass unit units bohr magneton magnetons pound pounds per square inch and standard atmosphere atmospheres elementary electron electronic charge charges deg degree degrees cubic mole".split())


def _in_unit(word: str) -> bool:
    """Whether a word may be part of the spelling of a unit: each of its runs of letters is a symbol, a name, a word of a phrase, or one letter."""
    return all(len(run) < 2 or run.lower() in _PHRASE_WORDS or _symbol(run) for run in re.findall(r"[^\W\d_]+", _tidy(word)))


class UnitBook:
    """The units of a reference table, (quantity, unit_code) pairs of which there are few."""

    CODES = {"ev": "eV", "kj": "kJ", "mub": "mub", "pascal": "Pa"}

    def __init__(self, pairs: list[tuple[str, str]]):
        self.units: dict[str, dict] = {}
        self.wide: dict[str, dict] = {}
        self.atomic: dict[str, str] = {}
        for quantity, code in sorted(pairs):
            parsed = parse_unit("/".join(self.CODES.get(x, x) for x in code.split("/")))
            if parsed is None:
                continue
            terms, power = _same(parsed[0], quantity), parsed[1]
            self.units.setdefault(quantity, {})[terms] = (code, power)
            wide, p = _metres(terms, power)
            self.wide.setdefault(quantity, {}).setdefault(wide, []).append((code, p))
            if re.search("bohr|hartree", code):
                self.atomic[quantity] = code

    def find(self, quantity: str | None, text: str | None) -> tuple[str, int] | None:
        """unit_code and power of ten of a spelling, None if it names no unit of the quantity."""
        parsed = parse_unit(text)
        if parsed is None or quantity not in self.units:
            return None
        terms, power = parsed
        if terms == (("atomic", 1),):
            return (self.atomic[quantity], power) if quantity in self.atomic else None
        terms = _same(terms, quantity)
        if got := self.units[quantity].get(terms):
            return got[0], power - got[1]
        wide, power = _metres(terms, power)
        if got := self.wide[quantity].get(wide):
            code, p = min(got, key=lambda x: (abs(power - x[1]), x[0]))
            return code, power - p
        return None

    def in_note(self, quantity: str | None, note: str | None) -> tuple[str, int] | None:
        """The unit that a remark states for the samples; mentions of other things or of earlier units do not count."""
        if not note or quantity not in self.units:
            return None
        for cue in _CUES.finditer(note):
            start = max((x.end() for x in re.finditer(r"[.!?;]\s+", note[: cue.start()])), default=0)
            if _EARLIER.search(note[start : cue.start()]) or _EARLIER.match(cue.group()):
                continue
            rest = re.split(r"(?<=[\w)\]³])(?<!deg)(?<!Deg)\.\s+(?=[A-ZÄÖÜ])|\]\s|\]$|\n|;", note[cue.end() :])[0]
            rest = re.split(r"\s+(?:for|as of|throughout|before|instead)\b|,\s", rest)[0]
            words = list(takewhile(_in_unit, rest.split(" ")))
            for n in range(len(words), 0, -1):
                tried = " ".join(words[:n]).strip(" :=\"'`,;")
                for form in (tried, tried.rstrip(".")):
                    if got := self.find(quantity, form):
                        return got
        return None

    def stated(self, quantity: str | None, unit: str | None, note: str | None) -> tuple[str | None, int | None, str]:
        if got := self.in_note(quantity, note):
            return *got, "note"
        if got := self.find(quantity, unit):
            return *got, "unit"
        said = quantity in self.units and unit is not None and _tidy(unit).lower() not in NOT_STATED
        return None, None, "unreadable" if said else "missing"


_CUES = re.compile(
    r"(?i)(?:\bsamples?\s+(?:(?:were|are|is|was)\s+)?(?:(?:re)?written\s+|given\s+|stored\s+|expressed\s+|recorded\s+)?(?:in|as)\b|\bsamples?\s*[:=]|\b(?:values?|numbers|data|grid|entries|field)\s+(?:(?:are|is|were|was)\s+)?(?:given|stored|expressed|recorded|written|dumped|stated|tabulated)\s+(?:as|in)\b"
    r"|\b(?:all\s+)?(?:values|numbers)\s+(?:are\s+)?in\b|\ball (?:numbers|values)\b|\bunits?(?: of the (?:values|samples))?\s*[:=]|\beinheit(?:en)?(?: der (?:werte|daten))?\s*[:=]|\b(?:werte|daten) in\b|\bunit[ée]s?\s*:|\bunidad(?:es)?\s*:|\bwriter used\b)\s*"
)
_EARLIER = re.compile(r"(?i)\b(?:original(?:ly)?|formerly|previously|earlier|converted from|used to be|once|no longer)\b")
