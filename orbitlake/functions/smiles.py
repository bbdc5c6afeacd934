"""Line notations of molecules and of patterns: reading, checking, and matching patterns in molecules.

``molecule`` reads a SMILES text into a graph; ``Pattern`` compiles a SMARTS text once and finds its embeddings. One
scanner serves both: it walks the chain with a stack of branch points and a table of open rings, and leaves atoms and
bonds to the caller.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from orbitlake.functions import elements
from orbitlake.functions.molecule import EPS, Atom, Molecule, RingInfo, ring_info

ORDER = {"-": 1.0, "=": 2.0, "#": 3.0, "$": 4.0, ":": 1.5, "/": 1.0, "\\": 1.0}
ORGANIC = re.compile(r"Cl|Br|[BCNOPSFI]|[bcnops]|\*")
BRACKET = re.compile(r"(?P<iso>\d+)?(?P<sym>[A-Z][a-z]?|[a-z]{1,2}|\*)(?P<chi>@@?)?(?:H(?P<h>\d*))?(?P<chg>\++\d*|-+\d*)?(?::(?P<cls>\d+))?\Z")
AROMATIC = {"b", "c", "n", "o", "p", "s", "se", "as", "te"}
#: How deep recursive patterns may stand in each other.
DEPTH = 16


class NotationError(ValueError):
    """What is wrong with a text, and where."""


def _scan(text: str, bond_at: Callable, atom_at: Callable, join: Callable) -> list[list[int]]:
    """Walks a text. bond_at and atom_at read at a place and return a value and the next place; join makes a bond. Returns the atoms of each part between dots."""
    stack: list[int] = []
    rings: dict[int, tuple[int, object, int]] = {}
    parts: list[list[int]] = [[]]
    last, bond, at, count = None, None, 0, 0
    while at < len(text):
        c = text[at]
        if c == ".":
            if last is None or stack or bond is not None:
                raise NotationError(f"dot at {at} follows nothing")
            parts.append([])
            last, at = None, at + 1
        elif c == "(":
            if last is None or bond is not None:
                raise NotationError(f"branch at {at} has no atom before it")
            stack.append(last)
            at += 1
            if text[at : at + 1] in ("", ")"):
                raise NotationError(f"empty branch at {at}")
        elif c == ")":
            if not stack or bond is not None:
                raise NotationError(f"branch at {at} was not opened")
            last, at = stack.pop(), at + 1
        elif c.isdigit() or c == "%":
            if c == "%":
                if not re.match(r"\d\d", text[at + 1 : at + 3]):
                    raise NotationError(f"two digits must follow % at {at}")
                number, at = int(text[at + 1 : at + 3]), at + 3
            else:
                number, at = int(c), at + 1
            if last is None:
                raise NotationError(f"ring bond {number} has no atom before it")
            if number in rings:
                other, first, _ = rings.pop(number)
                if first is not None and bond is not None and first != bond:
                    raise NotationError(f"ring bond {number} is given in two ways")
                if other == last:
                    raise NotationError(f"ring bond {number} joins an atom to itself")
                join(other, last, bond if first is None else first)
            else:
                rings[number] = (last, bond, at)
            bond = None
        elif (got := bond_at(text, at)) is not None:
            if bond is not None or last is None:
                raise NotationError(f"bond at {at} has no atom before it")
            bond, at = got
        else:
            at = atom_at(text, at)
            if last is not None:
                join(last, count, bond)
            parts[-1].append(count)
            last, bond, count = count, None, count + 1
    if stack:
        raise NotationError("a branch is not closed")
    if rings:
        raise NotationError(f"ring bond {min(rings)} is not closed")
    if bond is not None or not parts[-1]:
        raise NotationError("the text ends where an atom must follow")
    return parts


def _inside(text: str, at: int) -> tuple[str, int]:
    """What stands in the brackets that open at a place, and the place after them."""
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] == "[") - (text[k] == "]")
        if not depth:
            return text[at + 1 : k], k + 1
    raise NotationError(f"the bracket at {at} is not closed")


def _charge(text: str | None) -> int:
    if not text:
        return 0
    digits = text.strip("+-")
    return (1 if text[0] == "+" else -1) * (int(digits) if digits else len(text))


def molecule(text: str) -> Molecule:
    """The molecule of a SMILES text. Bonds that are not written have order None; / and \\ are kept as marks. Raises NotationError."""
    mol = Molecule()

    def bond_at(t: str, at: int):
        return (t[at], at + 1) if t[at] in ORDER else None

    def atom_at(t: str, at: int) -> int:
        if t[at] == "[":
            inner, end = _inside(t, at)
            m = BRACKET.match(inner)
            if not m:
                raise NotationError(f"no atom in [{inner}]")
            symbol = m["sym"]
            if symbol != "*" and (elements.by_symbol(symbol) is None or symbol[0].islower() and symbol not in AROMATIC):
                raise NotationError(f"no element {symbol}")
            h = None if m["h"] is None else int(m["h"] or 1)
            mol.atoms.append(Atom(
                symbol[0].upper() + symbol[1:], float(_charge(m["chg"])), symbol[0].islower(), int(m["iso"]) if m["iso"] else None, h,
                {"@": "CCW", "@@": "CW", None: None}[m["chi"]], int(m["cls"]) if m["cls"] else None,
            ))
            return end
        m = ORGANIC.match(t, at)
        if not m:
            raise NotationError(f"{t[at]!r} at {at} is no atom, bond or branch")
        mol.atoms.append(Atom(m.group().capitalize() if m.group() != "*" else "*", aromatic=m.group()[0].islower()))
        return m.end()

    def join(i: int, j: int, bond: str | None) -> None:
        mol.bond(i, j, ORDER[bond] if bond else None, {"/": "up", "\\": "down"}.get(bond))

    if not text:
        raise NotationError("empty text")
    _scan(text, bond_at, atom_at, join)
    return mol


class _Target:
    """A molecule with what predicates ask for, each worked out once."""

    def __init__(self, mol: Molecule):
        self.mol, self._rings = mol, None

    @property
    def rings(self) -> RingInfo:
        if self._rings is None:
            self._rings = ring_info(self.mol)
        return self._rings

    def orders(self, i: int) -> float:
        return sum(self.mol.order(k) for _, k in self.mol.around[i])

    def hydrogens(self, i: int) -> int:
        a = self.mol.atoms[i]
        if a.h_count is not None:
            return a.h_count
        z = elements.by_symbol(a.element)
        valences = elements.VALENCES.get(elements.SYMBOLS[z - 1], ()) if z else ()
        return 0 if not z else int(max((valences[0] if valences else 0) - self.orders(i), 0.0) + 0.5)


Test = Callable[[_Target, int], bool]


def _element(symbol: str, aromatic: bool | None) -> Test:
    return lambda t, i: (t.mol.atoms[i].element or "").lower() == symbol.lower() and (aromatic is None or t.mol.atoms[i].aromatic == aromatic)


def _number(text: str, at: int, default: int | None) -> tuple[int | None, int]:
    m = re.compile(r"\d+").match(text, at)
    return (int(m.group()), m.end()) if m else (default, at)


def _primitive(t: str, at: int, depth: int) -> tuple[Test, int]:
    c = t[at]
    if t.startswith("$(", at):
        level = 0
        for k in range(at + 1, len(t)):
            level += (t[k] == "(") - (t[k] == ")")
            if not level:
                inner = Pattern(t[at + 2 : k], depth + 1)
                return (lambda g, i: inner.anchored(g, i)), k + 1
        raise NotationError("a recursive pattern is not closed")
    if c == "*":
        return (lambda g, i: True), at + 1
    if c == "#":
        z, end = _number(t, at + 1, None)
        if z is None or not 1 <= z <= len(elements.SYMBOLS):
            raise NotationError(f"no element {t[at:end]}")
        return _element(elements.SYMBOLS[z - 1], None), end
    if c in "+-":
        m = re.compile(r"\++\d*|-+\d*").match(t, at)
        q = _charge(m.group())
        return (lambda g, i: int(g.mol.atoms[i].charge) == q), m.end()
    if c == "@":
        return (lambda g, i: False), at + (2 if t.startswith("@@", at) else 1)
    if c == ":":
        n, end = _number(t, at + 1, None)
        return (lambda g, i: g.mol.atoms[i].atom_class == n), end
    if c.isdigit():
        n, end = _number(t, at, None)
        return (lambda g, i: g.mol.atoms[i].isotope == n), end
    two = t[at : at + 2]
    if len(two) == 2 and two[1].islower() and elements.by_symbol(two) and two not in ("Dh", "Hr", "Xr") and (two[0].isupper() or two in AROMATIC):
        return _element(two, two[0].islower()), at + 2
    if c in "DXHhvRr":
        n, end = _number(t, at + 1, None)
        if c == "D":
            return (lambda g, i, n=1 if n is None else n: len(g.mol.around[i]) == n), end
        if c == "X":
            return (lambda g, i, n=1 if n is None else n: len(g.mol.around[i]) + g.hydrogens(i) == n), end
        if c in "Hh":
            return (lambda g, i, n=1 if n is None else n: g.hydrogens(i) == n), end
        if c == "v":
            return (lambda g, i, n=1 if n is None else n: int(g.orders(i) + g.hydrogens(i) + 0.5) == n), end
        if n is None:
            return (lambda g, i: bool(g.rings.of_atom[i])), end
        return ((lambda g, i: len(g.rings.of_atom[i]) == n) if c == "R" else (lambda g, i: min(g.rings.of_atom[i], default=0) == n)), end
    if c == "A":
        return (lambda g, i: not g.mol.atoms[i].aromatic), at + 1
    if c == "a":
        return (lambda g, i: g.mol.atoms[i].aromatic), at + 1
    if elements.by_symbol(c) and (c.isupper() or c in AROMATIC):
        return _element(c, c.islower()), at + 1
    raise NotationError(f"no primitive at {t[at:]!r}")


def _logic(t: str, unit: Callable) -> Callable:
    """A test from primitives joined by ! & , and ; in this order of strength. unit reads one primitive at a place."""
    if not t:
        raise NotationError("an empty query")
    low, high, ors = [], [], []
    at, negate = 0, False
    while at < len(t):
        c = t[at]
        if c == "!":
            negate, at = not negate, at + 1
            continue
        if c in "&,;":
            if not high or negate:
                raise NotationError(f"{c!r} joins nothing in {t!r}")
            if c != "&":
                ors.append(high)
                high = []
            if c == ";":
                low.append(ors)
                ors = []
            at += 1
            if at == len(t):
                raise NotationError(f"{c!r} joins nothing in {t!r}")
            continue
        test, at = unit(t, at)
        high.append((lambda *x, f=test: not f(*x)) if negate else test)
        negate = False
    if negate or not high:
        raise NotationError(f"an operator joins nothing in {t!r}")
    low.append([*ors, high])
    return lambda *x: all(any(all(f(*x) for f in ands) for ands in each) for each in low)


def _bond_unit(t: str, at: int) -> tuple[Callable, int]:
    c = t[at]
    if c == "~":
        return (lambda order, ring: True), at + 1
    if c == "@":
        return (lambda order, ring: ring), at + 1
    if c in "/\\":
        return (lambda order, ring: False), at + 1
    return (lambda order, ring, o=ORDER[c]: abs(order - o) < 0.01), at + 1


class Pattern:
    """A compiled SMARTS pattern.

    An embedding maps pattern atoms to different atoms so that bonds map to bonds and atoms that are bonded in the molecule
    are bonded in the pattern too. Every embedding counts, also those that a symmetry of the pattern turns into each other.
    Parts between dots map to disjoint atoms. A bond that is not written is single or aromatic.
    """

    def __init__(self, text: str, depth: int = 0):
        if depth > DEPTH:
            raise NotationError("recursive patterns are too deep")
        self.tests: list[Test] = []
        self.links: list[dict[int, Callable]] = []

        def bond_at(t: str, at: int):
            m = re.compile(r"[-=#$:~@/\\!&,;]+").match(t, at)
            return (m.group(), m.end()) if m else None

        def atom_at(t: str, at: int) -> int:
            if t[at] == "[":
                inner, end = _inside(t, at)
                self.tests.append(_logic(inner, lambda x, k: _primitive(x, k, depth)))
            else:
                m = re.compile(r"Cl|Br|[BCNOPSFI]|[bcnops]|[*aA]").match(t, at)
                if not m:
                    raise NotationError(f"{t[at]!r} at {at} is no atom, bond or branch")
                self.tests.append(_primitive(m.group(), 0, depth)[0])
                end = m.end()
            self.links.append({})
            return end

        def join(i: int, j: int, bond: str | None) -> None:
            test = _logic(bond, _bond_unit) if bond else lambda order, ring: abs(order - 1.0) < 0.01 or abs(order - 1.5) < 0.01
            self.links[i][j] = self.links[j][i] = test

        self.parts = _scan(text, bond_at, atom_at, join) if text else []
        if not text:
            raise NotationError("empty text")
        self._plan = [self._ordered(p[0]) for p in self.parts]

    def _ordered(self, first: int) -> list[int]:
        """Pattern atoms of a part so that each but the first has a neighbour before it."""
        out, seen = [first], {first}
        for i in out:
            for j in sorted(self.links[i]):
                if j not in seen:
                    seen.add(j)
                    out.append(j)
        return out

    def _grow(self, g: _Target, plan: list[int], start: int | None, first: bool = False) -> list[dict[int, int]]:
        mol, out = g.mol, []

        def fits(p: int, a: int, held: dict[int, int], used: dict[int, int]) -> bool:
            bonds = 0
            for b, k in mol.around[a]:
                q = used.get(b)
                if q is not None:
                    test = self.links[p].get(q)
                    if test is None or not test(mol.order(k), k in g.rings.bonds):
                        return False
                    bonds += 1
            return bonds == sum(q in held for q in self.links[p]) and self.tests[p](g, a)

        def step(at: int, held: dict[int, int], used: dict[int, int]) -> bool:
            if at == len(plan):
                out.append(dict(held))
                return first
            p = plan[at]
            near = next((held[q] for q in self.links[p] if q in held), None)
            pool = [b for b, _ in mol.around[near]] if near is not None else [start] if start is not None else range(len(mol.atoms))
            for a in pool:
                if a not in used and fits(p, a, held, used):
                    held[p], used[a] = a, p
                    done = step(at + 1, held, used)
                    del held[p], used[a]
                    if done:
                        return True
            return False

        step(0, {}, {})
        return out

    def anchored(self, g: _Target, atom: int) -> bool:
        """Whether an embedding has its first atom there."""
        return bool(self._grow(g, self._plan[0], atom, first=True)) if len(self.parts) == 1 else any(m[0] == atom for m in self._all(g))

    def _all(self, g: _Target) -> list[tuple[int, ...]]:
        whole: list[dict[int, int]] = [{}]
        for plan in self._plan:
            part = self._grow(g, plan, None)
            whole = [a | b for a in whole for b in part if not set(a.values()) & set(b.values())]
        return [tuple(m[p] for p in range(len(self.tests))) for m in whole]

    def find(self, mol: Molecule) -> list[tuple[int, ...]]:
        """Every embedding, as the atoms of the molecule in the order of the pattern."""
        return self._all(_Target(mol))


@lru_cache(maxsize=1000)
def pattern(text: str) -> Pattern:
    return Pattern(text)


def fault(text: str | None) -> str | None:
    """What is wrong with a SMILES text, None if nothing is."""
    if text is None:
        return "null"
    try:
        molecule(text)
    except NotationError as e:
        return str(e)
    return None
