"""One molecule as a graph, and what its graph alone decides: rings, hydrogens, charges, stereo, rotatable bonds.

These are kernels for the groups of one molecule that ``operators.molecules`` makes; they hold one molecule at a time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from orbitlake.functions import elements

EPS = 1e-6


@dataclass
class Atom:
    element: str | None
    charge: float = 0.0
    aromatic: bool = False
    isotope: int | None = None
    h_count: int | None = None
    stereo: str | None = None
    atom_class: int | None = None
    xyz: tuple[float, float, float] | None = None


@dataclass
class Molecule:
    """Atoms by place, and bonds (i, j, order or None, mark); an order of None counts as 1."""

    atoms: list[Atom] = field(default_factory=list)
    bonds: list[tuple[int, int, float | None, str | None]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._around: list[list[tuple[int, int]]] | None = None

    def bond(self, i: int, j: int, order: float | None = None, mark: str | None = None) -> None:
        self.bonds.append((i, j, order, mark))
        self._around = None

    @property
    def around(self) -> list[list[tuple[int, int]]]:
        """(neighbour, bond) of each atom, in the order of the bonds."""
        if self._around is None or len(self._around) != len(self.atoms):
            self._around = [[] for _ in self.atoms]
            for k, (i, j, _, _) in enumerate(self.bonds):
                self._around[i].append((j, k))
                self._around[j].append((i, k))
        return self._around

    def order(self, k: int) -> float:
        """Order of a bond; one without, or of order 1, between aromatic atoms counts 1.5."""
        i, j, order, _ = self.bonds[k]
        order = 1.0 if order is None else order
        return 1.5 if abs(order - 1.0) < EPS and self.atoms[i].aromatic and self.atoms[j].aromatic else order

    def valence_sum(self, i: int) -> float:
        return sum(1.0 if self.bonds[k][2] is None else self.bonds[k][2] for _, k in self.around[i])


def rings(mol: Molecule) -> list[list[int]]:
    """A smallest set of independent rings, each as its atoms in order, shortest first.

    Candidates are the shortest ring through each bond, and where these are too few, those through each atom; one joins the
    set if it is no sum (of bonds, modulo 2) of rings in it. Bonds - atoms + components of them are enough. Ties go to the
    bond that comes first.
    """
    around, n = mol.around, len(mol.atoms)
    seen, parts = [False] * n, 0
    for s in range(n):
        if not seen[s]:
            parts += 1
            seen[s], stack = True, [s]
            while stack:
                for v, _ in around[stack.pop()]:
                    if not seen[v]:
                        seen[v] = True
                        stack.append(v)
    want = len(mol.bonds) - n + parts
    if want <= 0:
        return []
    leaves = deque(i for i in range(n) if len(around[i]) == 1)
    degree, dead = [len(x) for x in around], set()
    while leaves:
        i = leaves.popleft()
        for v, k in around[i]:
            if k not in dead:
                dead.add(k)
                degree[v] -= 1
                if degree[v] == 1:
                    leaves.append(v)
    found: dict[frozenset, tuple[list[int], int]] = {}
    for k, (i, j, _, _) in enumerate(mol.bonds):
        if k in dead:
            continue
        back, todo = {i: (-1, -1)}, deque([i])
        while todo and j not in back:
            u = todo.popleft()
            for v, b in around[u]:
                if b != k and b not in dead and v not in back:
                    back[v] = (u, b)
                    todo.append(v)
        if j in back:
            path, bits, at = [j], 1 << k, j
            while at != i:
                at, b = back[at]
                path.append(at)
                bits |= 1 << b
            found.setdefault(frozenset(path), (path, bits))
    out, basis = [], {}

    def take(candidates) -> None:
        for path, bits in sorted(candidates, key=lambda x: len(x[0])):
            left = bits
            while left and (top := left.bit_length()) in basis:
                left ^= basis[top]
            if left and len(out) < want:
                basis[left.bit_length()] = left
                out.append(path)

    take(found.values())
    if len(out) < want:
        take(_through_vertices(mol, dead))
    return out


def _through_vertices(mol: Molecule, dead: set[int]) -> list[tuple[list[int], int]]:
    """Rings of two shortest paths from an atom and the bond between their ends, for every atom and bond: enough where one ring for each bond is not."""
    out = []
    for s in range(len(mol.atoms)):
        way, todo = {s: ([s], 0)}, deque([s])
        while todo:
            u = todo.popleft()
            for v, b in mol.around[u]:
                if b not in dead and v not in way:
                    way[v] = (way[u][0] + [v], way[u][1] | 1 << b)
                    todo.append(v)
        for k, (i, j, _, _) in enumerate(mol.bonds):
            if k not in dead and i in way and j in way and set(way[i][0]) & set(way[j][0]) == {s}:
                out.append((way[i][0] + way[j][0][:0:-1], way[i][1] | way[j][1] | 1 << k))
    return out


@dataclass
class RingInfo:
    rings: list[list[int]]
    of_atom: list[list[int]]
    bonds: set[int]


def ring_info(mol: Molecule) -> RingInfo:
    """Rings, the sizes of those each atom is in, and the bonds that are in one."""
    got = rings(mol)
    of = [[] for _ in mol.atoms]
    at: dict[frozenset, list[int]] = {}
    for k, (i, j, _, _) in enumerate(mol.bonds):
        at.setdefault(frozenset((i, j)), []).append(k)
    bonds = set()
    for r in got:
        for x, i in enumerate(r):
            of[i].append(len(r))
            bonds.update(at.get(frozenset((i, r[x - 1])), ()))
    return RingInfo(got, of, bonds)


def implicit_hydrogens(mol: Molecule, i: int) -> int | None:
    """Hydrogens that the smallest usual valence at or above the bond orders leaves open, plus the formal charge; None without an element or a valence."""
    z = elements.by_symbol(mol.atoms[i].element)
    valences = elements.VALENCES.get(elements.SYMBOLS[z - 1], ()) if z else ()
    if not valences:
        return None
    total = mol.valence_sum(i)
    target = next((v for v in valences if v >= total - EPS), None)
    if target is None:
        return None
    n = target - total + mol.atoms[i].charge
    return 0 if n <= 0.5 else int(n + 0.5)


def hydrogenated(mol: Molecule) -> Molecule:
    """The molecule with a hydrogen for each open valence of its heavy atoms."""
    out = Molecule(list(mol.atoms), list(mol.bonds))
    for i, a in enumerate(mol.atoms):
        if (a.element or "").upper() != "H":
            for _ in range(implicit_hydrogens(mol, i) or 0):
                out.atoms.append(Atom("H"))
                out.bond(i, len(out.atoms) - 1, 1.0)
    return out


def walk(mol: Molecule) -> tuple[list[int], dict[int, tuple[int, int, int, int, int]]]:
    """Atoms in the order of a depth-first walk, and what each bond outside rings cuts off, in time that grows with the molecule.

    Of such a bond: the atom under it, first and last place (exclusive) in the walk of all that hangs on that atom, and those of their component.
    """
    around, order, cuts = mol.around, [], {}
    at, low = [-1] * len(mol.atoms), [0] * len(mol.atoms)
    for s in range(len(mol.atoms)):
        if at[s] >= 0:
            continue
        start, found = len(order), []
        at[s] = low[s] = start
        order.append(s)
        stack = [(s, -1, iter(around[s]))]
        while stack:
            u, by, todo = stack[-1]
            for v, k in todo:
                if k == by:
                    continue
                if at[v] < 0:
                    at[v] = low[v] = len(order)
                    order.append(v)
                    stack.append((v, k, iter(around[v])))
                    break
                low[u] = min(low[u], at[v])
            else:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[u])
                    if low[u] == at[u]:
                        found.append((by, u, at[u], len(order)))
        cuts |= {k: (u, a, b, start, len(order)) for k, u, a, b in found}
    return order, cuts


def _turning(mol: Molecule, cuts) -> list[int]:
    around = mol.around
    return [k for k, (i, j, o, _) in enumerate(mol.bonds) if k in cuts and abs((1.0 if o is None else o) - 1.0) <= 0.01 and len(around[i]) > 1 and len(around[j]) > 1]


def rotatable(mol: Molecule) -> list[int]:
    """Bonds of order 1 outside rings, both ends of which have another neighbour."""
    return _turning(mol, walk(mol)[1])


def downstream(mol: Molecule, j: int, k: int) -> list[int]:
    """Atoms that are reached from k without passing j."""
    seen, todo = {j, k}, [k]
    while todo:
        for v, _ in mol.around[todo.pop()]:
            if v not in seen:
                seen.add(v)
                todo.append(v)
    return sorted(seen - {j})


# Coefficients a, b, c of the electronegativity a + b q + c q^2 by element and hybridisation, and those of hydrogen.
ELECTRONEGATIVITY = {
    ("C", "sp3"): (7.98, 9.18, 1.88), ("C", "sp2"): (8.79, 9.18, 1.88), ("C", "sp"): (10.39, 9.18, 1.88), ("N", "sp3"): (11.54, 10.82, 1.36), ("N", "sp2"): (12.87, 11.15, 0.85), ("N", "sp"): (15.68, 11.70, -0.27),
    ("O", "sp3"): (14.18, 12.92, 1.39), ("O", "sp2"): (17.07, 13.79, 0.47), ("F", "*"): (14.66, 13.85, 2.31), ("Cl", "*"): (11.00, 9.69, 1.35), ("Br", "*"): (10.08, 8.47, 1.16), ("I", "*"): (9.90, 7.96, 0.96),
    ("P", "sp3"): (8.90, 8.24, 0.65), ("S", "sp3"): (10.14, 9.13, 1.38), ("S", "so"): (12.00, 10.81, 1.20), ("S", "so2"): (14.00, 12.00, 1.20), ("Li", "*"): (3.00, 1.79, -0.15), ("Na", "*"): (2.84, 1.77, -0.08), ("K", "*"): (2.42, 1.64, -0.03),
    ("Mg", "sp3"): (5.54, 5.36, 0.61), ("Al", "sp3"): (5.47, 6.09, 1.19), ("Si", "sp3"): (6.99, 7.99, 1.87), ("B", "sp2"): (5.42, 6.68, 1.80),
}
HYDROGEN, HYDROGEN_ION, DAMPING = (7.17, 6.24, -0.56), 20.02, 0.5


def hybridisation(mol: Molecule, i: int) -> str:
    """sp, sp2 or sp3 by the highest bond order; so and so2 for saturated sulfur with oxygens; * where it does not matter."""
    symbol = mol.atoms[i].element or ""
    if symbol.upper() == "H" or symbol in ("F", "Cl", "Br", "I", "Li", "Na", "K"):
        return "*"
    top = max((1.0 if mol.bonds[k][2] is None else mol.bonds[k][2] for _, k in mol.around[i]), default=0.0)
    if top >= 1.5 - EPS:
        return "sp" if top >= 3.0 - EPS else "sp2"
    oxygens = sum(mol.atoms[v].element == "O" for v, _ in mol.around[i]) if symbol == "S" else 0
    return ("sp3", "so", "so2")[min(oxygens, 2)]


def partial_charges(mol: Molecule, rounds: int = 12) -> dict[int, tuple[float, float]]:
    """Charge of each heavy atom and of its implicit hydrogens together, by damped equalisation of electronegativities along bonds.

    A formal charge is first shared among the atoms of its element two conjugated bonds away. In each round charge flows along every bond
    in proportion to the difference of the electronegativities, over that of the cation of the poorer end, half as much as in the round before.
    """
    heavy = [i for i, a in enumerate(mol.atoms) if (a.element or "").upper() != "H"]
    mode = {i: hybridisation(mol, i) for i in range(len(mol.atoms))}
    coef = {i: ELECTRONEGATIVITY.get((mol.atoms[i].element, mode[i]), (0.0, 0.0, 0.0)) for i in heavy}
    ion = {i: sum(c) for i, c in coef.items()}
    q, qh = dict.fromkeys(heavy, 0.0), dict.fromkeys(heavy, 0.0)

    def conjugated(a: int, b: int, k: int) -> bool:
        order = mol.bonds[k][2]
        return (1.0 if order is None else order) >= 1.5 - EPS or all(mode[x] in ("sp", "sp2") for x in (a, b))

    for i in heavy:
        formal = mol.atoms[i].charge
        if abs(formal) >= EPS and abs(q[i]) <= EPS:
            z, group = elements.by_symbol(mol.atoms[i].element), [i]
            for j, k in mol.around[i]:
                if conjugated(i, j, k):
                    group += [v for v, b in mol.around[j] if v != i and v in q and v not in group and z and elements.by_symbol(mol.atoms[v].element) == z and conjugated(j, v, b)]
            for x in group:
                q[x] = formal / len(group)
    n_h = {i: implicit_hydrogens(mol, i) or 0 for i in heavy}
    damp = DAMPING
    for _ in range(rounds):
        level = {i: a + q[i] * (b + c * q[i]) for i, (a, b, c) in coef.items()}
        flow, flow_h = dict.fromkeys(heavy, 0.0), dict.fromkeys(heavy, 0.0)
        for i in heavy:
            for j, _ in mol.around[i]:
                if j in q:
                    poorer = ion[i] if level[j] >= level[i] else ion[j]
                    flow[i] += (level[j] - level[i]) / poorer if abs(poorer) > EPS else 0.0
            if n_h[i]:
                each = qh[i] / n_h[i]
                up = HYDROGEN[0] + each * (HYDROGEN[1] + HYDROGEN[2] * each) - level[i]
                poorer = ion[i] if up >= 0 else HYDROGEN_ION
                if abs(poorer) > EPS:
                    flow[i] += n_h[i] * up / poorer
                    flow_h[i] = -n_h[i] * up / poorer
        for i in heavy:
            q[i] += damp * flow[i]
            qh[i] += damp * flow_h[i]
        damp *= DAMPING
    return {i: (q[i], qh[i]) for i in heavy}


def sides_of_rotatable(mol: Molecule) -> Iterator[tuple[int, np.ndarray]]:
    """(bond, sorted atoms on the side of its second end) of each rotatable bond, one at a time: chains have as many atoms on their sides as the square of their length."""
    order, cuts = walk(mol)
    order = np.array(order, dtype=np.int64)
    for k in _turning(mol, cuts):
        under, a, b, start, end = cuts[k]
        yield k, np.sort(order[a:b] if mol.bonds[k][1] == under else np.concatenate((order[start:a], order[b:end])))


def downstream_of_rotatable(mol: Molecule) -> list[tuple[int, list[int]]]:
    """(bond, atoms on the side of its second end) of each rotatable bond."""
    return [(k, side.tolist()) for k, side in sides_of_rotatable(mol)]
