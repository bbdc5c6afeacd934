"""Places in space for a molecule that is known as a graph: distance bounds, a metric matrix, and descent on springs.

One molecule at a time, in plain arrays; ``operators.molecules.embed`` hands it the molecules of a table.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np

from orbitlake.functions import elements
from orbitlake.functions.molecule import Molecule, hybridisation, ring_info

#: Steps of the descent by quality.
STEPS = {"fast": 120, "medium": 260, "better": 520}
#: Bond lengths shrink with the order: factors for single, aromatic, double and triple bonds.
SHRINK = {1.0: 1.0, 1.5: 0.92, 2.0: 0.87, 3.0: 0.78}


@dataclass
class Report:
    """Energy after each stage, the seed that was used, and warnings of stereo centres that came out turned."""

    energies: dict[str, float] = field(default_factory=dict)
    seed: int = 0
    warnings: list[str] = field(default_factory=list)


def _radius(symbol: str | None) -> tuple[float, float]:
    z = elements.by_symbol(symbol)
    return (elements.COVALENT[z - 1], elements.VAN_DER_WAALS[z - 1]) if z else (0.77, 1.7)


def bounds(mol: Molecule) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], float]]:
    """Lower and upper bounds of all distances, smoothed by the triangle inequality, and the distances that are known: over one bond and over two."""
    n = len(mol.atoms)
    cov, vdw = zip(*[_radius(a.element) for a in mol.atoms]) if n else ((), ())
    low, high = np.zeros((n, n)), np.full((n, n), 1e3)
    known: dict[tuple[int, int], float] = {}

    def fix(i: int, j: int, d: float) -> None:
        known.setdefault((min(i, j), max(i, j)), d)

    length = {}
    for k, (i, j, _, _) in enumerate(mol.bonds):
        order = mol.order(k)
        factor = SHRINK.get(order, 1.0 if order < 1.25 else 0.87)
        length[frozenset((i, j))] = (cov[i] + cov[j]) * factor
        fix(i, j, (cov[i] + cov[j]) * factor)
    inside: dict[tuple[int, frozenset], int] = {}
    for r in ring_info(mol).rings:
        for x, i in enumerate(r):
            key = (i, frozenset((r[x - 1], r[(x + 1) % len(r)])))
            inside[key] = min(inside.get(key, 99), len(r))
    for j in range(n):
        ideal = {"sp": np.pi, "sp2": 2 * np.pi / 3}.get(hybridisation(mol, j), np.arccos(-1 / 3))
        if mol.atoms[j].aromatic:
            ideal = 2 * np.pi / 3
        near = [v for v, _ in mol.around[j]]
        for x, i in enumerate(near):
            for k in near[:x]:
                size = inside.get((j, frozenset((i, k))))
                angle = np.pi * (size - 2) / size if size and size < 6 else ideal
                a, b = length[frozenset((i, j))], length[frozenset((j, k))]
                fix(i, k, float(np.sqrt(a * a + b * b - 2 * a * b * np.cos(angle))))
    for i in range(n):
        for j in range(i):
            low[i, j] = low[j, i] = 0.7 * (vdw[i] + vdw[j])
    for (i, j), d in known.items():
        low[i, j] = low[j, i] = high[i, j] = high[j, i] = d
    np.fill_diagonal(high, 0.0)
    for k in range(n):
        high = np.minimum(high, high[:, k : k + 1] + high[k : k + 1, :])
    low = np.minimum(low, high)
    for k in range(n):
        low = np.maximum(low, np.maximum(low[:, k : k + 1] - high[k : k + 1, :], low[k : k + 1, :] - high[:, k : k + 1]))
    np.fill_diagonal(low, 0.0)
    return np.minimum(low, high), high, known


def start(low: np.ndarray, high: np.ndarray, rnd: np.random.Generator) -> np.ndarray:
    """Places from distances drawn between the bounds: the three greatest eigenvectors of their metric matrix."""
    n = len(low)
    d = low + (np.minimum(high, low + 6.0) - low) * rnd.random((n, n))
    d = np.triu(d, 1)
    d2 = (d + d.T) ** 2
    g = -0.5 * (d2 - d2.mean(0) - d2.mean(1)[:, None] + d2.mean())
    values, vectors = np.linalg.eigh(g)
    top = np.argsort(values)[::-1][:3]
    x = np.zeros((n, 3))
    x[:, : len(top)] = vectors[:, top] * np.sqrt(np.maximum(values[top], 1e-2))
    return x + rnd.normal(scale=1e-3, size=x.shape)


class Springs:
    """Energy and slope: known distances as springs, all others as walls at their lower bound, chiral centres as signed volumes."""

    def __init__(self, low: np.ndarray, known: dict[tuple[int, int], float], chiral: list[tuple[tuple[int, ...], float]]):
        n = len(low)
        self.i, self.j = np.triu_indices(n, 1)
        at = {p: d for p, d in known.items()}
        self.rest = np.array([at.get((a, b), 0.0) for a, b in zip(self.i, self.j)])
        self.bound = self.rest > 0
        self.low, self.chiral = low[self.i, self.j], chiral

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        v = x[self.i] - x[self.j]
        r = np.maximum(np.sqrt((v * v).sum(1)), 1e-9)
        off = np.where(self.bound, r - self.rest, np.minimum(r - self.low, 0.0))
        weight = np.where(self.bound, 1.0, 0.3)
        pull = (2 * weight * off / r)[:, None] * v
        slope = np.zeros_like(x)
        np.add.at(slope, self.i, pull)
        np.add.at(slope, self.j, -pull)
        energy = float((weight * off * off).sum())
        for (a, b, c, d), sign in self.chiral:
            p, q, s = x[b] - x[a], x[c] - x[a], x[d] - x[a]
            volume = float(p @ np.cross(q, s))
            short = min(sign * volume - 1.0, 0.0)
            energy += 0.2 * short * short
            f = 0.4 * short * sign
            gp, gq, gs = f * np.cross(q, s), f * np.cross(s, p), f * np.cross(p, q)
            slope[b] += gp
            slope[c] += gq
            slope[d] += gs
            slope[a] -= gp + gq + gs
        return energy, slope


def descend(springs: Springs, x: np.ndarray, steps: int, memory: int = 8) -> tuple[np.ndarray, float]:
    """Quasi-Newton descent with a limited memory; a step that would climb is halved, and the memory is dropped where halving does not help."""
    energy, slope = springs(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(slope).max(initial=0.0) < 1e-5:
            break
        q, alphas = slope.ravel().copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q -= a * y
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 0.1
        for (s, y), a in zip(past, reversed(alphas)):
            q += (a - (y @ q) / (s @ y)) * s
        move = -q.reshape(x.shape)
        size = np.abs(move).max()
        move *= min(1.0, 0.3 / size) if size > 0 else 1.0
        scale = 1.0
        for _ in range(12):
            e, g = springs(x + scale * move)
            if e < energy:
                break
            scale /= 2
        else:
            if not past:
                break
            past = []
            continue
        s, y = (scale * move).ravel(), (g - slope).ravel()
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        x, energy, slope = x + scale * move, e, g
    return x, energy


def _turn(x: np.ndarray, axis: tuple[int, int], side: list[int], angle: float) -> np.ndarray:
    """x with the atoms of one side turned about a bond."""
    a, b = x[axis[0]], x[axis[1]]
    k = (b - a) / max(np.linalg.norm(b - a), 1e-9)
    v = x[side] - b
    out = x.copy()
    out[side] = b + v * np.cos(angle) + np.cross(k, v) * np.sin(angle) + np.outer(v @ k, k) * (1 - np.cos(angle))
    return out


def embed(mol: Molecule, seed: int = 0, quality: str = "medium", turns: int = 10) -> tuple[np.ndarray, Report]:
    """Places of the atoms, and a report. The same molecule, seed and quality give the same places.

    Stages: bounds and start, descent, turns about random rotatable bonds that are kept where they lower the energy, descent again, and the check of marked centres.
    A centre marked CCW or CW has that sign of the volume of its first three arms, as the order of its bonds gives them. An empty molecule has no places.
    """
    from orbitlake.functions.molecule import downstream_of_rotatable

    n = len(mol.atoms)
    report = Report(seed=seed)
    if n == 0:
        return np.zeros((0, 3)), report
    text = "".join(f"{a.element}" for a in mol.atoms) + str([b[:2] for b in mol.bonds])
    rnd = np.random.default_rng([seed, zlib.crc32(text.encode())])
    low, high, known = bounds(mol)
    chiral = []
    for c, a in enumerate(mol.atoms):
        near = [v for v, _ in mol.around[c]]
        if a.stereo in ("CW", "CCW") and len(near) >= 3:
            chiral.append(((c, *near[:3]), 1.0 if a.stereo == "CCW" else -1.0))
    springs = Springs(low, known, chiral)
    x = start(low, high, rnd)
    report.energies["start"] = springs(x)[0]
    x, e = descend(springs, x, STEPS[quality])
    report.energies["descent"] = e
    rotors = downstream_of_rotatable(mol)
    for _ in range(turns if rotors else 0):
        k, side = rotors[rnd.integers(len(rotors))]
        trial = _turn(x, mol.bonds[k][:2], side, rnd.uniform(-np.pi, np.pi))
        te = springs(trial)[0]
        if te < e:
            x, e = trial, te
    report.energies["turns"] = e
    x, e = descend(springs, x, STEPS[quality])
    report.energies["final"] = e
    for (c, *arms), sign in chiral:
        p, q, s = (x[v] - x[c] for v in arms)
        if sign * float(p @ np.cross(q, s)) <= 0:
            report.warnings.append(f"centre {c} is turned")
    return x - x.mean(0), report
