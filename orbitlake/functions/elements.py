"""The elements: symbols, names, standard masses, radii and usual valences, and expressions that look them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Symbols and names by atomic number, masses in unified atomic mass units, covalent and van der Waals radii
# in angstrom (1.6 and 2.0 where none is known), usual valences, smallest first.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu "
    "Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
NAMES = (
    "Hydrogen Helium Lithium Beryllium Boron Carbon Nitrogen Oxygen Fluorine Neon Sodium Magnesium Aluminum Silicon Phosphorus Sulfur Chlorine Argon Potassium Calcium Scandium Titanium Vanadium "
    "Chromium Manganese Iron Cobalt Nickel Copper Zinc Gallium Germanium Arsenic Selenium Bromine Krypton Rubidium Strontium Yttrium Zirconium Niobium Molybdenum Technetium Ruthenium Rhodium "
    "Palladium Silver Cadmium Indium Tin Antimony Tellurium Iodine Xenon Cesium Barium Lanthanum Cerium Praseodymium Neodymium Promethium Samarium Europium Gadolinium Terbium Dysprosium Holmium "
    "Erbium Thulium Ytterbium Lutetium Hafnium Tantalum Tungsten Rhenium Osmium Iridium Platinum Gold Mercury Thallium Lead Bismuth Polonium Astatine Radon Francium Radium Actinium Thorium "
    "Protactinium Uranium Neptunium Plutonium Americium Curium Berkelium Californium Einsteinium Fermium Mendelevium Nobelium Lawrencium Rutherfordium Dubnium Seaborgium Bohrium Hassium "
    "Meitnerium Darmstadtium Roentgenium Copernicium Nihonium Flerovium Moscovium Livermorium Tennessine Oganesson"
).split()
MASSES = (
    1.008, 4.003, 6.941, 9.012, 10.81, 12.01, 14.01, 16.0, 19.0, 20.18, 22.99, 24.31, 26.98, 28.09, 30.97, 32.07, 35.45, 39.95, 39.1, 40.08, 44.96, 47.87, 50.94, 52.0, 54.94, 55.85, 58.93, 58.69,
    63.55, 65.39, 69.72, 72.61, 74.92, 78.96, 79.9, 83.8, 85.47, 87.62, 88.91, 91.22, 92.91, 95.94, 98.0, 101.1, 102.9, 106.4, 107.9, 112.4, 114.8, 118.7, 121.8, 127.6, 126.9, 131.3, 132.9,
    137.3, 138.9, 140.1, 140.9, 144.2, 145.0, 150.4, 152.0, 157.3, 158.9, 162.5, 164.9, 167.3, 168.9, 173.0, 175.0, 178.5, 180.9, 183.8, 186.2, 190.2, 192.2, 195.1, 197.0, 200.6, 204.4, 207.2,
    209.0, 209.0, 210.0, 222.0, 223.0, 226.0, 227.0, 232.0, 231.0, 238.0, 237.0, 244.0, 243.0, 247.0, 247.0, 251.0, 252.0, 257.0, 258.0, 259.0, 262.0, 267.0, 268.0, 271.0, 272.0, 270.0, 276.0,
    281.0, 280.0, 285.0, 284.0, 289.0, 288.0, 293.0, 294.0, 294.0,
)
COVALENT = (
    0.31, 0.28, 1.28, 0.96, 0.84, 0.76, 0.71, 0.66, 0.57, 0.58, 1.66, 1.41, 1.21, 1.11, 1.07, 1.05, 1.02, 1.06, 2.03, 1.76, 1.7, 1.6, 1.53, 1.39, 1.39, 1.32, 1.26, 1.24, 1.32, 1.22, 1.22, 1.2,
    1.19, 1.2, 1.2, 1.16, 2.2, 1.95, 1.9, 1.75, 1.64, 1.54, 1.47, 1.46, 1.42, 1.39, 1.45, 1.44, 1.42, 1.39, 1.39, 1.38, 1.39, 1.4, 2.44, 2.15, 2.07, 2.04, 2.03, 2.01, 1.99, 1.98, 1.98, 1.96,
    1.94, 1.92, 1.92, 1.89, 1.9, 1.87, 1.87, 1.75, 1.7, 1.62, 1.51, 1.44, 1.41, 1.36, 1.36, 1.32, 1.45, 1.46, 1.48, 1.4, 1.5, 1.5, 2.6, 2.21, 2.15, 2.06, 2.0, 1.96, 1.9, 1.87, 1.8, 1.69, 1.6,
    1.6, 1.6, 1.6, 1.6, 1.6, 1.6, 1.6, 1.6, 1.6, 1.6, 1.6, 1.6, 1.6, 1.6, 1.6, 1.6, 1.6, 1.6, 1.6, 1.6, 1.6,
)
VAN_DER_WAALS = (
    1.2, 1.4, 1.82, 1.53, 1.92, 1.7, 1.55, 1.52, 1.47, 1.54, 2.27, 1.73, 1.84, 2.1, 1.8, 1.8, 1.75, 1.88, 2.75, 2.31, 2.11, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 1.63, 1.4, 1.39, 1.87, 2.11, 1.85, 1.9,
    1.85, 2.02, 3.03, 2.49, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 1.63, 1.72, 1.58, 1.93, 2.17, 2.06, 2.06, 1.98, 2.16, 3.43, 2.68, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0,
    2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 1.75, 1.66, 1.55, 1.96, 2.02, 2.07, 1.97, 2.02, 2.2, 3.48, 2.83, 2.0, 2.0, 2.0, 1.86, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0,
    2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0,
)
VALENCES = {
    "H": (1,), "Li": (1,), "Be": (2,), "B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "F": (1,), "Na": (1,), "Mg": (2,), "Al": (3,), "Si": (4,), "P": (3, 5), "S": (2, 4, 6), "Cl": (1, 3, 5, 7),
    "K": (1,), "Ca": (2,), "Sc": (3,), "Ti": (2, 3, 4), "V": (2, 3, 4, 5), "Cr": (2, 3, 6), "Mn": (2, 3, 4, 6, 7), "Fe": (2, 3), "Co": (2, 3), "Ni": (2, 3), "Cu": (1, 2), "Zn": (2,), "Ga": (3,),
    "Ge": (2, 4), "As": (3, 5), "Se": (2, 4, 6), "Br": (1, 3, 5, 7), "Rb": (1,), "Sr": (2,), "Y": (3,), "Zr": (4,), "Nb": (3, 5), "Mo": (2, 3, 4, 5, 6), "Tc": (4, 6, 7), "Ru": (2, 3, 4, 6, 8),
    "Rh": (2, 3), "Pd": (2, 4), "Ag": (1,), "Cd": (2,), "In": (3,), "Sn": (2, 4), "Sb": (3, 5), "Te": (2, 4, 6), "I": (1, 3, 5, 7), "Cs": (1,), "Ba": (2,), "La": (3,), "Ce": (3, 4), "Pr": (3, 4),
    "Nd": (3,), "Pm": (3,), "Sm": (2, 3), "Eu": (2, 3), "Gd": (3,), "Tb": (3, 4), "Dy": (3,), "Ho": (3,), "Er": (3,), "Tm": (2, 3), "Yb": (2, 3), "Lu": (3,), "Hf": (4,), "Ta": (5,),
    "W": (2, 3, 4, 5, 6), "Re": (2, 4, 6, 7), "Os": (2, 3, 4, 6, 8), "Ir": (2, 3, 4), "Pt": (2, 4), "Au": (1, 3), "Hg": (1, 2), "Tl": (1, 3), "Pb": (2, 4), "Bi": (3, 5), "Po": (2, 4), "At": (1,),
    "Fr": (1,), "Ra": (2,), "Ac": (3,), "Th": (4,), "Pa": (4, 5), "U": (3, 4, 5, 6), "Np": (3, 4, 5, 6), "Pu": (3, 4, 5, 6), "Am": (2, 3, 4, 5, 6), "Cm": (3,), "Bk": (3, 4), "Cf": (2, 3, 4),
    "Es": (2, 3), "Fm": (2, 3), "Md": (2, 3), "No": (2, 3), "Lr": (3,),
}
NUMBER = {s.lower(): z for z, s in enumerate(SYMBOLS, 1)}


def by_symbol(symbol: str | None) -> int | None:
    """Atomic number of a symbol in any case, None for what is no element."""
    return NUMBER.get(symbol.strip().lower()) if symbol else None


def table(spark: SparkSession) -> DataFrame:
    """z, symbol, name, mass, covalent_radius, vdw_radius, valences: one row for each element."""
    rows = [(z, s, n, m, c, v, list(VALENCES.get(s, ()))) for z, (s, n, m, c, v) in enumerate(zip(SYMBOLS, NAMES, MASSES, COVALENT, VAN_DER_WAALS), 1)]
    return spark.createDataFrame(rows, "z int, symbol string, name string, mass double, covalent_radius double, vdw_radius double, valences array<int>")


def mass(symbol: Column, default: float = 1.0) -> Column:
    """Mass of an element symbol in any case; the default for blanks, nulls and elements without a mass here."""
    table = F.create_map(*[F.lit(x) for pair in zip((s.lower() for s in SYMBOLS), MASSES) for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(symbol))), F.lit(default))


def mass_sql(symbol: str, default: float = 1.0) -> str:
    return f"CASE lower(trim({symbol})) " + " ".join(f"WHEN '{s.lower()}' THEN {m}::DOUBLE" for s, m in zip(SYMBOLS, MASSES)) + f" ELSE {default}::DOUBLE END"


def number(symbol: Column) -> Column:
    """Atomic number, null for what is no element."""
    return F.nullif(F.array_position(F.array(*[F.lit(s.lower()) for s in SYMBOLS]), F.lower(F.trim(symbol))), F.lit(0)).cast("int")
