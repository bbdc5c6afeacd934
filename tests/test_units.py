import math

import pytest

from orbitlake.runtime import Scratch
from orbitlake.functions.units import UnitBook, parse_unit
from orbitlake.operators import units

PAIRS = [
    ("electron_density", "e/angstrom3"), ("electron_density", "e/bohr3"), ("electron_density", "e/nm3"), ("electrostatic_potential", "volt"), ("electrostatic_potential", "hartree/e"), ("electrostatic_potential", "kj/mol/e"),
    ("mass_density", "g/cm3"), ("mass_density", "kg/m3"), ("mass_density", "amu/angstrom3"), ("temperature", "kelvin"), ("temperature", "celsius"), ("pressure", "bar"), ("pressure", "pascal"), ("pressure", "psi"),
]
BOOK = UnitBook(PAIRS)


@pytest.mark.parametrize(
    ("quantity", "text", "want"),
    [
        ("electron_density", "|e| nm^-3", ("e/nm3", 0)), ("electron_density", "el/(a_0^3)", ("e/bohr3", 0)), ("electron_density", "e-·Å⁻³", ("e/angstrom3", 0)), ("electron_density", "electrons per cubic bohr", ("e/bohr3", 0)),
        ("electron_density", "a.u.", ("e/bohr3", 0)), ("electron_density", "(10⁴ e/a03)", ("e/bohr3", 4)), ("electron_density", "[u*Ang^(-3)]", None), ("electrostatic_potential", "10^3 kV", ("volt", 6)), ("electrostatic_potential", "mHa/e (x1e3)", ("hartree/e", 0)),
        ("electrostatic_potential", "kJ mol-1 e-1", ("kj/mol/e", 0)), ("electrostatic_potential", "J/C", ("volt", 0)), ("electrostatic_potential", "eV/e * 10**-2", ("volt", -2)), ("mass_density", "kg/(m^3)", ("kg/m3", 0)), ("mass_density", "g mL^-1", ("g/cm3", 0)),
        ("mass_density", "[u*Ang^(-3) (x1e4)]", ("amu/angstrom3", 4)), ("temperature", "mK", ("kelvin", -3)), ("temperature", "℃", ("celsius", 0)), ("pressure", "hPa", ("pascal", 2)), ("pressure", "lbf/in^2", ("psi", 0)), ("pressure", "N m⁻²", ("pascal", 0)),
        ("pressure", "mbar", ("bar", -3)), ("pressure", "?", None), ("pressure", None, None), ("pressure", "", None), ("nothing", "bar", None),
    ],
)
def test_spellings(quantity, text, want):
    assert BOOK.find(quantity, text) == want


def test_notes():
    assert BOOK.stated("pressure", "bar", "Samples in hPa. Origin shifted by 2 Å.") == ("pascal", 2, "note")
    assert BOOK.stated("pressure", "bar", "Originally in pascals, converted before export; the unit field is right.") == ("bar", 0, "unit")
    assert BOOK.stated("pressure", "n/a", "Barostat held 1 atm during the run.") == (None, None, "missing")
    assert BOOK.stated("temperature", None, "Header unit is stale: samples were rewritten in degrees Celsius.") == ("celsius", 0, "note")
    assert BOOK.stated("electron_density", "e/nm3", "Cell edges are in bohr.")[0] == "e/nm3"


def test_very_long_text_is_no_unit():
    assert parse_unit("x" * 100_000) is None


FIELDS = "field_id long, quantity string, unit string, note string, grid_values array<double>, ingested_at timestamp_ntz, factor int"
REF = "quantity string, unit_code string, factor double, shift double, is_common boolean"


def test_mixture_and_conversion(spark):
    ref = spark.createDataFrame([("pressure", "bar", 1.0, 0.0, True), ("pressure", "pascal", 1e-5, 0.0, False)], REF)
    rows = [(k, "pressure", "bar" if k % 3 else None, None, [1.0 + k / 100, None, 1.1], None, 7) for k in range(30)] + [(100, "pressure", "hPa", None, [1000.0], None, 7), (101, "pressure", "", "", [1.05e5, 0.98e5], None, 7), (102, "colour", "red", None, [1.0], None, 7), (103, "pressure", None, None, None, None, 7)]
    fields = spark.createDataFrame(rows, FIELDS)
    out = {r.field_id: r for r in units.to_common(units.assign_units(fields, ref, Scratch(spark, "test")), ref).collect()}
    assert len(out) == len(rows)
    assert out[0].unit_code == "bar" and out[0].unit_source == "inferred" and not out[0].uncertain and out[0].common_values[1] is None
    assert out[101].unit_code == "pascal" and out[101].unit_source == "inferred" and math.isclose(out[101].common_values[0], 1.05)
    assert math.isclose(out[100].common_values[0], 1.0) and out[100].pow10 == 2
    assert out[102].unit_code is None and out[102].uncertain and out[103].unit_source == "unknown"


def test_not_common_repeated_rows_and_empty(spark):
    ref = spark.createDataFrame([("pressure", "bar", 1.0, 0.0, True), ("pressure", "pascal", 1e-5, 0.0, False)], REF)
    fields = spark.createDataFrame([(1, "pressure", "kPa", None, [1.0], None, 1), (1, "pressure", "kPa", None, [1.0], None, 1), (2, "pressure", "bar", None, [1.0], None, 1)], FIELDS)
    assert [tuple(r) for r in units.not_common(fields, ref).collect()] == [(1, "pascal", 3)]
    assert units.not_common(fields.limit(0), ref).count() == 0
    assert units.assign_units(fields.limit(0), ref, Scratch(spark, "test")).count() == 0


def test_powers_of_ten_and_unreadable(spark):
    ref = spark.createDataFrame([("pressure", "bar", 1.0, 0.0, True), ("pressure", "pascal", 1e-5, 0.0, False)], REF)
    rows = [(k, "pressure", "bar", None, [1.0 + k % 7 / 50], None, 7) for k in range(60)] + [(100 + k, "pressure", "Pa x 10^3", None, [100.0 + k], None, 7) for k in range(20)]
    rows += [(200, "pressure", None, None, [104.0], None, 7), (201, "pressure", "zorkmid", None, [104.0], None, 7), (202, "pressure", None, None, [-1.0, 0.0, float("nan")], None, 7), (203, "pressure", None, None, [0.0], None, 7)]
    fields = spark.createDataFrame(rows, FIELDS)
    out = {r.field_id: r for r in units.assign_units(fields, ref, Scratch(spark, "test")).collect()}
    assert (out[200].unit_code, out[200].pow10, out[200].unit_source, out[200].uncertain) == ("pascal", 3, "inferred", False)
    assert (out[201].unit_code, out[201].unit_source, out[201].uncertain) == ("pascal", "unreadable", True)
    assert out[202].unit_code == "bar" and out[203].unit_source == "unknown" and out[203].uncertain
    held = units.held_out(fields, ref, Scratch(spark, "test")).collect()
    assert sum(r.n for r in held) == sum(r.n_right for r in held) > 5


def test_found_where_the_unit_cannot_be_read(spark, tmp_path):
    from orbitlake.plans import problems

    rows = [(k, "pressure", "bar", None, [1.0 + k % 7 / 50], None, 7) for k in range(60)] + [(100 + k, "pressure", "Pa", None, [1e5 + 1000.0 * k], None, 7) for k in range(20)]
    rows += [(200, "pressure", "zorkmid", None, [1.04e5], None, 7), (201, "pressure", "zorkmid", None, [1.04], None, 7), (202, "pressure", None, None, [1.04e5], None, 7), (203, "pressure", "kPa", None, None, None, 7), (203, "pressure", "kPa", None, None, None, 7)]
    spark.createDataFrame(rows, FIELDS).write.parquet(f"{tmp_path}/gridfields.parquet")
    spark.createDataFrame([("pressure", "bar", 1.0, 0.0, True), ("pressure", "pascal", 1e-5, 0.0, False)], REF).write.parquet(f"{tmp_path}/unitref.parquet")
    got = sorted(tuple(r) for r in problems.p1_found(spark, str(tmp_path)).collect())
    assert got == [(100 + k, "pascal", 0) for k in range(20)] + [(200, "pascal", 0), (203, "pascal", 3)]


def test_note_of_many_words():
    assert BOOK.stated("pressure", "bar", "Samples are in pascals " + "and so on " * 20_000)[0] == "pascal"


def test_note_with_powers_written_above():
    assert BOOK.stated("mass_density", "", "Einheit der Werte: amu / Ang³ Potential cut at 9 Å.") == ("amu/angstrom3", 0, "note")
    assert BOOK.stated("electron_density", None, "values are given as a.u. for all")[0] == "e/bohr3"
