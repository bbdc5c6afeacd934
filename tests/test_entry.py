import importlib
import sys

from tests.conftest import DATA


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_text_package(monkeypatch, spark):
    for name in [m for m in sys.modules if m.startswith("orbitlake.llm")]:
        monkeypatch.delitem(sys.modules, name)
    import orbitlake

    monkeypatch.delattr(orbitlake, "llm", raising=False)
    monkeypatch.setitem(sys.modules, "orbitlake.llm", None)
    import __spark_entry__ as e

    e = importlib.reload(e)
    assert "p1_found" in e.queries() and not any(k.startswith(("p4_", "p6_", "p7_", "p8_")) for k in e.queries())
    monkeypatch.undo()
    importlib.reload(e)


def test_found_columns(spark):
    from orbitlake.plans import problems

    assert problems.p1_found(spark, DATA).columns == ["field_id", "unit_code", "pow10"]
    assert problems.p3_found(spark, DATA).columns == ["tab", "row_id", "ref_field", "atom_id", "orphan_kind", "rec_month"]
    assert problems.p5_found(spark, DATA).columns == ["line_id", "reason"]
