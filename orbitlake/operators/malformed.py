"""Problem 5: rows that fail to parse.

Structure (quoting, number of columns) is checked once on each line and written with the fields. The fields of
well-built lines are then checked by value: each distinct value of a kind of field is cast once, the invalid ones make a
dictionary with their reasons, and the dictionary is joined back to the fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitlake.runtime import HOT_SHARE, Scratch

# Possessive throughout: no pattern goes back, or recurses, on a long value. \z, as $ would allow a line end after the value.
WHOLE = r"^\+?+[0-9]++\z"
DECIMAL = r"^[+-]?+(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)(?:[eE][+-]?+[0-9]++)?+\z"
INTEGER = r"^[+-]?+[0-9]++\z"
LABEL = r"^[A-Za-z][^ \t\n\r\u000b\f,\"'#]*+\z"
FREE_LABEL = r"^[A-Za-z]"
CSV_CELL = r'(?:[ \t]*+"[^"]*+(?:""[^"]*+)*+"[ \t]*+|[^",]*+)'
CSV_SHAPE = rf"^(?:,{CSV_CELL})++\z"
CSV_FIELD = rf",({CSV_CELL})"

#: Kinds of fields of each layout, in the order of the columns.
LAYOUTS: dict[str, list[tuple[str, str]]] = {
    "pdb_atom": [("id", "positive"), ("x", "decimal"), ("y", "decimal"), ("z", "decimal")],
    "sdf_bond": [("atom_i", "positive"), ("atom_j", "positive"), ("bond_order", "order")],
    "lammps_atomic": [("id", "positive"), ("atom_type", "type"), ("x", "decimal"), ("y", "decimal"), ("z", "decimal")],
    "lammps_charge": [("id", "positive"), ("atom_type", "type"), ("charge", "decimal"), ("x", "decimal"), ("y", "decimal"), ("z", "decimal")],
    "lammps_molecular": [("id", "positive"), ("molecule_id", "natural"), ("atom_type", "type"), ("x", "decimal"), ("y", "decimal"), ("z", "decimal")],
    "lammps_full": [("id", "positive"), ("molecule_id", "natural"), ("atom_type", "type"), ("charge", "decimal"), ("x", "decimal"), ("y", "decimal"), ("z", "decimal")],
    "csv": [("id", "positive"), ("molecule_id", "natural?"), ("atom_type", "free_type"), ("charge", "decimal?"), ("x", "decimal"), ("y", "decimal"), ("z", "decimal")],
}
TYPED = [("id", "int"), ("molecule_id", "int"), ("atom_type", "string"), ("charge", "double"), ("x", "double"), ("y", "double"), ("z", "double"), ("atom_i", "int"), ("atom_j", "int"), ("bond_order", "int")]


def _whole(v: Column, low: int, high: int = 2147483647) -> Column:
    digits = F.ltrim(F.regexp_replace(v, r"^\+", ""), F.lit("0"))
    number = F.when(F.length(digits) <= 10, F.when(digits == "", 0).otherwise(digits.cast("long")))
    return F.when(~v.rlike(WHOLE), "not a whole number").when(number.isNull() | (number > high), "number too large" if high > 99 else "outside the allowed range").when(number < low, "number too small")


def fault(kind: Column, value: Column) -> Column:
    """What is wrong with a value of a kind, null if nothing is."""
    optional = kind.endswith("?")
    base = F.rtrim(kind, F.lit("?"))
    decimal = F.when(~value.rlike(DECIMAL), "not a decimal number")
    numbered = value.rlike(r"^[+0-9]")
    return F.when(optional & (value == ""), None).otherwise(
        F.when(base == "positive", _whole(value, 1)).when(base == "natural", _whole(value, 0)).when(base == "order", _whole(value, 1, 8)).when(base == "decimal", decimal)
        .when(base == "integer", F.when(~value.rlike(INTEGER), "not an integer"))
        .when(base.isin("type", "free_type"), F.when(numbered, _whole(value, 1)).when(~F.when(base == "type", value.rlike(LABEL)).otherwise(value.rlike(FREE_LABEL)), "not a label"))
    )


def structure(lines: DataFrame) -> DataFrame:
    """Records with ``fault`` (quoting, columns or null) and ``fields``, an array of (name, kind, value).

    Blank lines, null lines and lines whose first non-blank character is # are no records. A layout that isn't known
    has fault ``columns``: no line can follow it.
    """
    line, layout = F.col("line"), F.col("layout")
    records = lines.where(line.isNotNull() & ~line.rlike(r"^\s*+(?:#|\z)"))
    plain = F.rtrim(line, F.lit("\r\n"))
    lammps = layout.startswith("lammps_")
    words = F.filter(F.split(F.substring_index(plain, "#", 1), r"[ \t]+"), lambda x: x != "")
    commas = F.concat(F.lit(","), plain)
    inner = F.transform(F.regexp_extract_all(commas, F.lit(CSV_FIELD), F.lit(1)), lambda x: F.btrim(x, F.lit(" \t")))
    cells = F.transform(inner, lambda x: F.when(x.startswith('"'), F.btrim(F.regexp_replace(x.substr(F.lit(2), F.length(x) - 2), '""', '"'), F.lit(" \t"))).otherwise(x))
    fixed = {"pdb_atom": [(7, 5), (31, 8), (39, 8), (47, 8)], "sdf_bond": [(1, 3), (4, 3), (7, 3)]}
    raw = F.when(lammps, words).when(layout == "csv", F.when(commas.rlike(CSV_SHAPE), cells))
    want, kinds = F.lit(None).cast("int"), None
    for name, cols in LAYOUTS.items():
        spec = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(k).alias("kind")) for c, k in cols])
        want = F.when(layout == name, len(cols)).otherwise(want)
        kinds = F.when(layout == name, spec) if kinds is None else kinds.when(layout == name, spec)
        if name in fixed:
            raw = raw.when(layout == name, F.array(*[F.btrim(plain.substr(a, n), F.lit(" \t")) for a, n in fixed[name]]))
    n = F.size("raw")
    fault_ = (
        F.when((layout == "csv") & F.col("raw").isNull(), "quoting")
        .when(F.col("want").isNull() | ((layout == "pdb_atom") & ((F.length(plain) < 54) | ~plain.rlike("^(?:ATOM|HETATM)"))) | ((layout == "sdf_bond") & (F.length(plain) < 9)), "columns")
        .when(~(n == F.col("want")) & ~(lammps & (n == F.col("want") + 3)), "columns")
    )
    named = F.transform(F.slice(F.arrays_zip(F.slice(F.col("raw"), F.lit(1), F.col("want")).alias("v"), kinds.alias("k")), F.lit(1), F.col("want")), lambda s: F.struct(s["k"]["name"].alias("name"), s["k"]["kind"].alias("kind"), s["v"].alias("value")))
    flags = F.transform(F.slice(F.col("raw"), F.col("want") + 1, F.lit(3)), lambda v: F.struct(F.lit("image").alias("name"), F.lit("integer").alias("kind"), v.alias("value")))
    fields = F.when(F.col("fault").isNull(), F.when(n > F.col("want"), F.concat(named, flags)).otherwise(named))
    return records.withColumn("raw", raw).withColumn("want", want).withColumn("fault", fault_).withColumn("fields", fields).select("line_id", "file_code", "layout", "fault", "fields")


class Checked:
    """The lines of one load: the structure of each line, written once, and the dictionary of its invalid values.

    A value that makes up more than HOT_SHARE of all fields, valid or not, is looked up by broadcast, which is bounded by
    1 / HOT_SHARE values; the others meet the dictionary in a shuffled join.
    """

    def __init__(self, lines: DataFrame, scratch: Scratch | None = None):
        self.scratch = scratch or Scratch(lines.sparkSession, "malformed")
        self.records = self.scratch.put(structure(lines))
        self.fields = self.records.where("fault is null").select("line_id", F.explode("fields").alias("f")).select("line_id", "f.*")
        counts = self.fields.groupBy("kind", "value").agg(F.count("*").alias("n")).withColumn("why", fault(F.col("kind"), F.col("value")))
        total = self.records.agg(F.sum(F.when(F.col("fault").isNull(), F.size("fields")))).first()[0] or 0
        self.limit = total * HOT_SHARE
        #: kind, value, n, why: the invalid values, and the hot valid ones, whose why is null.
        self.values = self.scratch.put(counts.where((F.col("n") > self.limit) | F.col("why").isNotNull()))

    def hits(self) -> DataFrame:
        """line_id, name, kind, value, why of every invalid field."""
        hot = F.broadcast(self.values.where(F.col("n") > self.limit).select("kind", "value", F.lit(True).alias("hot"), F.col("why").alias("hot_why")))
        looked = self.fields.join(hot, ["kind", "value"], "left")
        rest = looked.where("hot is null").select("line_id", "name", "kind", "value").join(self.values.where((F.col("n") <= self.limit) & F.col("why").isNotNull()).select("kind", "value", "why"), ["kind", "value"])
        return looked.where("hot_why is not null").select("line_id", "name", "kind", "value", F.col("hot_why").alias("why")).unionByName(rest.select("line_id", "name", "kind", "value", "why"))

    def invalid_values(self) -> DataFrame:
        """The dictionary: kind, value, n, why."""
        return self.values.where("why is not null")


def rejects(lines: DataFrame | Checked) -> DataFrame:
    """line_id, reason (quoting, columns or value), and the details (field name, value, why) of the records that do not follow their layout."""
    checked = lines if isinstance(lines, Checked) else Checked(lines)
    wrong = checked.hits().groupBy("line_id").agg(F.sort_array(F.collect_set(F.struct("name", "value", "why"))).alias("details")).select("line_id", F.lit("value").alias("reason"), "details")
    kind = "array<struct<name:string,value:string,why:string>>"
    return checked.records.where("fault is not null").select("line_id", F.col("fault").alias("reason"), F.lit(None).cast(kind).alias("details")).unionByName(wrong.withColumn("details", F.col("details").cast(kind)))


def typed_rows(lines: DataFrame | Checked) -> DataFrame:
    """The valid records: line_id, file_code, layout and their typed columns; columns that a layout lacks, and empty optional fields, are null."""
    checked = lines if isinstance(lines, Checked) else Checked(lines)
    good = checked.records.where("fault is null").join(checked.hits().select("line_id").distinct(), "line_id", "left_anti")
    as_map = F.map_from_entries(F.transform(F.filter("fields", lambda f: f["name"] != "image"), lambda f: F.struct(f["name"], F.nullif(f["value"], F.lit("")))))
    out = good.withColumn("_m", as_map)
    return out.select("line_id", "file_code", "layout", *[F.element_at("_m", F.lit(c)).try_cast(t).alias(c) for c, t in TYPED])
