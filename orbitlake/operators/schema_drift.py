"""Problem 2: schemas that drift between files.

Header schemas are read in parallel, folded through a lattice of types, all files are cast to the union schema, and the
differences between successive files of a stream are logged in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitlake.operators.skew import hot_keys, lookup
from orbitlake.operators.units import latest
from orbitlake.runtime import Scratch

#: The lattice: L < I < R < S; the join of several types is the highest of them, and the larger number of tokens holds.
LATTICE = ["L", "I", "R", "S"]
#: Days in a block of a stream's time line; the order inside blocks and between blocks is found apart.
BLOCK_DAYS = 30
TRUE, FALSE = ["t", "true", ".true.", "1", "yes"], ["f", "false", ".false.", "0", "no"]
NUMBER = r"^[+-]?+(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)(?:[eEdD][+-]?+[0-9]++)?+\z"
DIGITS = r"^[+-]?+[0-9]++\z"


def previous_files(files: DataFrame) -> DataFrame:
    """file_id and prev_id of each file but the first of its stream, by written_at and then file_id.

    Repeated rows count once; rows with a null file, stream or time have no place in an order and are left out. No
    task sees more of a stream than one block of time: blocks are linked by their last files.
    """
    f = latest(files.select("file_id", "stream_id", "written_at", "ingested_at"), ["file_id"]).where("stream_id is not null and written_at is not null")
    f = f.withColumn("block", F.floor(F.unix_date(F.col("written_at").cast("date")) / BLOCK_DAYS))
    inner = Window.partitionBy("stream_id", "block").orderBy("written_at", "file_id")
    f = f.withColumn("prev_id", F.lag("file_id").over(inner))
    ends = f.groupBy("stream_id", "block").agg(F.max(F.struct("written_at", "file_id"))["file_id"].alias("last_id"))
    ends = ends.withColumn("carried", F.lag("last_id").over(Window.partitionBy("stream_id").orderBy("block"))).drop("last_id")
    f = f.where("prev_id is not null").select("file_id", "prev_id").unionAll(f.where("prev_id is null").join(ends, ["stream_id", "block"]).select("file_id", F.col("carried").alias("prev_id")))
    return f.where("prev_id is not null")


def header_schemas(specs: DataFrame) -> DataFrame:
    """file_id, spec_no, name, ty (upper case), m and first, the place of the property's first token in a line; one row for each property."""
    s = specs.select("file_id", "spec_no", F.col("prop_name").alias("name"), F.upper("ty").alias("ty"), "m").distinct().where("file_id is not null and spec_no is not null")
    before = Window.partitionBy("file_id").orderBy("spec_no").rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("first", F.coalesce(F.sum(F.coalesce("m", F.lit(1))).over(before), F.lit(0)).cast("int"))


def truth(token: Column) -> Column:
    return F.when(F.lower(token).isin(TRUE), F.lit(True)).when(F.lower(token).isin(FALSE), F.lit(False))


def real(token: Column) -> Column:
    return F.when(token.rlike(NUMBER), F.regexp_replace(token, "[dD]", "e").try_cast("double"))


def whole(token: Column) -> Column:
    """A token as a whole number: exact if it is written in digits, else through a real number without a fraction that doubles hold exactly."""
    x = real(token)
    return F.when(token.rlike(DIGITS), F.ltrim(token, F.lit("+")).try_cast("decimal(38,0)")).when((x == F.floor(x)) & (F.abs(x) < 2.0**53), x.try_cast("decimal(38,0)"))


def canonical(ty: Column, token: Column) -> Column:
    """A token in one form for each value: numbers for I and R, truth values for L, the text itself for S and whatever can't be read."""
    x = real(token)
    number = F.when(x == 0.0, F.lit(0.0)).otherwise(x).cast("string")
    return F.coalesce(F.when(ty == "I", F.coalesce(whole(token).cast("string"), number)).when(ty == "R", number).when(ty == "L", F.when(truth(token), "T").when(~truth(token), "F")), token)


def _tokens() -> Column:
    return F.filter(F.split("line", r"\s+"), lambda x: x != "")


def _part(p: Column) -> Column:
    """The tokens of a property in a line, null if the line is too short for all of them."""
    n = F.greatest(F.coalesce(p["m"], F.lit(1)), F.lit(0))
    got = F.slice(F.col("tokens"), p["first"] + 1, n)
    return F.when(F.size(got) == n, got)


def _with_header(lines: DataFrame, headers: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct lines with the one row that headers has for their file; a file with very many lines is not gathered in one task."""
    rows = lines.select("file_id", "line_no", "line").distinct()
    hot, _ = hot_keys(rows, ["file_id"], scratch)
    return lookup(rows, headers, ["file_id"], hot, "inner").withColumn("tokens", _tokens())


def changes(files: DataFrame, specs: DataFrame, lines: DataFrame, scratch: Scratch) -> DataFrame:
    """file_id, change_kind, old_name, new_name: what differs between each file and the previous one of its stream.

    A removed and an added property of equal type and size are one renamed property if a digest of their values over the
    atoms that both files hold is equal, and the files share an atom. Of several with equal values, they pair up by name.
    Lines are read only of files that lost and gained a property of one kind, and of these properties only. Files without
    the property id share no atoms. Each stage that several others read is written once.
    """
    order = scratch.put(previous_files(files))
    schemas = scratch.put(header_schemas(specs))
    slim = schemas.groupBy("file_id", "name").agg(F.min(F.struct("spec_no", "ty", "m", "first")).alias("p")).select("file_id", "name", "p.ty", "p.m", "p.first").where("name is not null")
    new = order.join(slim, "file_id").select("file_id", "prev_id", "name", F.col("ty").alias("new_ty"), F.col("m").alias("new_m"), F.col("first").alias("new_first"))
    old = order.join(slim.withColumnRenamed("file_id", "prev_id"), "prev_id").select("file_id", F.col("prev_id").alias("old_prev"), "name", F.col("ty").alias("old_ty"), F.col("m").alias("old_m"), F.col("first").alias("old_first"))
    both = scratch.put(new.join(old, ["file_id", "name"], "full"))
    same = both.where("prev_id is not null and old_prev is not null")
    kept = same.where("not (old_ty <=> new_ty)").select("file_id", F.lit("retyped").alias("change_kind"), F.col("name").alias("old_name"), F.col("name").alias("new_name"))
    kept = kept.unionAll(same.where("not (old_m <=> new_m)").select("file_id", F.lit("resized").alias("change_kind"), F.col("name").alias("old_name"), F.col("name").alias("new_name")))
    gone = both.where("prev_id is null").select("file_id", F.col("old_prev").alias("source"), "name", F.col("old_ty").alias("ty"), F.col("old_m").alias("m"), F.col("old_first").alias("first"))
    come = both.where("old_prev is null").select("file_id", F.col("file_id").alias("source"), "name", F.col("new_ty").alias("ty"), F.col("new_m").alias("m"), F.col("new_first").alias("first"))

    kind = ["file_id", "ty", "m"]
    open_ = gone.join(come.select(*kind).distinct(), kind, "left_semi").withColumn("side", F.lit(0)).unionByName(come.join(gone.select(*kind).distinct(), kind, "left_semi").withColumn("side", F.lit(1)))
    roles = open_.groupBy("source", "file_id", "side").agg(F.collect_list(F.struct("name", "ty", "m", "first")).alias("props"))
    roles = roles.groupBy("source").agg(F.collect_list(F.struct(F.col("file_id").alias("pair"), "side", "props")).alias("roles"))
    ids = slim.where("name = 'id'").select(F.col("file_id").alias("source"), F.struct("ty", "m", "first").alias("id"))
    wanted = scratch.put(roles.join(ids, "source").withColumnRenamed("source", "file_id"))
    rows = _with_header(lines, wanted, scratch).withColumn("atom", canonical(F.col("id.ty"), F.array_join(_part(F.col("id")), " "))).where("atom is not null")
    value = lambda p: F.array_join(F.transform(_part(p), lambda t: canonical(p["ty"], t)), " ")
    each = rows.select("atom", F.explode("roles").alias("r"), "tokens").select("atom", "r.pair", "r.side", F.explode(F.transform("r.props", lambda p: F.struct(p["name"].alias("name"), p["ty"].alias("ty"), p["m"].alias("m"), value(p).alias("value")))).alias("v")).select("pair", "atom", "side", "v.*")
    # One shuffle by file and atom serves the least value of repeated atoms and the test that both files hold the atom.
    met = each.repartition("pair", "atom").groupBy("pair", "atom", "side", "name", "ty", "m").agg(F.min("value").alias("value"))
    over = Window.partitionBy("pair", "atom")
    met = met.withColumn("shared", (F.min("side").over(over) == 0) & (F.max("side").over(over) == 1)).where("shared").withColumn("h", F.xxhash64("atom", F.coalesce("value", F.lit("\u0000"))))
    digest = scratch.put(met.groupBy("pair", "side", "name", "ty", "m").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("d1"), F.bit_xor(F.xxhash64("h")).alias("d2")))
    digest = digest.withColumn("k", F.row_number().over(Window.partitionBy("pair", "side", "ty", "m", "n", "d1", "d2").orderBy("name")))
    pair = ["pair", "ty", "m", "n", "d1", "d2", "k"]
    before, after = digest.where("side = 0").select(*pair, F.col("name").alias("old_name")), digest.where("side = 1").select(*pair, F.col("name").alias("new_name"))
    renamed = scratch.put(before.join(after, pair).select(F.col("pair").alias("file_id"), F.lit("renamed").alias("change_kind"), "old_name", "new_name"))
    gone = gone.select("file_id", F.col("name").alias("old_name")).join(renamed.select("file_id", "old_name"), ["file_id", "old_name"], "left_anti")
    come = come.select("file_id", F.col("name").alias("new_name")).join(renamed.select("file_id", "new_name"), ["file_id", "new_name"], "left_anti")
    out = renamed.unionByName(kept).unionByName(gone.select("file_id", F.lit("removed").alias("change_kind"), "old_name", F.lit("").alias("new_name")))
    return out.unionByName(come.select("file_id", F.lit("added").alias("change_kind"), F.lit("").alias("old_name"), "new_name"))


def _folded(schemas: DataFrame) -> DataFrame:
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LATTICE)), F.col("ty")), F.lit(0)), F.lit(len(LATTICE)))
    folded = schemas.where("name is not null").groupBy("name").agg(F.max(rank).alias("r"), F.max("m").alias("m"), F.count_distinct("file_id").alias("n_files"))
    return folded.select("name", F.element_at(F.array(*map(F.lit, LATTICE)), F.col("r").cast("int")).alias("ty"), "m", "n_files")


def union_schema(specs: DataFrame) -> DataFrame:
    """name, ty, m, n_files: the union schema. Types are folded up the lattice, and the largest m holds; a type outside it counts as text."""
    return _folded(header_schemas(specs))


def _cast(p: Column, raw: Column) -> Column:
    """The tokens of a property as the union type says, from the tokens as written: truths become 0 and 1 among numbers, texts stay as they are."""
    number = lambda t: F.when(p["ty"] == "L", truth(t).cast("double")).otherwise(real(t))
    digits = lambda t: F.when(p["ty"] == "L", truth(t).cast("decimal(38,0)")).otherwise(whole(t))
    return F.struct(
        F.when(p["union_ty"] == "L", F.transform(raw, truth)).alias("truths"), F.when(p["union_ty"] == "I", F.transform(raw, digits)).alias("wholes"),
        F.when(p["union_ty"] == "R", F.transform(raw, number)).alias("reals"), F.when(p["union_ty"] == "S", raw).alias("texts"),
    )


def _cast_lines(specs: DataFrame, lines: DataFrame, scratch: Scratch) -> DataFrame:
    """file_id, line_no, cells: for each property its name, union_ty, union_m, values and failed, the tokens that can't be read."""
    schemas = scratch.put(header_schemas(specs))
    # The union type goes to the headers, of which each file has one, and not to the cells, all of which share a few names.
    target = scratch.put(_folded(schemas).select("name", F.col("ty").alias("union_ty"), F.col("m").alias("union_m")))
    hot, _ = hot_keys(schemas, ["name"], scratch)
    typed = lookup(schemas.where("name is not null"), target, ["name"], hot, "inner")
    headers = typed.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("spec_no", "name", "ty", "m", "first", "union_ty", "union_m"))).alias("props"))
    rows = _with_header(lines, headers, scratch)

    def read(p: Column) -> Column:
        raw = _part(p)
        v = _cast(p, raw)
        lost = F.when(raw.isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.filter(raw, lambda t: F.when(p["union_ty"] == "L", truth(t).isNull()).when(p["union_ty"] == "I", F.when(p["ty"] == "L", truth(t).isNull()).otherwise(whole(t).isNull())).when(p["union_ty"] == "R", F.when(p["ty"] == "L", truth(t).isNull()).otherwise(real(t).isNull())).otherwise(F.lit(False))))
        return F.struct(p["name"].alias("name"), p["union_ty"].alias("ty"), p["union_m"].alias("m"), v.alias("v"), lost.alias("failed"))

    return rows.select("file_id", "line_no", F.transform("props", read).alias("cells"))


def consistent_table(specs: DataFrame, lines: DataFrame, scratch: Scratch) -> DataFrame:
    """All lines as one long table: file_id, line_no, name, ty and m (of the union schema), and the values cast to it.

    truths, wholes (exact up to 38 digits), reals and texts hold the values of L, I, R and S. failed has the tokens that
    can't be read, whose value is null, or one null if the line is too short for the property. Repeated lines count once.
    """
    out = _cast_lines(specs, lines, scratch).select("file_id", "line_no", F.explode("cells").alias("c"))
    return out.select("file_id", "line_no", "c.name", "c.ty", "c.m", "c.v.*", "c.failed")


def wide_table(specs: DataFrame, lines: DataFrame, scratch: Scratch) -> DataFrame:
    """All lines as one wide table under the union schema: file_id, line_no, and a column for each property, an array if m is not 1.

    Only the union schema goes to the driver, one row for each name. A name that equals another column without case gets a number after it.
    """
    schema = union_schema(specs).orderBy("name").collect()
    field = {"L": "truths", "I": "wholes", "R": "reals", "S": "texts"}
    rows = _cast_lines(specs, lines, scratch).withColumn("_m", F.map_from_entries(F.transform(F.filter("cells", lambda c, i: ~F.exists(F.slice("cells", F.lit(1), i), lambda b: b["name"] == c["name"])), lambda c: F.struct(c["name"], c["v"]))))
    taken, cols = {"file_id", "line_no"}, []
    for r in schema:
        name, n = r["name"], 1
        while name.lower() in taken:
            n += 1
            name = f"{r['name']}_{n}"
        taken.add(name.lower())
        got = F.try_element_at("_m", F.lit(r["name"]))[field[r["ty"]]]
        cols.append((F.try_element_at(got, F.lit(1)) if r["m"] == 1 else got).alias(name))
    return rows.select("file_id", "line_no", *cols)
