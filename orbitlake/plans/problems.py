"""Queries of the general problems over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.operators import malformed, references, schema_drift, units
from orbitlake.runtime import Scratch, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return units.not_common_inferred(_fields(spark, d), table(spark, d, "unitref"), Scratch(spark, "units"))


def _fields(spark: SparkSession, d: str) -> DataFrame:
    return units.latest(table(spark, d, "gridfields").select("field_id", "quantity", "unit", "note", "grid_values", "ingested_at"), ["field_id"])


def p1_holdout(spark: SparkSession, d: str) -> DataFrame:
    """How often the mixture is right, and how often it is certain and wrong, where a stated unit is hidden from it."""
    return units.held_out(_fields(spark, d), table(spark, d, "unitref"), Scratch(spark, "units"))


def p1_common(spark: SparkSession, d: str) -> DataFrame:
    """Every field with its samples in the common unit, stated or inferred."""
    ref = table(spark, d, "unitref")
    return units.to_common(units.assign_units(_fields(spark, d), ref, Scratch(spark, "units")), ref).select("field_id", "quantity", "unit_code", "pow10", "unit_source", "posterior", "uncertain", "common_unit", "common_values")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(table(spark, d, "xyzfiles"), table(spark, d, "propspecs"), table(spark, d, "xyzlines"), Scratch(spark, "drift"))


def p2_schema(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.union_schema(table(spark, d, "propspecs"))


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.consistent_table(table(spark, d, "propspecs"), table(spark, d, "xyzlines"), Scratch(spark, "drift"))


def p2_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The consistent table with one row for each token."""
    one = F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("truths"), F.size("wholes"), F.size("reals"), F.size("texts")) - 1), lambda k: F.struct(k.alias("k"), F.col("truths")[k].alias("truth"), F.col("wholes")[k].cast("string").alias("whole"), F.col("reals")[k].alias("real"), F.col("texts")[k].alias("text"))))
    return p2_table(spark, d).where("coalesce(size(truths), size(wholes), size(reals), size(texts)) > 0").select("file_id", "line_no", "name", "ty", "m", one.alias("t")).select("file_id", "line_no", "name", "ty", "m", "t.*")


def p2_wide(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.wide_table(table(spark, d, "propspecs"), table(spark, d, "xyzlines"), Scratch(spark, "drift"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(*(table(spark, d, t) for t in ("atoms", "atomdrops", "bonds", "angles", "conect")))


def p3_by_month(spark: SparkSession, d: str) -> DataFrame:
    return references.orphans_by_month(p3_found(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return malformed.rejects(table(spark, d, "rawlines")).select("line_id", "reason")


def p5_details(spark: SparkSession, d: str) -> DataFrame:
    """One row for each invalid field."""
    out = malformed.rejects(table(spark, d, "rawlines")).where("reason = 'value'")
    return out.select("line_id", F.explode("details").alias("f")).select("line_id", "f.*")


def p5_typed(spark: SparkSession, d: str) -> DataFrame:
    return malformed.typed_rows(table(spark, d, "rawlines"))


QUERIES = {f.__name__: f for f in (p1_found, p1_common, p1_holdout, p2_found, p2_schema, p2_table, p2_tokens, p2_wide, p3_found, p3_by_month, p5_found, p5_details, p5_typed)}

_REFS = " UNION ALL ".join(
    [f"SELECT '{t}' tab, {k} row_id, '{f}' ref_field, frame_id, {f} id, recorded_at t FROM {t}" for t, k, fs in (("bonds", "bond_id", ("atom_i", "atom_j")), ("angles", "angle_id", ("atom_i", "atom_j", "atom_k"))) for f in fs]
    + ["SELECT 'conect', conect_id, 'bonded', frame_id, unnest(bonded), recorded_at FROM conect"]
)
_ORPHANS = f"""WITH a AS (SELECT frame_id, id, min(recorded_at) born FROM atoms GROUP BY 1, 2), x AS (SELECT frame_id, id, min(deleted_at) died FROM atomdrops GROUP BY 1, 2), r AS ({_REFS}),
found AS (SELECT DISTINCT tab, row_id, ref_field, id::BIGINT atom_id, CASE WHEN a.id IS NULL THEN 'missing' WHEN t < born THEN 'late' ELSE 'deleted' END orphan_kind, strftime(t, '%Y-%m') rec_month
FROM r LEFT JOIN a USING (frame_id, id) LEFT JOIN x USING (frame_id, id) WHERE r.id IS NOT NULL AND r.id <> 0 AND r.frame_id IS NOT NULL AND (a.id IS NULL OR t < born OR died <= t))"""
SQL = {
    "p3_found": f"{_ORPHANS} SELECT * FROM found",
    "p3_by_month": f"{_ORPHANS} SELECT tab, ref_field, orphan_kind, rec_month, count(*) n_refs, count(DISTINCT row_id) n_rows FROM found GROUP BY 1, 2, 3, 4",
    "p2_schema": """WITH s AS (SELECT DISTINCT file_id, spec_no, prop_name AS name, upper(ty) ty, m FROM propspecs WHERE file_id IS NOT NULL AND spec_no IS NOT NULL AND prop_name IS NOT NULL)
SELECT name, ['L', 'I', 'R', 'S'][max(CASE ty WHEN 'L' THEN 1 WHEN 'I' THEN 2 WHEN 'R' THEN 3 ELSE 4 END)] ty, max(m) m, count(DISTINCT file_id) n_files FROM s GROUP BY name""",
}


def _whole(v: str, low: int, high: int = 2147483647) -> str:
    return f"(regexp_full_match({v}, '[+]?[0-9]+') AND coalesce(try_cast(ltrim({v}, '+') AS HUGEINT) BETWEEN {low} AND {high}, false))"


def _decimal(v: str) -> str:
    return f"regexp_full_match({v}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')"


def _kind(v: str, kind: str) -> str:
    plain = {
        "positive": _whole(v, 1), "natural": _whole(v, 0), "order": _whole(v, 1, 8), "decimal": _decimal(v), "type": f"({_whole(v, 1)} OR regexp_full_match({v}, '[A-Za-z][^ \\t,\"''#]*'))", "free_type": f"({_whole(v, 1)} OR regexp_matches({v}, '^[A-Za-z]'))",
    }[kind.rstrip("?")]
    return f"({v} = '' OR {plain})" if kind.endswith("?") else plain


def _malformed_sql() -> str:
    cases = []
    for layout, cols in malformed.LAYOUTS.items():
        right = " AND ".join(_kind(f"t[{n + 1}]", kind) for n, (_, kind) in enumerate(cols))
        n = len(cols)
        if layout.startswith("lammps"):
            right += "".join(f" AND (len(t) = {n} OR regexp_full_match(t[{n + k}], '[+-]?[0-9]+'))" for k in (1, 2, 3))
            cases.append(f"WHEN layout = '{layout}' THEN CASE WHEN len(t) NOT IN ({n}, {n + 3}) THEN 'columns' WHEN {right} THEN NULL ELSE 'value' END")
        elif layout == "csv":
            cases.append(f"WHEN layout = 'csv' THEN CASE WHEN NOT shaped THEN 'quoting' WHEN len(t) <> {n} THEN 'columns' WHEN {right} THEN NULL ELSE 'value' END")
        else:
            short = "length(s) < 54 OR NOT regexp_matches(s, '^(ATOM|HETATM)')" if layout == "pdb_atom" else "length(s) < 9"
            cases.append(f"WHEN layout = '{layout}' THEN CASE WHEN {short} THEN 'columns' WHEN {right} THEN NULL ELSE 'value' END")
    cell = "([ \\t]*\"([^\"]|\"\")*\"[ \\t]*|[^\",]*)"
    trim = lambda v: f"trim({v}, ' ' || chr(9))"
    return f"""WITH r AS (SELECT line_id, layout, line s FROM rawlines WHERE line IS NOT NULL AND NOT regexp_matches(line, '^\\s*(#|$)')),
p AS (SELECT *, regexp_full_match(s, '{cell}(,{cell})*') shaped FROM r),
f AS (SELECT *, CASE layout WHEN 'pdb_atom' THEN [{trim("substr(s, 7, 5)")}, {trim("substr(s, 31, 8)")}, {trim("substr(s, 39, 8)")}, {trim("substr(s, 47, 8)")}] WHEN 'sdf_bond' THEN [{trim("substr(s, 1, 3)")}, {trim("substr(s, 4, 3)")}, {trim("substr(s, 7, 3)")}]
WHEN 'csv' THEN list_transform(regexp_extract_all(',' || s, ',([ \\t]*"(?:[^"]|"")*"[ \\t]*|[^",]*)', 1), lambda x: {trim("CASE WHEN left(" + trim("x") + ", 1) = '\"' THEN replace(substr(" + trim("x") + ", 2, length(" + trim("x") + ") - 2), '\"\"', '\"') ELSE x END")})
ELSE list_filter(regexp_split_to_array(regexp_replace(s, '#.*$', ''), '[ \\t]+'), lambda x: x <> '') END t FROM p),
v AS (SELECT line_id, CASE {" ".join(cases)} ELSE 'columns' END reason FROM f)
SELECT line_id, reason FROM v WHERE reason IS NOT NULL"""


SQL["p5_found"] = _malformed_sql()

_NUMBER = "'[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eEdD][+-]?[0-9]+)?'"


def _real_sql(t: str) -> str:
    return f"CASE WHEN regexp_full_match({t}, {_NUMBER}) THEN try_cast(regexp_replace({t}, '[dD]', 'e') AS DOUBLE) END"


def _truth_sql(t: str) -> str:
    return f"CASE WHEN lower({t}) IN ('t', 'true', '.true.', '1', 'yes') THEN true WHEN lower({t}) IN ('f', 'false', '.false.', '0', 'no') THEN false END"


_DRIFT = f"""WITH s AS (SELECT DISTINCT file_id, spec_no, prop_name AS name, upper(ty) ty, m FROM propspecs WHERE file_id IS NOT NULL AND spec_no IS NOT NULL),
h AS (SELECT *, coalesce(sum(coalesce(m, 1)) OVER (PARTITION BY file_id ORDER BY spec_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM s),
l AS (SELECT DISTINCT file_id, line_no, list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '') toks FROM xyzlines)"""
_VALUE = f"""array_to_string(list_transform(l.toks[h.start + 1 : h.start + h.m], lambda t: coalesce(CASE WHEN h.ty IN ('I', 'R') THEN (({_real_sql('t')}) + 0.0)::VARCHAR WHEN h.ty = 'L' THEN ({_truth_sql('t')})::VARCHAR END, t)), ' ')"""
SQL["p2_found"] = f"""{_DRIFT},
f AS (SELECT file_id, arg_max(stream_id, ingested_at) stream_id, arg_max(written_at, ingested_at) written_at FROM xyzfiles WHERE file_id IS NOT NULL GROUP BY 1),
o AS (SELECT file_id, lag(file_id) OVER (PARTITION BY stream_id ORDER BY written_at, file_id) prev_id FROM f WHERE stream_id IS NOT NULL AND written_at IS NOT NULL),
n AS (SELECT o.file_id, h.name, h.ty, h.m FROM o JOIN h USING (file_id) WHERE prev_id IS NOT NULL), p AS (SELECT o.file_id, h.name, h.ty, h.m FROM o JOIN h ON h.file_id = o.prev_id),
gone AS (SELECT * FROM p ANTI JOIN n USING (file_id, name)), come AS (SELECT * FROM n ANTI JOIN p USING (file_id, name)),
v AS (SELECT l.file_id, h.name, {_VALUE} value, i.id FROM l JOIN h USING (file_id) JOIN (SELECT l.file_id, l.line_no, l.toks, {_VALUE} id FROM l JOIN h USING (file_id) WHERE h.name = 'id') i ON i.file_id = l.file_id AND i.line_no = l.line_no AND i.toks = l.toks),
both_ AS (SELECT DISTINCT o.file_id, a.id FROM o JOIN v a ON a.file_id = o.file_id AND a.name = 'id' JOIN v b ON b.file_id = o.prev_id AND b.name = 'id' AND a.id = b.id),
g AS (SELECT gone.file_id, gone.name, gone.ty, gone.m, string_agg(v.id || '=' || v.value, ';' ORDER BY v.id) d FROM gone JOIN o USING (file_id) JOIN v ON v.file_id = o.prev_id AND v.name = gone.name JOIN both_ ON both_.file_id = gone.file_id AND both_.id = v.id GROUP BY 1, 2, 3, 4),
c AS (SELECT come.file_id, come.name, come.ty, come.m, string_agg(v.id || '=' || v.value, ';' ORDER BY v.id) d FROM come JOIN v ON v.file_id = come.file_id AND v.name = come.name JOIN both_ ON both_.file_id = come.file_id AND both_.id = v.id GROUP BY 1, 2, 3, 4),
r AS (SELECT g.file_id, g.name old_name, c.name new_name FROM (SELECT *, row_number() OVER (PARTITION BY file_id, ty, m, d ORDER BY name) k FROM g) g JOIN (SELECT *, row_number() OVER (PARTITION BY file_id, ty, m, d ORDER BY name) k FROM c) c USING (file_id, ty, m, d, k))
SELECT file_id, 'renamed' change_kind, old_name, new_name FROM r
UNION ALL SELECT file_id, 'retyped', n.name, n.name FROM n JOIN p USING (file_id, name) WHERE n.ty <> p.ty UNION ALL SELECT file_id, 'resized', n.name, n.name FROM n JOIN p USING (file_id, name) WHERE n.m <> p.m
UNION ALL SELECT file_id, 'removed', name, '' FROM gone ANTI JOIN r ON r.file_id = gone.file_id AND r.old_name = gone.name UNION ALL SELECT file_id, 'added', '', name FROM come ANTI JOIN r ON r.file_id = come.file_id AND r.new_name = come.name"""
SQL["p2_tokens"] = f"""{_DRIFT}, u AS (SELECT name, ['L', 'I', 'R', 'S'][max(CASE ty WHEN 'L' THEN 1 WHEN 'I' THEN 2 WHEN 'R' THEN 3 ELSE 4 END)] uty, max(m) um FROM s WHERE name IS NOT NULL GROUP BY name),
c AS (SELECT l.file_id, l.line_no, h.name, h.ty, u.uty, u.um, CASE WHEN len(l.toks) >= h.start + h.m THEN l.toks[h.start + 1 : h.start + h.m] END raw FROM l JOIN h USING (file_id) JOIN u USING (name)),
e AS (SELECT file_id, line_no, name, ty, uty, um, unnest(raw) t, generate_subscripts(raw, 1) - 1 k FROM c)
SELECT file_id, line_no, name, uty ty, um m, k::INT k, CASE WHEN uty = 'L' THEN {_truth_sql('t')} END truth, CASE WHEN uty = 'I' THEN CASE WHEN ty = 'L' THEN ({_truth_sql('t')})::INT ELSE try_cast(ltrim(t, '+') AS DECIMAL(38,0)) END END::VARCHAR whole,
CASE WHEN uty = 'R' THEN CASE WHEN ty = 'L' THEN ({_truth_sql('t')})::INT::DOUBLE ELSE {_real_sql('t')} END END AS real, CASE WHEN uty = 'S' THEN t END text FROM e"""
