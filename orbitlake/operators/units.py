"""Problem 1: quantities recorded in different units.

The unit of a field is read from its remark or its unit text; where neither states one, it is inferred. For that, a
mixture is fitted to the log10 of the magnitudes of each quantity: each component is the distribution in the common unit,
offset by the known conversion factor of a unit and by a power of ten that the fields with a stated unit show. Fields
with a stated unit keep theirs, the others get the most probable component, its posterior, and a flag unless that is sure.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitlake.functions.units import UnitBook
from orbitlake.runtime import Scratch

#: Width of a bin of log10 magnitudes in the histogram that the mixture is fitted to.
BIN = 0.02
#: Powers of ten that components may have, so that their number is bounded by units times powers.
POWERS = 30
STATED = "unit_code string, pow10 long, source string"


def stated_units(fields: DataFrame, unitref: DataFrame) -> DataFrame:
    """Adds ``stated`` (unit_code, pow10, source) to fields: source is note, unit or missing.

    unitref is a small reference table. Null or empty unit and note, or an unknown quantity, give source ``missing``; a
    unit text that says something but can't be read gives ``unreadable``.
    """
    pairs = [(r[0], r[1]) for r in unitref.select("quantity", "unit_code").dropna().distinct().collect()]

    def read(quantity: pd.Series, unit: pd.Series, note: pd.Series) -> pd.DataFrame:
        book, seen = UnitBook(pairs), {}
        out = []
        for key in zip(quantity, unit, note):
            key = tuple(x if isinstance(x, str) else None for x in key)
            if key not in seen:
                seen[key] = book.stated(*key)
            out.append(seen[key])
        frame = pd.DataFrame(out, columns=["unit_code", "pow10", "source"])
        return frame.assign(pow10=frame.pow10.astype("Int64"))

    # Not deterministic to the optimizer, which would else repeat the call in filters on its result.
    return fields.withColumn("stated", F.pandas_udf(read, STATED).asNondeterministic()("quantity", "unit", "note"))


def latest(df: DataFrame, key: list[str], order: str = "ingested_at") -> DataFrame:
    """One row of each key, the one with the greatest ``order`` (nulls count as smallest)."""
    others = [c for c in df.columns if c not in key]
    row = F.struct(F.coalesce(F.col(order).cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")).alias("_o"), *[F.col(c) for c in others if c != order], F.col(order))
    plain = all(not d.startswith("map") for _, d in df.dtypes)
    picked = F.max(row) if plain else F.max_by(row, row["_o"])
    return df.groupBy(*key).agg(picked.alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in others]).select(*df.columns)


def magnitude(values: str, shifted: list[str]) -> Column:
    """The size of the samples as recorded: their mean for quantities with a unit of another zero, else their geometric mean without signs.

    Nulls, NaN and infinities do not count, nor zeros in a geometric mean. Null if none is left.
    """
    good = F.filter(F.col(values), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.filter(good, lambda x: x != 0)
    mean = F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda a, x: a + x) / F.size(good))
    logs = F.when(F.size(some) > 0, F.pow(F.lit(10.0), F.aggregate(some, F.lit(0.0), lambda a, x: a + F.log10(F.abs(x))) / F.size(some)))
    return F.when(F.col("quantity").isin(shifted), mean).otherwise(logs) if shifted else logs


def fit_mixture(parts: list[tuple[str, int, float, float]], counts: dict, common: list[tuple[float, int]], open_: list[tuple[float, int]], rounds: int = 60) -> dict:
    """The mixture of one quantity: mu and sigma in the common unit, and the weight of each component.

    parts: (unit, power, factor, shift) of each component; counts: stated fields of each (unit, power); common: histogram of
    log10 of the stated fields in the common unit; open_: of the sizes of the others, as recorded. Stated fields belong to their component.
    """
    keys = [(u, p) for u, p, _, _ in parts]
    total = sum(n for _, n in common)
    first = common or [(x, n) for x, n in open_ for _ in (0,)]
    known = sum(n for _, n in first) or 1
    mu = sum(x * n for x, n in first) / known
    sigma = max(math.sqrt(sum(n * (x - mu) ** 2 for x, n in first) / known), BIN)
    stated = sum(counts.values())
    weight = {k: (counts.get(k, 0) + 1) / (stated + len(keys)) for k in keys}
    s1, s2 = (sum(x**e * n for x, n in common) for e in (1, 2))
    for _ in range(rounds if open_ else 0):
        mass, t0, t1, t2 = dict.fromkeys(keys, 0.0), float(total), s1, s2
        for x, n in open_:
            logs = {}
            for u, p, f, s in parts:
                y, jacobian = _common_log(x, p, f, s)
                logs[u, p] = (math.log(weight[u, p]) - (y - mu) ** 2 / (2 * sigma * sigma) + jacobian, y)
            top = max(v for v, _ in logs.values())
            norm = sum(math.exp(v - top) for v, _ in logs.values())
            for k, (v, y) in logs.items():
                share = n * math.exp(v - top) / norm
                mass[k] += share
                t0, t1, t2 = t0 + share, t1 + share * y, t2 + share * y * y
        before, mu = mu, t1 / t0
        sigma = max(math.sqrt(max(t2 / t0 - mu * mu, 0.0)), BIN)
        weight = {k: (counts.get(k, 0) + mass[k] + 1) / (stated + sum(mass.values()) + len(keys)) for k in keys}
        if abs(before - mu) < 1e-9:
            break
    return {"mu": mu, "sigma": sigma, "weight": weight}


def _common_log(x: float, power: int, factor: float, shift: float) -> tuple[float, float]:
    """log10 in the common unit of a recorded size, and the log of the stretch between the two scales."""
    raw = x * 10.0**power * factor
    size = max(abs(raw + shift), 1e-300)
    return math.log10(size), math.log(max(abs(raw), 1e-300) / size)


def assign_units(fields: DataFrame, unitref: DataFrame, scratch: Scratch, sure: float = 0.97) -> DataFrame:
    """Fields with ``unit_code``, ``pow10``, ``unit_source``, ``posterior`` and ``uncertain``.

    unit_source is note, unit, inferred, unreadable (inferred too, as the text can't be read, and always uncertain), or
    unknown: a quantity that unitref doesn't have, or no usable sample. What is inferred is uncertain if its posterior is
    under ``sure``. A quantity without any stated field has components of power 0 only, with equal weights. The
    histograms on the driver have at most one row for each quantity and bin, and for each unit and power, whatever the number of fields.
    """
    ref = [tuple(r) for r in unitref.select("quantity", "unit_code", "factor", "shift").dropna().distinct().orderBy("quantity", "unit_code").collect()]
    units: dict[str, dict] = defaultdict(dict)
    for q, u, f, s in ref:
        units[q][u] = (f, s)
    shifted = sorted({q for q, _, _, s in ref if s})
    marked = scratch.put(stated_units(fields, unitref).withColumn("_size", magnitude("grid_values", shifted)))
    rules = unitref.select("quantity", F.col("unit_code").alias("_u"), "factor", "shift").dropna().dropDuplicates(["quantity", "_u"])
    sized = marked.where(F.col("_size").isNotNull()).select("quantity", F.col("stated.unit_code").alias("_u"), F.col("stated.pow10").alias("p"), "_size")
    stated = sized.where("_u is not null").join(F.broadcast(rules), ["quantity", "_u"])
    binned = lambda v: (F.round(v / BIN) * BIN).alias("x")
    common = stated.groupBy("quantity", binned(F.log10(F.greatest(F.abs(F.col("_size") * F.pow(F.lit(10.0), F.col("p").cast("double")) * F.col("factor") + F.col("shift")), F.lit(1e-300))))).count().collect()
    counts = stated.where(F.abs("p") <= POWERS).groupBy("quantity", "_u", "p").count().collect()
    free = sized.where(F.col("_u").isNull() & F.col("quantity").isin(list(units)))
    open_ = free.groupBy("quantity", F.signum("_size").alias("sign"), binned(F.log10(F.greatest(F.abs("_size"), F.lit(1e-300))))).count().collect()
    table = []
    for q, known in units.items():
        seen = {(r[1], r[2]): r[3] for r in counts if r[0] == q}
        parts = [(u, p, *known[u]) for u, p in sorted(set(seen) | {(u, 0) for u in known})]
        m = fit_mixture(parts, seen, [(r[1], r[2]) for r in common if r[0] == q], [(r[1] * 10.0 ** r[2], r[3]) for r in open_ if r[0] == q])
        table.append((q, m["mu"], m["sigma"], [(u, p, 10.0**p * f, s, math.log(m["weight"][u, p])) for u, p, f, s in parts]))
    mixture = marked.sparkSession.createDataFrame(table, "quantity string, _mu double, _sigma double, _parts array<struct<u:string,p:bigint,f:double,s:double,w:double>>")

    def score(c: Column) -> Column:
        raw = F.col("_size") * c["f"]
        size = F.greatest(F.abs(raw + c["s"]), F.lit(1e-300))
        return F.struct((c["w"] - F.pow((F.log10(size) - F.col("_mu")) / F.col("_sigma"), F.lit(2.0)) / 2 + F.log(F.greatest(F.abs(raw), F.lit(1e-300)) / size)).alias("l"), c["u"].alias("u"), c["p"].alias("p"))

    scores = F.transform("_parts", score)
    norm = F.aggregate("_l", F.lit(0.0), lambda a, x: a + F.exp(x["l"] - F.col("_b.l")))
    stated_, guessed = F.col("stated.unit_code").isNotNull(), F.col("_b").isNotNull()
    return (
        marked.join(F.broadcast(mixture), "quantity", "left").withColumn("_l", F.when(F.col("_size").isNotNull() & ~stated_, scores)).withColumn("_b", F.array_max("_l")).withColumn("_p", 1.0 / norm)
        .withColumn("unit_code", F.coalesce("stated.unit_code", "_b.u"))
        .withColumn("pow10", F.coalesce("stated.pow10", "_b.p"))
        .withColumn("unit_source", F.when(stated_, F.col("stated.source")).when(guessed, F.when(F.col("stated.source") == "unreadable", "unreadable").otherwise("inferred")).otherwise("unknown"))
        .withColumn("posterior", F.when(stated_, 1.0).when(guessed, F.col("_p")))
        .withColumn("uncertain", (F.coalesce(F.col("posterior"), F.lit(0.0)) < sure) | (F.col("unit_source") == "unreadable"))
        .drop("_l", "_b", "_p", "_mu", "_sigma", "_parts", "stated", "_size")
    )


def held_out(fields: DataFrame, unitref: DataFrame, scratch: Scratch, every: int = 5) -> DataFrame:
    """quantity, certain, n, n_right, mean_posterior: how the mixture does on fields whose stated unit is hidden from it.

    Hidden are the unit and note of each field whose hash falls in one of ``every`` classes. Right means that unit and power of ten are as stated.
    """
    truth = stated_units(fields.select("field_id", "quantity", "unit", "note"), unitref).where("stated.unit_code is not null").select("field_id", "stated.unit_code", "stated.pow10")
    truth = scratch.put(truth.where(F.pmod(F.xxhash64("field_id"), F.lit(every)) == 0).withColumnsRenamed({"unit_code": "true_code", "pow10": "true_pow10"}))
    both = fields.join(truth, "field_id", "left")
    hidden = both.select(*fields.drop("unit", "note").columns, "true_code", "true_pow10", *[F.when(F.col("true_code").isNull(), F.col(c)).alias(c) for c in ("unit", "note")])
    got = assign_units(hidden, unitref, scratch).where("true_code is not null")
    right = (F.col("unit_code") == F.col("true_code")) & (F.col("pow10") == F.col("true_pow10"))
    return got.groupBy("quantity", (~F.col("uncertain")).alias("certain")).agg(F.count("*").alias("n"), F.sum(F.coalesce(right, F.lit(False)).cast("long")).alias("n_right"), F.avg("posterior").alias("mean_posterior"))


def to_common(assigned: DataFrame, unitref: DataFrame) -> DataFrame:
    """Adds ``common_unit`` and ``common_values``: value * 10^pow10 * factor + shift. Null samples stay null; fields without a unit get null.

    Columns of the input with these two names are replaced, other columns stay.
    """
    ref = unitref.dropDuplicates(["quantity", "unit_code"])
    rules = ref.select("quantity", "unit_code", F.col("factor").alias("_factor"), F.col("shift").alias("_shift"))
    common = ref.where("is_common").groupBy("quantity").agg(F.min("unit_code").alias("common_unit"))
    return (
        assigned.drop("common_unit").join(rules.hint("broadcast"), ["quantity", "unit_code"], "left").join(common.hint("broadcast"), "quantity", "left")
        .withColumn("common_values", F.when(F.col("_factor").isNotNull(), F.transform("grid_values", lambda v: v * F.pow(F.lit(10.0), F.col("pow10").cast("double")) * F.col("_factor") + F.col("_shift"))))
        .drop("_factor", "_shift")
    )


def _uncommon(marked: DataFrame, unitref: DataFrame) -> DataFrame:
    common = unitref.where("is_common").select("quantity", F.col("unit_code").alias("_common"))
    return marked.join(common.hint("broadcast"), "quantity", "left").where("_common is null or unit_code != _common or pow10 != 0").select("field_id", "unit_code", "pow10")


def not_common(fields: DataFrame, unitref: DataFrame) -> DataFrame:
    """field_id, unit_code, pow10 of the fields whose unit, as far as its text can be read, isn't the common one at scale 1. Repeated rows count once, by their latest row."""
    slim = latest(fields.select("field_id", "quantity", "unit", "note", "ingested_at"), ["field_id"])
    return _uncommon(stated_units(slim, unitref).where("stated.unit_code is not null").select("field_id", "quantity", "stated.unit_code", "stated.pow10"), unitref)


def not_common_inferred(fields: DataFrame, unitref: DataFrame, scratch: Scratch, sure: float = 0.97) -> DataFrame:
    """``not_common`` with the mixture for what is stated and can't be read: such a field counts with the unit and power that its samples show, if their posterior is ``sure`` at least.

    Fields whose unit is stated nowhere teach the mixture, and are no cases. fields have one row each.
    """
    marked = assign_units(fields, unitref, scratch, sure)
    told = F.col("unit_source").isin("note", "unit") | ((F.col("unit_source") == "unreadable") & (F.col("posterior") >= sure))
    return _uncommon(marked.where(told), unitref)
