"""Queries of the text problems over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.llm import groups, mixing, packing, pii, tokens
from orbitlake.runtime import Scratch, table

SQL: dict[str, str] = {}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.atom_groups(table(spark, d, "atoms"), table(spark, d, "bonds"), Scratch(spark, "groups"))


def _sized(spark: SparkSession, d: str, scratch: Scratch, *more: str) -> DataFrame:
    return scratch.put(tokens.with_tokens(table(spark, d, "documents").select("doc_id", "text", *more)).select("doc_id", "n_tokens", *more))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "packing")
    return packing.pack(_sized(spark, d, scratch), table(spark, d, "packsizes"), scratch)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p6_containers(spark, d), table(spark, d, "packsizes"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "mixing")
    return mixing.mixture(mixing.copies(_sized(spark, d, scratch, "source"), table(spark, d, "mixtargets"), scratch))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "mixing")
    sized = _sized(spark, d, scratch, "source")
    mix = table(spark, d, "mixtargets")
    return mixing.shares(mixing.copies(sized, mix, scratch), sized, mix)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "pii")
    return pii.accepted(pii.candidates(table(spark, d, "documents"), scratch), scratch).select("doc_id", "kind", "item").distinct()


def p8_evidence(spark: SparkSession, d: str) -> DataFrame:
    """kind, evidence, n: what the pieces were told by."""
    scratch = Scratch(spark, "pii")
    return pii.accepted(pii.candidates(table(spark, d, "documents"), scratch), scratch).groupBy("kind", "evidence").agg(F.count("*").alias("n"))


def p8_heldout(spark: SparkSession, d: str) -> DataFrame:
    """How many declared pieces are found where nobody declares them."""
    return pii.held_out(table(spark, d, "documents"), Scratch(spark, "pii"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return pii.sanitise(table(spark, d, "documents"), Scratch(spark, "pii"))


QUERIES = {f.__name__: f for f in (p4_found, p6_containers, p6_fill, p7_mixture, p7_shares, p8_found, p8_evidence, p8_heldout, p8_clean)}

SQL["p4_found"] = """WITH RECURSIVE a AS (SELECT DISTINCT frame_id f, id::BIGINT id FROM atoms WHERE frame_id IS NOT NULL AND id IS NOT NULL),
mol AS (SELECT frame_id f, id::BIGINT id, min(id::BIGINT) OVER (PARTITION BY frame_id, molecule_id) head FROM atoms WHERE molecule_id > 0 AND frame_id IS NOT NULL AND id IS NOT NULL),
e AS (SELECT f, id x, head y FROM mol WHERE id <> head UNION SELECT b.frame_id, b.atom_i::BIGINT, b.atom_j::BIGINT FROM bonds b JOIN a p ON p.f = b.frame_id AND p.id = b.atom_i JOIN a q ON q.f = b.frame_id AND q.id = b.atom_j WHERE b.atom_i <> b.atom_j),
links AS (SELECT f, x, y FROM e UNION SELECT f, y, x FROM e),
cc(f, id, g) USING KEY (f, id) AS (SELECT f, id, id FROM a UNION SELECT l.f, l.y, min(c.g) FROM cc c JOIN links l ON l.f = c.f AND l.x = c.id JOIN recurring.cc r ON r.f = l.f AND r.id = l.y WHERE c.g < r.g GROUP BY l.f, l.y)
SELECT f frame_id, id atom_id, g group_id FROM cc"""
