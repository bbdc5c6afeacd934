"""Problem 7: mixing sources to target weights, by pivotal dependent rounding.

The mixture is as large as the most limited source allows. Every document of a source has the same fractional number of
copies; within blocks, pairs of documents transfer mass, weighted by size, until one of them is integral, and the one
residual of each block goes up a reduction tree until one is left in each source.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitlake.runtime import Scratch

#: Documents of a block, about, and residuals that one step of the tree combines.
BLOCK = 20_000
FAN = 32


def _pivot(frame: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Rounds all probabilities but one. p1 * w1 + p2 * w2 is kept by each transfer, and every expectation too."""
    frame = frame.sort_values(["u", "doc_id"], kind="stable")
    p, w, u = frame["p"].to_numpy().copy(), frame["n_tokens"].to_numpy().astype(float), frame["u"].to_numpy()
    held = -1
    for k in range(len(p)):
        if not 1e-12 < p[k] < 1 - 1e-12 or w[k] <= 0:
            p[k] = round(p[k]) if w[k] > 0 else (1.0 if u[k] < p[k] else 0.0)
            continue
        if held < 0:
            held = k
            continue
        i, j = held, k
        # Move i up and j down, or i down and j up, as far as one of them allows.
        up = min((1 - p[i]) * w[i], p[j] * w[j])
        down = min(p[i] * w[i], (1 - p[j]) * w[j])
        rise = (u[j] * 2654435761.0 + u[i] + seed * 0.618) % 1.0 < down / (up + down)
        m = up if rise else -down
        p[i] += m / w[i]
        p[j] -= m / w[j]
        for x in (i, j):
            if p[x] < 1e-12 or p[x] > 1 - 1e-12:
                p[x] = round(p[x])
        open_ = [x for x in (i, j) if 0 < p[x] < 1]
        held = open_[0] if open_ else -1
    return frame.assign(p=p)


def _seeded(seed: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return _pivot(frame, seed)

    return run


def targets(sized: DataFrame, mix: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, n_docs, available, mixture_tokens, copies (expected number of each document).

    mix is a small table. Sources without a target, or with a share of 0, do not take part; sources of the mix without
    documents get copies 0, and the mixture is sized by the others.
    """
    have = sized.where("source is not null").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("available"))
    m = mix.where("target_share > 0").join(have, "source", "left").fillna(0, ["n_docs", "available"])
    total = m.where("available > 0").agg(F.min(F.col("max_repeats") * F.col("available") / F.col("target_share")).alias("mixture_tokens"))
    copies = F.when(F.col("available") > 0, F.least(F.col("target_share") * F.col("mixture_tokens") / F.col("available"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return m.join(F.broadcast(total)).withColumn("copies", copies).select("source", "target_share", "max_repeats", "n_docs", "available", "mixture_tokens", "copies")


def copies(sized: DataFrame, mix: DataFrame, scratch: Scratch, seed: int = 1) -> DataFrame:
    """doc_id, source, n_tokens, n_copies: whole numbers of copies for every document of the mix.

    sized: doc_id (unique), source, n_tokens. Random numbers come from a hash of doc_id and the seed, so that a task that
    runs again gives the same rows. A document of 0 tokens is rounded on its own.
    """
    wanted = targets(sized, mix).where("available > 0").select("source", "copies", "n_docs")
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)).alias("u")
    docs = sized.join(F.broadcast(wanted), "source").select("doc_id", "source", "n_tokens", "n_docs", F.floor("copies").alias("whole"), (F.col("copies") - F.floor("copies")).alias("p"), u)
    block = F.floor(F.col("u") * F.ceil(F.col("n_docs") / BLOCK)).cast("int")
    state = docs.withColumn("block", block).select("doc_id", "source", "n_tokens", "whole", "p", "u", "block")
    done = scratch.put(state.groupBy("source", "block").applyInPandas(_seeded(seed), state.schema))
    settled = [done.where("p = 0 or p = 1")]
    rest = done.where("p > 0 and p < 1")
    level = 0
    while rest.groupBy("source").count().where("count > 1").limit(1).count():
        level += 1
        step = rest.withColumn("block", F.floor(F.col("block") / FAN).cast("int"))
        done = scratch.put(step.groupBy("source", "block").applyInPandas(_seeded(seed + level), state.schema))
        settled.append(done.where("p = 0 or p = 1"))
        rest = done.where("p > 0 and p < 1")
    out = rest.withColumn("p", F.when(F.col("u") < F.col("p"), 1.0).otherwise(0.0))
    for s in settled:
        out = out.unionByName(s)
    return out.select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("p")).cast("int").alias("n_copies"))


def mixture(chosen: DataFrame) -> DataFrame:
    """doc_id, source, copy_no, n_tokens: one row for each copy."""
    return chosen.where("n_copies > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no"), "n_tokens")


def shares(chosen: DataFrame, sized: DataFrame, mix: DataFrame) -> DataFrame:
    """source, target_share, actual_share, n_tokens, n_docs, most_copies: what the mixture really holds."""
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("n_tokens"), F.sum(F.col("n_copies")).alias("n_docs"), F.max("n_copies").alias("most_copies"))
    total = got.agg(F.sum("n_tokens").alias("total"))
    return mix.join(got, "source", "left").join(F.broadcast(total)).select("source", "target_share", (F.coalesce("n_tokens", F.lit(0)) / F.col("total")).alias("actual_share"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
