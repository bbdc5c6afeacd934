import random

import numpy as np
from pyspark.sql import functions as F

from orbitlake.llm import mixing, packing, tokens
from orbitlake.runtime import Scratch


def first_fit_decreasing(sizes, capacity):
    room: list[int] = []
    for n in sorted(sizes, reverse=True):
        for k, left in enumerate(room):
            if n <= left:
                room[k] -= n
                break
        else:
            room.append(capacity - n)
    return len(room)


def test_plan_covers_histogram():
    rnd = np.random.default_rng(1)
    h = rnd.integers(0, 50, 64)
    used = np.zeros(64, dtype=int)
    for shape, n in packing.plan(h):
        assert sum(shape) <= 64 and n > 0
        for b in shape:
            used[b - 1] += n
    assert (used == h).all()


def test_every_piece_once(spark):
    rnd = random.Random(2)
    sized = spark.createDataFrame([(k, rnd.choice([0, 1, 7, 100, 511, 512, 513, 5000, rnd.randrange(1, 700)]), "x") for k in range(3000)], "doc_id long, n_tokens long, pack_code string").drop("pack_code")
    caps = spark.createDataFrame([("small", 512), ("odd", 1000)], "pack_code string, capacity_tokens int")
    rows = packing.pack(sized, caps, Scratch(spark, "test")).cache()
    whole = rows.groupBy("pack_code", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k")).join(sized, "doc_id")
    assert whole.count() == 6000 and whole.where("n != n_tokens").count() == 0
    assert whole.where("pack_code = 'small' and n_tokens <= 512 and k > 1").count() == 0
    load = rows.where("container_id > 0").groupBy("pack_code", "container_id").agg(F.sum("n_tokens").alias("n"))
    assert load.where("(pack_code = 'small' and n > 512) or n > 1000").count() == 0
    assert load.groupBy("pack_code").agg((F.max("container_id") == F.count("*")).alias("ok")).where("not ok").count() == 0
    for r in packing.fill(rows, caps).collect():
        sizes = [p.n_tokens for p in rows.where(F.col("pack_code") == r.pack_code).where("n_tokens > 0").collect()]
        assert r.n_containers <= 1.02 * first_fit_decreasing(sizes, r.capacity_tokens)
    assert packing.pack(sized.limit(0), caps, Scratch(spark, "test")).count() == 0


def test_mixture(spark):
    rnd = random.Random(4)
    docs = [(k, "a" if k % 3 else "b" if k % 2 else None, rnd.choice([0, 5, 100, 900])) for k in range(4000)] + [(9001, "other", 10)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    mix = spark.createDataFrame([("a", 0.4, 1), ("b", 0.5, 3), ("empty", 0.1, 2)], "source string, target_share double, max_repeats int")
    old, mixing.BLOCK = mixing.BLOCK, 100
    try:
        got = mixing.copies(sized, mix, Scratch(spark, "test")).cache()
    finally:
        mixing.BLOCK = old
    assert got.count() == got.select("doc_id").distinct().count() == sum(1 for d in docs if d[1] in ("a", "b"))
    wanted = {r.source: r for r in mixing.targets(sized, mix).collect()}
    for r in got.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("n"), F.max("n_copies").alias("most")).collect():
        assert r.most <= wanted[r.source].max_repeats and abs(r.n - wanted[r.source].copies * wanted[r.source].available) <= 900
    again = {tuple(r) for r in mixing.copies(sized, mix, Scratch(spark, "test")).select("doc_id", "n_copies").collect()}
    assert len(again) == got.count()
    assert mixing.copies(sized.limit(0), mix, Scratch(spark, "test")).count() == 0


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "a" * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.with_tokens(docs).collect()}
    encode = tokens.encoder(tokens.RANKS)
    for k, text in ((1, "hello world"), (4, "a" * 20_000)):
        ids = encode.encode_ordinary(text)
        assert got[k] == len(ids) and encode.decode(ids) == text
    assert got[2] == got[3] == 0
