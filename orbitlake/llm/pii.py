"""Problem 8: personal information inside free text, by information-theoretic sanitisation.

Candidates come from character classes. What the corpus decides on them is how strongly their terms (words, shapes,
contexts) disclose a protected entity: each term has the log-odds of the entity among its occurrences over those among
all candidates, from co-occurrence with plainly declared entities (seeds) and, in later rounds, with what they revealed.
Candidates whose terms together exceed the threshold are replaced by a typed placeholder. Mail and street addresses
disclose themselves by their form; the towns that end an address, and streets of a kind not known, are told by co-occurrence too.

Equal candidates in equal context count once, so that copies of a text teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitlake.llm.pii_spans import CLOSINGS, CUES, LABELS, RUN_PATTERN, spans
from orbitlake.operators.skew import hot_keys, lookup
from orbitlake.runtime import Scratch

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Probability of an entity, as its terms disclose it, from which on it is replaced.
DISCLOSURE = 0.25
#: A word of context that was expected beside so many entities, and was seen with a tenth of them at most, speaks against one.
VETO_EXPECTED, VETO_SHARE = 10, 0.1
#: Weight of the average of all candidates in the share of a term, and the same in the first round: a rare word that was
#: once declared must not reveal others yet.
PRIOR, FIRST_PRIOR = 5.0, 20.0
#: The threshold of the first round, whose entities teach the contexts: words of names are shared with other things, shapes of numbers hardly.
FIRST_DISCLOSURE = {"name": 0.9, "number": 0.5}
ROUNDS = 2
#: A word that was expected in so many seeds, and is in none, is no part of a name.
UNDECLARED = 8
#: Terms of the candidate itself. They alone count in the first round, when contexts are known from declarations only.
INNER = ("w", "s", "p")
KINDS = {"number": ["phone", "id_number"], "name": ["name"]}
SEP = "\x1f"
ROW = "grp string, kind string, item string, first int, last int, longer string, terms string, words string, cuts string"
#: A word counts as common only if it makes up so much of all capitalised words, which bounds their number.
COMMON_SHARE = 1e-5
#: And only if it was declared a person so much less often than the average word; a word that is a name too stays one.
COMMON_RATIO = 0.03


def common_words(docs: DataFrame, scratch: Scratch) -> frozenset[str]:
    """Capitalised words, in small letters, that were so often seen and so rarely declared persons that they are no names.

    If they were names, chance alone would have declared them more often. They are collected: a word counts only if it makes up
    COMMON_SHARE of all, so that there are at most 1 / COMMON_SHARE.
    """
    runs = docs.where("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit(RUN_PATTERN), F.lit(0))).alias("run"))
    words = scratch.put(runs.groupBy("run").count()).select(F.transform(F.split("run", "[ \u00a0\n]+"), lambda w: F.rtrim(w, F.lit(".:,"))).alias("w"), "count")
    cue = F.array_max(F.transform("w", lambda w, i: F.when(w.isin(sorted({*CUES, *(x.rstrip(":") for x in LABELS), *CLOSINGS})), i)))
    # The cue is found before the words are rows, once for each run.
    each = words.withColumn("cue", cue).select(F.posexplode("w").alias("at", "word"), F.col("count").alias("n"), "cue")
    # The four words after the last cue are declared persons.
    declared = F.when((F.col("at") > F.col("cue")) & (F.col("at") <= F.col("cue") + 4), F.col("n")).otherwise(F.lit(0).cast("long"))
    counts = each.select("word", "n", declared.alias("s")).where("length(word) > 1").groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = F.broadcast(counts.agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s")))
    expected = F.col("n") * F.col("all_s") / F.col("all_n")
    return frozenset(r[0] for r in counts.crossJoin(total).where((expected >= VETO_EXPECTED) & (F.col("s") < COMMON_RATIO * expected) & (F.col("n") >= COMMON_SHARE * F.col("all_n"))).select("word").collect())


def candidates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each span of each document: doc_id, grp, kind, item, first, last, longer, terms, words, cuts. Null and empty texts have none.

    terms and the words of a name are joined by SEP; cuts has first and last of each word, counted from the start of the item.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    common = common_words(docs, scratch)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 3 + [pa.int32()] * 2 + [pa.string()] * 4
        for batch in batches:
            at, cols = [], [[] for _ in kinds]
            add = [c.append for c in cols]
            for k, text in enumerate(batch.column("text").to_pylist()):
                for grp, kind, item, a, b, longer, terms, words in spans(text, common):
                    at.append(k)
                    row = (grp, kind, item, a, b, longer, SEP.join(terms), SEP.join([w for w, _, _ in words]).lower() if words else "", " ".join([f"{x} {y}" for _, x, y in words]))
                    for put, v in zip(add, row):
                        put(v)
            names = ["doc_id", "grp", "kind", "item", "first", "last", "longer", "terms", "words", "cuts"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=names)

    return scratch.put(docs.where("text is not null and text != ''").select("doc_id", "text").mapInArrow(read, f"doc_id {key}, {ROW}"))


def _initial(word: Column) -> Column:
    return F.endswith(word, F.lit("."))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def disclosed(found: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """h, terms, words, kind, told, score, low and high of the candidates, by words and context, whose terms disclose an entity.

    found: the candidates; kind is set on seeds. A seed is disclosed by itself, whatever its terms; told is what the terms alone
    say. low and high are the first and last word kept. Equal candidates in equal context are one.
    """
    # Kinds and groups go through the aggregates as numbers: those of strings sort all their rows.
    kinds = [k for ks in KINDS.values() for k in ks]
    order = F.array(*map(F.lit, sorted(kinds)))
    sigs = found.where(F.col("grp").isin(*KINDS)).groupBy("grp", "terms", "words").agg(F.max(F.array_position(order, F.col("kind"))).alias("seed"))
    sigs = scratch.put(sigs.select("grp", "terms", "words", F.when(F.col("seed") > 0, F.get(order, F.col("seed").cast("int") - 1)).alias("seed"), F.xxhash64("grp", "terms", "words").alias("h")))
    # Initials come after the other words, of which the patterns of names allow eight: their places are bits of a number.
    by_word = F.split("words", SEP)
    ordered = F.concat(F.filter(by_word, lambda w: ~_initial(w)), F.filter(by_word, _initial))
    inner = F.when(F.col("words") != "", F.transform(ordered, lambda w: F.concat(F.lit("w:"), w))).otherwise(F.array().cast("array<string>"))
    texts = F.concat(inner, F.split("terms", SEP))
    t = F.substring_index("text", ":", 1)
    beside = t.isin("l1", "l2", "r1")
    word, initial = t == "w", (t == "w") & _initial(F.col("text"))
    parts = sigs.select("h", "grp", F.posexplode(texts).alias("at", "text")).select(
        "h", (F.col("grp") == "name").alias("named"), "at", F.xxhash64("grp", "text").alias("term"), t.isin(*INNER).alias("inner"), (word & ~initial).alias("word"), (beside & F.col("text").rlike(r"^[lr]\d:(?:\S+ )?[\p{L}-]+$")).alias("wordy"),
        ((F.col("grp") == "name") & beside & F.col("text").rlike(r"^[lr]\d:\P{L}*$")).alias("mark"),
    )
    each = scratch.put(parts)
    hot, _ = hot_keys(each, ["term"], scratch)
    is_ = {k: F.coalesce((F.col("kind") == k).cast("double"), F.lit(0.0)) for k in kinds}
    label, judged = scratch.put(sigs.select("h", "grp", F.col("seed").alias("kind"), F.col("seed").isNotNull().alias("seed"))), None
    for no in range(rounds):
        prior = PRIOR if no else FIRST_PRIOR
        least = F.lit(DISCLOSURE) if no else F.when(F.col("grp") == "name", FIRST_DISCLOSURE["name"]).otherwise(FIRST_DISCLOSURE["number"])
        marked = (each if no else each.where("inner")).join(label.drop("grp"), "h")
        counts = marked.groupBy("term").agg(F.bool_or("named").alias("g"), F.count("*").alias("n"), F.count_if("seed").alias("n_seed"), *[F.sum(is_[k]).alias(f"n_{k}") for k in kinds]).where("n > 1")
        base = label.groupBy("grp").agg(*[F.greatest(F.lit(1e-4), F.least(F.lit(0.9), F.avg(is_[k]))).alias(f"b_{k}") for k in kinds], F.avg(F.when(F.col("kind").isNotNull(), F.col("seed").cast("double"))).alias("declared"))
        counts = scratch.put(counts.join(F.broadcast(base), F.col("g") == (F.col("grp") == "name")).drop("g", "grp"))
        met = lookup(marked, counts, ["term"], hot, "inner")
        odds_of = {}
        for k in kinds:
            b = F.col(f"b_{k}")
            # Without the candidate itself, which would else vouch for itself.
            share = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), (F.col(f"n_{k}") - is_[k] + prior * b) / (F.col("n") - 1 + prior)))
            odds_of[k] = (_logit(share) - _logit(b), ((F.col("n") - 1) * b >= VETO_EXPECTED) & (share < VETO_SHARE * b))
        # A word that persons lack does not belong to a name, nor does one before it that goes with persons and yet is hardly ever declared one.
        word = F.col("word")
        alien = word & odds_of["name"][1]
        cue = word & (F.col("n_name") * F.col("declared") >= UNDECLARED) & (F.col("n_seed") <= VETO_SHARE * F.col("n_name") * F.col("declared"))
        sums = []
        for k, (lift, against) in odds_of.items():
            # A mark beside it may speak against a person, but for one only words, forms and places do.
            sums += [F.sum(F.when(F.col("mark"), F.least(lift, F.lit(0.0))).when(~(alien | cue), lift)).alias(f"s_{k}"), F.max(against & F.col("wordy")).alias(f"v_{k}"), F.max(f"b_{k}").alias(f"b_{k}")]
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at"))
        # As bits, since sets would have all rows sorted.
        scored = met.groupBy("h").agg(*sums, F.bit_or(F.when(alien, bit)).alias("cut"), F.bit_or(F.when(cue, bit)).alias("lead"))
        odds = {k: F.when(F.col(f"v_{k}"), F.lit(-100.0)).otherwise(F.coalesce(F.col(f"s_{k}"), F.lit(0.0)) + _logit(F.col(f"b_{k}"))) for k in kinds}
        raw = scratch.put(scored.select("h", "cut", "lead", *[(1 / (1 + F.exp(-odds[k]))).alias(f"p_{k}") for k in kinds]).join(label, "h"))
        # Only some entities are declared: in the first round, what the declared ones score on average is what a sure one scores.
        sure = raw.agg(*[F.greatest(F.lit(0.05), F.avg(F.when(F.col("kind") == k, F.col(f"p_{k}")))).alias(f"c_{k}") for k in kinds])
        best = lambda g: F.greatest(*[F.struct(F.least(F.lit(1.0), F.col(f"p_{k}") / (F.lit(1.0) if no else F.coalesce(F.col(f"c_{k}"), F.lit(1.0)))).alias("p"), F.lit(k).alias("k")) for k in KINDS[g]], *[F.lit(None).cast("struct<p:double,k:string>")] * (len(KINDS[g]) == 1))
        judged = scratch.put(raw.join(F.broadcast(sure)).withColumn("best", F.when(F.col("grp") == "number", best("number")).otherwise(best("name"))).select("h", "cut", "lead", F.col("best.k").alias("k"), F.col("best.p").alias("score")))
        # In the first round a name has two words at least: one word alone may be shared with things named after persons.
        lone = F.lit(False) if no else (F.col("grp") == "name") & (F.instr("words", SEP) == 0)
        held = sigs.select("h", "grp", "seed", lone.alias("lone")).join(judged, "h", "left")
        label = scratch.put(held.select("h", "grp", F.coalesce("seed", F.when((F.col("score") >= least) & ~F.col("lone"), F.col("k"))).alias("kind"), F.col("seed").isNotNull().alias("seed")))
    out = sigs.join(judged, "h", "left").withColumn("told", F.when(F.col("score") >= DISCLOSURE, F.col("k"))).where("seed is not null or told is not null")
    n_words = F.when(F.col("words") == "", 0).otherwise(F.size(F.split("words", SEP)))
    every = F.sequence(F.lit(0), n_words - 1)
    others = F.filter(F.transform(by_word, lambda w, k: F.when(~_initial(w), k)), lambda k: k.isNotNull())
    places = lambda bits: F.filter(others, lambda _, k: F.call_function("shiftright", F.coalesce(bits, F.lit(0).cast("long")), k) % 2 != 0)
    out = out.withColumn("kept", F.when(n_words > 0, F.array_except(every, places("cut")))).withColumn("own", F.array_except("kept", places("lead")))
    return out.where("kept is null or size(own) > 0").select("h", "terms", "words", F.coalesce("seed", "told").alias("kind"), "told", "score", F.array_min("own").alias("low"), F.array_max("kept").alias("high"))


def accepted(found: DataFrame, scratch: Scratch) -> DataFrame:
    """The spans that are personal information: doc_id, kind, item, first, last, in their final form, and evidence.

    evidence is form (a mail or street address as such), declared (a seed that its terms alone would not disclose) or disclosed.
    """
    shaped = found.where("grp = 'form' and longer is null").select("doc_id", "kind", "item", "first", "last", F.lit("form").alias("evidence"))
    towns = found.where("grp = 'form' and kind = 'address'").select(F.regexp_extract(F.coalesce("longer", "item"), r"(?:,\s?|\n|\d{5} )(\p{Lu}[^\d,\n]*?)(?:,? [A-Z]{2}\d* .*)?$", 1).alias("town"), F.col("longer").isNull().alias("sure"))
    known = scratch.put(towns.where("town != ''").groupBy("town").agg(F.count("*").alias("n"), F.sum(F.col("sure").cast("int")).alias("n_sure")).where("n_sure > 0").select(F.concat(F.lit("t:"), "town").alias("terms"), F.lit(True).alias("known")))
    whole = found.where("grp = 'form' and longer is not null").join(known, "terms", "left")
    ended = whole.select("doc_id", "kind", F.when(F.col("known"), F.col("longer")).otherwise(F.col("item")).alias("item"), "first", F.when(F.col("known"), F.col("last")).otherwise(F.col("first") + F.length("item")).alias("last"), F.lit("form").alias("evidence"))
    streets = scratch.put(found.where("grp = 'open'").join(known, "terms").select("doc_id", "kind", "item", "first", "last", F.lit("disclosed").alias("evidence")))
    rare = found.where(F.col("grp").isin(*KINDS))
    told = scratch.put(disclosed(rare, scratch))
    rows = rare.drop("kind").withColumn("h", F.xxhash64("grp", "terms", "words"))
    hot, _ = hot_keys(rows, ["h"], scratch)
    hits = lookup(rows, told.withColumnsRenamed({"terms": "_terms", "words": "_words"}), ["h"], hot, "inner").where("terms = _terms and words = _words")
    at = F.split("cuts", " ")
    low = F.when(F.col("low") > 0, F.element_at(at, 2 * F.col("low") + 1).cast("int")).otherwise(F.lit(0))
    high = F.when(F.col("high").isNotNull(), F.element_at(at, 2 * F.col("high") + 2).cast("int")).otherwise(F.length("item"))
    # The last word of a name takes what follows it in the item, the dot of an initial for one.
    whole_ = F.col("high").isNotNull() & (2 * F.col("high") + 2 == F.size(at))
    high = F.when(whole_, F.length("item")).otherwise(high)
    evidence = F.when(F.col("told") == F.col("kind"), "disclosed").otherwise("declared")
    hits = hits.select("doc_id", "kind", F.col("item").substr(low + 1, high - low).alias("item"), (F.col("first") + low).alias("first"), (F.col("first") + high).alias("last"), evidence.alias("evidence"))
    hits = hits.where((F.length("item") > 2) & ~F.col("item").isin(sorted(CUES)))
    inner = streets.select("doc_id", F.col("first").alias("_a"), F.col("last").alias("_b"))
    hits = hits.join(inner, (hits["doc_id"] == inner["doc_id"]) & (F.col("first") < F.col("_b")) & (F.col("last") > F.col("_a")), "left_anti")
    return shaped.unionByName(ended).unionByName(streets).unionByName(hits)


def held_out(docs: DataFrame, scratch: Scratch, every: int = 5) -> DataFrame:
    """kind, n_hidden, n_found: seeds of one document in ``every``, by hash of its id, that the terms disclose though nobody declares them there."""
    found = candidates(docs, scratch)
    hide = (F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0) & F.col("grp").isin(*KINDS) & F.col("kind").isNotNull()
    truth = found.where(hide).select("doc_id", "first", "last", F.col("kind").alias("true_kind"))
    got = accepted(found.withColumn("kind", F.when(~hide, F.col("kind")).otherwise(F.when(F.lit(False), F.col("kind")))), scratch).select("doc_id", F.col("first").alias("_a"), F.col("last").alias("_b"), "kind")
    met = truth.join(got, "doc_id").where("kind = true_kind and _a < last and _b > first").select("doc_id", "first").distinct().withColumn("met", F.lit(1))
    return truth.join(met, ["doc_id", "first"], "left").groupBy(F.col("true_kind").alias("kind")).agg(F.count("*").alias("n_hidden"), F.count("met").alias("n_found"))


def sanitise(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, clean_text and n_replaced: every document, with a typed placeholder for each piece and the rest unchanged. A null text stays null."""
    pieces = accepted(candidates(docs, scratch), scratch).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "last", "kind"))).alias("pieces"))

    @F.pandas_udf("string")
    def replace(text: pd.Series, found: pd.Series) -> pd.Series:
        def one(t: str | None, xs) -> str | None:
            if t is None or xs is None:
                return t
            out, at = [], 0
            for x in xs:
                if x["first"] >= at:
                    out += [t[at : x["first"]], PLACEHOLDERS[x["kind"]]]
                    at = x["last"]
            return "".join(out) + t[at:]

        return pd.Series([one(t, xs) for t, xs in zip(text, found)])

    return docs.select("doc_id", "text").join(pieces, "doc_id", "left").select("doc_id", replace("text", "pieces").alias("clean_text"), F.coalesce(F.size("pieces"), F.lit(0)).alias("n_replaced"))
