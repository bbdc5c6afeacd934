import random
import re

from orbitlake.llm import pii
from orbitlake.llm.pii_spans import spans
from orbitlake.runtime import Scratch

TEXT = (
    "Thanks to Ada Varlosen for the hint. The Varlosen thermostat is fine. Copy it with scp a.tar run@node5:/scratch. Write to ada.v+x@lab.example.org or ada at lab dot example dot net.\n"
    "Call Bo on +46 31 390 06 53 ext. 12. Sample 946-36-3770 was dried in run 485-9377. The badge HB-954120-K no longer opens the room, ask Mr O'Kelmamer.\n"
    "My new office is at Flat 9, 306 Quillmere Ave., Dorrow Bay QX2 8XQ, come by. Die Proben gehen an Mühlenweg 2, D-05583 Dorrow Bay."
)


def test_spans():
    found = spans(TEXT)
    formed = {(k, i) for grp, k, i, *_ in found if grp == "form"}
    assert {("email", "ada.v+x@lab.example.org"), ("email", "ada at lab dot example dot net"), ("address", "Flat 9, 306 Quillmere Ave., Dorrow Bay QX2 8XQ")} <= formed
    seeds = {(k, i) for grp, k, i, *_ in found if grp != "form" and k}
    assert {("phone", "+46 31 390 06 53 ext. 12"), ("id_number", "HB-954120-K"), ("name", "O'Kelmamer")} <= seeds
    assert not any("946-36" in i or "485-9377" in i or "node5" in i for _, i in formed | seeds)
    assert {"Ada Varlosen", "The Varlosen", "Call Bo"} <= {i for grp, _, i, *_ in found if grp == "name"}
    assert all(TEXT[a:b].startswith(i) for _, _, i, a, b, *_ in found)


GIVEN = "Ada Bruno Cara Dov Elin Fadi Gita Hugo Ines Jana".split()
FAMILY = [a + b for a in ("Var", "Kel", "Osk", "Mir", "Tam", "Zol") for b in ("losen", "berg", "mamer", "dal", "quist", "nen")]
USES = ["{n} wrote the converter.", "We ask {n} about the box.", "The sample of {n} is dry."]
OTHER = ["The {f} thermostat keeps the temperature.", "Run {r} ended early.", "Molstride reads the dump.", "The {f} thermostat is stable.", "Sample {r} was dried."]
DECLARED = ["Dear {n},\nthe run is done.", "Mr {n} has the key.", "Call me: {p} is my phone.", "My phone is {p}.", "The badge {i} is lost."]


def corpus(seed: int = 2, n: int = 700):
    rnd = random.Random(seed)
    docs, truth = [], set()
    for k in range(n):
        name = f"{rnd.choice(GIVEN)} {rnd.choice(FAMILY)}"
        phone, badge, run = f"+46 31 {rnd.randrange(100, 999)} {rnd.randrange(10, 99)} {rnd.randrange(10, 99)}", f"HB-{rnd.randrange(10**5, 10**6)}-K", f"{rnd.randrange(100, 999)}-{rnd.randrange(1000, 9999)}"
        parts = [(rnd.choice(DECLARED), True)] if k % 3 == 0 else []
        parts += [(rnd.choice(USES), True), (rnd.choice(OTHER), False), (rnd.choice(OTHER), False), ("Reach us at {p} today.", True)]
        text = " ".join(t for t, _ in parts)
        for mark, kind, item in (("{n}", "name", name), ("{p}", "phone", phone), ("{i}", "id_number", badge)):
            if mark in text:
                truth.add((k, kind, item))
        docs.append((k, text.format(n=name, p=phone, i=badge, r=run, f=rnd.choice(FAMILY)), "x"))
    return docs, truth


SCHEMA = "doc_id long, text string, kind string"


def test_corpus_decides(spark):
    docs, truth = corpus()
    scratch = Scratch(spark, "test")
    out = pii.accepted(pii.candidates(spark.createDataFrame(docs, SCHEMA), scratch), scratch).collect()
    got = {(r.doc_id, r.kind, r.item) for r in out}
    assert len(got & truth) >= 0.95 * len(truth) and len(got & truth) >= 0.97 * len(got)
    assert sum(r.evidence == "disclosed" for r in out) > 0.9 * len(out)


def test_held_out(spark):
    rows = pii.held_out(spark.createDataFrame(corpus(5)[0], SCHEMA), Scratch(spark, "test")).collect()
    assert {r.kind for r in rows} >= {"name", "phone"} and all(r.n_found >= 0.9 * r.n_hidden for r in rows if r.kind != "id_number")


def test_street_of_an_unknown_kind_by_its_town(spark):
    docs = [(1, "Die Proben gehen an Mühlenweg 2, D-05583 Dorrow Bay.", "x"), (2, "We moved to 14 Quillmere Parade, Dorrow Bay last week.", "x"), (3, "We used 14 Quillmere Steps, Other Thing here.", "x")]
    scratch = Scratch(spark, "test")
    got = {(r.doc_id, r.item) for r in pii.accepted(pii.candidates(spark.createDataFrame(docs, SCHEMA), scratch), scratch).collect()}
    assert got == {(1, "Mühlenweg 2, D-05583 Dorrow Bay"), (2, "14 Quillmere Parade, Dorrow Bay")}


def test_sanitise_edge_cases(spark):
    docs = [(1, TEXT, "x"), (2, None, "x"), (3, "", "x"), (4, "x " * 100_000, "x"), (5, TEXT, "x"), (6, "Aa " * 60_000 + "9-" * 60_000 + "a@" * 30_000, "x")] + [(k + 100, t, c) for k, t, c in corpus()[0]]
    docs = spark.createDataFrame(docs, SCHEMA)
    out = {r.doc_id: r for r in pii.sanitise(docs, Scratch(spark, "test")).collect()}
    assert len(out) == 706 and out[2].clean_text is None and out[3].clean_text == "" and out[4].n_replaced == 0
    assert "[EMAIL]" in out[1].clean_text and "Varlosen thermostat" in out[1].clean_text and "Ada" not in out[1].clean_text and out[1].clean_text == out[5].clean_text
    assert pii.sanitise(docs.limit(0), Scratch(spark, "test")).count() == 0


def test_numbers_are_tried_only_where_one_may_start(monkeypatch):
    from orbitlake.llm import pii_spans as P

    tried = []

    class Counted:
        def match(self, text, a, b):
            tried.append(a)
            return whole.match(text, a, b)

    whole = P._NUMBER
    monkeypatch.setattr(P, "_NUMBER", Counted())
    table = " ".join(f"{k}.250000 -{k}.125000" for k in range(40))
    text = f"Rows {table} tel (030) 1234567, fax +49 30 123456-7, passport C01234567 and 123-45-6789."
    got = [(x[1], x[2]) for x in P.spans(text) if x[0] == "number"]
    assert {"(030) 1234567", "123-45-6789"} <= {i for _, i in got}
    assert len(tried) < 60 and all(not text[a - 1].isalnum() for a in tried)
    want, at = [], 0
    while m := whole.search(text, at):
        want.append(m.group())
        at = m.end()
    assert {i for _, i in got} <= set(want)


def test_streets_and_spelled_mails_beside_others():
    from orbitlake.llm.pii_spans import spans

    text = "Look at 7 rue Verte, 75001 Paris, then 14 Quillmere Parade, Dorrow Bay; write anna at lab dot org. A dot at rest."
    found = {(x[1], x[2]) for x in spans(text)}
    assert ("email", "anna at lab dot org") in found and ("address", "7 rue Verte, 75001 Paris") in found and any(x[0] == "open" and x[2].startswith("14 Quillmere Parade") for x in spans(text))


ODD = (
    TEXT + "\n9. Mai van der Kel, A. B. De la Mar, af Foo, D’Arc O'Kel-Mac, xVar @Var É. Ödal. Room 7 bis, rue Verte 3, 75001 Paris; true place 5.\n"
    "Flat 9, 306 Quillmere Parade, Dorrow Bay; Apt. 3B, 12a Foo-4 Bar Xyz, Town and 1.5 Quillmere Parade, Dorrow. Unit ٣, ٣ Alt Neu, Ort.\n"
    "1-555-123-4567, 1 (800) 1234567, 555‐1234, (030) 1234567, 0171/1234567-12, 01.23.45.67.89, 12345678Z, 1 85 05 78 006 084 36, 12 345 678 901, 123456-7890, 123 45 6789, AB‑123456, 1234567890, +1 1 22 33, ٣٣٣٣٣٣٣٣٣\n"
)


def test_places_tried_are_all_places():
    from orbitlake.llm import pii_spans as P

    plain = re.compile(rf"(?<![\w@.)])(?=[{P.U}vda])(?:{P.INITIAL}{P.S}?)*(?:{P.PARTICLE}{P.S})?{P.WORD}(?:{P.S}(?:{P.INITIAL}{P.S}?)*(?:{P.PARTICLE}{P.S})?{P.WORD}){{0,3}}(?!\w)")
    rnd = random.Random(1)
    for k in range(300):
        text = ODD if k == 0 else "".join(rnd.sample(re.findall(r"\S+|\s", ODD), 60)).replace(" ", "\n", rnd.randrange(20))
        assert [m.span() for m in P.SEQUENCE.finditer(text)] == [m.span() for m in plain.finditer(text)]
        assert [m.span() for m in P._open_addresses(text)] == [m.span() for m in P.OPEN_ADDRESS.finditer(text)]
        lines = {text.count("\n", 0, m.start()) for m in P._NUMBER_HINT.finditer(text)}
        assert all(text.count("\n", 0, m.start()) in lines for m in P._NUMBER.finditer(text) if sum(map(str.isdigit, m.group())) >= 6)
    assert [x[2] for x in P.spans("7 bis, rue Verte, 75001 Paris. The true place is 5 and\n9 quai Neuf, 75001 Paris") if x[1] == "address"] == ["7 bis, rue Verte, 75001 Paris", "9 quai Neuf, 75001 Paris"]


def test_lines_without_numbers_are_passed_over(monkeypatch):
    from orbitlake.llm import pii_spans as P

    read = []

    class Counted:
        def finditer(self, text, a=0, b=1 << 60):
            for m in whole.finditer(text, a, b):
                read.append(m.group())
                yield m

    whole = P._DIGITS
    monkeypatch.setattr(P, "_DIGITS", Counted())
    text = "\n".join(f"  {1000000 + 7 * k}   298.{k % 90 + 10}5 -5004.6832" for k in range(200)) + "\ncall (030) 1234567\n" + "  4084800   298.925\n"
    assert [x[2] for x in P.spans(text) if x[0] == "number"] == ["(030) 1234567"] and read == ["030) 1234567"]


def test_words_cut_as_bits(spark):
    """Initials, however many, take no place among the words of a name that the corpus cuts, and no aggregate sorts its rows for sets."""
    import io
    from contextlib import redirect_stdout

    plans = []

    class Seen(Scratch):
        def put(self, df, by=None):
            with redirect_stdout(io.StringIO()) as said:
                df.explain()
            plans.append(said.getvalue())
            return super().put(df, by)

    long = " ".join(f"{chr(65 + k % 26)}." for k in range(3000))
    docs = [(k, t, c) for k, t, c in corpus()[0]] + [(9000, f"Mr {long} Varlosen has the key.", "x")]
    scratch = Seen(spark, "test")
    got = {(r.doc_id, r.item) for r in pii.accepted(pii.candidates(spark.createDataFrame(docs, SCHEMA), scratch), scratch).collect()}
    assert (9000, f"{long} Varlosen") in got
    assert not any("collect_set" in p for p in plans)
