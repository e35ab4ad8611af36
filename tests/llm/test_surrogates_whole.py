"""The whole rewriting against a plain version that matches every place with the whole alternation."""

import re
from itertools import combinations

import pytest
import regex
from pyspark.sql import functions as F

from hourpanel.llm import pii_surrogates as ps

WHOLE = regex.compile("|".join(f"(?:{p})" for p in ps.PATTERNS.values()))
#: Formats of one number each: all get one surrogate, in their own format.
NUMBERS = [("(020) 7946 0958", "020 7946 0958", "020-7946-0958"), ("(030) 1234 5678", "030 12345678", "030/12345678"),
           ("+1 (988) 555-2485", "+1 988 555 2485", "+1-988-555-2485", "+19885552485"), ("988-555-2485", "988 555 2485", "(988) 555-2485"),
           ("1-800-555-1234", "1 800 555 1234", "1 800-555-1234"), ("01 23 45 67 89", "01.23.45.67.89", "(01) 2345 6789"),
           ("912 345 678", "912-345-678", "912 34 56 78"), ("+33 1 23 45 67 89", "+33123456789", "+33 123 456 789")]
OTHERS = ["Mr. Smith met Mme Durand", "Mr Smith", "ann@x.org and Ann@X.org", "10.0.0.1 or 10.0.0.2", "123-45-6789", "4041 8949 7460 8795", "DE89 3704 0044 0532 0130 00",
          "a@b", "@ alone 12", "Señora García, г-жа Иванова", "no entity here, 2024-01-02", "", None, "x" * 3000, "mail me: a.b+c@d-e.co.uk, call (020) 7946 0958!"]


def test_all_formats_of_a_number_agree(spark):
    said = [(i, f"{a}; {b}") for i, (a, b) in enumerate(p for forms in NUMBERS for p in combinations(forms, 2))]
    df = spark.createDataFrame(said, "doc_id long, text string").repartition(3)
    for attempt in (0, 5):
        new = {r.m: r.s for r in spark.createDataFrame([(x,) for forms in NUMBERS for x in forms], "m string").select(
            "m", ps.surrogate(F.col("m"), "k", F.lit(attempt)).alias("s")).collect()}
        for forms in NUMBERS:
            assert len({re.sub("[^0-9+]", "", new[x]) for x in forms}) == 1, forms
    for r in ps.pseudonymise(df, "k").collect():
        old, new = said[r.doc_id][1].split("; "), r.text.split("; ")
        assert re.sub("[^0-9+]", "", new[0]) == re.sub("[^0-9+]", "", new[1]) != re.sub("[^0-9+]", "", old[0])
        assert [re.sub("[0-9]", "0", x) for x in new] == [re.sub("[0-9]", "0", x) for x in old]


@pytest.mark.parametrize("table", ["given", "documents"])
def test_rewriting_equals_brute_force(spark, small, table):
    texts = [*OTHERS, *["; ".join(f) for f in NUMBERS]] if table == "given" else [r.text for r in small.collect()]
    # surnames whose surrogates meet: some entities get a later attempt
    texts += [f"Mr. {''.join(chr(97 + i // 26 ** k % 26) for k in range(4)).capitalize()} 7" for i in range(1500)] if table == "given" else []
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {i: [m[0] for m in WHOLE.finditer(t or "")] for i, t in enumerate(texts)}
    mentions = spark.createDataFrame([(m,) for m in sorted({m for ms in found.values() for m in ms})], "mention string")
    known = ps.store(mentions.groupBy(ps.canonical(F.col("mention")).alias("canon")).agg(F.min("mention").alias("mention")), "known")
    attempt = {r.canon: r.attempt for r in ps.exceptions(known, "k").collect()}
    assert bool(attempt) == (table == "given")
    canon = {r.mention: r.c for r in mentions.select("mention", ps.canonical(F.col("mention")).alias("c")).collect()}
    tried = spark.createDataFrame([(m, attempt.get(canon[m], 0)) for m in canon], "m string, attempt int")
    new = {r.m: r.s for r in tried.select("m", ps.surrogate(F.col("m"), "k", F.col("attempt")).alias("s")).collect()}
    got = {r.doc_id: r.text for r in ps.pseudonymise(df, "k").collect()}
    assert got == {i: None if t is None else WHOLE.sub(lambda m: new[m[0]], t) for i, t in enumerate(texts)}
    assert len({ps_c for m, ps_c in canon.items()}) == len({r.c for r in tried.select(
        ps.canonical(ps.surrogate(F.col("m"), "k", F.col("attempt"))).alias("c")).collect()})  # distinct entities stay distinct


def test_a_round_evaluates_a_surrogate_once(spark, monkeypatch, capsys):
    """Repeated in each use, a surrogate's tree filled the executors' memory when it was sent to every task of a round."""
    rounds, store = [], ps.store

    def kept(df, label):
        if label == "pii-round":
            df.explain()
            rounds.append(capsys.readouterr().out.count("sha2("))
        return store(df, label)

    monkeypatch.setattr(ps, "store", kept)
    known = spark.createDataFrame([("email:ann@x.org", "ann@x.org")], "canon string, mention string")
    assert ps.exceptions(known, "k").count() == 0
    assert rounds == [1]
