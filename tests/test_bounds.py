"""What keeps memory and time in bounds: slices of batches, one scan for each view of a text, first matches only."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType

from tellgrid import model, queries
from tellgrid.functions import columns, kernel, letters, native
from tellgrid.operators import documents as ops
from tellgrid.plans import fixed_values as fixed
from tellgrid.plans import rules
from tellgrid.plans.dialect import spelling_map
from tellgrid.plans.profile import Profile, default_profile

LONG = ["x" * 300_000, None, "y", "", "é" * 200_000] * 4


def test_functions_answer_in_slices():
    out = list(columns.function(StringType(), str.upper).func(iter([pa.array(LONG), pa.array([], pa.string())])))
    assert [x for part in out for x in part.to_pylist()] == [x and x.upper() for x in LONG]
    assert len(out) >= 3 and max(part.nbytes for part in out) <= 2 * columns.SLICE_BYTES


def test_edits_are_built_as_their_type():
    results = [[(0, "a"), (-1, " "), (1, "b")], None, [], [(1, "é")]]
    told = [None if r is None else [{"op": o, "token": t} for o, t in r] for r in results]
    assert columns._edits(results).equals(pa.array(told, to_arrow_type(model.DIFF)))
    assert columns._edits([None]).to_pylist() == [None]


def test_batches_of_rows_are_sliced():
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(LONG))), pa.array(LONG)], names=["doc_id", "text"])
    parts = list(ops._sliced(iter([batch]), 1))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and len(parts) >= 3


@pytest.mark.parametrize("name", ["names_kept", "fix_documents", "token_diff"])
def test_batches_from_the_jvm_are_bounded_in_bytes(spark, sf_dir, name):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        queries.QUERIES[name](spark, sf_dir)
        assert int(spark.conf.get(key)) <= 4 << 20
    finally:
        spark.conf.set(key, before)


def test_texts_compile_no_patterns(monkeypatch):
    engine = kernel.Engine(Profile(dialect="american"))
    compiled = []
    monkeypatch.setattr(rules, "compile_python", compiled.append)
    words, rnd = sorted(spelling_map("american")), random.Random(1)
    for _ in range(50):
        some = rnd.sample(words, 5)
        assert engine.clean(" ".join(some)) == " ".join(spelling_map("american")[w] for w in some)
    assert not compiled


@pytest.mark.parametrize("text", ["robuſt Kolour leveraKe", "ſrobust robustness", "cutting\nedge in the\trealm of ROBUST", "coloUr, grey-grey İrobust ırobust"])
def test_matches_are_those_of_a_whole_scan(text):
    for profile in (default_profile(), Profile(dialect="american"), Profile(wordReplace={"kolour": "color", "use": "apply"})):
        for rule in rules.compile_profile(profile).rules:
            if rule.heads or rule.starts:
                assert [m.span() for m in rule.matches(rules.Scan(text))] == [m.span() for m in rule.pattern.finditer(text)]


def test_a_rule_looks_at_a_text_once(monkeypatch):
    seen = []
    matches = rules.Rule.matches
    monkeypatch.setattr(rules.Rule, "matches", lambda self, scan: seen.append((self.order, scan.text)) or matches(self, scan))
    text = "Moreover, it is a robust plan ; an user and a hour.  It is slow — or not."
    engine = kernel.Engine()
    cleaned, found, before, after = engine.chop(text)
    # a text may come back as that of another pass, but not in one pass and the next
    assert len(seen) <= len(set(seen)) + 1
    assert (cleaned, found) == engine.fix(text) and before == engine.score(text) and after == engine.score(cleaned)


def test_a_text_that_stays_is_scored_once(monkeypatch):
    scored = []
    score = kernel.Engine.score
    monkeypatch.setattr(kernel.Engine, "score", lambda self, *a: scored.append(a) or score(self, *a))
    cleaned, _, before, after = kernel.Engine().chop("Nothing to see here.")
    assert cleaned == "Nothing to see here." and before == after and len(scored) == 1


def test_hedges_are_counted_in_one_walk(monkeypatch):
    calls = []
    lower = letters.lower
    monkeypatch.setattr(letters, "lower", lambda t: calls.append(t) or lower(t))
    assert kernel.count_hedges("May MIGHT, could_be mayé émay perhaps² fairly" + " possibly" * 100) == 105 and len(calls) <= 1


def test_case_is_that_of_single_letters():
    one = lambda c: "i" if c == "İ" else low if len(low := c.lower()) == 1 else c
    up = lambda c: u if len(u := c.upper()) == 1 else c
    text = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x1F000)])) + "ΑΣ ΣΑΣ. straße"
    assert letters.lower(text) == "".join(map(one, text)) and letters.upper(text) == "".join(map(up, text))


def test_before_first_reads_to_the_first_match_only(spark):
    words = fixed.BLOCK_WORDS
    texts = ["no tell", "a robustness then ROBUST and robust", "\U0001f600 é\nrobuſt", "robust", "", None, "cutting edge-x cutting-edge", "xrobust robust_ érobust"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", native.before_first("text", words).alias("p"))
    assert "regexp_extract_all" not in d._jdf.queryExecution().optimizedPlan().toString()
    fold = {"s": "[sſ]", "k": "[kK]"}
    p = re.compile(r"(?<![0-9A-Za-z_])(?:" + "|".join("".join(fold.get(c, re.escape(c)) for c in w) for w in words) + r")(?![0-9A-Za-z_])", re.I | re.A)
    want = [None if t is None or not (m := p.search(t)) else t[: m.start()] for t in texts]
    assert [r["p"] for r in d.orderBy("i").collect()] == want


def test_words_are_swapped_where_they_are_found(spark):
    table = {"leverage": "use", "use": "leverage", "robust": "solid", "Never": "x", "a-b": "y"}
    texts = ["Leverage USE use useful", "\x01robust\x01 Robust \x01", "Never a-b é robust", "éuse use_ use", "", None, "none"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", native.swap_words("text", table).alias("t"))
    assert "regexp_replace" in d._jdf.queryExecution().optimizedPlan().toString()
    want = ["Use LEVERAGE leverage useful", "\x01solid\x01 Solid \x01", "Never a-b é solid", "éleverage use_ leverage", "", None, "none"]
    assert [r["t"] for r in d.orderBy("i").collect()] == want


def test_scores_of_both_texts_in_one_stage(spark):
    d = spark.createDataFrame([(1, "Moreover, the plan is robust."), (2, None)], "i int, text string")
    got = d.select("i", columns.scores("text").alias("s"), columns.score("text").alias("b"), columns.clean("text").alias("c")).withColumn("a", columns.score("c")).orderBy("i").collect()
    assert got[0]["s"]["before"] == got[0]["b"] and got[0]["s"]["after"] == got[0]["a"] and got[1]["s"] is None
    plan = d.select(columns.scores("text").alias("s")).select(F.col("s.before.value"), F.col("s.after.value"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
