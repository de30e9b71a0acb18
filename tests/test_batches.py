"""Texts looked at together: the same results as one by one, with few rules tried, and no core left without work."""

import random

import pytest
from pyspark.sql import functions as F

from tellgrid import queries
from tellgrid.functions import batches, kernel
from tellgrid.plans import rules
from tellgrid.plans.profile import UNICODE_SPACE, Profile, default_profile
from tellgrid.sources import readers

PIECES = (
    *queries.TELLS, *UNICODE_SPACE, "a", "A", "an ", "a\t", "an  hour", "a user", "An apple", "may", "lİkely", "liKely", "maybe", "could_be", "COULD", "émay", "perhaps²", "robuſt", "Kelvin", "K",
    "straße", "STRASSE", "ﬁrst", "\0", "\x1c", "\x1f.", ".", "!", "?", ",", ", ", " ,", ",.", ",,", ";", "; b", "\n", "\n\n", "```\ncode robust — a hour\n```", "`a hour`", "    robust, indented", "\t", "prose-ignore",
    "prose-ignore-next-line", "[x](http://a.b/robust)", "<a:b>", "---\n", "it's not big, it's small", "This isn't it, it's that", "that", "let's take a look", "here's the thing", "certainly", "😀", "é", "\ud800", "_", "1", "colour", "cutting edge", "cutting-edge", "potential",
)


def some_texts(n: int) -> list[str]:
    rnd = random.Random(7)
    return ["", " ", "\0", *PIECES, *(rnd.choice(("", " ")).join(rnd.choices(PIECES, k=rnd.randrange(1, 30))) for _ in range(n))]


@pytest.mark.parametrize(
    "profile",
    [
        default_profile(), Profile(), Profile(dialect="american"), Profile(blockWords=("straße", "STRASSE", "cutting edge", "é", "it", "K")), Profile(allow=("robust", "in summary"), blockWords=("robust",), protectQuotes=True),
        Profile(flagPatterns={"x": r"(?i)straße|ﬁrst", "y": r"(?i)\b(?:it|that)\b"}, charReplace={"a": "b", "é": "e", "—": "-"}, phraseReplace={"K elvin": "x", "a hour": ""}), Profile(wordReplace={"may": "can", "colour": "", "likely": "x"}),
    ],
)
def test_texts_together_are_as_alone(profile):
    engine, texts = kernel.Engine(profile), some_texts(400)
    assert engine.checks(texts) == [engine.check(t) for t in texts]
    assert engine.scores(texts) == [engine.score(t) for t in texts]
    assert engine.scores([]) == engine.checks([]) == []


def test_literals_heads_and_words_are_those_of_each_text():
    texts = some_texts(300)
    folded = [t.casefold() for t in texts]
    finder = batches.Finder(["robust", "—", "  ", ",,", " ,", "strasse", "é", "\ud800", "cutting-edge", "a", "\0x"])
    assert finder.literals == {"robust", "—", "  ", ",,", " ,", "strasse", "é", "\ud800", "cutting-edge"}
    assert finder(folded) == [{x for x in finder.literals if x in t} for t in folded]
    starts = batches.Starts(["a ", "an ", "it", "that", "certainly"])
    word = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
    low = lambda t: t.encode("utf-32-le", "surrogatepass").decode("utf-32-le", "surrogatepass").translate({i: i + 32 for i in range(65, 91)})
    want = [{x: at for x in starts.heads if (at := [i for i in range(len(t)) if low(t).startswith(x, i) and (not i or t[i - 1] not in word)])} for t in texts]
    assert starts(texts) == want
    assert batches.words_and_sentences(texts) == [(len(kernel.fields(t)), kernel.sentence_lengths(t)) for t in texts]


def test_rules_without_their_literals_are_not_tried(monkeypatch):
    tried = []
    matches = rules.Rule.matches
    monkeypatch.setattr(rules.Rule, "matches", lambda self, scan: tried.append(self.order) or matches(self, scan))
    texts = ["Plain words, and nothing else to see in here."] * 50
    assert len(kernel.Engine().scores(texts)) == 50 and len(tried) <= 6 * len(texts)


def test_uneven_scans_are_dealt_out(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    path = str(tmp_path / "t")
    spark.range(0, 8000, 1, cores + 1).write.parquet(path)  # as many splits as files: two rounds, the second of one task
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "64m")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() == cores + 1
        dealt = readers.balanced(df)
        assert dealt.rdd.getNumPartitions() == 4 * cores and dealt.count() == 8000 and dealt.agg(F.sum("id")).first()[0] == 7999 * 4000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    even = spark.range(0, 8000, 1, 2 * cores)
    assert readers.balanced(even) is even and readers.balanced(spark.range(0, 8, 1, 8 * cores)).rdd.getNumPartitions() == 8 * cores
    assert readers.balanced(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == cores
