"""Personal data by bootstrapped contextual extraction (operator 4), in DataFrame functions only.

Base entities (e-mail, IP, card, phone) are found by patterns and checks.
They are seeds, as are tokens of public credential formats and, if given,
known identifiers.  Every identifier-like mention of the corpus is an
instance.  Its lexical patterns are what stands around it (the label before
it, one or two words before it, the word after it, the letters it begins
with), each with its shape.  Over the graph of patterns and instances Spark
scores patterns by the trust of their distinct instances and instances by
their patterns, in turn; a few labels that announce a secret are seed
patterns.  Patterns that end with high confidence mark the identifiers that no
base rule knows.  Generality is held down by what a pattern also meets: every
mention without trust counts against it, and one that fails a card's or an
address's check counts several times, and is only marked after a label.

Offsets are code points.  A span is found by interleaving the parts that a
pattern splits the text into with what it matches, so whole texts are read
once per pattern, inside the JVM; offsets are summed block by block, in time
proportional to the matches.

Defined results: a null or empty text has no spans (the hash is that of the
empty string); very long texts, words and tokens are read whole; spans of
different kinds may overlap, discovered spans overlap no base span; ties do
not arise, as scores are compared with limits only; rows that repeat id and
text get the same spans each; an empty table gives an empty result; other
columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellgrid.llm.common import cut, forget, text_or_empty

KINDS = ("email", "ip", "card", "phone", "id")
# The contract's patterns.  Runs are possessive and start where a run can start
# (or where the match before ended): the same matches, without a second look at long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: An identifier-like token: six characters or more, a digit among them.
TOKEN = r"(?<![A-Za-z0-9@._%+-])(?=[A-Za-z@._%+-]*+[0-9])[A-Za-z0-9@._%+-]{5,}[A-Za-z0-9]"
#: A mention: what may be a base entity, spaces included, or a token.
MENTION = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
    r"|\+[0-9][\x20().0-9-]+[0-9]"
    r"|(?<![A-Za-z0-9@._%+-])[0-9](?:[\x20-]?[0-9]){11,}+(?![A-Za-z0-9@._%+-])"
    r"|" + TOKEN
)
# What stands around a mention: the end of the gap before it, the start of the gap after it.
_OPENS, _CLOSES = r"[\"'(<\[]?", r"[\"')>\]]?"
#: A label is a word with a sign; the blanks around it count as one.
LABEL = rf"(?<![\p{{L}}_-])([\p{{L}}_-]++[\x20\t]*+[:=#][\x20\t]*+{_OPENS})$"
LEFT = rf"(?<![\p{{L}}\p{{M}}])([\p{{L}}\p{{M}}]++)[\x20\t]++{_OPENS}$"
LEFT_TWO = rf"(?<![\p{{L}}\p{{M}}])([\p{{L}}\p{{M}}]++[\x20\t]++[\p{{L}}\p{{M}}]++)[\x20\t]++{_OPENS}$"
RIGHT = rf"^{_CLOSES}[\x20\t]++([\p{{L}}\p{{M}}]++)"
BEGINS = r"^([A-Za-z]{2,8}[_-]?)(?=[A-Za-z0-9]*[0-9])"
# Public formats of credentials, and words that announce one.
#: Formats of issued credentials (access key ids, and tokens with an issuer's prefix).
FORMATS = (
    r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36,}",
    r"xox[abprs]-[A-Za-z0-9-]{10,}",
    r"AIza[A-Za-z0-9_-]{35}",
    r"sk_live_[A-Za-z0-9]{16,}",
)
#: Labels that are patterns from the start.
LABELS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "access_key", "secret_key", "private_key", "auth_token", "access_token")
#: Rounds of scoring, least confidence, least sum of the trust of distinct instances, trust handed on.
ROUNDS, CONFIDENCE, SUPPORT, DECAY = 3, 0.5, 3.0, 0.8
#: Score of a seed label, and how often an instance that fails its check counts beside a label's patterns.
PRIOR, NEGATIVE = 0.9, 3
#: Matches of one block of the running offsets.
BLOCK = 256

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _luhn(match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when((n - i) % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return F.when((n >= 12) & (n <= 19), total % 10 == 0).otherwise(False)


def _octets(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _phone_digits(match: Column) -> Column:
    n = F.length(F.regexp_replace(match, "[^0-9]", ""))
    return (n >= 9) & (n <= 15)


def _located(steps: Column, out: Callable[[Column, Column, Column], Column], empty: Column) -> Column:
    """``out(x, start, end)`` of the steps x (with gap, n and ok) that are ok: offsets run on from block to block."""

    def within(block: Column, offset: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + x["n"]
            return F.struct(end.alias("at"), F.when(x["ok"], F.concat(acc["out"], F.array(out(x, start, end)))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, F.struct(offset.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    def blocks(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)))

    def joined(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda acc, x: acc + x["gap"] + x["n"]))
        offsets = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)))
        return _let(offsets, lambda o: F.flatten(F.transform(parts, lambda p, i: within(p, F.get(o, i)))))

    return _let(steps, lambda all_: F.when(F.size(all_) == 0, empty).when(F.size(all_) <= BLOCK, within(all_, F.lit(0))).otherwise(_let(blocks(all_), joined)))


def _spans(text: Column, guard: Column, pattern: str, kind: int, valid: Callable[[Column], Column]) -> Column:
    """Sorted spans of the valid matches of one pattern."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda s, m: F.struct(F.length(s).alias("gap"), F.length(m).alias("n"), valid(m).alias("ok")))
    empty = F.expr(f"cast(array() as {_SPAN})")
    spans = _located(steps, lambda x, s, e: F.struct(s.alias("start"), F.lit(kind).alias("kind"), e.alias("end")), empty)
    return F.when(guard, spans).otherwise(empty)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind."""
    digit = text.rlike("[0-9]")
    kinds = (
        _spans(text, text.contains("@"), EMAIL, 0, lambda m: F.lit(True)),
        _spans(text, digit & text.rlike(r"[0-9]\.[0-9]"), IP, 1, _octets),
        _spans(text, digit & text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), CARD, 2, _luhn),
        _spans(text, text.contains("+") & digit, PHONE, 3, _phone_digits),
    )
    return F.array_sort(F.concat(*kinds))


def shape(token: Column) -> Column:
    """The classes of characters of a mention, and its length as a power of two."""
    signs = F.concat_ws(
        "",
        F.when(token.rlike("[A-Za-z]"), F.lit("a")),
        F.when(token.rlike("[0-9]"), F.lit("9")),
        *[F.when(token.contains(c), F.lit(c)) for c in "@._%+-( "],
    )
    return F.concat(signs, F.floor(F.log2(F.length(token).cast("double"))).cast("string"))


def _contexts(before: Column, token: Column, after: Column) -> Column:
    """What the patterns of a mention are made of: array of (kind, words)."""
    one = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.lower(F.regexp_replace(c, r"[\x20\t]+", " ")).alias("words"))
    all_ = F.array(
        one("label", F.regexp_extract(before, LABEL, 1)),
        one("left", F.regexp_extract(before, LEFT, 1)),
        one("left two", F.regexp_extract(before, LEFT_TWO, 1)),
        one("right", F.regexp_extract(after, RIGHT, 1)),
        one("begins", F.regexp_extract(token, BEGINS, 1)),
    )
    return F.filter(all_, lambda x: x["words"] != "")


def mentions(text: Column) -> Column:
    """Identifier-like mentions with their contexts: array of (start, end, token, contexts)."""
    kind = "array<struct<start:int,end:int,token:string,contexts:array<struct<kind:string,words:string>>>>"
    empty = F.expr(f"cast(array() as {kind})")

    def all_(parts: Column, found: Column) -> Column:
        n = F.size(found)
        zipped = F.arrays_zip(F.slice(parts, F.lit(1), n).alias("before"), found.alias("token"), F.slice(parts, F.lit(2), n).alias("after"))
        steps = F.transform(
            zipped,
            lambda x: F.struct(F.length(x["before"]).alias("gap"), F.length(x["token"]).alias("n"), F.lit(True).alias("ok"), x["token"].alias("token"), _contexts(x["before"], x["token"], x["after"]).alias("contexts")),
        )
        return _located(steps, lambda x, s, e: F.struct(s.alias("start"), e.alias("end"), x["token"].alias("token"), x["contexts"].alias("contexts")), empty)

    both = F.struct(F.split(text, MENTION, -1).alias("parts"), F.regexp_extract_all(text, F.lit(MENTION), F.lit(0)).alias("found"))
    return F.when(text.rlike("[0-9@]"), _let(both, lambda b: all_(b["parts"], b["found"]))).otherwise(empty)


def score_patterns(edges: DataFrame, rounds: int = ROUNDS, labels: Sequence[str] = LABELS) -> DataFrame:
    """kind, words, shape, score, support from distinct edges (kind, words, shape, token, seed, fails).

    A seed is trusted fully.  A pattern's score is the trust of its distinct
    instances over their number plus one, those that fail a check counted
    ``NEGATIVE`` times more unless the pattern is a label; a seed label has
    ``PRIOR`` at least.  An instance that is no seed is trusted as its
    patterns, together, vouch for it.
    """
    key = ["kind", "words", "shape"]
    given = (F.col("kind") == "label") & F.regexp_extract("words", r"^([\p{L}_-]+)", 1).isin([x.lower() for x in labels])
    against = F.sum(F.when(F.col("fails") & ~F.col("seed") & (F.col("kind") != "label"), NEGATIVE).otherwise(0))
    live = cut(edges.withColumn("trust", F.when(F.col("seed"), 1.0).otherwise(0.0)))
    for k in range(rounds):
        patterns = live.groupBy(*key).agg((F.sum("trust") / (F.count("*") + against + 1)).alias("score"), F.sum("trust").alias("support"))
        patterns = patterns.select(*key, F.when(given, F.greatest("score", F.lit(PRIOR))).otherwise(F.col("score")).alias("score"), F.when(given, F.col("support") + SUPPORT).otherwise(F.col("support")).alias("support"))
        if k + 1 == rounds:
            return patterns
        # only patterns that have some trust can hand any on
        lent = patterns.where("score > 0").select(*[F.col(c).alias(f"p_{c}") for c in key], "score")
        votes = live.where("not seed").join(lent, (F.col("kind") == F.col("p_kind")) & (F.col("words") == F.col("p_words")) & (F.col("shape") == F.col("p_shape")))
        told = votes.groupBy(F.col("token").alias("t")).agg((1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.99)) * DECAY)))).alias("given"))
        before = live
        live = cut(live.join(told, F.col("token") == F.col("t"), "left").select(*key, "token", "seed", "fails", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("given", F.lit(0.0))).alias("trust")))
        forget(before)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find_personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = ROUNDS,
    confidence: float = CONFIDENCE,
    support: float = SUPPORT,
    formats: Sequence[str] = FORMATS,
    labels: Sequence[str] = LABELS,
    known: DataFrame | None = None,
) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found.

    ``known``: identifiers known beforehand (a column ``token``), seeds besides the base entities.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    slim = cut(rows.select("doc_id", F.xxhash64("text").alias("th"), base_spans(F.col("text")).alias("base"), mentions(F.col("text")).alias("occ")))
    one = slim.where("size(occ) > 0").select("doc_id", "th", "base", F.explode("occ").alias("o")).select("doc_id", "th", "base", "o.*")
    covers = F.exists("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    exact = F.exists("base", lambda b: (b["start"] == F.col("start")) & (b["end"] == F.col("end")))
    issued = F.col("token").rlike(f"^(?:{'|'.join(formats)})$") if formats else F.lit(False)
    card_like = F.col("token").rlike(r"^[0-9](?:[\x20-]?[0-9]){11,18}$")
    ip_like = F.col("token").rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
    seen = one.select("doc_id", "th", "start", "end", "contexts", shape(F.col("token")).alias("shape"), F.lower("token").alias("token"), covers.alias("covered"), exact.alias("base"), issued.alias("issued"), (card_like | ip_like).alias("checked"))
    seen = seen.where("base or not covered")
    if known is not None:
        told = known.select(F.lower("token").alias("k")).distinct()
        seen = seen.join(told, F.col("token") == F.col("k"), "left").withColumn("issued", F.col("issued") | F.col("k").isNotNull()).drop("k")
    seen = cut(seen.select("doc_id", "th", "start", "end", "contexts", "shape", "token", "covered", "issued", (F.col("base") | F.col("issued")).alias("seed"), (F.col("checked") & ~F.col("base") & ~F.col("issued")).alias("fails")))
    edges = seen.select("shape", "token", "seed", "fails", F.explode("contexts").alias("c")).groupBy(F.col("c.kind").alias("kind"), F.col("c.words").alias("words"), "shape", "token").agg(F.max("seed").alias("seed"), F.max("fails").alias("fails"))
    good = score_patterns(edges, rounds, labels).where((F.col("score") >= confidence) & (F.col("support") >= support))
    good = good.select(F.col("kind").alias("gk"), F.col("words").alias("gw"), F.col("shape").alias("gs"))
    by_pattern = seen.where("not covered").select("doc_id", "th", "start", "end", "shape", "fails", F.explode("contexts").alias("c"))
    by_pattern = by_pattern.where("not fails or c.kind = 'label'").join(good, (F.col("c.kind") == F.col("gk")) & (F.col("c.words") == F.col("gw")) & (F.col("shape") == F.col("gs")))
    new = by_pattern.select("doc_id", "th", "start", "end").unionByName(seen.where("issued and not covered").select("doc_id", "th", "start", "end"))
    found = new.groupBy(F.col("doc_id").alias("fid"), F.col("th").alias("fth")).agg(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end")).alias("new"))
    out = slim.drop("occ").join(found, F.col("doc_id").eqNullSafe(F.col("fid")) & (F.col("th") == F.col("fth")), "left")
    everything = F.array_sort(F.concat("base", F.coalesce(F.col("new"), F.expr(f"cast(array() as {_SPAN})"))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(everything).alias("spans"),
        F.when(F.col("new").isNull(), 0).otherwise(F.size("new")).cast("long").alias("n_found"),
    )
