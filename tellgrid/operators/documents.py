"""Operators on DataFrames of documents: check, findings, fix, score, chop, anchors, drift, gates.

All are narrow but the aggregates: one Arrow stage per operator, and filters
and projections stay outside of it so that they reach the scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from tellgrid import model
from tellgrid.functions import columns, kernel, native, ranges
from tellgrid.plans import fixed_values as fixed
from tellgrid.plans.errors import ProfileError
from tellgrid.plans.profile import Profile, apply_presets, default_profile, load_profile, load_voice, overlay, trim, with_voice


def _sliced(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded bytes of text."""
    for batch in batches:
        for at, n in columns.slices(batch.column(text)):
            yield batch.slice(at, n)


def check(df: DataFrame, profile: Profile | None = None, text_col: str = "text", out: str = "findings", **options) -> DataFrame:
    return df.withColumn(out, columns.check(text_col, profile, **options))


def findings(df: DataFrame, profile: Profile | None = None, text_col: str = "text", keys: Sequence[str] = ("doc_id",), **options) -> DataFrame:
    """A row for each finding, with the keys of its document.

    One generator stage: exploding a column of findings would let the
    optimizer copy the function into a filter and run it twice.
    """
    profile = default_profile() if profile is None else profile
    kernel.Engine(profile)
    plan, names = profile.to_json(), [f.name for f in model.FINDING.fields]
    rows = df.select(*keys, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = kernel.engine_for(plan, *(options.get(k, d) for k, d in (("ignore", ranges.IGNORE), ("ignore_next", ranges.IGNORE_NEXT))))
        kind = pa.struct([pa.field(f.name, to_arrow_type(f.dataType)) for f in model.FINDING.fields])
        for batch in _sliced(batches, len(keys)):
            at, found = [], []
            texts = batch.column(len(keys)).to_pylist()
            checked = iter(engine.checks([t for t in texts if t is not None]))
            for i, text in enumerate(texts):
                new = next(checked) if text is not None else []
                at += [i] * len(new)
                found += map(vars, new)
            told = pa.array(found, kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))), *told.flatten()], names=[*keys, *names])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], *model.FINDING.fields]))


def fix(df: DataFrame, profile: Profile | None = None, text_col: str = "text", **options) -> DataFrame:
    done = df.withColumn("__fix", columns.fix(text_col, profile, **options))
    return done.withColumn("cleaned", F.col("__fix.cleaned")).withColumn("findings", F.coalesce("__fix.findings", F.array())).drop("__fix")


def score(df: DataFrame, profile: Profile | None = None, text_col: str = "text", out: str = "score", **options) -> DataFrame:
    return df.withColumn(out, columns.score(text_col, profile, **options))


def gate(df: DataFrame, profile: Profile | None = None, text_col: str = "text", most: int | None = None) -> DataFrame:
    """One row: exit code 1 where a document has findings, or a score above ``most``; else 0."""
    bad = F.size(columns.check(text_col, profile)) > 0 if most is None else columns.score(text_col, profile)["value"] > most
    told = df.select(bad.alias("bad"))
    return told.agg(F.coalesce(F.max(F.col("bad").cast("int")), F.lit(0)).alias("exit_code"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("documents"))


def anchor_drift(df: DataFrame, before: str, after: str, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Multiset differences of the facts in two texts: dropped and added, each sorted."""
    rows = df.select(*keys, columns.anchors(before).alias("b"), columns.anchors(after).alias("a"))
    signed = F.concat(F.transform("b", lambda x: F.struct(x.alias("anchor"), F.lit(1).alias("n"))), F.transform("a", lambda x: F.struct(x.alias("anchor"), F.lit(-1).alias("n"))))
    # within a document: no shuffle
    distinct = F.array_sort(F.array_distinct(F.concat("b", "a")))
    sums = F.transform(distinct, lambda x: F.struct(x.alias("anchor"), F.aggregate(F.filter(signed, lambda s: s["anchor"] == x), F.lit(0), lambda acc, s: acc + s["n"]).alias("n")))
    rows = rows.withColumn("sums", sums)
    times = lambda sign: F.flatten(F.transform(F.filter("sums", lambda s: s["n"] * sign > 0), lambda s: F.array_repeat(s["anchor"], F.abs(s["n"]))))
    return rows.select(*keys, times(1).alias("dropped"), times(-1).alias("added"))


def drift_report(anchors: Column, what: str, shown: int = fixed.ANCHORS_SHOWN) -> Column:
    """Lines for the first anchors, and how many more there are."""
    lines = F.transform(F.slice(anchors, 1, shown), lambda a: F.concat(F.lit(f"{what} "), a))
    more = F.array(F.concat(F.lit("and "), (F.size(anchors) - shown).cast("string"), F.lit(f" more {what}")))
    return F.when(F.size(anchors) > shown, F.concat(lines, more)).otherwise(lines)


def top_findings(df: DataFrame, shown: int = fixed.FINDINGS_SHOWN) -> DataFrame:
    """The first findings of each document and how many were left out."""
    return df.withColumn("more", F.greatest(F.size("findings") - shown, F.lit(0))).withColumn("findings", F.slice("findings", 1, shown))


def segments(text: Column, findings: Column) -> Column:
    """A text cut at its findings, in bytes: array of (text, rule or null); later overlapping findings are skipped."""
    raw = text.cast("binary")
    empty = F.expr("cast(array() as array<struct<text:string,rule:string>>)")
    piece = lambda s, e, rule: F.struct(F.substring(raw, s + 1, e - s).cast("string").alias("text"), rule.cast("string").alias("rule"))

    def step(acc: Column, f: Column) -> Column:
        s, e = f["offset"], f["offset"] + F.octet_length(f["match"])
        cut = F.concat(acc["out"], F.when(s > acc["at"], F.array(piece(acc["at"], s, F.lit(None)))).otherwise(empty), F.array(piece(s, e, f["rule"])))
        return F.when(s < acc["at"], acc).otherwise(F.struct(e.alias("at"), cut.alias("out")))

    def finish(acc: Column) -> Column:
        n = F.octet_length(text)
        return F.concat(acc["out"], F.when(acc["at"] < n, F.array(piece(acc["at"], n, F.lit(None)))).otherwise(empty))

    return F.aggregate(findings, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, finish)


# --- the batch API ---------------------------------------------------------------


@lru_cache(maxsize=256)
def _requested(profile: str | None, presets: tuple[str, ...], voice: str | None) -> kernel.Engine:
    """The engine of a request; one for all requests that ask for the same."""
    out = apply_presets(load_profile(profile) if profile else default_profile(), presets)
    if voice:
        out = with_voice(out, load_voice(voice))
        if profile:
            out = overlay(out, replace(load_profile(profile), tone=()))
    return kernel.engine_for(out.to_json())


def chop(requests: DataFrame, presets: Sequence[str] = ("cleaver",), most_bytes: int = fixed.REQUEST_BYTES) -> DataFrame:
    """Requests (text, presets?, profile?, voice?) -> their columns and output, findings, scores before and after, error.

    A blank text, an oversized one, and a profile, voice or preset that cannot
    be used give an error and nothing else.
    """
    fields = [*requests.schema.fields, StructField("result", model.CHOP)]
    names = requests.columns

    def one(row: dict) -> dict:
        nothing = {"output": None, "findings": None, "score": None, "score_after": None}
        text = row.get("text")
        if text is None or not trim(text):
            return nothing | {"error": "text is required"}
        if len(text.encode("utf-8", "surrogatepass")) > most_bytes:
            return nothing | {"error": "text is too large"}
        try:
            named = row.get("presets")
            engine = _requested(row.get("profile") or None, tuple(presets if named is None else named), row.get("voice") or None)
        except ProfileError as e:
            return nothing | {"error": str(e)}
        cleaned, found, before, after = engine.chop(text)
        return {"output": cleaned, "findings": list(map(vars, found)), "score": vars(before), "score_after": vars(after), "error": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_type(model.CHOP)
        for batch in _sliced(batches, names.index("text")) if "text" in names else batches:
            rows = batch.select([c for c in ("text", "presets", "profile", "voice") if c in names]).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([one(r) for r in rows], kind)], names=[*names, "result"])

    return requests.mapInArrow(run, StructType(fields)).select(*names, "result.*")


def request_error(text: Column, most_bytes: int = fixed.REQUEST_BYTES) -> Column:
    """The validation of a request alone, natively."""
    blank = F.coalesce(text, F.lit("")).rlike(rf"^[{native.SPACE_CLASS}]*$")
    return F.when(blank, "text is required").when(F.octet_length(text) > most_bytes, "text is too large")


def report_json(df: DataFrame, pretty: bool = False) -> DataFrame:
    """A JSON report for each document."""
    options = {"pretty": "true"} if pretty else {}
    kept = F.transform("findings", lambda f: f.dropFields("order"))
    return df.withColumn("report", F.to_json(F.struct(F.col("cleaned"), kept.alias("findings")), options))


def profile_row(spark, profile: Profile) -> DataFrame:
    return spark.createDataFrame([profile.to_dict()], model.PROFILE)
