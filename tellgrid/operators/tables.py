"""Relational operators over findings and spans, and corpus evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellgrid.functions import columns
from tellgrid.plans import fixed_values as fixed
from tellgrid.plans.dialect import spelling_pairs
from tellgrid.plans.profile import Profile, default_profile, load_preset, preset_names


def merge_intervals(spans: DataFrame, keys: Sequence[str] = ("doc_id",), start: str = "start", end: str = "end") -> DataFrame:
    """Gaps and islands: spans of a key that touch or overlap become one."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(end).over(before)
    marked = spans.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    island = marked.withColumn("__island", F.sum("__new").over(running))
    return island.groupBy(*keys, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("__island")


def outside_intervals(spans: DataFrame, protected: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Interval anti-join: the spans that overlap no protected range of their document.

    Ranges are gathered by document, so the join is on equal keys and the
    overlap is tested inside a row.
    """
    held = protected.groupBy(*keys).agg(F.collect_list(F.struct(F.col("start").alias("s"), F.col("end").alias("e"))).alias("__held"))
    free = ~F.coalesce(F.exists("__held", lambda r: (r["s"] < F.col("end")) & (r["e"] > F.col("start"))), F.lit(False))
    return spans.join(held, list(keys), "left").where(free).drop("__held")


def dedupe_findings(found: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Of findings with one offset and match (in any case) the one that fix acts on."""
    best = Window.partitionBy(*keys, "offset", F.lower("match")).orderBy(F.col("replacement").isNull(), "order")
    return found.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def anchor_difference(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Multiset difference of two tables of (keys, anchor): rows with how many were dropped or added."""
    both = before.select(*keys, "anchor", F.lit(1).alias("n")).unionByName(after.select(*keys, "anchor", F.lit(-1).alias("n")))
    return both.groupBy(*keys, "anchor").agg(F.sum("n").alias("n")).where("n <> 0").select(*keys, "anchor", F.greatest("n", F.lit(0)).alias("dropped"), F.greatest(-F.col("n"), F.lit(0)).alias("added"))


def anchor_changes(df: DataFrame, before: Column, after: Column, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """:func:`anchor_difference` of two arrays of anchors in one row: one scan, and one partial sum."""
    signed = lambda c, n: F.transform(c, lambda x: F.struct(x.alias("anchor"), F.lit(n).alias("n")))
    both = df.select(*keys, F.explode(F.concat(signed(before, 1), signed(after, -1))).alias("s")).select(*keys, "s.*")
    changed = both.groupBy(*keys, "anchor").agg(F.sum("n").alias("n")).where("n <> 0")
    return changed.select(*keys, "anchor", F.greatest("n", F.lit(0)).alias("dropped"), F.greatest(-F.col("n"), F.lit(0)).alias("added"))


def evaluate(df: DataFrame, positive: Column, profile: Profile | None = None, text_col: str = "text", threshold: int = fixed.CLEAN_BELOW) -> DataFrame:
    """One row: recall, precision, F1 and score margin of the score as a classifier of ``positive``."""
    told = df.select(positive.alias("yes"), columns.score(text_col, profile).alias("s")).select("yes", F.col("s.value").alias("v"))
    flagged = F.col("v") >= threshold
    count = lambda c: F.sum(c.cast("long"))
    agg = told.agg(
        count(F.col("yes")).alias("positives"), count(~F.col("yes")).alias("negatives"), count(F.col("yes") & flagged).alias("hits"),
        count(~F.col("yes") & flagged).alias("false_hits"), F.avg(F.when(F.col("yes"), F.col("v"))).alias("mean_positive"), F.avg(F.when(~F.col("yes"), F.col("v"))).alias("mean_negative"),
    )
    recall, precision = F.col("hits") / F.col("positives"), F.when(F.col("hits") + F.col("false_hits") > 0, F.col("hits") / (F.col("hits") + F.col("false_hits"))).otherwise(1.0)
    return agg.withColumns({"recall": recall, "precision": precision, "margin": F.col("mean_positive") - F.col("mean_negative")}).withColumn(
        "f1", F.when(F.col("recall") + F.col("precision") > 0, 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))).otherwise(0.0)
    )


def evaluate_tells(df: DataFrame, label_col: str = "label", profile: Profile | None = None, text_col: str = "text") -> DataFrame:
    """For each label: documents, documents with a content tell, mean score, documents at or above the clean threshold."""
    told = df.select(F.col(label_col).alias("label"), columns.report(text_col, profile).alias("r")).select("label", F.col("r.findings").alias("f"), F.col("r.score.value").alias("v"))
    tell = F.exists("f", lambda x: x["rule"].rlike("^(?:word|phrase|structural|char):"))
    return told.groupBy("label").agg(
        F.count("*").alias("documents"), F.sum(tell.cast("long")).alias("with_tells"), F.avg("v").alias("mean_score"), F.sum((F.col("v") >= fixed.CLEAN_BELOW).cast("long")).alias("flagged")
    )


# --- catalogs ---------------------------------------------------------------------

_SECTIONS = (("character swaps", "charReplace"), ("stock phrases", "phraseReplace"), ("word swaps", "wordReplace"), ("regex swaps", "regexReplace"))


def catalog_rows(profile: Profile | None = None) -> list[tuple[str, int, str, str | None, str]]:
    """(section, ordinal, key, target, fate) in the order of the listing."""
    p = default_profile() if profile is None else profile
    rows: list[tuple[str, int, str, str | None, str]] = []
    for title, name in _SECTIONS:
        for i, (k, v) in enumerate(sorted(getattr(p, name).items()), 1):
            rows.append((title, i, k, v, "swapped" if v else "dropped"))
    rows += [("buzzwords flagged", i, w, None, "flagged") for i, w in enumerate(sorted(p.blockWords), 1)]
    rows += [("patterns flagged", i, k, v, "flagged") for i, (k, v) in enumerate(sorted(p.flagPatterns.items()), 1)]
    rows += [("allowed", i, w, None, "kept") for i, w in enumerate(sorted(p.allow), 1)]
    on = lambda x: "on" if x else "off"
    switches = (("semicolon split", on(p.splitSemicolons)), ("space cleanup", on(p.collapseSpaces)), ("dialect", p.dialect or "off"))
    return rows + [("cleanup", i, k, v, "setting") for i, (k, v) in enumerate(switches, 1)]


def catalog(spark: SparkSession, profile: Profile | None = None) -> DataFrame:
    return spark.createDataFrame(catalog_rows(profile), "section string, ordinal int, key string, target string, fate string")


def _quoted(x: str) -> str:
    import json

    return json.dumps(x, ensure_ascii=False)


def catalog_text(profile: Profile | None = None) -> str:
    """The compact listing."""
    rows, out = catalog_rows(profile), []
    for section in dict.fromkeys(r[0] for r in rows):
        own = [r for r in rows if r[0] == section]
        if section in ("buzzwords flagged", "allowed"):
            out.append(f"{section} ({len(own)}): {', '.join(r[2] for r in own)}")
        elif section == "cleanup":
            out += [f"{r[2]}: {r[3]}" for r in own]
        else:
            out.append(f"{section} ({len(own)}):")
            out += [f"  {_quoted(r[2])} => {_quoted(r[3]) if r[3] else '(dropped)'}" for r in own]
    return "\n".join(out) + "\n"


def catalog_markdown(profile: Profile | None = None) -> str:
    """The listing as a page, with what each preset pack adds."""
    rows = catalog_rows(profile)
    code = lambda x: f"`{x}`"

    def table(own, head: tuple[str, str], left=lambda r: r[2], right=lambda r: code(r[3]) if r[3] else "dropped") -> list[str]:
        return [f"| {head[0]} | {head[1]} |", "| --- | --- |", *[f"| {code(left(r))} | {right(r)} |" for r in own], ""]

    out = ["# Catalog", ""]
    for section in dict.fromkeys(r[0] for r in rows):
        own = [r for r in rows if r[0] == section]
        out += [f"## {section.capitalize()} ({len(own)})", ""]
        if section in ("buzzwords flagged", "allowed"):
            out += [" ".join(code(r[2]) for r in own), ""]
        elif section == "stock phrases":
            out += table(own, ("Phrase", "Fate"), left=lambda r: r[2].rstrip(" "))
        elif section == "patterns flagged":
            out += table(own, ("Name", "Pattern"), right=lambda r: code(r[3].replace("|", "\\|")))
        elif section == "cleanup":
            out += table(own, ("Pass", "State"), right=lambda r: r[3])
        else:
            out += table(own, ("From", "To"))
    for name in preset_names():
        pack = load_preset(name)
        out += [f"## Preset {name}", "", *table([("", 0, k, v, "") for k, v in sorted({**pack.phraseReplace, **pack.wordReplace}.items())], ("From", "To"))]
        if pack.blockWords:
            out += [f"Adds {len(pack.blockWords)} buzzwords: " + " ".join(code(w) for w in sorted(pack.blockWords)), ""]
    return "\n".join(out)


def preset_entries(spark: SparkSession) -> DataFrame:
    """(preset, kind, key, value) of every pack."""
    rows = []
    for name in preset_names():
        pack = load_preset(name)
        rows += [(name, "phrase", k, v) for k, v in pack.phraseReplace.items()] + [(name, "word", k, v) for k, v in pack.wordReplace.items()]
        rows += [(name, "block", w, None) for w in pack.blockWords]
    return spark.createDataFrame(rows, "preset string, kind string, key string, value string")


def overlay_entries(layers: DataFrame) -> DataFrame:
    """Map precedence as a table: of entries (priority, kind, key, value) the one of the highest priority for each key."""
    best = Window.partitionBy("kind", "key").orderBy(F.desc("priority"))
    return layers.withColumn("__n", F.row_number().over(best)).where("__n = 1").select("kind", "key", "value", "priority")


def dialect_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p.british, p.american, p.oneway) for p in spelling_pairs()], "british string, american string, oneway boolean")
