"""Live documents: a keyed stream of open, change and close events.

State is the latest text and version of each document.  An event older than
the state is stale and dropped; the last of several changes is the text;
closing a document publishes an empty set and forgets it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tellgrid import model
from tellgrid.functions import kernel
from tellgrid.plans import fixed_values as fixed
from tellgrid.plans.profile import Profile, default_profile
from tellgrid.plans.rules import compile_profile

WARNING = 3
_OUT = "uri string, version long, open boolean, diagnostics array<struct<start_line:int,start_char:int,end_line:int,end_char:int,severity:int,code:string,message:string>>"


def message(finding: kernel.Finding) -> str:
    match = kernel_quote(finding.match)
    if finding.replacement is None:
        return f"{match}: {finding.rule}"
    return f"{match}: drop" if finding.replacement == "" else f"{match} -> {kernel_quote(finding.replacement)}"


def kernel_quote(text: str) -> str:
    import json

    return json.dumps(text, ensure_ascii=False)


def diagnostics(engine: kernel.Engine, text: str) -> list[dict]:
    """Findings as editor diagnostics: lines and UTF-16 columns from zero."""
    found = engine.check(text)
    spans = [(f.offset, f.offset + len(f.match.encode("utf-8", "surrogatepass"))) for f in found]
    at = kernel.utf16_positions(text, [x for s in spans for x in s])
    return [
        {"start_line": at[s][0], "start_char": at[s][1], "end_line": at[e][0], "end_char": at[e][1], "severity": WARNING, "code": f.rule, "message": message(f)}
        for f, (s, e) in zip(found, spans, strict=True)
    ]


def whole_edit(engine: kernel.Engine, text: str) -> dict | None:
    """The edit that replaces a document by its cleaned text, if that changes anything."""
    cleaned = engine.clean(text)
    if cleaned == text:
        return None
    n = len(text.encode("utf-8", "surrogatepass"))
    line, char = kernel.utf16_positions(text, [n])[n]
    return {"end_line": line, "end_char": char, "text": cleaned}


def publish(events: DataFrame, profile: Profile | None = None) -> DataFrame:
    """Document events -> the latest diagnostics of each document that changed (update mode)."""
    profile = default_profile() if profile is None else profile
    compile_profile(profile)
    plan = profile.to_json()

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, version = state.get if state.exists else (None, -(1 << 62))
        news = pd.concat(list(frames)).sort_values("version", kind="stable")
        touched = False
        for kind, v, changes in zip(news["kind"], news["version"], news["changes"], strict=True):
            if v < version or kind not in ("open", "change", "close"):
                continue
            if kind == "close":
                text, touched = None, True
            elif changes is not None and len(changes):
                text, touched = changes[-1], True
            version = v
        if text is None:
            if state.exists:
                state.remove()
        else:
            state.update((text, int(version)))
        if touched:
            found = [] if text is None else diagnostics(kernel.engine_for(plan), text)
            yield pd.DataFrame({"uri": [key[0]], "version": [int(version)], "open": [text is not None], "diagnostics": [found]})

    return events.groupBy("uri").applyInPandasWithState(run, _OUT, "text string, version long", "update", GroupStateTimeout.NoTimeout)


def dead_letters(frames: DataFrame, body_col: str = "body") -> DataFrame:
    """Raw frames that are no event of a known kind, with the reason."""
    parsed = F.from_json(F.col(body_col), model.DOCUMENT_EVENT)
    reason = F.when(parsed.isNull() | parsed["uri"].isNull(), "malformed").when(~parsed["kind"].isin("open", "change", "close"), "unknown method")
    return frames.withColumn("reason", reason).where(F.col("reason").isNotNull())


def settled(events: DataFrame, ts: str = "ts", key: str = "uri", quiet: str = f"{fixed.DEBOUNCE_MS} milliseconds", latest: Column | None = None) -> DataFrame:
    """Debounce: bursts of a key that no quiet period parts, with their size and their last value."""
    last = F.max_by(F.col("changes"), F.col("version")) if latest is None else latest
    return events.groupBy(key, F.session_window(ts, quiet).alias("burst")).agg(F.count("*").alias("events"), last.alias("latest")).select(key, F.col("burst.start").alias("start"), F.col("burst.end").alias("end"), "events", "latest")


def stream_check(documents: DataFrame, profile: Profile | None = None, ts: str = "ts", late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Findings per rule and time window of a stream of (ts, text); late rows beyond the watermark are dropped."""
    from tellgrid.functions import columns

    told = documents.withWatermark(ts, late).select(ts, F.explode(columns.check("text", profile)).alias("f"))
    return told.groupBy(F.window(ts, width).alias("w"), F.col("f.rule").alias("rule")).agg(F.count("*").alias("findings")).select(F.col("w.start").alias("start"), "rule", "findings")
