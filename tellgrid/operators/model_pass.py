"""The optional model pass: rewrite, check again, judge, retry, and fail closed.

A backend is any callable (system, user) -> text; nothing here reaches a
network.  The pass runs as one Arrow stage of its own, as many calls at once
as there are partitions.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tellgrid import model
from tellgrid.functions import kernel, ranges
from tellgrid.plans import fixed_values as fixed
from tellgrid.plans.errors import ProfileError
from tellgrid.plans.profile import Profile, default_profile, merge_tone, parse_tone_notes, trim

Completer = Callable[[str, str], str]

REWRITE = (
    "Rewrite the text so that it reads as a person would write it, and keep every fact and idea as it is.\n"
    "Take out long dashes, semicolons between clauses, filler openers and buzzwords; vary the length of sentences; prefer plain words."
)
JUDGE = (
    "Compare the rewrite with the original. Answer with JSON only: "
    '{"faithful": true or false, "issues": [{"kind": "added, removed or changed", "was": "", "now": "", "note": ""}]}.'
)
LEARN = "Describe the voice of these samples as a JSON array of short notes, and nothing else."


@dataclass(frozen=True)
class Verdict:
    faithful: bool = False
    issues: Sequence[dict] = field(default_factory=tuple)

    def as_row(self) -> dict:
        return {"faithful": self.faithful, "issues": [{k: str(i.get(k, "") or "") for k in ("kind", "was", "now", "note")} for i in self.issues]}


def system_prompt(tone: Sequence[str] = (), feedback: Sequence[str] = ()) -> str:
    parts = [REWRITE]
    if tone:
        parts.append("Match this voice:\n" + "\n".join(f"- {t}" for t in tone))
    if feedback:
        parts.append("An earlier rewrite changed the meaning. This time keep:\n" + "\n".join(f"- {n}" for n in feedback))
    return "\n\n".join([*parts, "Return the rewritten text only."])


def parse_verdict(reply: str) -> Verdict:
    """The object between the first and the last brace; anything else raises."""
    a, b = reply.find("{"), reply.rfind("}")
    if a < 0 or b < a:
        raise ValueError("the judge's reply had no JSON object")
    data = json.loads(reply[a : b + 1])
    issues = data.get("issues") or []
    if not isinstance(data, dict) or not isinstance(issues, list) or not all(isinstance(i, dict) for i in issues):
        raise ValueError("the judge's reply is no verdict")
    return Verdict(bool(data.get("faithful", False)), tuple(issues))


def _clip(text: str) -> str:
    return text if len(text) <= fixed.FEEDBACK_FIELD else text[: fixed.FEEDBACK_FIELD] + "…"


def feedback_notes(issues: Sequence[dict]) -> list[str]:
    """What the next attempt must keep; bounded in number and length."""
    notes = []
    for issue in issues[: fixed.FEEDBACK_NOTES]:
        was, now, note = (_clip(str(issue.get(k, "") or "")) for k in ("was", "now", "note"))
        if was and now:
            notes.append(f'keep "{was}", do not change it to "{now}" ({note})')
        elif was:
            notes.append(f'keep "{was}", do not drop it ({note})')
        elif now:
            notes.append(f'do not add "{now}" ({note})')
        elif note:
            notes.append(note)
    return notes


def anchor_delta(before: str, after: str) -> tuple[list[str], list[str]]:
    a, b = Counter(kernel.anchors(before)), Counter(kernel.anchors(after))
    return sorted((a - b).elements()), sorted((b - a).elements())


def recheck(engine: kernel.Engine, original: str, reply: str) -> tuple[str, list[str]]:
    """The reply cleaned by the rules once more, with warnings on what it left, broke or lost."""
    cleaned = engine.clean(reply)
    warnings = ["the rewrite carried tells the rules had to clean"] if cleaned != reply else []
    warnings += [f'the rewrite left {f.rule} "{f.match}" at {f.line}:{f.col}' for f in engine.check(cleaned) if f.replacement is None]
    if ranges.code_segments(original) != ranges.code_segments(cleaned):
        warnings.append("the rewrite changed code")
    for what, tokens in zip(("dropped", "added"), anchor_delta(original, cleaned), strict=True):
        warnings += [f"{what} {t}" for t in tokens[: fixed.ANCHORS_SHOWN]]
        if len(tokens) > fixed.ANCHORS_SHOWN:
            warnings.append(f"and {len(tokens) - fixed.ANCHORS_SHOWN} more {what}")
    return cleaned, warnings


def rewrite_one(engine: kernel.Engine, original: str, completer: Completer, judge: Completer | None = None, retries: int = 1, tone: Sequence[str] = ()) -> dict:
    """Rules, model, rules again; with a judge the rewrite is kept only when it is found faithful."""
    safe = engine.clean(original)
    warnings: list[str] = []
    feedback: list[str] = []
    for attempt in range(1 + (max(0, retries) if judge else 0)):
        reply = trim(completer(system_prompt(tone, feedback), safe))
        if not reply:
            raise ValueError("the model's reply is empty")
        out, told = recheck(engine, original, reply)
        warnings += told
        if original.endswith("\n") and not out.endswith("\n"):
            out += "\n"
        if judge is None:
            return {"cleaned": out, "verdict": None, "warnings": warnings, "error": None}
        try:
            verdict = parse_verdict(judge(JUDGE, f"ORIGINAL:\n{original}\n\nREWRITE:\n{out}"))
        except Exception as e:  # noqa: BLE001 - a judge that cannot answer must not let a rewrite through
            failed = Verdict(False, ({"note": f"meaning check could not run: {e}"},))
            return {"cleaned": safe, "verdict": failed.as_row(), "warnings": [*warnings, "the meaning check could not run; kept the rules output"], "error": None}
        if verdict.faithful:
            return {"cleaned": out, "verdict": verdict.as_row(), "warnings": warnings, "error": None}
        feedback = feedback_notes(verdict.issues)
    return {"cleaned": safe, "verdict": verdict.as_row(), "warnings": [*warnings, "kept the rules output because the rewrite changed meaning"], "error": None}


RESULT = StructType([StructField("cleaned", StringType()), StructField("verdict", model.VERDICT), StructField("warnings", ArrayType(StringType())), StructField("error", StringType())])


def rewrite(df: DataFrame, completer: Completer, judge: Completer | None = None, retries: int = 1, profile: Profile | None = None, text_col: str = "text") -> DataFrame:
    """The model pass over a column: cleaned, verdict, warnings, error (a backend's failure leaves the text null)."""
    profile = default_profile() if profile is None else profile
    kernel.engine_for(profile.to_json())
    plan, tone, at = profile.to_json(), tuple(profile.tone), df.columns.index(text_col)

    def one(text: str | None) -> dict:
        if text is None:
            return {"cleaned": None, "verdict": None, "warnings": [], "error": None}
        try:
            return rewrite_one(kernel.engine_for(plan), text, completer, judge, retries, tone)
        except Exception as e:  # noqa: BLE001 - one document's failure is its own
            return {"cleaned": None, "verdict": None, "warnings": [], "error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_type(RESULT)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([one(t) for t in batch.column(at).to_pylist()], kind)], names=[*batch.schema.names, "rewrite"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("rewrite", RESULT)])).select(*df.columns, "rewrite.*")


def shares_judge(rewriter: Sequence[str], judge: Sequence[str], defaults: dict[str, str]) -> bool:
    """Whether (provider, model, base url) of both come to the same, a judge's blanks being the rewriter's."""
    def effective(x: Sequence[str]) -> tuple[str, str, str]:
        provider, name, url = x
        return provider, name or defaults.get(provider, ""), url

    provider = judge[0] or rewriter[0]
    same = provider == rewriter[0]
    return effective(rewriter) == effective((provider, judge[1] or (rewriter[1] if same else ""), judge[2] or (rewriter[2] if same else "")))


def learn_tone(samples: Sequence[str], completer: Completer, existing: Sequence[str] = ()) -> list[str]:
    """Tone notes from samples, cut to a bounded number of bytes, merged into those that exist."""
    joined = "\n\n".join(samples)
    if not trim(joined):
        raise ProfileError("no samples to learn from")
    clipped = joined.encode("utf-8")[: fixed.LEARN_BYTES].decode("utf-8", "ignore")
    return merge_tone(existing, parse_tone_notes(completer(LEARN, clipped)))
