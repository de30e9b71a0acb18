"""Exact operators as columns: one Arrow-batched function each, compiled once per worker.

A null text has no findings, stays null when fixed, and has a null score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from tellgrid import model
from tellgrid.functions import kernel, ranges
from tellgrid.plans import fixed_values as fixed
from tellgrid.plans.profile import Profile, default_profile
from tellgrid.plans.rules import compile_profile


#: Bytes of text that are Python objects, or results not yet sent, at a time; a longer text alone is more.
SLICE_BYTES = 1 << 20


def slices(*texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(offset, rows) of the parts of a batch that hold about ``SLICE_BYTES`` of text, a row at least."""
    if len(texts[0]):
        size = sum(pc.fill_null(pc.binary_length(t), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts)
        starts = np.flatnonzero(np.diff(np.cumsum(size) // SLICE_BYTES, prepend=-1)).tolist()
        yield from ((a, b - a) for a, b in zip(starts, [*starts[1:], len(texts[0])], strict=True))


def function(returns: DataType, per_text: Callable | None, sides: int = 1, on_null=None, build: Callable | None = None, together: Callable | None = None):
    """``per_text`` as a function of Arrow batches, for columns or to be registered for SQL.

    ``together`` takes its place where one text is given: it answers a list of texts.

    Batches are worked on and answered in slices of bounded bytes: ten thousand
    rows, Spark's bound, are gigabytes of objects where texts or results are long.
    """
    kind = to_arrow_type(returns)
    build = build or (lambda results: pa.array(results, kind))

    def run(*arrays: pa.Array) -> Iterator[pa.Array]:
        for at, n in slices(*arrays):
            if together:
                texts = arrays[0].slice(at, n).to_pylist()
                results = iter(together([t for t in texts if t is not None]))
                yield build([on_null if t is None else next(results) for t in texts])
                continue
            rows = zip(*(a.slice(at, n).to_pylist() for a in arrays), strict=True)
            yield build([on_null if any(x is None for x in row) else per_text(*row) for row in rows])

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield from run(a)

    def two(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield from run(a, b)

    return F.arrow_udf(one if sides == 1 else two, returns)


def _column(returns: DataType, per_text: Callable | None, *cols: Column | str, on_null=None, build: Callable | None = None, together: Callable | None = None) -> Column:
    return function(returns, per_text, len(cols), on_null, build, together)(*cols)


def _planned(profile: Profile | None) -> str:
    """The profile's JSON; compiled here once so that errors come before any job."""
    profile = default_profile() if profile is None else profile
    compile_profile(profile)
    return profile.to_json()


def check(text: Column | str, profile: Profile | None = None, ignore: str = ranges.IGNORE, ignore_next: str = ranges.IGNORE_NEXT) -> Column:
    plan = _planned(profile)
    run = lambda texts: [[vars(f) for f in found] for found in kernel.engine_for(plan, ignore, ignore_next).checks(texts)]
    return _column(model.FINDINGS, None, text, on_null=[], together=run)


def fix(text: Column | str, profile: Profile | None = None, ignore: str = ranges.IGNORE, ignore_next: str = ranges.IGNORE_NEXT) -> Column:
    plan = _planned(profile)

    def run(t: str) -> dict:
        cleaned, findings = kernel.engine_for(plan, ignore, ignore_next).fix(t)
        return {"cleaned": cleaned, "findings": [vars(f) for f in findings]}

    return _column(model.FIX, run, text)


def clean(text: Column | str, profile: Profile | None = None, ignore: str = ranges.IGNORE, ignore_next: str = ranges.IGNORE_NEXT) -> Column:
    plan = _planned(profile)
    return _column(StringType(), lambda t: kernel.engine_for(plan, ignore, ignore_next).clean(t), text)


def score(text: Column | str, profile: Profile | None = None, ignore: str = ranges.IGNORE, ignore_next: str = ranges.IGNORE_NEXT) -> Column:
    plan = _planned(profile)
    return _column(model.SCORE, None, text, together=lambda texts: map(vars, kernel.engine_for(plan, ignore, ignore_next).scores(texts)))


def scores(text: Column | str, profile: Profile | None = None, ignore: str = ranges.IGNORE, ignore_next: str = ranges.IGNORE_NEXT) -> Column:
    """The scores of a text and of what it becomes when fixed, in one pass."""
    plan = _planned(profile)

    def run(t: str) -> dict:
        _, _, before, after = kernel.engine_for(plan, ignore, ignore_next).chop(t)
        return {"before": vars(before), "after": vars(after)}

    return _column(StructType([StructField("before", model.SCORE), StructField("after", model.SCORE)]), run, text)


def report(text: Column | str, profile: Profile | None = None, ignore: str = ranges.IGNORE, ignore_next: str = ranges.IGNORE_NEXT) -> Column:
    """Findings and score of a text that is checked once."""
    plan = _planned(profile)

    def run(t: str) -> dict:
        engine = kernel.engine_for(plan, ignore, ignore_next)
        found = engine.check(t)
        return {"findings": [vars(f) for f in found], "score": vars(engine.score(t, found))}

    return _column(model.REPORT, run, text, on_null={"findings": [], "score": None})


def anchors(text: Column | str) -> Column:
    return _column(ArrayType(StringType()), kernel.anchors, text, on_null=[])


def code_segments(text: Column | str) -> Column:
    return _column(ArrayType(StringType()), ranges.code_segments, text, on_null=[])


def _byte_ranges(find: Callable) -> Callable:
    def run(t: str) -> list[dict]:
        found = find(t)
        at = ranges.byte_offsets(t, [x for r in found for x in r])
        return [{"start": at[s], "end": at[e]} for s, e in found]

    return run


def code_ranges(text: Column | str) -> Column:
    """Byte ranges of code."""
    return _column(model.RANGES, _byte_ranges(ranges.code_ranges), text, on_null=[])


def skip_ranges(text: Column | str, ignore: str = ranges.IGNORE, ignore_next: str = ranges.IGNORE_NEXT) -> Column:
    return _column(model.RANGES, _byte_ranges(lambda t: ranges.skip_ranges(t, ignore, ignore_next)), text, on_null=[])


def mask_code(text: Column | str) -> Column:
    return _column(StringType(), ranges.mask_code, text)


def diff(before: Column | str, after: Column | str, most: int | None = fixed.DIFF_DISTANCE) -> Column:
    """Token edits, null where more than ``most`` are needed (never, if it is None)."""

    return _column(model.DIFF, lambda a, b: kernel.diff(a, b, most), before, after, build=_edits)


def _edits(results: list[list[tuple[int, str]] | None]) -> pa.Array:
    """Edits as Arrow, without an object for each."""
    kind = to_arrow_type(model.DIFF)
    ends = np.cumsum([0, *(len(r or ()) for r in results)]).tolist()
    # a null offset makes a null list
    offsets = pa.array([None if r is None else at for r, at in zip(results, ends, strict=False)] + ends[-1:], pa.int32())
    ops, tokens = ([x[i] for r in results if r for x in r] for i in (0, 1))
    fields = [kind.value_type.field(i) for i in range(2)]
    values = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip((ops, tokens), fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(offsets, values, type=kind)
