"""SQL functions: ``check_text``, ``fix_text``, ``score_text``, ``anchors``, and the table function ``findings``."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tellgrid import model
from tellgrid.functions import kernel
from tellgrid.functions.columns import function
from tellgrid.plans.profile import Profile, default_profile
from tellgrid.plans.rules import compile_profile


def register(spark: SparkSession, profile: Profile | None = None) -> None:
    """Register the functions under a profile; texts reach Python in Arrow batches."""
    profile = default_profile() if profile is None else profile
    compile_profile(profile)
    plan = profile.to_json()
    engine = lambda: kernel.engine_for(plan)
    for name, returns, one, on_null in (
        ("check_text", model.FINDINGS, lambda t: [asdict(f) for f in engine().check(t)], []),
        ("fix_text", StringType(), lambda t: engine().clean(t), None),
        ("score_text", model.SCORE, lambda t: asdict(engine().score(t)), None),
        ("anchors", ArrayType(StringType()), kernel.anchors, []),
    ):
        spark.udf.register(name, function(returns, one, on_null=on_null))

    @F.udtf(returnType="rule string, match string, replacement string, offset int, line int, col int")
    class Findings:
        def eval(self, text: str):  # noqa: ANN201
            if text is not None:
                for f in kernel.engine_for(plan).check(text):
                    yield f.rule, f.match, f.replacement, f.offset, f.line, f.col

    spark.udtf.register("findings", Findings)
