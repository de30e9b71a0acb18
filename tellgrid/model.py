"""Schemas of what the operators read and return."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


_text, _int, _double = StringType(), IntegerType(), DoubleType()

FINDING = StructType(
    [
        StructField("rule", _text), StructField("match", _text), StructField("replacement", _text), StructField("offset", _int),
        StructField("line", _int), StructField("col", _int), StructField("order", _int),
    ]
)
FINDINGS = ArrayType(FINDING)
RANGES = ArrayType(_struct(start=_int, end=_int))
SCORE = _struct(value=_int, tells=_int, words=_int, tells_per_100=_double, cadence_cv=_double, density=_int, cadence=_int, hedging=_int)
REPORT = _struct(findings=FINDINGS, score=SCORE)
FIX = _struct(cleaned=_text, findings=FINDINGS)
CHOP = _struct(output=_text, findings=FINDINGS, score=SCORE, score_after=SCORE, error=_text)
DIFF = ArrayType(_struct(op=_int, token=_text))
ISSUE = _struct(kind=_text, was=_text, now=_text, note=_text)
VERDICT = _struct(faithful=BooleanType(), issues=ArrayType(ISSUE))
DIAGNOSTIC = StructType(
    [
        StructField("start_line", _int), StructField("start_char", _int), StructField("end_line", _int), StructField("end_char", _int),
        StructField("severity", _int), StructField("code", _text), StructField("message", _text),
    ]
)
DOCUMENT_EVENT = _struct(uri=_text, kind=_text, version=LongType(), ts=TimestampType(), changes=ArrayType(_text))
PUBLISHED = _struct(uri=_text, version=LongType(), diagnostics=ArrayType(DIAGNOSTIC))
REQUEST = _struct(text=_text, presets=ArrayType(_text), profile=_text, voice=_text)
PROFILE = _struct(
    charReplace=MapType(_text, _text), phraseReplace=MapType(_text, _text), wordReplace=MapType(_text, _text), regexReplace=MapType(_text, _text),
    blockWords=ArrayType(_text), flagPatterns=MapType(_text, _text), allow=ArrayType(_text), collapseSpaces=BooleanType(),
    splitSemicolons=BooleanType(), fixArticles=BooleanType(), protectQuotes=BooleanType(), tone=ArrayType(_text), dialect=_text,
)
CORPUS = _struct(label=_text, text=_text, note=_text)
