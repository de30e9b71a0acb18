"""Registered queries of the text engine, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellgrid import golden, model
from tellgrid.functions import columns, native
from tellgrid.operators import documents as ops
from tellgrid.operators import tables
from tellgrid.plans import fixed_values as fixed
from tellgrid.plans.dialect import spelling_map, spelling_pairs
from tellgrid.plans.profile import Profile, Voice, default_profile, load_preset, preset_names, resolve
from tellgrid.sources.readers import balanced, read_table, small_batches, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Sentences with tells, put before documents by id, the same in both engines.
TELLS = (
    "Moreover, the plan is robust.",
    "In summary, we leverage a comprehensive toolkit.",
    "It is slow — it is “fast”…",
    "This works; that does not.",
    "Let's dive in. Here's the thing: it may possibly fail.",
    "Great question! The colour of the centre is grey.",
    "Two  spaces , and stray commas,.",
    "It is not just quick but it is also cheap, and this is not big, it's small.",
    "Nothing to see here.",
    "He said ‘yes’ – once.",
)


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else _lit(v) for v in r) + ")" for r in rows) + f") t({names})"


#: Unicode white space for RE2.
_WS = r"\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_INJECTED = f"(SELECT doc_id, lang, source, concat([{', '.join(map(_lit, TELLS))}][(doc_id % {len(TELLS)}) + 1], ' ', text) AS text FROM documents)"


def _words_sql(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{_WS}]+'))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_batches(spread(read_table(spark, sf_dir, "documents")))


def injected(spark: SparkSession, sf_dir: str, deal: Callable[[DataFrame], DataFrame] = spread) -> DataFrame:
    tells = F.array(*[F.lit(t) for t in TELLS])
    return small_batches(deal(read_table(spark, sf_dir, "documents"))).select("doc_id", "lang", "source", F.concat(F.element_at(tells, (F.col("doc_id") % len(TELLS) + 1).cast("int")), F.lit(" "), "text").alias("text"))


# --- raw documents ----------------------------------------------------------------


@query(f"SELECT doc_id, {_words_sql('text')}::BIGINT AS words, strlen(text)::BIGINT AS bytes, length(text)::BIGINT AS chars FROM documents")
def word_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", native.word_count("text").alias("words"), F.octet_length("text").cast("long").alias("bytes"), F.length("text").cast("long").alias("chars"))


def _sentences_sql(source: str) -> str:
    return f"SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: {_words_sql('s')}), lambda n: n > 0) AS n FROM {source}"



_CV = """CASE WHEN len(n) < 3 THEN -1.0 ELSE sqrt((len(n) * list_sum(list_transform(n, lambda x: x * x)) - list_sum(n) * list_sum(n))::DOUBLE) / list_sum(n) END"""


@query(f"SELECT doc_id, len(n)::BIGINT AS sentences, coalesce(list_max(n), 0)::BIGINT AS longest FROM ({_sentences_sql('documents')})")
def sentence_count(spark, sf_dir):
    n = native.sentence_lengths("text")
    return _docs(spark, sf_dir).select("doc_id", n.alias("n")).select("doc_id", F.size("n").cast("long").alias("sentences"), F.coalesce(F.array_max("n"), F.lit(0)).cast("long").alias("longest"))


@query(f"SELECT doc_id, CASE WHEN cv < 0 THEN -1.0 ELSE floor(cv * 1000 + 0.5) / 1000 END AS cv FROM (SELECT doc_id, {_CV} AS cv FROM ({_sentences_sql('documents')}))")
def cadence_cv(spark, sf_dir):
    cv = _docs(spark, sf_dir).select("doc_id", native.cadence_cv("text").alias("cv"))
    return cv.select("doc_id", F.when(F.col("cv") < 0, F.lit(-1.0)).otherwise(native.rounded(F.col("cv"), 3)).alias("cv"))


@query(
    f"""SELECT doc_id, CASE WHEN cv >= 0 THEN floor(greatest(0.0, least(1.0, (0.5 - cv) / 0.5)) * 20 * 100 + 0.5) / 100 ELSE 0.0 END AS points
    FROM (SELECT doc_id, {_CV} AS cv FROM ({_sentences_sql('documents')}))"""
)
def cadence_points(spark, sf_dir):
    cv = _docs(spark, sf_dir).select("doc_id", native.cadence_cv("text").alias("cv"))
    return cv.select("doc_id", native.rounded(native.cadence_points(F.col("cv")), 2).alias("points"))


_COMMON = ("the", "of", "and", "der", "die", "les", "des", "los")


@query(f"SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda w: w IN ({', '.join(map(_lit, _COMMON))})))::BIGINT AS hits FROM documents")
def listed_word_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", native.hedge_count("text", _COMMON).alias("hits"))


@query("SELECT doc_id, regexp_replace(text, ',+([.!?;:])', '\\1', 'g') AS text FROM documents")
def comma_before_stop_fix(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", native.comma_before_stop("text").alias("text"))


@query(f"SELECT doc_id, regexp_replace(text, ',{{2,}}', ',', 'g') AS text FROM {_INJECTED}")
def comma_run_fix(spark, sf_dir):
    return injected(spark, sf_dir).select("doc_id", native.comma_runs("text").alias("text"))


def _article_sql() -> str:
    low = "lower(trim(w, ''''))"
    caps = "(w = upper(w) AND w <> lower(trim(w, '''')) AND length(w) > 1)"
    vowel = (
        f"CASE WHEN {low} = '' THEN false WHEN {caps} THEN regexp_matches(w, '^[{fixed.VOWEL_NAMED}]') WHEN regexp_matches({low}, '^(?:{'|'.join(fixed.SILENT_H)})') THEN true "
        f"WHEN regexp_matches({low}, '^(?:{'|'.join(fixed.CONSONANT_SOUND)})') THEN false ELSE regexp_matches({low}, '^[aeiou]') END"
    )
    m = r"unnest(regexp_extract_all(text, '\b([Aa]n?)\b([ \t]+)([A-Za-z][A-Za-z.''-]*)'))"
    return f"""WITH m AS (SELECT doc_id, {m} AS m FROM documents), p AS (SELECT doc_id, regexp_extract(m, '^([Aa]n?)', 1) AS a, regexp_extract(m, '[ \\t]+(.*)$', 1) AS w FROM m),
    v AS (SELECT doc_id, count(*) AS n FROM p WHERE ({vowel}) <> (length(a) = 2) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS wrong FROM documents d LEFT JOIN v ON d.doc_id = v.doc_id"""


@query(_article_sql())
def article_candidates(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(native.wrong_articles("text")).cast("long").alias("wrong"))


def _single_anchor(kind: str, pattern: str, name: str) -> None:
    sql = f"SELECT doc_id, array_to_string(regexp_extract_all(text, {_lit(pattern)}), '|') AS found FROM documents"

    def run(spark, sf_dir):
        found = F.transform(native.matches("text", pattern), lambda m: m["match"])
        return _docs(spark, sf_dir).select("doc_id", F.array_join(found, "|").alias("found"))

    run.__name__ = name
    query(sql)(run)


for _kind in ("url", "email", "percent", "number", "acronym"):
    _single_anchor(_kind, fixed.ANCHOR_PATTERNS[_kind], f"{_kind}_anchors")


def _anchor_chain(source: str) -> str:
    steps, prev = [], f"s0 AS (SELECT doc_id, text AS t FROM {source})"
    for i, p in enumerate(fixed.ANCHOR_PATTERNS.values()):
        steps.append(f"s{i + 1} AS (SELECT doc_id, regexp_replace(t, {_lit(p)}, ' ', 'g') AS t FROM s{i})")
    parts = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(t, {_lit(p)})) AS anchor FROM s{i}" for i, (k, p) in enumerate(fixed.ANCHOR_PATTERNS.items()))
    return f"WITH {prev}, {', '.join(steps)}, a AS ({parts})"


@query(_anchor_chain("documents") + " SELECT kind, count(*)::BIGINT AS anchors, count(DISTINCT anchor)::BIGINT AS distinct_anchors, count(DISTINCT doc_id)::BIGINT AS docs FROM a GROUP BY kind")
def anchor_kinds(spark, sf_dir):
    a = _docs(spark, sf_dir).select("doc_id", F.explode(native.anchors("text")).alias("a")).select("doc_id", "a.*")
    return a.groupBy("kind").agg(F.count("*").alias("anchors"), F.countDistinct("anchor").alias("distinct_anchors"), F.countDistinct("doc_id").alias("docs"))


@query(_anchor_chain("documents") + " SELECT anchor, count(*)::BIGINT AS n FROM a GROUP BY anchor ORDER BY n DESC, anchor LIMIT 50")
def anchor_counts_topk(spark, sf_dir):
    a = _docs(spark, sf_dir).select(F.explode(native.anchors("text")).alias("a")).select("a.anchor")
    return a.groupBy("anchor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "anchor").limit(50)


@query(
    _anchor_chain("documents").replace("s0 AS (SELECT doc_id, text AS t FROM documents)", "s0 AS (SELECT doc_id * 2 AS doc_id, text AS t FROM documents UNION ALL SELECT doc_id * 2 + 1, replace(text, '1', '7') FROM documents)")
    + """, c AS (SELECT doc_id // 2 AS doc_id, anchor, sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END) AS n FROM a GROUP BY ALL)
    SELECT doc_id, anchor, greatest(n, 0)::BIGINT AS dropped, greatest(-n, 0)::BIGINT AS added FROM c WHERE n <> 0"""
)
def anchor_except_all(spark, sf_dir):
    d = _docs(spark, sf_dir)
    take = lambda t: d.select("doc_id", F.explode(native.anchors(t)).alias("a")).select("doc_id", "a.anchor")
    out = tables.anchor_difference(take(F.col("text")), take(F.replace("text", F.lit("1"), F.lit("7"))))
    return out.select("doc_id", "anchor", F.col("dropped").cast("long"), F.col("added").cast("long"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\"[^\"\\n]*\"|“[^”\\n]*”'))::BIGINT AS spans FROM documents")
def quote_spans(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(native.matches("text", fixed.QUOTED)).cast("long").alias("spans"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\('))::BIGINT AS opened, len(regexp_extract_all(text, '\\)'))::BIGINT AS closed FROM documents")
def paren_balance(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.regexp_count("text", F.lit(r"\(")).cast("long").alias("opened"), F.regexp_count("text", F.lit(r"\)")).cast("long").alias("closed"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[ \\t]*\\|')))::BIGINT AS table_rows, len(string_split(text, chr(10)))::BIGINT AS lines FROM documents")
def table_rows(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    return _docs(spark, sf_dir).select("doc_id", F.size(F.filter(lines, lambda x: x.rlike(r"^[ \t]*\|"))).cast("long").alias("table_rows"), F.size(lines).cast("long").alias("lines"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) SELECT doc_id, n::BIGINT AS line_no, (1 + coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1)::BIGINT AS start_byte, strlen(line)::BIGINT AS bytes FROM l")
def line_ranges(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    before = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("doc_id", (F.col("n") + 1).cast("long").alias("line_no"), F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)).cast("long").alias("start_byte"), F.octet_length("line").cast("long").alias("bytes"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), f AS (SELECT doc_id, n, lag(contains(line, 'th')) OVER (PARTITION BY doc_id ORDER BY n) AS silenced FROM l) SELECT doc_id, (count(*) FILTER (silenced))::BIGINT AS silenced FROM f GROUP BY doc_id")
def next_line_directives(spark, sf_dir):
    """The next-line directive as a window: lines after one that holds the token."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    hit = F.lag(F.col("line").contains("th")).over(Window.partitionBy("doc_id").orderBy("n"))
    return lines.select("doc_id", hit.alias("hit")).groupBy("doc_id").agg(F.count(F.when(F.col("hit"), 1)).alias("silenced"))


@query("SELECT doc_id, len(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: length(w) > 1 AND w = upper(w)))::BIGINT AS caps, len(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: regexp_matches(w, '^[A-Z][a-z]')))::BIGINT AS titled FROM documents")
def case_classes(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    return _docs(spark, sf_dir).select("doc_id", words.alias("w")).select(
        "doc_id", F.size(F.filter("w", lambda w: (F.length(w) > 1) & (w == F.upper(w)))).cast("long").alias("caps"), F.size(F.filter("w", lambda w: w.rlike("^[A-Z][a-z]"))).cast("long").alias("titled")
    )


@query("SELECT doc_id, (length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')))::BIGINT AS utf16 FROM documents")
def utf16_length(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", native.utf16_length("text").alias("utf16"))


_PARTS = f"""SELECT d.doc_id, d.lang, d.source, {_CV} AS cv, {_words_sql('d.text')} AS words,
  len(list_filter(string_split_regex(lower(d.text), '[^\\p{{L}}]+'), lambda w: w IN ({', '.join(map(_lit, fixed.HEDGES))}))) AS hedges
  FROM documents d JOIN ({_sentences_sql('documents')}) s ON d.doc_id = s.doc_id"""
_PROSE_POINTS = "CASE WHEN cv >= 0 THEN greatest(0.0, least(1.0, (0.5 - cv) / 0.5)) * 20 ELSE 0.0 END + least(10.0, CASE WHEN words > 0 THEN hedges::DOUBLE / words * 100 ELSE 0.0 END * 2.5)"


def _prose_points(d: DataFrame) -> DataFrame:
    parts = d.select("*", native.cadence_cv("text").alias("cv"), native.word_count("text").alias("words"), native.hedge_count("text").alias("hedges"))
    return parts.withColumn("points", native.cadence_points(F.col("cv")) + F.least(F.lit(fixed.HEDGE_CAP), native.per_100(F.col("hedges"), F.col("words")) * fixed.HEDGE_RATE))


@query(f"SELECT doc_id, floor(points + 0.5)::BIGINT AS points FROM (SELECT doc_id, {_PROSE_POINTS} AS points FROM ({_PARTS}))")
def score_parts_no_tells(spark, sf_dir):
    return _prose_points(_docs(spark, sf_dir)).select("doc_id", F.floor(F.col("points") + 0.5).alias("points"))


@query(
    f"""SELECT lang, CASE WHEN points < 5 THEN 'low' WHEN points < 10 THEN 'mid' ELSE 'high' END AS band, count(*)::BIGINT AS docs
    FROM (SELECT lang, {_PROSE_POINTS} AS points FROM ({_PARTS})) GROUP BY ALL"""
)
def score_bands_by_lang(spark, sf_dir):
    band = F.when(F.col("points") < 5, "low").when(F.col("points") < 10, "mid").otherwise("high")
    return _prose_points(_docs(spark, sf_dir)).groupBy("lang", band.alias("band")).agg(F.count("*").alias("docs"))


@query(
    f"""SELECT quality, toxic, count(*)::BIGINT AS docs, floor(avg(points) * 1000 + 0.5) / 1000 AS mean_points
    FROM (SELECT doc_id, {_PROSE_POINTS} AS points FROM ({_PARTS})) s JOIN labels USING (doc_id) GROUP BY ALL"""
)
def label_eval(spark, sf_dir):
    told = _prose_points(_docs(spark, sf_dir)).select("doc_id", "points").join(read_table(spark, sf_dir, "labels"), "doc_id")
    return told.groupBy("quality", "toxic").agg(F.count("*").alias("docs"), native.rounded(F.avg("points"), 3).alias("mean_points"))


@query(f"SELECT source, count(*)::BIGINT AS docs, sum({_words_sql('text')})::BIGINT AS words, max(strlen(text))::BIGINT AS largest FROM documents GROUP BY source")
def source_rollup(spark, sf_dir):
    d = _docs(spark, sf_dir).select("source", native.word_count("text").alias("w"), F.octet_length("text").alias("b"))
    return d.groupBy("source").agg(F.count("*").alias("docs"), F.sum("w").alias("words"), F.max("b").cast("long").alias("largest"))


@query(f"SELECT role, count(*)::BIGINT AS turns, sum({_words_sql('text')})::BIGINT AS words FROM conversations GROUP BY role")
def turns_by_role(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(native.word_count("text")).alias("words"))


# --- injected tells: the exact engine beside SQL --------------------------------------


def _found(spark, sf_dir, prefix: str) -> DataFrame:
    return ops.findings(injected(spark, sf_dir)).where(F.col("rule").startswith(prefix))


@query(" UNION ALL ".join(f"SELECT {_lit('char:' + c)} AS rule, sum(length(text) - length(replace(text, {_lit(c)}, '')))::BIGINT AS n FROM {_INJECTED} HAVING n > 0" for c in sorted(fixed.CHAR_REPLACE)))
def char_findings(spark, sf_dir):
    return _found(spark, sf_dir, "char:").groupBy("rule").agg(F.count("*").alias("n"))


@query(
    f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, {_lit(native.any_word(fixed.BLOCK_WORDS))})) AS w FROM {_INJECTED})
    SELECT concat('word:', lower(w)) AS rule, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs FROM w GROUP BY ALL"""
)
def block_findings(spark, sf_dir):
    return _found(spark, sf_dir, "word:").groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(" UNION ALL ".join(f"SELECT {_lit('structural:' + k)} AS rule, sum(len(regexp_extract_all(text, {_lit(p)})))::BIGINT AS n FROM {_INJECTED} HAVING n > 0" for k, p in fixed.FLAG_PATTERNS.items()))
def structural_findings(spark, sf_dir):
    return _found(spark, sf_dir, "structural:").groupBy("rule").agg(F.count("*").alias("n"))


def _phrase_sql(p: str) -> str:
    return r"(?i)\b" + native.quote(p.rstrip(" "))


@query(" UNION ALL ".join(f"SELECT {_lit('phrase:' + p.strip())} AS rule, sum(len(regexp_extract_all(text, {_lit(_phrase_sql(p))})))::BIGINT AS n FROM {_INJECTED} HAVING n > 0" for p in fixed.PHRASE_DROPS))
def phrase_findings(spark, sf_dir):
    return _found(spark, sf_dir, "phrase:").groupBy("rule").agg(F.count("*").alias("n"))


def _positions_sql(pattern: str) -> str:
    p = _lit(pattern)
    return f"""WITH s AS (SELECT doc_id, text, string_split_regex(text, {p})[1] AS prefix FROM {_INJECTED} WHERE regexp_matches(text, {p}))
    SELECT doc_id, strlen(prefix)::BIGINT AS byte_offset, (1 + length(prefix) - length(replace(prefix, chr(10), '')))::BIGINT AS line,
           (length(string_split(prefix, chr(10))[-1]) + 1)::BIGINT AS col FROM s"""


@query(_positions_sql(native.any_word(fixed.BLOCK_WORDS)))
def line_col_of_findings(spark, sf_dir):
    first = ops.findings(injected(spark, sf_dir), Profile(blockWords=fixed.BLOCK_WORDS)).groupBy("doc_id").agg(F.min(F.struct("offset", "line", "col")).alias("f"))
    return first.select("doc_id", F.col("f.offset").cast("long").alias("byte_offset"), F.col("f.line").cast("long").alias("line"), F.col("f.col").cast("long").alias("col"))


@query(_positions_sql(native.any_word(fixed.BLOCK_WORDS)))
def line_col_native(spark, sf_dir):
    d = injected(spark, sf_dir).select("doc_id", native.before_first("text", fixed.BLOCK_WORDS).alias("prefix")).where("prefix is not null")
    prefix = F.col("prefix")
    return d.select("doc_id", F.octet_length(prefix).cast("long").alias("byte_offset"), native.line_of(prefix).cast("long").alias("line"), native.column_of(prefix).cast("long").alias("col"))


def _nested_replace(x: str) -> str:
    for c in sorted(fixed.CHAR_REPLACE):
        x = f"replace({x}, {_lit(c)}, {_lit(fixed.CHAR_REPLACE[c])})"
    return x


@query(f"SELECT doc_id, {_nested_replace('text')} AS text FROM {_INJECTED}")
def char_swap_fix(spark, sf_dir):
    return injected(spark, sf_dir).select("doc_id", native.swap_chars("text").alias("text"))


@query(f"SELECT doc_id, {_nested_replace('text')} AS text FROM {_INJECTED}")
def char_swap_exact(spark, sf_dir):
    return injected(spark, sf_dir).select("doc_id", columns.clean("text", Profile(charReplace=fixed.CHAR_REPLACE)).alias("text"))


_SWAPS = {"leverage": "use", "comprehensive": "thorough", "robust": "solid"}


def _swap_sql(table: dict[str, str]) -> str:
    x = "text"
    for k, v in sorted(table.items()):
        x = rf"regexp_replace({x}, '\b{k}\b', '{v}', 'g')"
    return f"SELECT doc_id, {x} AS text FROM {_INJECTED}"


@query(_swap_sql(_SWAPS))
def word_swap_fix(spark, sf_dir):
    return injected(spark, sf_dir).select("doc_id", native.swap_words("text", _SWAPS).alias("text"))


@query(_swap_sql(_SWAPS))
def word_swap_exact(spark, sf_dir):
    return injected(spark, sf_dir).select("doc_id", columns.clean("text", Profile(wordReplace=_SWAPS)).alias("text"))


@query(_swap_sql({"colour": "color", "centre": "center", "grey": "gray"}))
def spelling_swap_fix(spark, sf_dir):
    return injected(spark, sf_dir).select("doc_id", columns.clean("text", Profile(dialect="american")).alias("text"))


@query(_swap_sql({"colour": "color", "centre": "center", "grey": "gray"}))
def spelling_swap_native(spark, sf_dir):
    return injected(spark, sf_dir).select("doc_id", native.swap_words("text", spelling_map("american")).alias("text"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(text, '^Moreover, t', 'T'), '^In summary, w', 'W') AS text FROM {_INJECTED}")
def phrase_drop_fix(spark, sf_dir):
    return injected(spark, sf_dir).select("doc_id", columns.clean("text", Profile(phraseReplace={"moreover, ": "", "in summary, ": ""})).alias("text"))


@query(f"SELECT doc_id, regexp_replace(text, '\\b(fast|quick)\\b', '<\\1>', 'g') AS text FROM {_INJECTED}")
def regex_swap_fix(spark, sf_dir):
    return injected(spark, sf_dir).select("doc_id", columns.clean("text", Profile(regexReplace={r"\b(fast|quick)\b": "<$1>"})).alias("text"))


@query(f"SELECT doc_id, regexp_replace(text, '; t', '. T') AS text FROM (SELECT doc_id, CASE WHEN doc_id % {len(TELLS)} = 3 THEN 'This works; that does not.' ELSE 'x' END AS text FROM documents)")
def semicolon_split_fix(spark, sf_dir):
    short = F.when(F.col("doc_id") % len(TELLS) == 3, F.lit(TELLS[3])).otherwise("x")
    return _docs(spark, sf_dir).select("doc_id", short.alias("t")).select("doc_id", columns.clean("t", Profile(splitSemicolons=True)).alias("text"))


@query(f"SELECT doc_id, count(*)::BIGINT AS findings FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_lit(native.any_word(fixed.BLOCK_WORDS))})) FROM {_INJECTED}) GROUP BY doc_id ORDER BY findings DESC, doc_id LIMIT 20")
def findings_top_docs(spark, sf_dir):
    f = ops.findings(injected(spark, sf_dir), Profile(blockWords=fixed.BLOCK_WORDS))
    return f.groupBy("doc_id").agg(F.count("*").alias("findings")).orderBy(F.desc("findings"), "doc_id").limit(20)


@query(
    f"""SELECT doc_id, floor(least(80.0, CASE WHEN words > 0 THEN tells::DOUBLE / words * 100 ELSE 0.0 END * 8) * 100 + 0.5) / 100 AS density
    FROM (SELECT doc_id, len(regexp_extract_all(text, {_lit(native.any_word(fixed.BLOCK_WORDS))})) AS tells, {_words_sql('text')} AS words FROM {_INJECTED})"""
)
def tell_density(spark, sf_dir):
    d = injected(spark, sf_dir).select("doc_id", F.size(columns.check("text", Profile(blockWords=fixed.BLOCK_WORDS))).alias("tells"), native.word_count("text").alias("words"))
    return d.select("doc_id", native.rounded(F.least(F.lit(fixed.DENSITY_CAP), native.per_100(F.col("tells"), F.col("words")) * fixed.DENSITY_RATE), 2).alias("density"))


_BLOCK_SCORE = f"""WITH d AS (SELECT doc_id, text FROM {_INJECTED}), s AS ({_sentences_sql('d')}),
  p AS (SELECT d.doc_id, {_CV} AS cv, {_words_sql('d.text')} AS words, len(regexp_extract_all(d.text, {_lit(native.any_word(fixed.BLOCK_WORDS))})) AS tells,
    len(list_filter(string_split_regex(lower(d.text), '[^\\p{{L}}]+'), lambda w: w IN ({', '.join(map(_lit, fixed.HEDGES))}))) AS hedges FROM d JOIN s USING (doc_id))
  SELECT doc_id, tells::BIGINT AS tells, words::BIGINT AS words,
    floor(least(100.0, least(80.0, CASE WHEN words > 0 THEN tells::DOUBLE / words * 100 ELSE 0.0 END * 8) + {_PROSE_POINTS}) + 0.5)::BIGINT AS value FROM p"""


@query(_BLOCK_SCORE)
def full_score(spark, sf_dir):
    """The exact score of a profile of block words."""
    s = injected(spark, sf_dir).select("doc_id", columns.score("text", Profile(blockWords=fixed.BLOCK_WORDS)).alias("s"))
    return s.select("doc_id", F.col("s.tells").cast("long").alias("tells"), F.col("s.words").cast("long").alias("words"), F.col("s.value").cast("long").alias("value"))


@query(
    f"""WITH f AS (SELECT doc_id, len(regexp_extract_all(text, {_lit(native.any_word(fixed.BLOCK_WORDS))})) AS n FROM {_INJECTED})
    SELECT (CASE WHEN max(n) > 0 THEN 1 ELSE 0 END)::BIGINT AS exit_code, (count(*) FILTER (n > 0))::BIGINT AS documents FROM f"""
)
def check_gate(spark, sf_dir):
    g = ops.gate(injected(spark, sf_dir), Profile(blockWords=fixed.BLOCK_WORDS))
    return g.select(F.col("exit_code").cast("long").alias("exit_code"), "documents")


_OCCURRENCES = """WITH p AS (SELECT doc_id, w, strpos(text, w) AS pos FROM {src}, (VALUES ('leverage'), ('comprehensive'), ('robust'), ('plan'), ('the plan is')) x(w))
, spans AS (SELECT doc_id, pos - 1 AS s, pos - 1 + length(w) AS e FROM p WHERE pos > 0)"""


def _occurrences(spark, sf_dir) -> DataFrame:
    words = F.explode(F.array(*[F.lit(w) for w in ("leverage", "comprehensive", "robust", "plan", "the plan is")]))
    p = injected(spark, sf_dir).select("doc_id", "text", words.alias("w")).withColumn("at", F.expr("instr(text, w)")).where("at > 0")
    return p.select("doc_id", (F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.length("w")).alias("end"))


@query(
    _OCCURRENCES.replace("{src}", _INJECTED)
    + """, r AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans)
    , i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM r)
    SELECT doc_id, min(s)::BIGINT AS span_start, max(e)::BIGINT AS span_end FROM i GROUP BY doc_id, isl"""
)
def interval_merge(spark, sf_dir):
    m = tables.merge_intervals(_occurrences(spark, sf_dir))
    return m.select("doc_id", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"))


@query(
    _OCCURRENCES.replace("{src}", _INJECTED)
    + """, held AS (SELECT doc_id, 0 AS hs, 40 AS he FROM documents WHERE doc_id % 2 = 0)
    SELECT doc_id, s::BIGINT AS span_start, e::BIGINT AS span_end FROM spans WHERE NOT EXISTS (SELECT 1 FROM held WHERE held.doc_id = spans.doc_id AND hs < e AND he > s)"""
)
def interval_antijoin(spark, sf_dir):
    held = _docs(spark, sf_dir).where(F.col("doc_id") % 2 == 0).select("doc_id", F.lit(0).alias("start"), F.lit(40).alias("end"))
    free = tables.outside_intervals(_occurrences(spark, sf_dir), held)
    return free.select("doc_id", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"))


_LETTERED = "SELECT doc_id, (doc_id * 7) % 5 AS pos, CASE WHEN doc_id % 3 = 0 THEN 'Robust' ELSE 'robust' END AS m, CASE WHEN doc_id % 2 = 0 THEN 'x' END AS repl, doc_id % 4 AS ord, doc_id % 50 AS g FROM documents"


@query(f"SELECT g, pos, m, repl, ord FROM (SELECT *, row_number() OVER (PARTITION BY g, pos, lower(m) ORDER BY (repl IS NULL), ord, doc_id) AS n FROM ({_LETTERED})) WHERE n = 1")
def dedupe_findings(spark, sf_dir):
    d = _docs(spark, sf_dir)
    f = d.select(
        (F.col("doc_id") % 50).alias("g"), ((F.col("doc_id") * 7) % 5).alias("offset"), F.when(F.col("doc_id") % 3 == 0, "Robust").otherwise("robust").alias("match"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("x")).alias("replacement"), F.struct((F.col("doc_id") % 4).alias("o"), "doc_id").alias("order"),
    )
    best = tables.dedupe_findings(f, ("g",))
    return best.select("g", F.col("offset").alias("pos"), F.col("match").alias("m"), F.col("replacement").alias("repl"), F.col("order.o").alias("ord"))


# --- protection, voices and reports: known prefixes before documents -----------------------

_CHARS = Profile(charReplace=fixed.CHAR_REPLACE)


def _prefixed(name: str, profile: Profile, prefix: str, expected: str) -> None:
    """The cleaned prefix and the untouched document, under a profile that finds nothing in documents."""

    def run(spark, sf_dir):
        return _docs(spark, sf_dir).select("doc_id", columns.clean(F.concat(F.lit(prefix), "text"), profile).alias("text"))

    run.__name__ = name
    query(f"SELECT doc_id, concat({_lit(expected)}, text) AS text FROM documents")(run)


_prefixed("link_destinations_kept", _CHARS, "see [a — b](http://x.test/a—b) and <http://y.test/—> — ", "see [a ,  b](http://x.test/a—b) and <http://y.test/—> ,  ")
_prefixed("fenced_code_kept", _CHARS, "```\na — b\n```\nc—d\n", "```\na — b\n```\nc, d\n")
_prefixed("inline_code_kept", _CHARS, "run `a — b` or ``c ` — d`` e—f\n", "run `a — b` or ``c ` — d`` e, f\n")
_prefixed("indented_code_kept", _CHARS, "\n    a — b\n\nc—d\n", "\n    a — b\n\nc, d\n")
_prefixed("front_matter_kept", _CHARS, "---\nt: a — b\n---\nc—d\n", "---\nt: a — b\n---\nc, d\n")
_prefixed("silenced_lines_kept", _CHARS, "a—b <!-- prose-ignore -->\n<!-- prose-ignore-next-line -->\nc—d\ne—f\n", "a—b <!-- prose-ignore -->\n<!-- prose-ignore-next-line -->\nc—d\ne, f\n")
_prefixed("reference_definitions_kept", _CHARS, "[a]: http://x.test/— title —\n:rocket-man: { .a—b } c—d\n", "[a]: http://x.test/— title —\n:rocket-man: { .a—b } c, d\n")
_prefixed("quotes_kept", Profile(wordReplace={"leverage": "use"}, protectQuotes=True), 'He said "we leverage it" and “we leverage”, we leverage\n', 'He said "we leverage it" and “we leverage”, we use\n')
_prefixed("allowed_phrases_kept", Profile(wordReplace={"robust": "solid"}, allow=("robust regression",)), "a robust\nregression is robust\n", "a robust\nregression is solid\n")
_prefixed("allowed_words_kept", Profile(wordReplace={"robust": "solid", "myriad": "many"}, allow=("Myriad",)), "myriad robust\n", "myriad solid\n")
_prefixed("names_kept", Profile(wordReplace={"seamless": "smooth"}), "We use Seamless. Seamless helps, SEAMLESS too, seamless\n", "We use Seamless. Smooth helps, SMOOTH too, smooth\n")
_prefixed("swaps_happen_once", Profile(wordReplace={"leverage": "make leverage of", "robust": "seamless", "seamless": "robust"}), "leverage robust seamless\n", "make leverage of seamless robust\n")
_prefixed("voice_over_preset", resolve(load_preset("marketing"), ["corporate"], Voice(keep=("bandwidth",), prefer={"learnings": "notes", "touch base": "meet"})), "bespoke bandwidth learnings touch base\n", "custom bandwidth notes meet\n")
_prefixed("dropped_words", Profile(wordReplace={"seamlessly": ""}), "Seamlessly it runs. It seamlessly runs\n", "It runs. It runs\n")


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_lit('An hour, a user; an FAQ. X, y. It ends.')} ELSE {_lit('Fine as it is.')} END AS text FROM documents")
def tidy_rules(spark, sf_dir):
    messy = F.when(F.col("doc_id") % 2 == 0, F.lit("A hour ,  an user; a FAQ. , x ,, y,. It ends .")).otherwise("Fine as it is.")
    p = Profile(collapseSpaces=True, fixArticles=True)
    return _docs(spark, sf_dir).select("doc_id", messy.alias("t")).select("doc_id", columns.clean("t", p).alias("text"))


@query(
    f"""WITH s AS (SELECT doc_id, string_split_regex(text, {_lit(native.any_word(fixed.BLOCK_WORDS))})[1] AS prefix, regexp_extract(text, {_lit(native.any_word(fixed.BLOCK_WORDS))}) AS w
      FROM {_INJECTED} WHERE regexp_matches(text, {_lit(native.any_word(fixed.BLOCK_WORDS))}))
    SELECT doc_id, concat('doc', doc_id, ':', 1 + length(prefix) - length(replace(prefix, chr(10), '')), ':', length(string_split(prefix, chr(10))[-1]) + 1, ' word:', lower(w), ': "', w, '"') AS line FROM s"""
)
def report_lines(spark, sf_dir):
    d = ops.check(injected(spark, sf_dir), Profile(blockWords=fixed.BLOCK_WORDS))
    return d.where(F.size("findings") > 0).select("doc_id", native.report_line(F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.get("findings", F.lit(0))).alias("line"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, {_lit(native.any_word(fixed.BLOCK_WORDS))}))::BIGINT AS marked, text FROM {_INJECTED}")
def highlight_segments(spark, sf_dir):
    d = ops.check(injected(spark, sf_dir), Profile(blockWords=fixed.BLOCK_WORDS)).select("doc_id", ops.segments(F.col("text"), F.col("findings")).alias("s"))
    return d.select("doc_id", F.size(F.filter("s", lambda x: x["rule"].isNotNull())).cast("long").alias("marked"), F.array_join(F.transform("s", lambda x: x["text"]), "").alias("text"))


@query("SELECT doc_id, concat('12', CASE WHEN doc_id % 2 = 0 THEN '|99' ELSE '' END) AS dropped, CASE WHEN doc_id % 2 = 0 THEN '7' ELSE '' END AS added FROM documents")
def anchor_drift(spark, sf_dir):
    odd = F.col("doc_id") % 2 == 0
    d = _docs(spark, sf_dir).select("doc_id", F.when(odd, "12 of 5 and 99").otherwise("12 of 5").alias("b"), F.when(odd, "5 and 7").otherwise("5").alias("a"))
    return ops.anchor_drift(d, "b", "a").select("doc_id", F.array_join("dropped", "|").alias("dropped"), F.array_join("added", "|").alias("added"))


@query("SELECT note FROM (SELECT source AS note, row_number() OVER (PARTITION BY lower(trim(source)) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def tone_merge(spark, sf_dir):
    first = Window.partitionBy(F.lower(F.trim("source"))).orderBy("doc_id")
    return _docs(spark, sf_dir).withColumn("n", F.row_number().over(first)).where("n = 1").select(F.col("source").alias("note"))


@query(f"SELECT conv_id, turn::BIGINT AS turn, strlen(t)::BIGINT AS bytes, {_words_sql('t')}::BIGINT AS words FROM (SELECT conv_id, turn, text AS t FROM conversations)")
def turn_sizes(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", F.col("turn").cast("long").alias("turn"), F.octet_length("text").cast("long").alias("bytes"), native.word_count("text").alias("words"))


# --- streams and states as batches -----------------------------------------------------


@query(
    """WITH e AS (SELECT user_id, ts, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_id FROM events),
    b AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM e)
    SELECT user_id, count(*)::BIGINT AS events, epoch_us(min(ts))::BIGINT AS start_us, arg_max(event_id, event_id)::BIGINT AS latest FROM b GROUP BY user_id, burst"""
)
def debounce(spark, sf_dir):
    from tellgrid.streaming.documents import settled

    b = settled(read_table(spark, sf_dir, "events"), key="user_id", quiet="10 minutes", latest=F.max("event_id"))
    return b.select("user_id", "events", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.col("latest").cast("long").alias("latest"))


@query("SELECT conv_id, max(turn)::BIGINT AS version, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def latest_document(spark, sf_dir):
    """The keyed state of a document stream, as an aggregate: the newest version wins."""
    c = read_table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.max("turn").cast("long").alias("version"), F.max_by("text", "turn").alias("text"))


@query("SELECT date_trunc('hour', ts) AS hour_start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").alias("hour_start"), "event_type", "n")


# --- profiles, presets, catalogs ------------------------------------------------------


def _preset_rows():
    out = []
    for name in preset_names():
        pack = load_preset(name)
        out += [(name, "phrase", k, v) for k, v in sorted(pack.phraseReplace.items())] + [(name, "word", k, v) for k, v in sorted(pack.wordReplace.items())] + [(name, "block", w, None) for w in pack.blockWords]
    return out


@query(f"SELECT preset, kind, count(*)::BIGINT AS entries, (count(*) FILTER (value = ''))::BIGINT AS drops FROM {_values(_preset_rows(), 'preset, kind, key, value')} GROUP BY ALL")
def preset_entry_counts(spark, sf_dir):
    return tables.preset_entries(spark).groupBy("preset", "kind").agg(F.count("*").alias("entries"), F.count(F.when(F.col("value") == "", 1)).alias("drops"))


@query(f"SELECT kind, key, value FROM (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY preset DESC) AS n FROM {_values(_preset_rows(), 'preset, kind, key, value')}) WHERE n = 1")
def preset_overlay(spark, sf_dir):
    rank = F.dense_rank().over(Window.orderBy("preset"))
    return tables.overlay_entries(tables.preset_entries(spark).withColumn("priority", rank)).select("kind", "key", "value")


@query(f"SELECT oneway, count(*)::BIGINT AS pairs, count(DISTINCT american)::BIGINT AS targets FROM {_values([(p.british, p.american, 'yes' if p.oneway else 'no') for p in spelling_pairs()], 'british, american, oneway')} GROUP BY ALL")
def dialect_pairs_stats(spark, sf_dir):
    d = tables.dialect_pairs(spark).withColumn("oneway", F.when(F.col("oneway"), "yes").otherwise("no"))
    return d.groupBy("oneway").agg(F.count("*").alias("pairs"), F.countDistinct("american").alias("targets"))


@query(f"SELECT section, count(*)::BIGINT AS entries FROM {_values(tables.catalog_rows(), 'section, ordinal, key, target, fate')} GROUP BY section")
def catalog_counts(spark, sf_dir):
    return tables.catalog(spark).groupBy("section").agg(F.count("*").alias("entries"))


@query(f"SELECT section, ordinal::BIGINT AS ordinal, key, target, fate FROM {_values(tables.catalog_rows(), 'section, ordinal, key, target, fate')}")
def catalog(spark, sf_dir):
    return tables.catalog(spark).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("SELECT doc_id, list_filter(list_transform(string_split(concat(source, ', ,', lang, ',x '), ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents")
def comma_lists(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", native.split_list(F.concat("source", F.lit(", ,"), "lang", F.lit(",x "))).alias("parts"))


@query("SELECT doc_id, replace(replace(rtrim(to_base64(encode(concat('{\"s\":\"', source, '\",\"i\":', doc_id, '}'))), '='), '+', '-'), '/', '_') AS code, concat('{\"s\":\"', source, '\",\"i\":', doc_id, '}') AS back FROM documents")
def share_links(spark, sf_dir):
    state = F.concat(F.lit('{"s":"'), "source", F.lit('","i":'), F.col("doc_id").cast("string"), F.lit("}"))
    return _docs(spark, sf_dir).select("doc_id", native.share_encode(state).alias("code")).withColumn("back", native.share_decode("code"))


@query("SELECT doc_id, concat('{\"faithful\": ', CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END, '}') AS object, doc_id % 2 = 0 AS faithful FROM documents")
def verdict_carving(spark, sf_dir):
    reply = F.concat(F.lit("Here:\n```json\n{\"faithful\": "), F.when(F.col("doc_id") % 2 == 0, "true").otherwise("false"), F.lit("}\n```"))
    d = _docs(spark, sf_dir).select("doc_id", native.json_object(reply).alias("object"))
    return d.withColumn("faithful", F.from_json("object", model.VERDICT)["faithful"])


@query(f"SELECT doc_id, CASE WHEN regexp_matches(t, '^[{_WS}]*$') THEN 'text is required' WHEN strlen(t) > 20000 THEN 'text is too large' END AS error FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE text END AS t FROM documents)")
def request_errors(spark, sf_dir):
    t = F.when(F.col("doc_id") % 9 == 0, "  ").otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", ops.request_error(t, 20000).alias("error"))


# --- golden cases ---------------------------------------------------------------------


def _golden(spark, rows, names: str) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"case_no long, {names}")


def _per_profile(cases: DataFrame, apply) -> DataFrame:
    parts = [apply(cases.where(F.col("profile") == k), p) for k, p in golden.PROFILES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT case_no::BIGINT AS case_no, expected AS output FROM " + _values([(i, e) for i, (_, _, e) in enumerate(golden.FIX)], "case_no, expected"))
def golden_fix(spark, sf_dir):
    return _per_profile(_golden(spark, golden.FIX, "profile string, input string, expected string"), lambda d, p: d.select("case_no", columns.clean("input", p).alias("output")))


@query("SELECT case_no::BIGINT AS case_no, expected AS output FROM " + _values([(i, e) for i, (_, _, e) in enumerate(golden.CHECK)], "case_no, expected"))
def golden_check(spark, sf_dir):
    line = lambda f: F.concat_ws(":", f["rule"], f["line"], f["col"])
    return _per_profile(
        _golden(spark, golden.CHECK, "profile string, input string, expected string"), lambda d, p: d.select("case_no", F.array_join(F.transform(columns.check("input", p), line), "|").alias("output"))
    )


@query("SELECT case_no::BIGINT AS case_no, expected AS output FROM " + _values([(i, e) for i, (_, e) in enumerate(golden.CODE)], "case_no, expected"))
def golden_code_ranges(spark, sf_dir):
    d = _golden(spark, golden.CODE, "input string, expected string")
    return d.select("case_no", F.array_join(F.transform(columns.code_ranges("input"), lambda r: F.concat_ws("-", r["start"], r["end"])), "|").alias("output"))


@query("SELECT case_no::BIGINT AS case_no, expected AS output FROM " + _values([(i, e) for i, (_, e) in enumerate(golden.ANCHORS)], "case_no, expected"))
def golden_anchors(spark, sf_dir):
    return _golden(spark, golden.ANCHORS, "input string, expected string").select("case_no", F.array_join(columns.anchors("input"), "|").alias("output"))


# --- exact operators without an SQL form ------------------------------------------------


@query()
def check_documents(spark, sf_dir):
    return ops.findings(injected(spark, sf_dir)).drop("order")


@query()
def findings_by_rule(spark, sf_dir):
    return ops.findings(injected(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("findings"), F.countDistinct("doc_id").alias("docs"))


@query()
def fix_documents(spark, sf_dir):
    return injected(spark, sf_dir).select("doc_id", columns.clean("text").alias("cleaned"))


@query()
def score_documents(spark, sf_dir):
    return injected(spark, sf_dir, balanced).select("doc_id", columns.score("text").alias("s")).select("doc_id", "s.*")


@query()
def fix_before_after_delta(spark, sf_dir):
    d = injected(spark, sf_dir).select("doc_id", columns.scores("text").alias("s"))
    return d.select("doc_id", F.col("s.before.value").alias("before"), F.col("s.after.value").alias("after"))


@query()
def chop_batch(spark, sf_dir):
    return ops.chop(injected(spark, sf_dir).select("doc_id", "text")).select("doc_id", "output", "score.value", F.col("score_after.value").alias("value_after"), "error")


@query()
def token_diff(spark, sf_dir):
    d = injected(spark, sf_dir).select("doc_id", "text", columns.clean("text").alias("cleaned"))
    ops_ = columns.diff("text", "cleaned")
    return d.select("doc_id", ops_.alias("ops")).select("doc_id", F.size(F.filter("ops", lambda o: o["op"] == 1)).alias("added"), F.size(F.filter("ops", lambda o: o["op"] == -1)).alias("removed"))


@query()
def tells_by_label(spark, sf_dir):
    d = injected(spark, sf_dir).join(read_table(spark, sf_dir, "labels"), "doc_id")
    return tables.evaluate_tells(d.withColumn("label", F.col("quality").cast("string")))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by rule over injected documents under the default profile."""
    return ops.findings(injected(spark, sf_dir), default_profile()).groupBy("rule").agg(F.count("*").alias("findings"), F.countDistinct("doc_id").alias("docs"))
