import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_ops import DOCS, brute_components, brute_fingerprint


def _docs(spark):
    rows = []
    for i in range(60):
        lang = ("the of and to in is that for with was", "der die und das ist nicht ein eine mit von")[i % 2].split()
        rows.append((i, " ".join(lang[(i * 7 + k * (i % 5 + 1)) % 10] + str(chr(97 + (i * k) % 26)) for k in range(40 + i)), ("en", "de")[i % 2], f"s{i % 4}", 0))
    rows += [(100, rows[3][1], "de", "s0", 0), (101, rows[3][1].replace(" ", "  "), "de", "s1", 0), (102, "12345 !!", "en", "s2", 0), (103, None, None, None, 0), (104, rows[5][1], "de", "s0", 0), (104, rows[5][1], "de", "s0", 0)]
    return spark.createDataFrame(rows, DOCS)


def test_stages_against_brute_force(spark, sf_dir):
    import public_tokenizers as P
    import tiktoken

    import corpus_pipeline as c
    from tellgrid.llm.bpe import load_ranks
    from tellgrid.llm.common import cut

    docs = _docs(spark).withColumn("norm", F.lit(1))
    names = docs.columns
    seen = [docs]
    for _, stage in c.STAGES:
        seen.append(cut(stage(spark, seen[-1], sf_dir)))
    assert all(d.columns == names for d in seen[:-1])
    said = [[r for r in d.collect()] for d in seen]
    # language: what has no letter goes, everything else stays
    assert {r.doc_id for r in said[0]} - {r.doc_id for r in said[1]} == {102, 103}
    # exact: the first of equal texts
    groups = {}
    for r in said[1]:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), []).append(r.doc_id)
    assert Counter(r.doc_id for r in said[2]) == Counter(min(g) for g in groups.values())
    # near copies: the document that names its component
    ids, fps = [r.doc_id for r in said[2]], [brute_fingerprint(r.text) for r in said[2]]
    keep = {i for i, comp in zip(ids, brute_components(ids, fps), strict=True) if i == comp}
    assert Counter(r.doc_id for r in said[3]) == Counter(keep)
    # mixing: copies of kept documents, near each source's target
    assert {r.doc_id for r in said[4]} <= keep and max(Counter(r.doc_id for r in said[4]).values()) <= 3
    # tokens of every taken document
    ranks = load_ranks(P.path("byte_bpe_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r.doc_id, np.array(lib.encode_ordinary(r.text), "<u4").tobytes(), hashlib.sha256(r.text.encode()).hexdigest()) for r in said[4])
    assert Counter((r.doc_id, bytes(r.ids), r.decoded_sha256) for r in said[5]) == want


def test_run_and_registration(spark, sf_dir):
    import __spark_entry__
    import corpus_pipeline as c

    q = __spark_entry__.queries()
    assert q["pipeline"] is c.run and "pipeline" not in __spark_entry__.oracle_sql()
    assert {re.match(r"op\d+", n)[0] for n in q if re.match(r"op\d+_", n)} == {f"op{i}" for i in range(1, 11)}
    assert c.run(spark, sf_dir).count() > 0


def test_stages_on_an_empty_table(spark, sf_dir):
    import corpus_pipeline as c

    docs = _docs(spark).limit(0)
    for _, stage in c.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_near_copies_as_brute_force_jaccard(spark, sf_dir):
    import random

    import corpus_pipeline as c

    r = random.Random(7)
    texts = []
    for _ in range(40):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.choice((3, 5, 12, 80, 300)))]
        texts.append(words)
        for edits in range(6):  # copies on both sides of the limit
            copy = list(words)
            for _ in range(edits if len(words) > 20 else edits // 4):
                copy[r.randrange(len(copy))] = f"x{r.randint(0, 400)}"
            texts.append([w.upper() if edits == 5 else w for w in copy])
    footer = [f"f{i}" for i in range(60)]
    texts += [[f"y{r.randint(0, 400)}" for _ in range(15)] + footer for _ in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, " "), (901, None)]
    own = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for data in (rows, own):
        sets = []
        for _, t in data:
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
        up = list(range(len(data)))
        far = 0  # linked pairs that fingerprints within three bits do not link
        for i in range(len(data)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                    far += bin(brute_fingerprint(data[i][1]) ^ brute_fingerprint(data[j][1])).count("1") > 3
                    a, b = up[i], up[j]
                    up = [min(a, b) if x in (a, b) else x for x in up]
        want = Counter(data[i][0] for i in range(len(data)) if data[i][0] == min(data[j][0] for j in range(len(data)) if up[j] == up[i]))
        docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], DOCS)
        assert Counter(x.doc_id for x in c.near(spark, docs, sf_dir).collect()) == want
        assert data is own or far > 20
