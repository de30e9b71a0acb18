import json
import os

from pyspark.sql import functions as F

from tellgrid.sources.readers import stream_events
from tellgrid.streaming import documents as stream


def _write(folder, n, events):
    path = folder / f"{n}.json"
    path.write_text("\n".join(json.dumps(e) for e in events))
    os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))  # files are read in the order of their times


def _event(uri, kind, version, *changes):
    return {"uri": uri, "kind": kind, "version": version, "ts": f"2024-01-01T00:00:0{version}Z", "changes": list(changes)}


def test_latest_text_wins_and_close_forgets(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    _write(source, 1, [_event("a", "open", 1, "robust"), _event("b", "open", 1, "fine")])
    _write(source, 2, [_event("a", "change", 3, "old — text", "plain"), _event("a", "change", 2, "x — y")])
    _write(source, 3, [_event("b", "close", 2), _event("a", "change", 2, "stale — text")])
    out: list = []

    def keep(df, batch):
        out.append({r.uri: r for r in df.collect()})

    q = stream.publish(stream_events(spark, str(source))).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {k: v for batch in out for k, v in batch.items()}
    assert [len(b) for b in out if b] == [2, 1, 1]
    assert out[0]["a"].diagnostics[0].code == "word:robust" and out[0]["a"].diagnostics[0].end_char == 6
    assert got["a"].diagnostics == [] and got["a"].version == 3
    assert got["b"].open is False and got["b"].diagnostics == []


def test_messages_and_edits():
    from tellgrid.functions.kernel import Engine

    e = Engine()
    d = stream.diagnostics(e, "é — robust 😀, x")
    assert [(x["start_char"], x["end_char"], x["code"]) for x in d] == [(2, 3, "char:—"), (4, 10, "word:robust")]
    assert d[0]["message"] == '"—" -> ", "' and d[1]["message"] == '"robust": word:robust'
    assert stream.whole_edit(e, "fine") is None
    assert stream.whole_edit(e, "a — b\n") == {"end_line": 1, "end_char": 0, "text": "a, b\n"}


def test_dead_letters_and_debounce(spark):
    frames = spark.createDataFrame([('{"uri":"a","kind":"open"}',), ("{",), ('{"uri":"a","kind":"hover"}',)], "body string")
    assert sorted(r.reason for r in stream.dead_letters(frames).collect()) == ["malformed", "unknown method"]
    rows = [("a", 1, "2024-01-01 00:00:00.000", ["x"]), ("a", 2, "2024-01-01 00:00:00.200", ["y"]), ("a", 3, "2024-01-01 00:00:02.000", ["z"])]
    e = spark.createDataFrame(rows, "uri string, version long, ts string, changes array<string>").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.events, r.latest[0]) for r in stream.settled(e).collect()) == [(1, "z"), (2, "y")]
