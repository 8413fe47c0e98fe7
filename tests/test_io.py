import numpy as np
import pytest
from pyspark.sql import functions as F

from stylomill.functions.models import encoder, hashing_encoder, token_stats
from stylomill.operators import adversarial as A, lines as L
from stylomill.sources.json_tables import attributions_from_npz, done_ids_at, read_json, read_lines, read_pair_files
from stylomill.sources.sinks import append_json_array, markdown, write_attributions, write_csv, write_json_array, write_jsonl, write_text
from stylomill.streaming.streams import deduplicated, process_new, run_to_table, windowed_counts

SCHEMA = "id BIGINT, author STRING, text STRING"


def ids(df):
    return sorted(r["id"] for r in df.collect() if r["id"] is not None)


def test_json_forms(spark, tmp_path):
    forms = {
        "lines": '{"id": 1, "author": "a"}\n\n{"id": 2, "text": "é"}\n',
        "array": '[{"id": 1}, {"id": 2}]',
        "pretty": '[\n  {\n    "id": 1\n  },\n  {\n    "id": 2\n  }\n]\n',
        "bom": '﻿{"id": 1}\n{"id": 2}\n',
    }
    for name, body in forms.items():
        (tmp_path / name).write_text(body, encoding="utf-8")
        assert ids(read_json(spark, str(tmp_path / name), SCHEMA)) == [1, 2], name
    (tmp_path / "empty").write_text("")
    assert read_json(spark, str(tmp_path / "empty"), SCHEMA).count() == 0
    (tmp_path / "bad").write_text('{"id": 1}\n{"id": 2\n')
    assert ids(read_json(spark, str(tmp_path / "bad"), SCHEMA)) == [1]
    assert [r["_bad_line"] for r in read_json(spark, str(tmp_path / "bad"), SCHEMA, "report").where("_bad_line IS NOT NULL").collect()] == ['{"id": 2']
    with pytest.raises(Exception):
        read_json(spark, str(tmp_path / "bad"), SCHEMA, "raise").collect()


def test_files(spark, tmp_path):
    for n in ("silver_AA_train.jsonl", "gold_TT_test.jsonl", "other.jsonl"):
        (tmp_path / n).write_text('{"id0": 1}\n')
    got = read_pair_files(spark, str(tmp_path), "id0 BIGINT")
    assert sorted((r["dataset"], r["mode"], r["split"]) for r in got.collect()) == [("gold", "TT", "test"), ("silver", "AA", "train")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("JH: “Hi” there\r\nXX: no\nJH: bye\n")
    lines = read_lines(spark, str(tmp_path / "t"))
    assert [r["line_no"] for r in lines.orderBy("line_no").collect()] == [1, 2, 3]
    assert L.speaker_text(lines, "JH:").first()["text"] == "Hi there bye"
    v = tmp_path / "v"
    v.mkdir()
    (v / "s.vtt").write_text("WEBVTT\n00:00 --> 00:01\n\n[Music]\nhello\nhello\nhello<00:00:01.000><c> world</c>\n")
    kept = L.without_repeats(L.speech_lines(read_lines(spark, str(v)))).orderBy("line_no").collect()
    assert [r["value"] for r in kept] == ["hello", "hello world"]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "id BIGINT, t STRING")
    write_jsonl(d, str(tmp_path / "j"))
    write_jsonl(d, str(tmp_path / "j"), mode="append")
    assert ids(read_json(spark, str(tmp_path / "j"), "id BIGINT, t STRING")) == [1, 1, 2, 2]
    write_csv(d, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).where("id = 1").first()["t"] == 'a "b", c'
    write_text(d, str(tmp_path / "t"), "id", "t")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()) == ['1\ta "b", c', "2\t"]
    assert write_json_array(d, str(tmp_path / "a.json")) == 2
    with pytest.raises(ValueError):
        write_json_array(d, str(tmp_path / "a.json"), most=1)
    assert markdown(d, "id").first()["report"].count("\n") == 3
    np.savez(tmp_path / "s.npz", values=np.ones((1, 3, 2)), tokens=np.array([["a", "b", ""]]), lengths=np.array([2]))
    assert attributions_from_npz(spark, str(tmp_path / "s.npz"), "m").count() == 2


def test_mixed_forms_and_missing_paths(spark, tmp_path):
    (tmp_path / "a b.json").write_text('\n [{"id": 1, "error": null},\n {"id": 2, "error": "x"}]')
    (tmp_path / "c.jsonl").write_text('\ufeff{"id": 3}\n{"id": 2, "error": "x"}\nnot json\n')
    (tmp_path / "d.jsonl").write_text("")
    paths = [str(tmp_path / f) for f in ("c.jsonl", "a b.json", "d.jsonl")]
    for order in (paths, paths[::-1]):
        assert sorted(r["id"] for r in read_json(spark, order, "id BIGINT, error STRING").collect()) == [1, 2, 2, 3]
        assert read_json(spark, order, "id BIGINT, error STRING", "report").where("_bad_line IS NOT NULL").count() == 1
    assert read_json(spark, paths[2], "id BIGINT").count() == 0
    done = done_ids_at(spark, [*paths, str(tmp_path / "absent.jsonl"), str(tmp_path / "no*thing")])
    assert sorted((r["id"], r["error"]) for r in done.collect()) == [(1, None), (2, "x"), (3, None)]
    assert done_ids_at(spark, [str(tmp_path / "absent.jsonl")]).count() == 0
    records = spark.createDataFrame([(i,) for i in range(1, 5)], "id BIGINT")
    assert ids(A.pending(records, done)) == [2, 4]


def test_append_to_array(spark, tmp_path):
    path = str(tmp_path / "x.json")
    one = spark.createDataFrame([(1, "é")], "id BIGINT, t STRING")
    assert append_json_array(one, path) == 1 and append_json_array(one, path) == 2
    assert [r["t"] for r in read_json(spark, path, "id BIGINT, t STRING").collect()] == ["é", "é"]
    with pytest.raises(ValueError):
        append_json_array(one, path, most=2)
    assert read_json(spark, path, "id BIGINT").count() == 2


def test_attributions_round_trip(spark, tmp_path):
    rows = [("m", s, p, f"t{s}{p}", 0.5 * s, -1.0 * p) for s in range(3) for p in range(s + 1)]
    d = spark.createDataFrame(rows, "model STRING, sample INT, pos INT, token STRING, s0 DOUBLE, s1 DOUBLE")
    assert write_attributions(d, str(tmp_path / "a.npz")) == 3
    assert sorted(map(tuple, attributions_from_npz(spark, str(tmp_path / "a.npz"), "m").collect())) == sorted(rows)
    data, values = np.empty(2, object), np.empty(2, object)
    data[:] = [["a", "b"], ["c"]]
    values[:] = [np.ones((2, 2)), np.zeros((1, 2))]
    np.savez(tmp_path / "o.npz", values=values, data=data)
    with pytest.raises(ValueError):
        attributions_from_npz(spark, str(tmp_path / "o.npz"), "m")
    got = attributions_from_npz(spark, str(tmp_path / "o.npz"), "m", trusted=True).collect()
    assert sorted((r["sample"], r["token"], r["s1"]) for r in got) == [(0, "a", 1.0), (0, "b", 1.0), (1, "c", 0.0)]


def test_streams(spark, tmp_path):
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    batch = lambda lo, hi: spark.range(lo, hi).selectExpr("id", "CAST(id AS STRING) AS author", "'x' AS text").write.mode("append").parquet(src)
    work = lambda df: df.where("id % 2 = 0")
    batch(0, 10)
    process_new(spark, src, SCHEMA, out, ck, work).awaitTermination()
    batch(10, 14)
    process_new(spark, src, SCHEMA, out, ck, work).awaitTermination()
    assert ids(spark.read.parquet(out)) == [0, 2, 4, 6, 8, 10, 12]
    ev = str(tmp_path / "ev")
    rows = [(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:50:00", "a", 2.0), (3, "2024-01-01 02:00:00", "b", 4.0)]
    spark.createDataFrame(rows, "event_id BIGINT, ts STRING, event_type STRING, value DOUBLE").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", "event_type", "value").write.parquet(ev)
    stream = spark.readStream.schema(spark.read.parquet(ev).schema).parquet(ev)
    got = run_to_table(windowed_counts(deduplicated(stream), late=None), "w", str(tmp_path / "ck2"))
    assert [(r["event_type"], r["n"]) for r in got.collect()] == [("a", 2)]
    assert windowed_counts(deduplicated(spark.read.parquet(ev))).count() == 2


def test_models(spark):
    d = spark.createDataFrame([("a b, c",), (None,), ("",)], "text STRING")
    r = token_stats(d).first()
    assert (r["n_texts"], r["max_tokens"], r["min_tokens"]) == (3, 4, 0)
    v = d.select(encoder(hashing_encoder(16))("text").alias("v")).collect()
    assert all(len(x["v"]) == 16 for x in v)
    s = spark.createDataFrame([("abcd", "abcx"), (None, "a")], "a STRING, b STRING").select(L.similarity("a", "b").alias("s")).collect()
    assert [x["s"] for x in s] == [0.75, None]


def test_rewrite_and_resume(spark):
    def make():
        def generate(prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("no")
            return [p.upper() for p in prompts]

        return generate

    p = spark.createDataFrame([(1, "x"), (2, "bad"), (3, "y")], "id BIGINT, prompt STRING")
    done = A.rewrite(p, make)
    assert sorted((r["id"], r["rewritten"], r["error"]) for r in done.collect()) == [(1, "X", None), (2, None, "RuntimeError: no"), (3, "Y", None)]
    assert ids(A.pending(p, done)) == [2] and ids(A.pending(p, done, retry_errors=False)) == []
    a, b = L.split_pair(F.col("prompt"), "a")
    assert [tuple(r) for r in p.select(a, b).orderBy("id").collect()] == [("x", ""), ("b", "d"), ("y", "")]


def test_adversarial(spark, frame):
    rows = [(i, "abc"[i % 3], "Article" if i < 30 else "Tweet", "w " * (40 + 30 * (i % 9))) for i in range(60)] + [(99, "lone", "Article", "x")]
    mods = spark.createDataFrame([(i, "m " * 90, "b") for i in range(0, 30)] + [(99, "m", "b"), (500, "m", "b")], "id BIGINT, mod_text STRING, impersonator STRING")
    for mode in ("AA", "AT"):
        got = A.adversarial_pairs(mods, frame(rows), mode, negatives=2, most_uses=4).collect()
        pos, neg = [r for r in got if r["label"] == 1], [r for r in got if r["label"] == 0]
        assert len(pos) == 30 and all(r["author0"] == r["author1"] and r["id0"] != r["id1"] for r in pos)
        assert all(r["author0"] != r["author1"] for r in neg)
        uses = [r["id1"] for r in neg]
        assert max(map(uses.count, uses)) <= 4 and len({(r["id0"], r["id1"]) for r in neg}) == len(neg)
        assert len(neg) == 60
    assert A.adversarial_pairs(mods.limit(0), frame(rows)).count() == 0
    imp = spark.createDataFrame([("a",), ("b",)], "author STRING")
    asg = A.assign_impersonators(frame(rows).where("id < 30"), imp).collect()
    assert len(asg) == 30 and all(r["author"] != r["impersonator"] for r in asg)
    few = frame([(1, "a", "article", "x"), (2, "a", "Article", "y"), (3, "b", "Article", "z")])
    bun = A.support_bundles(few, imp, few.where("id = 3"), size=3, bundles=2).collect()
    assert len(bun) == 6 and {r["impersonator"] for r in bun} == {"a"}
