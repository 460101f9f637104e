import json
from datetime import datetime

from caselattice.operators import multimodal as V
from caselattice.sinks import files as K
from caselattice.sources import files as S
from caselattice.streaming import rules as Z


def test_call_and_transfer_layouts(spark, rows, tmp_path):
    (tmp_path / "cdr.csv").write_text('caller,callee,timestamp,duration_seconds,tower_location\n9,8,2025-01-01T10:00:00,30,"A, B"\n9,8,never,x,C\n')
    good, bad = S.calls(spark, str(tmp_path / "cdr.csv"))
    assert rows(good, "caller", "ts", "duration_s", "place", "src_file") == [("9", datetime(2025, 1, 1, 10), 30, "A, B", "cdr.csv")]
    assert rows(bad, "given", "duration_s") == [("never", 0)]
    (tmp_path / "t.csv").write_text("timestamp,sender_account,receiver_account,amount_inr,transaction_id,flagged\n2025-01-01 10:00:00,A,B,oops,T1,1\n")
    moved, _ = S.transfers(spark, str(tmp_path / "t.csv"), of_case=True)
    assert rows(moved, "src", "dst", "amount", "flagged") == [("A", "B", 0.0, True)]
    docs = S.rows_as_documents(good, "CDR", "ts", "%s called %s", "caller", "callee")
    assert docs.first()["clean_text"] == "9 called 8"


def test_texts_entities_segments(spark, rows, tmp_path):
    (tmp_path / "FIR_1.txt").write_text("कुछ text")
    (tmp_path / "skip.csv").write_text("x")
    assert rows(S.texts(spark, str(tmp_path)), "name", "text") == [("FIR_1", "कुछ text")]
    (tmp_path / "r.json").write_text(json.dumps([{"source": "a", "target": "b", "relationship": "CALLED", "timestamp": "2025-01-01T00:00:00", "confidence": 0.5}, {"source": "", "target": "b"}]))
    good, bad = S.relations(spark, str(tmp_path / "r.json"))
    assert good.count() == 1 and bad.first()["errors"] == "source,relationship,confidence"
    (tmp_path / "s.jsonl").write_text('{"video_id": "v", "segment_id": "s", "start_ts": 0, "end_ts": 1}\nbroken\n')
    fine, broken = S.segments(spark, str(tmp_path / "s.jsonl"))
    assert fine.count() == 1 and broken.count() == 1
    assert S.optional(spark, S.entities, str(tmp_path / "none.json"), "entity_id string").count() == 0


def test_graph_round_trip_and_missing(spark, rows, tmp_path):
    nodes = spark.createDataFrame([("a", "PERSON")], "entity_id string, type string")
    edges = spark.createDataFrame([("a", "b", "R")], "src string, dst string, relationship string")
    K.write_graph(nodes, edges, str(tmp_path / "g"))
    back = S.graph(spark, str(tmp_path / "g"))
    assert rows(back[0]) == [("a", "PERSON")] and rows(back[1], "src", "dst", "relationship") == [("a", "b", "R")]
    try:
        S.graph(spark, str(tmp_path / "nothing"))
    except ValueError:
        return
    raise AssertionError


def test_upserts_and_appends(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, n int, s string")
    K.upsert(first, path, "k")
    K.upsert(spark.createDataFrame([("a", 9, "new"), ("c", 3, None)], "k string, n int, s string"), path, "k", "fill")
    assert rows(spark.read.parquet(path), "k", "n", "s") == [("a", 1, "new"), ("b", 2, "x"), ("c", 3, None)]
    K.upsert(spark.createDataFrame([("a", 7, "z")], "k string, n int, s string"), path, "k")
    assert ("a", 7, "z") in rows(spark.read.parquet(path), "k", "n", "s")
    K.append_new(spark.createDataFrame([("a", 0, ""), ("d", 4, "d")], "k string, n int, s string"), path, "k")
    assert [r[0] for r in rows(spark.read.parquet(path), "k")] == ["a", "b", "c", "d"]


def test_manifest_and_signature(spark, rows, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.txt").write_text("one")
    (tmp_path / "m" / "b.txt").write_text("two")
    listed = spark.createDataFrame(K.manifest(spark, str(tmp_path / "m")).collect())
    (tmp_path / "m" / "b.txt").write_text("changed")
    (tmp_path / "m" / "c.txt").write_text("extra")
    assert rows(K.verify_manifest(spark, str(tmp_path / "m"), listed)) == [("a.txt", "same"), ("b.txt", "changed"), ("c.txt", "extra")]
    signed = K.pack(str(tmp_path / "m"), str(tmp_path / "m.tgz"), b"key")
    assert signed["signature"] == K.sign(signed["files"], b"key") != K.sign(signed["files"], b"other")


SEGMENTS = [
    ("v", "s1", 0.0, 5.0, [("car", 0.9, ["red"])], ["QX 12 AB 1234"]), ("v", "s2", 5.0, 10.0, [("person", 0.8, None)], None), ("v", "s3", 10.0, 15.0, [("truck", 0.7, None)], []), ("v", "s4", 15.0, 20.0, None, None),
]


def test_video_query(spark):
    q = V.parse_query("When did the red car with plate QX12AB1234 leave?")
    assert q.objects == (("vehicle", ("red",)),) and q.actions == ("depart",) and q.plates == ("QX12AB1234",)
    df = spark.createDataFrame(SEGMENTS, "video_id string, segment_id string, start_ts double, end_ts double, objects array<struct<label:string,confidence:double,attributes:array<string>>>, ocr array<string>")
    df = df.selectExpr("*", "named_struct('embedding_id', cast(null as string)) AS visual", "named_struct('embedding_id', cast(null as string)) AS audio")
    got = {r["segment_id"]: r for r in V.search(df, q, 9).collect()}
    assert got["s1"]["score"] >= 0.85 and got["s1"]["objects_score"] == 1.0
    assert got["s3"]["event"] == 1.0  # the last vehicle seen is the one that leaves
    assert got["s1"]["event"] == 0.35 and "s4" not in got  # an earlier sighting counts by its place, a segment without one not at all


def test_modalities(spark):
    visual = spark.createDataFrame([("v", "s1", 0.0, 10.0)], "video_id string, segment_id string, start_ts double, end_ts double")
    audio = spark.createDataFrame([("v", 0.0, 9.0, "good"), ("v", 8.0, 30.0, "bad")], "video_id string, start_ts double, end_ts double, transcript string")
    frames = spark.createDataFrame([("v", 1.0, ["car"], ["a"]), ("v", 9.0, ["car", "man"], []), ("v", 11.0, ["x"], [])], "video_id string, ts double, labels array<string>, texts array<string>")
    r = V.join_modalities(visual, audio, frames).first()
    assert (r["transcript"], r["labels"], r["ocr"]) == ("good", ["car", "man"], ["a"])


def test_modalities_may_fail(spark):
    visual = spark.createDataFrame([("v", "s1", 0.0, 10.0)], "video_id string, segment_id string, start_ts double, end_ts double")
    found, failed = V.ingest(spark, {"visual": lambda: visual, "audio": lambda: spark.read.parquet("/no/such/table"), "frames": lambda: 1 / 0})
    assert found.count() == 1 and set(failed) == {"audio", "frames"}
    frames = spark.createDataFrame([("v", 1.0, ["car", "car"], ["a", " AB ", "AB"], True), ("v", 2.0, None, ["CD"], False)], "video_id string, ts double, labels array<string>, texts array<string>, sharp boolean")
    assert [(r["labels"], r["texts"]) for r in V.frame_records(frames).orderBy("ts").collect()] == [(["car"], ["AB"]), ([], [])]


def stream(spark, path, rows, schema):
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_streams(spark, rows, tmp_path):
    calls = [("p", datetime(2025, 1, 1, 10, m)) for m in range(5)] + [("q", datetime(2025, 1, 1, 10, 0))]
    query = Z.spikes(stream(spark, str(tmp_path / "c"), calls, "phone string, ts timestamp")).writeStream.format("memory").queryName("spikes").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {r["phone"] for r in spark.sql("SELECT phone FROM spikes").collect()} == {"p"}
    sessions = Z.sessions(stream(spark, str(tmp_path / "e"), [("u", datetime(2025, 1, 1, h)) for h in (1, 1, 5)], "user string, ts timestamp"), "user")
    query = sessions.writeStream.format("memory").queryName("sessions").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["n_events"] for r in spark.sql("SELECT n_events FROM sessions").collect()) == [1, 2]
    table = str(tmp_path / "table")
    query = Z.merge_into(stream(spark, str(tmp_path / "m"), [("a", 1), ("a", 2), ("b", 1)], "k string, n int"), table, "k", str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert rows(spark.read.parquet(table), "k", "n") == [("a", 2), ("b", 1)]


def test_stateful_turns(spark, tmp_path):
    path = str(tmp_path / "turns")
    at = lambda s: datetime.fromtimestamp(1_735_700_000 + s)
    source = [("k", at(s), 1_735_700_000.0 + s, 1_735_700_002.0 + s) for s in (0, 3, 20)]
    turns = Z.merged_turns(stream(spark, path, source, "k string, ts timestamp, start double, end double"), "k", 10.0)
    query = turns.writeStream.format("memory").queryName("turns").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["first"], r["last"], r["n_rows"]) for r in spark.sql("SELECT * FROM turns").collect()] == [(1_735_700_000.0, 1_735_700_005.0, 2)]


def test_case_folder_flags_and_restore(spark, rows, tmp_path):
    (tmp_path / "firs").mkdir()
    (tmp_path / "firs" / "a.txt").write_text("x" * (1 << 21))  # texts have no size limit of their own
    (tmp_path / "cdrs").mkdir()
    (tmp_path / "cdrs" / "c.csv").write_text("caller,callee,timestamp,duration_seconds,tower_location\n1,2,2024-01-01T10:00:00,5,T\n")
    docs = S.case_folder(spark, str(tmp_path))
    assert rows(docs, "doc_type") == [("CDR",), ("FIR",)] and docs.filter("length(clean_text) > 2000000").count() == 1
    (tmp_path / "flags.json").write_text('[{"entity_id": "e", "flags": ["F"], "priority_score": 0.2, "evidence": ["x"]}, {"entity_id": "e", "flags": ["G"], "priority_score": 0.9, "evidence": []}]')
    assert rows(S.pattern_flags(spark, str(tmp_path / "flags.json")), "entity_id", "priority_score") == [("e", 0.9)]
    assert S.raw_rows(spark, str(tmp_path / "cdrs")).dtypes[3] == ("duration_seconds", "string")
    table = tmp_path / "t"
    spark.range(2).selectExpr("cast(id as string) k", "1 v").write.parquet(f"{table}__old")  # as a crash between the renames leaves it
    K.upsert(spark.createDataFrame([("0", 5)], "k string, v int"), str(table), "k")
    assert rows(spark.read.parquet(str(table)), "k", "v") == [("0", 5), ("1", 1)]
