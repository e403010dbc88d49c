import bz2
import datetime

import pytest
from pyspark.sql import functions as F

from tessera.sources import files
from tessera.streaming import events


def test_text_files_and_types(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "Bible_x.txt").write_text("one\ntwo")
    (tmp_path / "n.md").write_text("three")
    (tmp_path / "skip.pdf").write_text("no")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["t"]) for r in files.text_files(spark, str(tmp_path)).withColumn("t", files.source_type(F.col("path"))).collect()}
    assert got == {"Bible_x.txt": ("one\ntwo", "bible"), "n.md": ("three", "book")}


def test_json_csv_xml(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('[{"id": "1", "text": "x"}]')
    (tmp_path / "j" / "b.json").write_text('{"entries": [{"id": "2", "text": "y"}, {"id": "3"}]}')
    (tmp_path / "j" / "c.json").write_text("not json")
    assert sorted(r["id"] for r in files.json_records(spark, str(tmp_path / "j"), "id string, text string").collect()) == ["1", "2", "3"]
    (tmp_path / "c.csv").write_text('id,Authors,Subjects\n1,"A; B","x;;y"\n2,,\n')
    got = {r["id"]: (r["Authors"], r["Subjects"]) for r in files.csv_catalogue(spark, str(tmp_path / "c.csv")).collect()}
    assert got == {"1": (["A", "B"], ["x", "y"]), "2": ([], [])}
    (tmp_path / "r.xml").write_text("<l><rec><t>one</t></rec><rec><t>two</t></rec></l>")
    assert sorted(r["t"] for r in files.xml_records(spark, str(tmp_path / "r.xml"), "rec", "t string").collect()) == ["one", "two"]
    (tmp_path / "bad.xml").write_text('<!DOCTYPE a [<!ENTITY x SYSTEM "file:///etc/passwd">]><a><rec><t>&x;</t></rec></a>')
    with pytest.raises(ValueError):
        files.xml_records(spark, str(tmp_path / "bad.xml"), "rec", "t string")


def test_dump(spark, tmp_path):
    streams = [bz2.compress(f"<page>{i}</page>".encode()) for i in range(3)]
    (tmp_path / "d.bz2").write_bytes(b"".join(streams))
    starts = [0, len(streams[0]), len(streams[0]) + len(streams[1])]
    lines = [f"{s}:{i}:Title: {i}" for i, s in enumerate(starts)] + [f"{starts[0]}:9:Other", "rubbish"]
    index = files.dump_index(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {r["title"] for r in index.collect()} == {"Title: 0", "Title: 1", "Title: 2", "Other"}
    assert files.byte_ranges(index).count() == 2
    ranges = files.byte_ranges(index, sum(map(len, streams)))
    got = {r["start"]: r["text"] for r in files.read_streams(spark, str(tmp_path / "d.bz2"), ranges).collect()}
    assert got == {s: f"<page>{i}</page>" for i, s in enumerate(starts)}


def test_pages_and_wiki(spark):
    df = spark.createDataFrame([("<html><head><title>t</title><script>x()</script></head><body><nav>menu</nav><h1>A &amp; B</h1><p>one<br>two</p></body></html>",), (None,)], "h string")
    assert [r[0] for r in df.select(files.html_text("h")).collect()] == ["t\nA & B\n\none\ntwo", None]
    w = spark.createDataFrame([("{{a|{{b}}}}'''Bold''' [[x|link]] [[y]]<ref>n</ref> [http://u text]",)], "w string")
    assert w.select(files.clean_wikitext(F.col("w"))).collect()[0][0] == "Bold link y text"


def test_mime_and_robots(spark):
    df = spark.createDataFrame([(bytearray(b"%PDF-1.4"),), (bytearray(b"MZ..."),), (bytearray(b"<html><body>"),), (bytearray(b"plain"),)], "c binary")
    assert [r[0] for r in df.select(files.mime(F.col("c"))).collect()] == ["application/pdf", "forbidden", "text/html", "text/plain"]
    t = "User-agent: a\nContent-Signal: search=no\n\nUser-agent: *\nContent-Signal: search=yes, ai-train=no, x=maybe\nContent-Signal: search=no # last"
    got = {r["name"]: r["allowed"] for r in files.content_signal(spark.createDataFrame([("h", t)], "host string, t string"), "host", "t").collect()}
    assert got == {"search": False, "ai-train": False, "x": None}


def test_sharded_store_writes_each_digest_once(spark, tmp_path):
    df = spark.createDataFrame([("abcd1", "x"), ("abcd1", "x"), ("beef2", "y")], "sha string, v string")
    path = str(tmp_path / "store")
    files.write_sharded(df, path, "sha")
    files.write_sharded(df, path, "sha")
    assert spark.read.parquet(path).count() == 2


def test_streams(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, base + datetime.timedelta(minutes=i), i % 3, "view" if i % 2 else "click", 1.0, "{}") for i in range(40)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows[:25] + rows[:3], events.EVENTS).coalesce(1).write.parquet(src)
    out, chk = str(tmp_path / "out"), str(tmp_path / "chk")
    stream = lambda: events.tail(events.event_stream(spark, src), since=1, kinds=["view", "click"])
    events.run_once(stream(), chk, events.append_readings(out))
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == list(range(2, 25))
    spark.createDataFrame(rows[20:], events.EVENTS).coalesce(1).write.mode("append").parquet(src)
    events.run_once(stream(), chk, events.append_readings(out))
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == list(range(2, 40))
    got = []
    events.run_once(events.tumbling(events.event_stream(spark, src), "10 minutes", "0 minutes"), str(tmp_path / "chk2"), lambda df, _: got.extend(df.collect()))
    assert sum(r["n"] for r in got) > 0
    assert events.sessions(spark.createDataFrame(rows, events.EVENTS).withColumn("ts", F.col("ts").cast("timestamp")), "5 minutes").agg(F.sum("n")).collect()[0][0] == 40
