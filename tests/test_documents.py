import bz2
import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.sources import documents as D
from tessera.sources import files


def book(**more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", "<container><rootfiles><rootfile full-path='OPS/p.opf'/></rootfiles></container>")
        z.writestr("OPS/p.opf", "<package><manifest><item id='b' href='two.xhtml'/><item id='a' href='t/one%20a.xhtml'/><item id='colophon' href='c.xhtml'/><item id='x' href='gone.xhtml'/></manifest><spine><itemref idref='a'/><itemref idref='x'/><itemref idref='b'/><itemref idref='colophon'/></spine></package>")
        z.writestr("OPS/t/one a.xhtml", "<html><head><title>t</title><style>x</style></head><body><h1>One</h1><p>The é oath.</p></body></html>")
        z.writestr("OPS/two.xhtml", "<html><body><p>Two &amp; more</p></body></html>")
        z.writestr("OPS/c.xhtml", "<p>printed by</p>")
        for k, v in more.items():
            z.writestr(k, v)
    return out.getvalue()


TEI = b"<TEI xmlns='http://www.tei-c.org/ns/1.0'><teiHeader><title>no</title></teiHeader><text><body><head>Head</head><p>The <hi>oath</hi> of<note>no</note> all.</p><fw>12</fw><lg><l>one</l><l>two</l></lg></body><back>no</back></text></TEI>"


def test_texts_of_formats(spark):
    stream = zlib.compress(b"BT (The \\(oath\\)) Tj T* [(of ) -20 (all\\056)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj <<>> stream\n" + stream + b"\nendstream endobj"
    rows = [(1, book(), "epub"), (2, TEI, "application/tei+xml"), (3, pdf, "application/pdf"), (4, "\ufeffé\r\nb".encode(), "text/plain"), (5, b"\xe9t\xe9", "txt"), (6, None, "txt"), (7, b"<!DOCTYPE x><x/>", "xml"), (8, b"x", "what"), (9, b"<p>a</p><script>b</script>", "html")]
    df = spark.createDataFrame(rows, "id long, content binary, kind string")
    got = {r["id"]: (r["e"]["text"], r["e"]["error"]) for r in df.select("id", D.extract_text("content", "kind").alias("e")).collect()}
    assert got[1][0].endswith("The é oath.\n\nTwo & more") and "printed" not in got[1][0]
    assert got[2][0] == "Head\n\nThe oath of all.\n\none\ntwo"
    assert got[3][0] == "The (oath)\nof all." and got[4][0] == "é\nb" and got[5][0] == "été" and got[6] == (None, None) and got[9][0] == "a"
    assert got[7][0] is None and got[7][1].startswith("UnsafeFile") and got[8][1].startswith("ValueError")


def test_unsafe_archives():
    with pytest.raises(D.UnsafeFile):
        D.epub(book(**{"../x": "y"}))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"0" * 3_000_000)
    with pytest.raises(D.UnsafeFile):
        D.safe_zip(packed.getvalue())
    assert D.format_rank("txt") < D.format_rank("pdf") < D.format_rank("djvu")


def test_envelopes(spark):
    oai = b"<OAI-PMH xmlns='http://www.openarchives.org/OAI/2.0/'><ListRecords><record><header><identifier>oai:x:1</identifier></header><metadata><dc xmlns='d'><title>A  b</title><creator>C</creator><identifier>https://x/1</identifier><subject>s</subject><rights>CC0</rights></dc></metadata></record><record><header status='deleted'><identifier>oai:x:2</identifier></header></record><resumptionToken completeListSize='7'> tok </resumptionToken></ListRecords></OAI-PMH>"
    sru = b"<searchRetrieveResponse><numberOfRecords>12</numberOfRecords><records><record><recordData><dc><title>T</title><identifier>ark:/1/2</identifier></dc></recordData></record></records><nextRecordPosition>11</nextRecordPosition></searchRetrieveResponse>"
    atom = b"<feed xmlns='a'><link rel='next' href='/2'/><entry><id>e1</id><title>T</title><author><name>N</name></author><category term='c'/><link rel='http://opds-spec.org/acquisition/open-access' href='/b.epub'/><link rel='self' href='/s'/></entry></feed>"
    df = spark.createDataFrame([(1, oai), (2, sru), (3, atom), (4, None)], "id long, c binary")
    got = {r["id"]: r["p"] for r in df.select("id", D.catalogue_pages("c").alias("p")).collect()}
    assert got[1]["next"] == "tok" and got[1]["total"] == 7 and len(got[1]["records"]) == 1
    r = got[1]["records"][0]
    assert (r["id"], r["title"], r["creators"], r["links"], r["rights"]) == ("oai:x:1", "A b", ["C"], ["https://x/1"], "CC0")
    assert got[2]["next"] == "11" and got[2]["total"] == 12 and got[2]["records"][0]["id"] == "ark:/1/2"
    r = got[3]["records"][0]
    assert got[3]["next"] == "/2" and (r["id"], r["creators"], r["subjects"], r["links"]) == ("e1", ["N"], ["c"], ["/b.epub"])
    assert got[4] is None or got[4]["records"] is None


def test_pages_of_scans():
    x = b"<alto><Layout><TextBlock><TextLine><String CONTENT='The'/><String CONTENT='coun' SUBS_TYPE='HypPart1' SUBS_CONTENT='council'/></TextLine><TextLine><String CONTENT='cil' SUBS_TYPE='HypPart2' SUBS_CONTENT='council'/><String CONTENT='sat'/></TextLine></TextBlock><TextBlock><TextLine><String CONTENT='End'/></TextLine></TextBlock></Layout></alto>"
    assert D.alto(x) == "The council\nsat\n\nEnd"


def test_templates_of_any_depth(spark):
    deep = "a " + "{{x|" * 40 + "y" + "}}" * 40 + " b }} c {{open"
    got = spark.createDataFrame([(deep,), (None,)], "w string").select(files.clean_wikitext(F.col("w")).alias("t")).collect()
    assert got[0]["t"] == "a  b }} c {{open" and got[1]["t"] is None


def test_streams_to_their_ends():
    data = bz2.compress(b"a" * 100) + bz2.compress(b"b")
    assert files.decompressed(data) == b"a" * 100 + b"b"
    with pytest.raises((ValueError, OSError)):
        files.decompressed(data[:-5])


def test_lines_of_json_and_sidecars(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "id long, text string")
    files.write_jsonl(df, str(tmp_path / "out"), "id", since=1)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"id":2}', '{"id":3,"text":"c"}']
    got = {r["name"]: r["content"] for r in files.with_sidecar(df, "id", "text").collect()}
    assert len(got) == 6 and got["3.txt"] == "c" and got["2.txt"] == "" and '"chars":1' in got["3.json"] and '"id":3' in got["3.json"]
