"""Nothing that is masked stays in any part of an archive, wherever people leave it."""

import zipfile
from io import BytesIO

from pyspark.sql import functions as F

from veilspark.operators import control, segments
from veilspark.plans.recipes import ANNOTATED, annotated_file
from veilspark.sources import extras
from veilspark.sources.files import read_segments
from veilspark.sources.sinks import write_masked
from veilspark.stored import stored


def test_all_places_of_an_archive(spark):
    line = "call 010-1234-5678 & <k@l.co>"
    files = spark.createDataFrame([(f"in/f{ext}", annotated_file(ext, 7, [("n", line, "m")])) for ext in ANNOTATED], "path string, content binary")
    segs = stored(segments.mask_segments(segments.detect_segments(read_segments(files))))
    got = {(r["path"], r["seg_id"]): r["text"] for r in segs.collect()}
    want = {(f"in/f{ext}", seg): text.replace("A", "a7@b.example") if text != "L" else line for ext, (_, places) in ANNOTATED.items() for seg, text in places.items()}
    assert got == want
    done = write_masked(files, segs)
    for r in done.collect():
        if r["path"].endswith(".txt"):
            assert bytes(r["content"]).decode() == "call 010-XXXX-XXXX & <k**@l.co>"
            continue
        with zipfile.ZipFile(BytesIO(bytes(r["content"]))) as z:
            for name in z.namelist():
                part = z.read(name).decode()
                assert not [x for x in ("a7@b", "1234-5678", "k@l.co") if x in part], (r["path"], name)
    back = {(r["path"], r["seg_id"]): r["text"] for r in read_segments(done.select("path", "content")).collect()}
    assert back == {(r["path"], r["seg_id"]): r["masked"] for r in segs.collect()}


def test_repeated_texts_in_other_parts_follow(spark):
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w:d><w:t>a@b.co</w:t></w:d>")
        z.writestr("word/charts/chart1.xml", '<c:c><c:v>a@b.co</c:v><c:v>kept</c:v><c:s name="a@b.co" val="1"/></c:c>')
        z.writestr("word/media/image1.png", b"\x89PNG a@b.co")
    files = spark.createDataFrame([("x.docx", out.getvalue())], "path string, content binary")
    segs = segments.mask_segments(segments.detect_segments(read_segments(files)))
    with zipfile.ZipFile(BytesIO(bytes(write_masked(files, segs).first()["content"]))) as z:
        assert z.read("word/charts/chart1.xml").decode() == '<c:c><c:v>a**@b.co</c:v><c:v>kept</c:v><c:s name="a**@b.co" val="1"/></c:c>'
        assert z.read("word/media/image1.png").startswith(b"\x89PNG")


def test_places_keep_their_xml():
    xml = '<R><Relationship Id="a" Target="mailto:x@y.co?subject=1&amp;2" TargetMode="External"/><Relationship Id="b" Target="part.xml"/></R>'
    seg = "word/_rels/document.xml.rels@link#0"
    assert extras.read(".docx", "word/_rels/document.xml.rels", xml, lambda t: t.replace("&amp;", "&")) == [(seg, "mailto:x@y.co?subject=1&2")]
    new = extras.replaced(".docx", "word/_rels/document.xml.rels", xml, {seg: 'a"<&'}, lambda t: t.replace("&", "&amp;").replace("<", "&lt;"))
    assert 'Target="a&quot;&lt;&amp;"' in new and 'Target="part.xml"' in new


def test_domains_as_users_type_them(spark):
    typed = [" https://a.co/x/y ", "　a.co\t", "HTTPS://a.co/x", "http://b.co", "   ", "/only", "a.co/\nb", "https://https://c.co", None]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(typed)], "user int, at int, text string")
    assert [r[0] for r in df.select(control.clean_domain(F.col("text"))).collect()] == ["a.co", "a.co", "HTTPS:", "b.co", "", "", "a.co\nb", "https:", None]
    assert {(r["domain"], r["first"]) for r in control.domain_list(df, ["user"], "at").collect()} == {("a.co", 0), ("HTTPS:", 2), ("b.co", 3), ("a.co\nb", 6), ("https:", 7)}
