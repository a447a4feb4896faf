"""The source of segments and the sink of masked files: plans, filters, commits and what failed tasks leave."""

import os
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from test_functions import BOOK, archive, row, zipped
from veilspark.operators import segments
from veilspark.sources import datasource
from veilspark.sources.files import read_segments
from veilspark.sources.sinks import write_masked


def many_sheets(n, rows):
    book = {"[Content_Types].xml": "<Types/>", "xl/workbook.xml": '<workbook xmlns:r="urn:r"><sheets>' + "".join(f'<sheet name="S{i}" r:id="a{i}"/>' for i in range(n)) + "</sheets></workbook>"}
    book["xl/_rels/workbook.xml.rels"] = "<R>" + "".join(f'<R Id="a{i}" Target="worksheets/s{i}.xml"/>' for i in range(n)) + "</R>"
    cell = lambda i, r: f'<row><c r="A{r}" t="inlineStr"><is><t>user{i}.{r}@mail.example</t></is></c></row>'
    for i in range(n):
        book[f"xl/worksheets/s{i}.xml"] = "<worksheet><sheetData>" + "".join(cell(i, r) for r in range(1, rows + 1)) + "</sheetData></worksheet>"
    book["docProps/core.xml"] = '<cp:p xmlns:cp="urn:cp" xmlns:dc="urn:dc"><dc:creator>g@h.co</dc:creator></cp:p>'
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in book.items():
            z.writestr(name, text)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    body = lambda p: f"<{p}:d><{p}:t>k@l.co and 010-1234-5678</{p}:t><{p}:tbl>{row(p, '성명', '비고')}{row(p, '김민수', 'x')}</{p}:tbl></{p}:d>"
    made = {
        "a/one.txt": "call 010-1234-5678".encode(), "a/two.csv": "성명,전화\n김민수,\"02-1,2\"\n".encode(), "b/one.txt": b"x@y.example", "b/c.docx": archive(word__document_xml=body("w")),
        "b/d.xlsx": zipped(BOOK), "b/e.hwpx": archive(Contents__section0_xml=body("hp")), "big.xlsx": many_sheets(6, 400), "_hidden.txt": b"no", ".dot/also.txt": b"no", "b/empty.csv": b"",
    }
    for name, data in made.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    return tmp_path


def binary(spark, root):
    files = [(f"{d}/{f}", open(f"{d}/{f}", "rb").read()) for d, _, names in os.walk(root) for f in names if not f.startswith("_") and "/." not in d]
    return spark.createDataFrame(files, "path string, content binary")


def test_source_reads_what_read_segments_reads(spark, folder):
    columns = ("path", "seg_id", "text", "is_header", "forced_category", "name_hint_only")
    want = sorted(read_segments(binary(spark, f"{folder}/in")).select(*columns).collect(), key=str)
    for size in ("100000000", "2000"):
        got = datasource.load_segments(spark, f"{folder}/in", targetBytes=size)
        assert sorted(got.select(*columns).collect(), key=str) == want
    assert sorted(datasource.load_segments(spark, f"file://{folder}/in").select("seg_id", "text").collect()) == sorted((r["seg_id"], r["text"]) for r in want)


def test_a_large_workbook_is_read_by_several_tasks(spark, folder):
    datasource.register(spark)
    nodes = spark.read.format("segment_nodes").option("targetBytes", "2000").load(f"{folder}/in/big.xlsx")
    by_task = nodes.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(by_task) >= 6 and max(r["count"] for r in by_task) <= 401 and sum(r["count"] for r in by_task) == 6 * 400 + 1
    assert nodes.select("seq").distinct().count() == 6 * 400 + 1


def test_options_reach_the_listing(spark, folder):
    (folder / "in/bad.docx").write_bytes(b"no archive")  # opening it would fail
    datasource.register(spark)
    load = lambda **o: spark.read.format("segment_nodes").options(**o).load(f"{folder}/in")
    assert {r["ext"] for r in load(extensions=".txt").collect()} == {".txt"}
    assert {r["ext"] for r in load(extensions=".CSV, .txt").where("text <> ''").collect()} == {".txt", ".csv"}
    assert {r["text"] for r in load(matching="b/one[.]txt$").collect()} == {"x@y.example"}
    with pytest.raises(Exception, match="not a zip"):
        load().collect()
    (folder / "in/x.pdf").write_bytes(b"")
    with pytest.raises(Exception, match="no reader"):
        load().count()
    assert load(unknown="skip", extensions=".pdf").count() == 0
    assert {r["ext"] for r in datasource.load_segments(spark, f"{folder}/in", (".csv",)).collect()} == {".csv"}


def written(root):
    return sorted(os.path.relpath(f"{d}/{f}", root) for d, _, names in os.walk(root) for f in names if not f.endswith(".crc"))


def test_sink_round_trip_and_modes(spark, folder):
    files = binary(spark, f"{folder}/in").repartition(3)
    segs = segments.mask_segments(segments.detect_segments(datasource.load_segments(spark, f"{folder}/in")))
    datasource.save_masked(files, segs, f"{folder}/out", below=f"{folder}/in")
    names = ["_SUCCESS", "a/one_masked.txt", "a/two_masked.csv", "b/c_masked.docx", "b/d_masked.xlsx", "b/e_masked.hwpx", "b/empty_masked.csv", "b/one_masked.txt", "big_masked.xlsx"]
    assert written(f"{folder}/out") == names and (folder / "out/a/one_masked.txt").read_text() == "call 010-XXXX-XXXX"
    back = {(r["path"].replace("_masked", "").replace("/out/", "/in/"), r["seg_id"]): r["text"] for r in datasource.load_segments(spark, f"{folder}/out").collect()}
    assert back == {(r["path"], r["seg_id"]): r["masked"] for r in segs.collect()}
    with pytest.raises(Exception, match="are there"):
        datasource.save_masked(files, segs, f"{folder}/out", below=f"{folder}/in")
    datasource.save_masked(files, segs, f"{folder}/out", mode="overwrite", below=f"{folder}/in")
    assert written(f"{folder}/out") == names
    with pytest.raises(Exception, match="two files for one_masked.txt"):
        datasource.save_masked(files, segs, f"{folder}/flat")
    assert [x for x in written(f"{folder}/flat") if not x.startswith("_staging")] == []


def test_failed_tasks_leave_nothing(spark, folder):
    def some_fail(batches):
        for batch in batches:
            yield batch
            if any(x.endswith("7") for x in batch["path"]):
                raise RuntimeError("lost")

    rows = spark.range(40).select(F.col("id").cast("string").alias("path"), F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("name"), F.encode(F.lit("x"), "UTF-8").alias("content")).repartition(8)
    datasource.register(spark)
    with pytest.raises(Exception, match="lost"):
        rows.mapInPandas(some_fail, rows.schema).write.format("masked_files").mode("append").save(f"{folder}/failed")
    seen = lambda: [x for x in written(f"{folder}/failed") if not x.startswith("_staging")]  # noqa: E731  a task may outlive the abort
    assert seen() == []
    rows.write.format("masked_files").mode("append").save(f"{folder}/failed")
    assert len(seen()) == 41


def test_paths_stay_below_the_target():
    place = datasource.FileWriter({"path": "/out", "below": "/in"}, False)._place
    assert place("/in/a/b.txt", "b_masked.txt") == "a/b_masked.txt"
    for path in ("/other/x.txt", "/in/../../x.txt"):
        with pytest.raises(ValueError):
            place(path, "x_masked.txt")
    assert datasource.supported("a.DOCX") and not datasource.supported("a.pdf") and not write_masked.__doc__ == ""
