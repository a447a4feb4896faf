import itertools
import math
import zipfile
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.functions import checksums, detect, fixed, headers, masking, model, spans
from veilspark.functions.text import nfc, xml_decode, xml_encode
from veilspark.operators import control, decoding, evaluation, review, segments, settings
from veilspark.stored import spread, stored
from veilspark.sources.files import image_segments, read_segments
from veilspark.sources.sinks import write_masked
from veilspark.streaming.masking import mask_stream


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"__i int, {schema}").select("__i", *(c.alias(f"c{j}") for j, c in enumerate(columns))).orderBy("__i").drop("__i").collect()]


def found(spark, texts, column):
    return [[(s["text"], s["category"]) for s in r[0]] for r in values(spark, [(t,) for t in texts], "t string", column)]


def test_checksums(spark):
    rows = [("9001011234568",), ("9001011234567",), ("9013011234568",), ("",), (None,)]
    assert [r[0] for r in values(spark, rows, "d string", checksums.valid_rrn(F.col("d")))] == [True, False, False, False, False]
    assert [r[0] for r in values(spark, [("1208612347",), ("1208612346",), ("12086",)], "d string", checksums.valid_business(F.col("d")))] == [True, False, False]
    assert [r[0] for r in values(spark, [("4111111111111111",), ("4111111111111112",), ("0000000000000000",), ("79927398713",)], "d string", checksums.valid_luhn(F.col("d")))] == [True, False, False, False]


def test_detectors_find_and_leave(spark):
    text = F.col("t")
    cases = {
        "연락처010-1234-5678": ("010-1234-5678", "mobile"), "tel 02-123-4567.": ("02-123-4567", "landline"), "a.b+c@mail.example.com,": ("a.b+c@mail.example.com", "email"),
        "카드 4111-1111-1111-1111": ("4111-1111-1111-1111", "card"), "여권 M12345678": ("M12345678", "passport"), "면허 11-25-123456-78": ("11-25-123456-78", "driver_license"),
        "법인 130111-0006246": ("130111-0006246", "corporate_registration"), "key sk-abcdefghijklmnop1234": ("sk-abcdefghijklmnop1234", "credential"),
        "1990년 1월 1일": ("1990년 1월 1일", "date"), "우편번호 06024": ("06024", "postal_code"), "하나 100-200300-40500": ("하나 100-200300-40500", "account"),
        "서울특별시 강남구 테헤란로 12, ": ("서울특별시 강남구 테헤란로 12", "address"), "담당 김민수 부장": ("김민수", "person_name"), "_KimDoeFoo.pdf": ("KimDoeFoo", "person_name"),
        "주민 900101-1234568": ("900101-1234568", "rrn"), "mysql://u:p@db.example/x": ("mysql://u:p@db.example", "credential"),
    }
    got = found(spark, list(cases), detect.detect(text))
    assert {t: g for t, g in zip(cases, got, strict=True) if cases[t] not in g} == {}
    silent = ["이메일 주소", "version 2024.05.10", "build 12345", "2023-02-30", "900101-1234567", "4111-1111-1111-111", "서울 본부", "token = abcdef", "", "박사 과정"]
    assert found(spark, silent, detect.detect(text)) == [[] for _ in silent]
    assert values(spark, [(None,)], "t string", F.size(detect.detect(text))) == [(0,)]


def test_positions_count_code_points(spark):
    s = values(spark, [("😀 010-1234-5678 a@b.co",)], "t string", detect.detect(F.col("t")))[0][0]
    assert [(x["start"], x["end"]) for x in s] == [(2, 15), (16, 22)]


def test_contextual_names(spark):
    assert found(spark, ["a_박영_b", "a_서울_b", "a_김아무개_b"], detect.contextual_names(F.col("t"))) == [[("박영", "person_name")], [], [("김아무개", "person_name")]]


def test_dedupe_is_greedy_and_disjoint(spark):
    rng = np.random.default_rng(1)
    cats = [c[0] for c in fixed.CATEGORIES]
    rank = {c[0]: c[4] for c in fixed.CATEGORIES}
    rows, want = [], []
    for _ in range(40):
        own = [(int(a), int(a + n), "x", cats[k], float(c), "regex") for a, n, k, c in zip(rng.integers(0, 30, 8), rng.integers(1, 9, 8), rng.integers(0, 18, 8), rng.choice([0.5, 0.7], 8), strict=True)]
        kept = []
        for s in sorted(own, key=lambda s: (s[0] - s[1], -s[4], -rank[s[3]])):
            if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
                kept.append(s)
        rows.append((own,))
        want.append(sorted(kept))
    got = values(spark, rows, f"s {spans.SPANS}", spans.dedupe(F.col("s")))
    assert [[tuple(x) for x in r[0]] for r in got] == want


def test_merge_keeps_patterns_and_unlike_model_spans(spark):
    r = [(0, 4, "a", "mobile", 0.9, "regex"), (1, 4, "b", "card", 0.9, "regex")]
    m = [(0, 5, "c", "person_name", 0.5, "model"), (10, 14, "d", "person_name", 0.4, "model"), (10, 15, "e", "address", 0.8, "model"), (3, 12, "f", "date", 0.3, "model")]
    got = values(spark, [(r, m), (r, None)], f"r {spans.SPANS}, m {spans.SPANS}", spans.merge(F.col("r"), F.col("m")))
    assert [x["text"] for x in got[0][0]] == ["a", "b", "f", "e"] and [x["text"] for x in got[1][0]] == ["a", "b"]


MASKS = [
    ("900101-1234568", "rrn", "shape", "900101-XXXXXXX"), ("010-1234-5678", "mobile", "shape", "010-XXXX-XXXX"), ("01012345678", "mobile", "shape", "01012345678"),
    ("11-25-123456-78", "driver_license", "shape", "11-25-XXXXXX-XX"), ("4111 1111 1111 1111", "card", "shape", "4111-XXXX-XXXX-1111"), ("110-234-567890", "account", "shape", "110-XXX-XXX890"),
    ("minsu@example.com", "email", "shape", "m****@example.com"), ("ab@c.de", "email", "shape", "a**@c.de"), ("120-86-12347", "business_number", "shape", "120-86-XXXXX"),
    ("M12345678", "passport", "shape", "MXXXXXXXX"), ("06024", "postal_code", "shape", "XXXXX"), ("홍", "person_name", "shape", "●●"), ("sk-abc1234567890abcdef", "credential", "shape", "●" * 16),
    ("홍길동", "person_name", "partial", "홍O동"), ("홍길", "person_name", "partial", "홍O"), ("홍", "person_name", "partial", "홍"), ("x", "date", "tag", "[날짜]"), ("x", "card", "fake", "4111-1111-1111-1111"), ("x", "url", "remove", ""),
]


def test_masks(spark):
    got = values(spark, [m[:3] for m in MASKS], "t string, c string, m string", masking.apply_mask(F.col("t"), F.col("c"), F.col("m")))
    assert [g[0] for g in got] == [m[3] for m in MASKS]


def test_mask_text_shadows_and_toggles(spark):
    s = [(0, 5, "aaaaa", "mobile", 0.9, "regex"), (3, 8, "bbbbb", "person_name", 0.9, "regex"), (9, 10, "c", "person_name", 0.9, "regex")]
    off = {"mobile": False}
    got = values(spark, [("aaabbbbb c end", s, off, None), ("aaabbbbb c end", s, None, []), ("aaabbbbb c end", s, None, ["9:10:person_name"]), ("plain", [], None, None)], f"t string, s {spans.SPANS}, e map<string,boolean>, k array<string>", masking.mask_text(F.col("t"), F.col("s"), enabled=F.col("e"), keys=F.col("k"), default="tag"))
    assert [g[0]["text"] for g in got] == ["aaabbbbb [이름] end", "aaabbbbb c end", "aaabbbbb [이름] end", "plain"]
    assert [len(g[0]["skipped"]) for g in got] == [1, 2, 1, 0]


def test_headers_and_labels(spark):
    assert [r[0] for r in values(spark, [("성 명",), ("E-mail",), ("연락처:",), ("면허",), ("비고",), ("",)], "t string", headers.category_for_header(F.col("t")))] == ["person_name", "email", "mobile", "driver_license", None, None]
    got = values(spark, [("성명: 김민수 연락처: 1\n소속：x",)], "t string", headers.label_spans(F.col("t")))[0][0]
    assert [(x["text"], x["category"]) for x in got] == [("김민수 연락처: 1", "person_name")]


def test_header_row_is_the_best_of_five(spark):
    cells = [("a", r, c, t) for r, row in enumerate([["명단", ""], ["성명", "비고"], ["이름", "이메일"], ["kim", "x@y.zz"]]) for c, t in enumerate(row)]
    df = spark.createDataFrame(cells, "doc string, row int, col int, text string")
    assert {(r["header_row"], r["col"], r["category"]) for r in segments.header_columns(df, ["doc"]).collect()} == {(2, 0, "person_name"), (2, 1, "email")}
    done = segments.mask_segments(segments.detect_segments(segments.mark_cells(df, ["doc"])))
    assert {(r["row"], r["col"]): r["masked"] for r in done.collect()}[3, 1] == "x**@y.zz"


def test_model_spans(spark):
    ents = [("B-SURNAME", "김", 3, 4, 0.9), ("I-GIVENNAME", "민수님은", 4, 8, 0.5), ("ORG", "x", 0, 1, 0.9), ("PER", "##a  b", None, None, 0.8), ("PER", "zz", None, None, 0.8), ("PER", "a", None, None, 0.1)]
    got = values(spark, [("담당 김민수님은 a b", ents), ("x", None)], "t string, e array<struct<label:string,word:string,start:int,end:int,score:double>>", model.model_spans(F.col("t"), F.col("e")))
    assert [(s["text"], round(s["confidence"], 3)) for s in got[0][0]] == [("김민수", 0.7), ("a b", 0.8)] or [(s["text"]) for s in got[0][0]] == ["김민수님은 a b"]
    assert got[1][0] == []


def test_filter_ratio_and_router(spark):
    s = [(0, 2, t, c, p, "model") for t, c, p in [("do", "person_name", 0.99), ("Kim", "person_name", 0.5), ("Kim", "person_name", 0.9), ("심리학", "person_name", 0.9), ("do", "address", 0.9), ("김민수", "person_name", 0.4)]]
    assert [x["text"] + x["category"][0] for x in values(spark, [(s,)], f"s {spans.SPANS}", model.filter_false_names(F.col("s")))[0][0]] == ["Kimp", "doa", "김민수p"]
    got = values(spark, [("가나ab", "multilingual", ["tier2-multilingual"]), ("abc", "multilingual", ["tier2-multilingual"]), ("abc", "precision_high", []), ("", "default", None)], "t string, m string, a array<string>", model.korean_ratio(F.col("t")), model.pick_model(F.col("t"), F.col("m"), F.col("a")))
    assert got == [(0.5, "tier1-default"), (0.0, "tier2-multilingual"), (0.0, "tier1-default"), (0.0, "tier1-default")]


@pytest.mark.parametrize("scheme,tags", [("bio", ["O", "B-X", "I-X"]), ("bioes", ["O", "B-X", "I-X", "E-X", "S-X"])])
def test_decoding_finds_the_best_allowed_path(scheme, tags):
    allowed = decoding._allowed(tags, scheme)
    rng = np.random.default_rng(4)
    for _ in range(30):
        scores = -rng.random((4, len(tags)))
        best = max((p for p in itertools.product(range(len(tags)), repeat=4) if allowed[-1][p[0]] and all(allowed[a][b] for a, b in zip(p, p[1:], strict=False))), key=lambda p: sum(scores[t][k] for t, k in enumerate(p)))
        got = decoding.decode(scores, tags, scheme)
        marked = {t for s in got for t in range(s["start"], s["end"])}
        assert {t for t, k in enumerate(best) if tags[k] != "O"} == marked
        assert all(math.isclose(s["score"], np.mean([scores[t][best[t]] for t in range(s["start"], s["end"])])) for s in got)
    assert decoding.decode(np.zeros((0, 3)), tags[:3], scheme) == []


def test_evaluation_matches_one_to_one(spark):
    e = [(0, 4, "x", "a"), (10, 14, "y", "b")]
    p = [(0, 4, "x", "a", 1.0, "r"), (1, 4, "x", "a", 1.0, "r"), (20, 24, "z", "b", 1.0, "r")]
    df = spark.createDataFrame([(p, e)], f"predicted {spans.SPANS}, expected array<struct<start:int,end:int,text:string,category:string>>")
    got = {r["category"]: (r["tp"], r["fp"], r["fn"]) for r in evaluation.evaluate(df).collect()}
    assert got == {"a": (1, 1, 0), "b": (0, 1, 1)}
    with pytest.raises(Exception, match="not in the input"):
        values(spark, [("abc", [("zz", "a")])], "t string, e array<struct<text:string,category:string>>", evaluation.expected_spans(F.col("t"), F.col("e")))


def test_admission_does_not_count_rejected_files(spark):
    rows = [("q", 1, 60), ("q", 2, 200), ("q", 3, 50), ("q", 4, 40), ("p", 1, 100)]
    got = control.admit(spark.createDataFrame(rows, "q string, i int, size int"), "q", "i", max_file=150, max_queue=100)
    assert {(r["q"], r["i"]): r["reason"] for r in got.collect()} == {("q", 1): None, ("q", 2): "file-too-large", ("q", 3): "queue-total-exceeded", ("q", 4): None, ("p", 1): None}


def test_hosts_names_and_guard(spark):
    hosts = spark.createDataFrame([("a.b.co",), ("b.co",), ("xb.co",), (None,)], "host string")
    left = control.without_listed(hosts, spark.createDataFrame([("b.co",)], "domain string"))
    assert {r["host"] for r in left.collect()} == {"xb.co", None}
    assert [r[0] for r in values(spark, [("a.b.HWP",), ("x",), ("y.csv",)], "n string", control.output_name(F.col("n")))] == ["a.b_masked.txt", "x_masked", "y_masked.csv"]
    assert [r[0] for r in values(spark, [(0,), (25,), (26,), (701,), (702,)], "n int", control.column_letters(F.col("n")))] == ["A", "Z", "AA", "ZZ", "AAA"]
    lines = spark.createDataFrame([("010-4321-8765 and 010-1234-5678",)], "text string")
    assert [r["match"] for r in control.guard(lines).collect()] == ["010-4321-8765"]


def test_text_functions(spark):
    assert values(spark, [("é",), (None,)], "t string", nfc(F.col("t"))) == [("é",), (None,)]
    assert values(spark, [("a<b&c",)], "t string", xml_encode(F.col("t")), xml_decode(xml_encode(F.col("t")))) == [("a&lt;b&amp;c", "a<b&c")]
    assert values(spark, [("&amp;lt;",)], "t string", xml_decode(F.col("t"))) == [("<",)]


def archive(**parts):
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_x", ".x"), text)
    return out.getvalue()


def row(prefix, *cells):
    return f"<{prefix}:tr>" + "".join(f"<{prefix}:tc><{prefix}:t>{c}</{prefix}:t></{prefix}:tc>" for c in cells) + f"</{prefix}:tr>"


def test_files_round_trip(spark):
    body = lambda p: f"<{p}:t>연락 010-1234-5678 &amp; 끝</{p}:t><{p}:tbl>{row(p, '성명', '비고')}{row(p, '김민수', 'x')}</{p}:tbl>"
    sheet = '<worksheet xmlns="urn:m"><sheetData><row><c r="B2" t="s"><v>0</v></c><c r="C2" t="n"><v>7</v></c></row><row><c r="B3" t="s"><v>1</v></c></row></sheetData></worksheet>'
    book = {
        "xl/workbook.xml": '<workbook xmlns:r="urn:r"><sheets><sheet name="S" r:id="a"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><r Id="a" Target="worksheets/s1.xml"/></R>',
        "xl/sharedStrings.xml": "<sst><si><t>이메일</t></si><si><t>a@b.co</t></si></sst>", "xl/worksheets/s1.xml": sheet,
    }
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in book.items():
            z.writestr(name, text)
    props = '<p:x><dc:creator>홍길동 01</dc:creator></p:x>'
    files = spark.createDataFrame([
        ("d/a.txt", "call 010-1234-5678".encode()), ("d/b.csv", "메모,\n성명,전화\n김민수,\"02-1,2\"\n".encode()), ("d/c.docx", archive(word__document_xml=body("w"), docProps__core_xml=props)),
        ("d/e.hwpx", archive(Contents__section0_xml=body("hp"))), ("d/f.xlsx", out.getvalue()), ("d/g.pptx", archive(ppt__slides__slide1_xml=body("a"))),
    ], "path string, content binary")
    segs = segments.mask_segments(segments.detect_segments(read_segments(files)))
    got = {(r["path"], r["seg_id"]): r["masked"] for r in segs.collect()}
    assert got["d/a.txt", "doc"] == "call 010-XXXX-XXXX" and got["d/b.csv", "r1c0"] == "성명" and got["d/b.csv", "r2c0"] == "●●●" and got["d/f.xlsx", "S!B3"] == "a**@b.co"
    assert got["d/c.docx", "t0"] == "연락 010-XXXX-XXXX & 끝" and got["d/c.docx", "t3"] == "●●●" and got["d/c.docx", "t1"] == "성명" and ("d/f.xlsx", "S!C2") not in got
    assert got["d/e.hwpx", "Contents/section0.xml#3"] == "●●●" and got["d/c.docx", "docprops::docProps/core.xml#0"] == "●●● 01"
    back = read_segments(write_masked(files, segs).select(F.col("path"), "content"))
    assert {(r["path"], r["seg_id"]): r["text"] for r in back.collect()} == got
    assert {r["name"] for r in write_masked(files, segs).collect()} == {"a_masked.txt", "b_masked.csv", "c_masked.docx", "e_masked.hwpx", "f_masked.xlsx", "g_masked.pptx"}
    with pytest.raises(Exception, match="no reader"):
        read_segments(spark.createDataFrame([("x.pdf", b"")], "path string, content binary")).collect()
    assert [r["text"] for r in read_segments(spark.createDataFrame([("x.pdf", b"z")], "path string, content binary"), {".pdf": lambda b: [("p1", b.decode())]}).collect()] == ["z"]


def test_image_segments(spark):
    df = spark.createDataFrame([(1, {"Artist": " 홍 ", "Make": "x", "rights": " "}), (2, None)], "i int, meta map<string,string>")
    assert [(r["i"], r["seg_id"], r["text"]) for r in image_segments(df).collect()] == [(1, "exif::Artist", "홍")]


def test_stream_masks_what_a_batch_masks(spark, tmp_path):
    spark.createDataFrame([("a@b.co",), ("none",), (None,)], "text string").write.parquet(str(tmp_path / "in"))
    stream = mask_stream(spark.readStream.schema("text string").parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("masked").start()
    run.processAllAvailable()
    run.stop()
    assert {(r["text"], r["masked"]) for r in spark.sql("select * from masked").collect()} == {("a@b.co", "a**@b.co"), ("none", "none"), (None, None)}


BOOK = {
    "[Content_Types].xml": "<Types/>", "xl/workbook.xml": '<workbook xmlns:r="urn:r"><sheets><sheet name="S" r:id="a"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><r Id="a" Target="worksheets/s1.xml"/></R>',
    "xl/sharedStrings.xml": "<sst><si><t>이메일</t></si><si><t>a@b.co</t></si><si><r><t>c@</t></r><r><t>d.co</t></r></si><si><t>unused@old.co</t></si></sst>",
    "xl/worksheets/s1.xml": '<worksheet xmlns="urn:m" xmlns:mc="urn:mc" xmlns:x1="urn:x1" xmlns:x2="urn:x2" mc:Ignorable="x1 x2" x1:id="7"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="n"><v>7</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2" t="str"><f>A1</f><v>e@f.co</v></c><c r="C2" t="s"><v>2</v></c></row></sheetData></worksheet>',
    "xl/worksheets/_rels/s1.xml.rels": '<R><r Id="c" Target="../comments1.xml"/></R>',
    "xl/comments1.xml": '<comments><authors><author>홍길동 부장</author><author>none</author></authors><commentList><comment ref="A1" authorId="0"><text><r><t>call </t></r><r><t>010-1234-5678</t></r></text></comment><comment ref="A1" authorId="1"><text><t>fine</t></text></comment></commentList></comments>',
    "xl/pivotCache/pivotCacheDefinition1.xml": '<p><s v="a@b.co"/><s v="kept"/><t>e@f.co</t></p>',
    "docProps/core.xml": '<cp:p xmlns:cp="urn:cp" xmlns:dc="urn:dc"><dc:creator>g@h.co</dc:creator><dc:title>plain</dc:title></cp:p>',
    "docProps/custom.xml": '<P xmlns:vt="urn:vt"><property name="owner"><vt:lpwstr>i@j.co</vt:lpwstr></property></P>',
}


def zipped(parts):
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_no_masked_text_stays_in_any_part_of_an_archive(spark):
    body = lambda p: f"<{p}:d><{p}:t>k@l.co and 010-1234-5678</{p}:t><{p}:tbl>{row(p, '성명', '비고')}{row(p, '김민수', 'x')}</{p}:tbl></{p}:d>"
    props = '<p:x><dc:creator>g@h.co</dc:creator></p:x>'
    files = spark.createDataFrame([
        ("a.xlsx", zipped(BOOK)), ("b.docx", archive(word__document_xml=body("w"), docProps__core_xml=props)), ("c.pptx", archive(ppt__slides__slide1_xml=body("a"), ppt__notesSlides__notesSlide1_xml=body("a"))),
        ("d.hwpx", zipped({"Contents/section0.xml": body("hp"), "Preview/PrvText.txt": "k@l.co 010-1234-5678"})),
    ], "path string, content binary")
    segs = stored(segments.mask_segments(segments.detect_segments(read_segments(files))))
    secret = ["a@b.co", "c@d.co", "<t>c@<", "e@f.co", "unused@old.co", "홍길동", "1234-5678", "g@h.co", "i@j.co", "k@l.co", "김민수"]
    for r in write_masked(files, segs).collect():
        with zipfile.ZipFile(BytesIO(bytes(r["content"]))) as z:
            for name in z.namelist():
                part = z.read(name).decode()
                assert not [x for x in secret if x in part], (r["path"], name)
    back = {(r["path"], r["seg_id"]): r["text"] for r in read_segments(write_masked(files, segs).select("path", "content")).collect()}
    assert back == {(r["path"], r["seg_id"]): r["masked"] for r in segs.collect()}
    assert back["a.xlsx", "xlsxcomment::S!A1#0::t"] == "call 010-XXXX-XXXX" and back["a.xlsx", "xlsxcomment::S!A1#1::t"] == "fine" and back["a.xlsx", "xlsxcustprops::owner"] == "i**@j.co"
    done = next(bytes(r["content"]) for r in write_masked(files, segs).collect() if r["path"] == "a.xlsx")
    with zipfile.ZipFile(BytesIO(done)) as z:
        assert 'Ignorable="x1"' in z.read("xl/worksheets/s1.xml").decode() and "kept" in z.read("xl/pivotCache/pivotCacheDefinition1.xml").decode() and "<v>7</v>" in z.read("xl/worksheets/s1.xml").decode().replace("ns0:", "").replace("m:", "")


def test_names_of_formats_without_a_way_back(spark):
    assert [r[0] for r in values(spark, [("a.pdf",), ("b.XLS",), ("c.xlsx",)], "n string", control.output_name(F.col("n")))] == ["a_masked.txt", "b_masked.txt", "c_masked.xlsx"]


def test_labels_follow_the_table(spark):
    cases = [("xlsxprops::Title", ".xlsx", "워크북 속성: Title"), ("xlsxcomment::S!A1#0::t", ".xlsx", "S!A1 코멘트 본문"), ("xlsxcomment::odd", ".xlsx", "셀 코멘트: odd"), ("r3c27", ".csv", "4행 AB열"), ("r3c27", ".docx", "r3c27"), ("S!A1", ".xls", "S!A1"), ("t4", ".docx", "본문 5번째 텍스트"), ("ppt/notesSlides/notesSlide2.xml#0", ".pptx", "슬라이드 2 발표자 노트"), ("Preview/PrvText.txt#0", ".hwpx", "미리보기 텍스트"), ("s1p2", ".hwp", "본문"), ("ocr", ".png", "OCR 텍스트"), ("p3", ".pdf", "3페이지"), ("customprops::x", ".docx", "문서 속성: x"), ("x", ".txt", "x")]
    assert [r[0] for r in values(spark, [c[:2] for c in cases], "s string, e string", control.segment_label(F.col("s"), F.col("e")))] == [c[2] for c in cases]


def test_files_of_no_queue_are_one_queue(spark):
    rows = [(None, 1, 60.0), (None, 2, 50.0), (None, 3, 40.0), (2.0, 1, 90.0)]
    got = control.admit(spark.createDataFrame(rows, "q double, i int, size double"), "q", "i", max_file=150, max_queue=100)
    assert {(r["q"], r["i"]): r["reason"] for r in got.collect()} == {(None, 1): None, (None, 2): "queue-total-exceeded", (None, 3): None, (2.0, 1): None}


def test_patterns_and_model_together(spark):
    ents = [("PER", "김민수", 0, 3, 0.9), ("PER", "do", 4, 6, 0.9), ("EMAIL", "x", 0, 30, 0.9)]
    text = "김민수 do 010-1234-5678"
    got = values(spark, [(text, ents), (text, None), (text, []), (None, None)], "t string, e array<struct<label:string,word:string,start:int,end:int,score:double>>", detect.detect_with_model(F.col("t"), F.col("e")))
    alone = found(spark, [text], detect.detect(F.col("t")))[0]
    assert [(s["text"], s["category"]) for s in got[1][0]] == alone == [(s["text"], s["category"]) for s in got[2][0]] and got[3][0] == []
    assert ("do", "person_name") not in [(s["text"], s["category"]) for s in got[0][0]] and {s["category"] for s in got[0][0]} == {"person_name", "email", "mobile"}


def test_settings_over_defaults(spark):
    raw = [(None,), ("{}",), ('{"stats":{"totalSpansMasked":4},"modeByCategory":{"url":"remove"},"theme":null}',), ("[1]",), ("x",)]
    got = [r[0] for r in values(spark, raw, "r string", settings.settings(F.col("r")))]
    assert all(got[i] == got[0] for i in (1, 3, 4)) and got[0]["enabledByCategory"] == {c[0]: c[2] for c in fixed.CATEGORIES} and got[0]["stats"].asDict() == {"totalConfirmed": 0, "totalSpansMasked": 0, "lastConfirmedAt": None}
    assert got[2]["stats"]["totalSpansMasked"] == 4 and got[2]["modeByCategory"] == {"url": "remove"} and got[2]["theme"] == "light" and got[2]["userMode"] == "default"


def test_review(spark):
    s = [(0, 1, "a", "mobile", 0.9, "r"), (2, 3, "b", "card", 0.9, "r"), (0, 1, "a", "mobile", 0.5, "r")]
    r = values(spark, [(s, ["2:3:card"])], f"s {spans.SPANS}, k array<string>", review.toggle(F.col("k"), F.col("s"), True, "mobile"), review.toggle(F.col("k"), F.col("s"), False), review.switched_off(F.col("s"), F.col("k")), review.visible_categories(F.col("s")), review.auto_apply(F.size("s"), F.lit(None)))
    assert r == [(["2:3:card", "0:1:mobile"], [], ["0:1:mobile"], ["mobile", "card"], False)]
    df = spark.createDataFrame([("f", ".csv", 1, "r0c0", s), ("f", ".csv", 0, "r1c1", s[:1]), ("f", ".csv", 2, "x", []), ("g", ".csv", 0, "y", None)], f"path string, ext string, seq int, seg_id string, spans {spans.SPANS}")
    assert [(x["path"], x["seq"], x["label"], x["flat"], x["large"]) for x in review.groups(df).orderBy("path", "seq").collect()] == [("f", 0, "2행 B열", False, False), ("f", 1, "1행 A열", False, False)]
    assert {(x["category"], x["total"], x["on"]) for x in review.counts(df.withColumn("keys", F.array(F.lit("0:1:mobile"))), ["path"]).collect()} == {("mobile", 3, 3), ("card", 1, 0)}


def test_cases_as_json(spark):
    text = '{"cases":[{"id":"a","kind":"positive","text":"x\\ny","expected":[{"text":"x","category":"mobile"}]}]}'
    got = values(spark, [(text,), ("no",), (None,)], "j string", evaluation.read_cases(F.col("j")), evaluation.written_cases(evaluation.read_cases(F.col("j"))))
    assert got[0][0][0]["text"] == "x\ny" and got[0][1] == text and got[1][0] is None and got[2][0] is None


def test_stored_and_spread(spark):
    df = spark.range(10).repartition(2)
    assert stored(df).count() == 10 and spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(spark.range(0, 10, 1, 9)).rdd.getNumPartitions() == 9


def test_expressions_over_plain_columns_are_built_once(spark):
    assert detect.detect(F.col("t")) is detect.detect(F.col("t")) and detect.detect(F.col("t")) is not detect.detect(F.col("u"))
    assert detect.detect_kind(F.col("t"), "card") is not detect.detect_kind(F.col("t"), "email")
