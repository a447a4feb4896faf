"""Texts made from table keys by SQL that Spark and DuckDB read alike, so that queries over them can be checked."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.stored import spread

_S = lambda x: f"cast({x} as string)"
_pad = lambda x, n: f"lpad({_S(x)},{n},'0')"


def _check(d: str, weights) -> str:
    return "(" + " + ".join(f"{w} * cast(substring({d},{i},1) as int)" for i, w in enumerate(weights, 1)) + ")"


def case(key: str, values: list[str]) -> str:
    """The value for key modulo the number of values."""
    return f"case {key} % {len(values)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


_k = "o_orderkey"
_RRN12 = f"concat({_pad(f'50 + {_k} % 50', 2)}, {_pad(f'1 + {_k} % 12', 2)}, {_pad(f'1 + {_k} % 28', 2)}, {_S(f'1 + {_k} % 4')}, {_pad(f'({_k} * 31) % 100000', 5)})"
_FOR12 = f"concat({_pad(f'50 + {_k} % 50', 2)}, {_pad(f'1 + {_k} % 12', 2)}, {_pad(f'1 + {_k} % 28', 2)}, {_S(f'5 + {_k} % 4')}, {_pad(f'({_k} * 37) % 100000', 5)})"
_W = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)
_wrong = f"case when {_k} % 3 = 0 then 1 else 0 end"
_rrn_digit = f"((11 - {_check(_RRN12, _W)} % 11) % 10 + {_wrong}) % 10"
_for_digit = f"((11 - {_check(_FOR12, _W)} % 11) % 10 + 2 + {_wrong}) % 10"
_c = "c_custkey"
_BIZ9 = _pad(f"({_c} * 104729 + 120861234) % 1000000000", 9)
_biz_digit = f"((10 - ({_check(_BIZ9, (1, 3, 7, 1, 3, 7, 1, 3, 5))} + cast(floor(cast(substring({_BIZ9},9,1) as int) * 5 / 10) as int)) % 10) % 10 + case when {_c} % 3 = 0 then 1 else 0 end) % 10"
_PHONE = f"concat('010-', {_pad(f'1000 + {_c} % 9000', 4)}, '-', {_pad(f'({_c} * 7919) % 10000', 4)})"
NAMES = ["'김민수'", "'이영희'", "'남궁민수'", "'이메일'"]
#: table, key, text
RECIPES = {
    "mobile": ("customer", _c, f"concat('연락처는 ', {_PHONE}, ' 입니다.')"),
    "mobile_attached": ("customer", _c, f"concat('연락처', replace({_PHONE}, '-', {case(_c, [chr(39) + '-' + chr(39), chr(39) * 2, chr(39) + ' ' + chr(39)])}), '입니다')"),
    "rrn": ("orders", _k, f"concat('주민등록번호 ', substring({_RRN12},1,6), '-', substring({_RRN12},7,6), {_S(_rrn_digit)}, ' 입니다.')"),
    "foreign_registration": ("orders", _k, f"concat('외국인 ', substring({_FOR12},1,6), {case(_k, [chr(39) + '-' + chr(39), chr(39) * 2])}, substring({_FOR12},7,6), {_S(_for_digit)}, '.')"),
    "business_number": ("customer", _c, f"concat('사업자 ', substring({_BIZ9},1,3), '-', substring({_BIZ9},4,2), '-', substring({_BIZ9},6,4), {_S(_biz_digit)}, ' (주)')"),
    "landline": ("customer", _c, f"concat('tel ', {case(_c, [chr(39) + x + chr(39) for x in ('02', '031', '070', '0505', '071')])}, '-', {_pad(f'100 + {_c} % 900', 3)}, {case(_c, ['chr(45)', 'chr(32)', 'chr(46)'])}, {_pad(f'({_c} * 7919) % 10000', 4)}, ' ok')"),
    "account": ("orders", _k, "concat('acct ', " + case(_k, [f"concat({_pad(f'{_k} % 1000', 3)}, {x})" for x in (f"'-12-', {_pad(f'{_k} % 1000000', 6)}", f"'-345-', {_pad(f'{_k} % 1000000', 6)}", f"{_pad(f'{_k} % 10', 1)}, '-45-', {_pad(f'{_k} % 1000000', 6)}", f"'-12-', {_pad(f'{_k} % 100000', 5)}", f"'7-1234-5678-', {_pad(f'{_k} % 10000', 4)}")]) + ", ' end')"),
    "driver_license": ("customer", _c, f"concat('면허 ', {_S(f'10 + {_c} % 20')}, '-', {_pad(f'{_c} % 100', 2)}, '-', {_pad(f'({_c} * 7919) % 1000000', 6)}, '-', {_pad(f'({_c} * 31) % 100', 2)}, ' 확인')"),
    "passport": ("customer", _c, f"concat('여권 ', {case(_c, [chr(39) + x + chr(39) for x in 'MRSOP'])}, {_pad(f'({_c} * 104729) % 100000000', 8)}, ', 끝')"),
    "corporate_registration": ("customer", _c, f"concat('법인 ', {_pad(f'({_c} * 7919) % 1000000', 6)}, '-', {_S(f'{_c} % 10')}, {_pad(f'({_c} * 31) % 1000000', 6)}, ' 등기')"),
    "credential": ("customer", _c, "concat('key ', " + case(_c, [f"concat('sk-abcdEFGH_', {_pad(_c, 8)})", f"concat('AKIAABCDEFGH', {_pad(_c, 8)})", f"concat('ghp_abcdefgh', {_pad(_c, 8)})", f"concat('xoxb-12345678-', {_pad(_c, 8)})", f"concat('postgres://u', {_S(_c)}, ':pw@db.host/x')", f"concat('sk-', {_pad(_c, 8)})"]) + ", ' .')"),
    "date": ("orders", _k, f"concat({case(_k, [chr(39) + x + chr(39) for x in ('born ', 'version ', '결재 ')])}, {_S(f'1900 + {_k} % 200')}, {case(_k, [chr(39) + x + chr(39) for x in '-./'])}, {_pad(f'1 + {_k} % 12', 2)}, {case(_k, [chr(39) + x + chr(39) for x in '-./'])}, {_pad(f'1 + {_k} % 31', 2)}, ' end')"),
    "date_korean": ("orders", _k, f"concat('결재일 ', {_S(f'1900 + {_k} % 200')}, '년 ', {_S(f'1 + {_k} % 12')}, '월 ', {_S(f'1 + {_k} % 31')}, '일에')"),
    "postal_code": ("customer", _c, f"concat({case(_c, [chr(39) + x + chr(39) for x in ('우편번호 ', 'build ', 'code ', '서울 ')])}, {_pad(f'({_c} * 7919) % 80000', 5)}, ' end')"),
    "bank_account": ("customer", _c, f"concat({case(_c, [chr(39) + x + chr(39) for x in ('국민', '신한', '카카오뱅크', '없는은행')])}, ' ', {_pad(f'100 + {_c} % 900', 3)}, '-', {_pad(f'({_c} * 7919) % 1000000', 6)}, '-', {_pad(f'{_c} % 100000', 5)}, ' 입금')"),
    "address": ("customer", _c, f"concat('주소: ', {case(_c, [chr(39) + x + chr(39) for x in ('서울특별시', '경기도', '부산', '뉴욕')])}, ' ', {case(_c, [chr(39) + x + chr(39) for x in ('강남구', '수원시', '해운대구')])}, ' ', {case(_c, [chr(39) + x + chr(39) for x in ('테헤란로', '역삼동')])}, ' ', {_S(f'1 + {_c} % 200')}, '-', {_S(f'1 + {_c} % 9')}, ', ')"),
    "names": ("customer", _c, f"concat('담당 ', {case(_c, NAMES)}, {case(_c, [chr(39) + x + chr(39) for x in (' 부장', '입니다', ' /')])})"),
    "context_names": ("customer", _c, f"concat('no_', {case(_c, [chr(39) + x + chr(39) for x in ('박영', '서울', '김아무개', '조사방법', '이상')])}, '_', {_S(_c)})"),
    "roman_names": ("customer", _c, f"concat('file_', {case(_c, [chr(39) + x + chr(39) for x in ('KimDoeFoo', 'LeeAB', 'DoeFooPark', 'JavaScript', 'kimdoe')])}, '_', {_S(_c)}, '.pdf')"),
    "file_names": ("customer", _c, f"concat({case(_c, [chr(39) + x + chr(39) for x in ('임꺽정이력서', '홍길동사본', '조달청영수증', '그냥문서')])}, '_', {_S(_c)}, '.doc')"),
    "overlaps": ("customer", _c, "concat('건 ', " + case(_c, [f"concat('국민 110-234-', {_pad(f'({_c} * 31) % 1000000', 6)})", f"concat('0101234', {_pad(f'{_c} % 10000', 4)}, '@mail.example')", f"concat('4111-1111-1111-', {_pad(f'{_c} % 10000', 4)})", f"concat('02-123-', {_pad(f'{_c} % 10000', 4)}, ' a.', {_S(_c)}, '@b.example')", f"concat('KimLee', '@', 'x', {_S(_c)}, '.example')", f"concat('신한 2024-05-10-', {_pad(f'{_c} % 1000', 3)})", f"concat('우리 12 34 56 78 ', {_pad(f'{_c} % 100', 2)})"]) + ", ' 끝')"),
    "labels": ("customer", _c, f"concat('성명: ', {case(_c, NAMES)}, chr(10), '연락처= ', {_PHONE}, chr(9), '메일：none', chr(10), 'memo: x')"),
}


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, key, text = RECIPES[name]
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet")).selectExpr(f"cast({key} as bigint) as key", f"{text} as text")


def texts_sql(name: str) -> str:
    table, key, text = RECIPES[name]
    return f"SELECT cast({key} as bigint) AS key, {text} AS t FROM {table}"


_ORG = case(_c, ["'한빛재단'", "'조달청'"])
#: The sheet that a customer stands in: of their nation and of 5,000 keys, so sheets grow in number and not in size.
SHEET = "cast(c_nationkey + 25 * floor(c_custkey / 5000) AS int)"
#: Each sheet has a title row, a header row, a row for each customer. SQL for both engines over a view or table.
CELLS = f"""
WITH c AS (SELECT doc, c_custkey, cast(1 + row_number() OVER (PARTITION BY doc ORDER BY c_custkey) AS int) AS r FROM (SELECT {SHEET} AS doc, c_custkey FROM customer)),
n AS (SELECT DISTINCT doc FROM c)
SELECT doc, cast(0 AS int) AS row, cast(0 AS int) AS col, '회원 명단' AS text FROM n
UNION ALL SELECT doc, cast(1 AS int), cast(0 AS int), '성 명' FROM n UNION ALL SELECT doc, cast(1 AS int), cast(1 AS int), '연락처' FROM n
UNION ALL SELECT doc, cast(1 AS int), cast(2 AS int), '소속' FROM n UNION ALL SELECT doc, cast(1 AS int), cast(3 AS int), '신분증 사본' FROM n
UNION ALL SELECT doc, cast(1 AS int), cast(4 AS int), '비고' FROM n
UNION ALL SELECT doc, r, cast(0 AS int), {case(_c, NAMES)} FROM c UNION ALL SELECT doc, r, cast(1 AS int), {_PHONE} FROM c
UNION ALL SELECT doc, r, cast(2 AS int), {_ORG} FROM c UNION ALL SELECT doc, r, cast(3 AS int), concat('박영_', {_S(_c)}, '.jpg') FROM c
UNION ALL SELECT doc, r, cast(4 AS int), concat('memo ', {_S(_c)}) FROM c
"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CELLS.replace("customer)", "{customer})").replace("FROM customer", "FROM {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


#: Lines of an office file: of 40 customers each a text with a phone number, a name and a memo.
LETTERS = f"SELECT cast(floor({_c} / 40) AS bigint) AS doc, cast({_c} AS bigint) AS key, {RECIPES['mobile'][2]} AS line, {case(_c, NAMES)} AS name, concat('memo ', {_S(_c)}) AS memo FROM customer"


def _xml(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def office_file(ext: str, doc: int, rows: list[tuple[str, str, str]]) -> bytes:
    """A small file of a format: lines, then a table of names and memos; in a workbook a sheet of names, lines and memos."""
    parts: dict[str, str] = {}
    if ext == ".xlsx":
        strings = ["성명", "연락", "비고", *(x for row in rows for x in row)]
        cell = lambda i: f'<c r="{"ABC"[i % 3]}{i // 3 + 1}" t="s"><v>{i}</v></c>'
        lines = "".join(f"<row>{''.join(cell(i) for i in range(r * 3, r * 3 + 3))}</row>" for r in range(len(rows) + 1))
        parts["xl/workbook.xml"] = '<workbook xmlns:r="urn:r"><sheets><sheet name="S" r:id="a"/></sheets></workbook>'
        parts["xl/_rels/workbook.xml.rels"] = '<R><r Id="a" Target="worksheets/s1.xml"/></R>'
        parts["xl/sharedStrings.xml"] = "<sst>" + "".join(f"<si><t>{_xml(x)}</t></si>" for x in strings) + "</sst>"
        parts["xl/worksheets/s1.xml"] = f"<worksheet><sheetData>{lines}</sheetData></worksheet>"
        parts["docProps/core.xml"] = f'<p xmlns:dc="urn:d"><dc:creator>a{doc}@b.example</dc:creator></p>'
    else:
        part, prefix = {".docx": ("word/document.xml", "w"), ".pptx": ("ppt/slides/slide1.xml", "a"), ".hwpx": ("Contents/section0.xml", "hp")}[ext]
        text = lambda x: f"<{prefix}:t>{_xml(x)}</{prefix}:t>"
        table = "".join(f"<{prefix}:tr>{''.join(f'<{prefix}:tc>{text(x)}</{prefix}:tc>' for x in row)}</{prefix}:tr>" for row in [("성명", "비고"), *((n, m) for n, _, m in rows)])
        parts[part] = f"<{prefix}:doc>{''.join(text(line) for _, line, _ in rows)}<{prefix}:tbl>{table}</{prefix}:tbl></{prefix}:doc>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


#: Formats with the parts that hold the line L or the author A of an annotated file, and the segments that these become.
ANNOTATED = {
    ".txt": ({"": "L"}, {"doc": "L"}),
    ".docx": (
        {
            "word/document.xml": "<w:d><w:t>plain</w:t></w:d>", "word/header1.xml": "<w:h><w:t>L</w:t></w:h>", "word/footnotes.xml": "<w:f><w:t>L</w:t></w:f>",
            "word/comments.xml": '<w:c><w:comment w:author="A"><w:t>L</w:t></w:comment></w:c>', "word/_rels/document.xml.rels": '<R><Relationship Id="a" Target="mailto:A" TargetMode="External"/><Relationship Id="b" Target="header1.xml"/></R>',
            "docProps/core.xml": "<p:p><dc:creator>A</dc:creator></p:p>",
        },
        {
            "t0": "plain", "word/header1.xml@text#0": "L", "word/footnotes.xml@text#0": "L", "word/comments.xml@text#0": "L", "word/comments.xml@author#0": "A", "word/_rels/document.xml.rels@link#0": "mailto:A",
            "docprops::docProps/core.xml#0": "A",
        },
    ),
    ".pptx": (
        {
            "ppt/slides/slide1.xml": "<p><a:t>plain</a:t></p>", "ppt/notesSlides/notesSlide1.xml": "<p><a:t>L</a:t></p>", "ppt/comments/comment1.xml": "<p:cmLst><p:cm><p:text>L</p:text></p:cm></p:cmLst>",
            "ppt/commentAuthors.xml": '<p:l><p:cmAuthor id="0" name="A"/></p:l>', "ppt/slides/_rels/slide1.xml.rels": '<R><Relationship Id="a" Target="mailto:A" TargetMode="External"/></R>',
        },
        {
            "ppt/slides/slide1.xml#0": "plain", "ppt/notesSlides/notesSlide1.xml#0": "L", "ppt/comments/comment1.xml@text#0": "L", "ppt/commentAuthors.xml@author#0": "A", "ppt/slides/_rels/slide1.xml.rels@link#0": "mailto:A",
        },
    ),
    ".hwpx": ({"Contents/section0.xml": "<hp:s><hp:t>plain</hp:t></hp:s>", "Preview/PrvText.txt": "L"}, {"Contents/section0.xml#0": "plain", "Preview/PrvText.txt#0": "L"}),
    ".xlsx": (
        {
            "xl/workbook.xml": '<workbook xmlns:r="urn:r"><sheets><sheet name="S" r:id="a"/></sheets><definedNames><definedName name="n">"A"</definedName></definedNames></workbook>',
            "xl/_rels/workbook.xml.rels": '<R><r Id="a" Target="worksheets/s1.xml"/></R>',
            "xl/worksheets/s1.xml": '<worksheet><sheetData><row><c r="A1" t="inlineStr"><is><t>plain</t></is></c></row></sheetData><hyperlinks><hyperlink ref="A1" display="A"/></hyperlinks></worksheet>',
            "xl/worksheets/_rels/s1.xml.rels": '<R><r Id="c" Target="../comments1.xml"/><r Id="m" Target="mailto:A" TargetMode="External"/></R>',
            "xl/comments1.xml": '<comments><authors><author>A</author></authors><commentList><comment ref="A1" authorId="0"><text><t>L</t></text></comment></commentList></comments>',
            "xl/threadedComments/threadedComment1.xml": '<T><threadedComment ref="A1"><text>L</text></threadedComment></T>', "xl/persons/person.xml": '<P><person displayName="A"/></P>',
            "docProps/core.xml": '<p xmlns:dc="urn:d"><dc:creator>A</dc:creator></p>', "docProps/custom.xml": '<P xmlns:vt="urn:vt"><property name="owner"><vt:lpwstr>A</vt:lpwstr></property></P>',
        },
        {
            "S!A1": "plain", "xl/workbook.xml@name#0": '"A"', "xl/worksheets/s1.xml@display#0": "A", "xl/worksheets/_rels/s1.xml.rels@link#0": "mailto:A", "xlsxcomment::S!A1#0::t": "L", "xlsxcomment::S!A1#0::a": "A",
            "xl/threadedComments/threadedComment1.xml@thread#0": "L", "xl/persons/person.xml@person#0": "A", "xlsxprops::Author": "A", "xlsxcustprops::owner": "A",
        },
    ),
}


def annotated_file(ext: str, doc: int, rows: list[tuple[str, str, str]]) -> bytes:
    """A file of a format with the first row's line, and an author, in all places of ANNOTATED."""
    filled = lambda t, xml: re.sub(r"(?<![A-Za-z])([AL])(?![A-Za-z0-9])", lambda m: f"a{doc}@b.example" if m[1] == "A" else _xml(rows[0][1]) if xml else rows[0][1], t)
    parts = ANNOTATED[ext][0]
    if "" in parts:
        return filled(parts[""], False).encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, filled(body, name.endswith((".xml", ".rels"))))
    return out.getvalue()


def office_files(spark: SparkSession, sf_dir: str, ext: str, make=office_file) -> DataFrame:
    """(path, content): LETTERS as files of a format."""
    lines = spark.sql(LETTERS.replace("FROM customer", "FROM {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    by_file = lines.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("key", "name", "line", "memo"))).alias("rows"))

    def made(batches):
        for pdf in batches:
            content = [make(ext, doc, [(r["name"], r["line"], r["memo"]) for r in rows]) for doc, rows in zip(pdf["doc"], pdf["rows"], strict=True)]
            yield pd.DataFrame({"path": [f"in/{doc}{ext}" for doc in pdf["doc"]], "content": content})

    return by_file.mapInPandas(made, "path string, content binary")
