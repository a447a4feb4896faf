"""Files as segments. Python opens the containers and lists their text nodes; Spark does the rest.

``read_segments`` takes (path, content), as spark.read.format("binaryFile") gives it, so any store that Spark reads will do.
Formats that need a library of their own (.hwp, .pdf, .xls, images) are read by functions that the caller passes in.
"""

from __future__ import annotations

import bisect
import csv
import io
import posixpath
import re
import unicodedata
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.operators.control import file_extension
from veilspark.operators.segments import header_columns, mark_cells
from veilspark.sources import extras
from veilspark.stored import stored

Reader = Callable[[bytes], list[tuple[str, str]]]
NODE = "path string, ext string, seq int, seg_id string, text string, sheet string, row int, col int"
_CELLS = (".csv", ".xlsx")


def opened(data) -> zipfile.ZipFile:
    """An archive from its bytes or from a file that can seek, of which only the parts that are asked for are read."""
    return zipfile.ZipFile(data if hasattr(data, "read") else io.BytesIO(data))


def decoded(text: str) -> str:
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = text.replace(a, b)
    return unicodedata.normalize("NFC", text)


def node_id(ext: str, part: str, i: int) -> str:
    return f"t{i}" if ext == ".docx" else f"{part}#{i}"


def parts_of(names: list[str], ext: str) -> list[str]:
    found = [n for n in names if re.search(fixed.PARTS[ext][0], n)]
    return sorted(found) if ext == ".pptx" else found


def _stretches(xml: str, tag: str, low: int, high: int):
    """(start, end) of elements, each closed by the first closing tag after it."""
    opening, closing = re.compile(rf"<{tag}(?:\s[^>]*)?>"), f"</{tag}>"
    while (m := opening.search(xml, low, high)) is not None:
        end = xml.find(closing, m.start(), high)
        if end < 0:
            return
        low = end + len(closing)
        yield m.start(), low


def table_cells(xml: str, prefix: str) -> list[tuple[int, int, int, list[int]]]:
    """(table, row, cell, numbers of its text nodes) of a part."""
    nodes = [(m.start(), m.end()) for m in re.finditer(rf"<{prefix}:t(?:\s[^>]*)?>[^<]*</{prefix}:t>", xml)]
    starts = [a for a, _ in nodes]  # ascending, as nodes do not nest
    out = []
    for t, (a, b) in enumerate(_stretches(xml, f"{prefix}:tbl", 0, len(xml))):
        for r, (c, d) in enumerate(_stretches(xml, f"{prefix}:tr", a, b)):
            for k, (e, f) in enumerate(_stretches(xml, f"{prefix}:tc", c, d)):
                low, high = bisect.bisect_left(starts, e), bisect.bisect_left(starts, f)
                out.append((t, r, k, [i for i in range(low, high) if nodes[i][1] <= f]))
    return out


def text_parts(ext: str, z: zipfile.ZipFile) -> list[str]:
    """The parts of an archive that may be read on their own: those of running text, or the sheets of a workbook."""
    return [part for _, part in sheet_parts(z)] if ext == ".xlsx" else parts_of(z.namelist(), ext)


def _text(z: zipfile.ZipFile, part: str) -> str:
    return z.read(part).decode("utf-8", "replace")


def _packed(z: zipfile.ZipFile, ext: str, only: list[str] | None = None, rest: bool = True) -> list[tuple]:
    out = []
    names = z.namelist()
    for part in parts_of(names, ext) if only is None else only:
        xml = _text(z, part)
        place = {i: (f"{part}#{t}", r, c) for t, r, c, nodes in table_cells(xml, fixed.PARTS[ext][1]) for i in nodes}
        for i, m in enumerate(re.finditer(fixed.TEXT_NODE[ext], xml)):
            if m[2]:
                out.append((node_id(ext, part, i), decoded(m[2]), *place.get(i, (None, None, None))))
    if rest and ext == ".hwpx":
        if fixed.PREVIEW in names and (text := unicodedata.normalize("NFC", _text(z, fixed.PREVIEW))):
            out.append((f"{fixed.PREVIEW}#0", text, None, None, None))
    elif rest:
        for part in fixed.PROPERTY_PARTS:
            if part in names:
                out += [(f"docprops::{part}#{i}", decoded(m[2]), None, None, None) for i, m in enumerate(re.finditer(fixed.PROPERTY_NODE, _text(z, part)))]
    return out + (_extras(z, ext) if rest else [])


def _extras(z: zipfile.ZipFile, ext: str) -> list[tuple]:
    return [(seg, text, None, None, None) for part in z.namelist() if extras.has_places(ext, part) for seg, text in extras.read(ext, part, _text(z, part), decoded)]


def tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def address(cell: str) -> tuple[int, int]:
    m = re.fullmatch(r"([A-Z]+)(\d+)", cell)
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]) - 1, col - 1


def sheet_parts(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet of a workbook."""
    links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    sheets = [(e.get("name"), links[next(v for k, v in e.attrib.items() if k.endswith("}id"))]) for e in ET.fromstring(z.read("xl/workbook.xml")).iter() if tag(e) == "sheet"]
    return [(n, t.lstrip("/") if t.startswith("/") else f"xl/{t}") for n, t in sheets]


def _text_of(e: ET.Element) -> str:
    return "".join(t.text or "" for t in e.iter() if tag(t) == "t")


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    part = "xl/sharedStrings.xml"
    return [_text_of(e) for e in ET.fromstring(z.read(part)) if tag(e) == "si"] if part in z.namelist() else []


def comment_parts(z: zipfile.ZipFile, sheet: str) -> list[str]:
    """The parts that hold the comments of a sheet's part."""
    rels, names = re.sub(r"([^/]+)$", r"_rels/\1.rels", sheet), set(z.namelist())
    targets = [link.get("Target", "") for link in ET.fromstring(z.read(rels))] if rels in names else []
    paths = [t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(sheet), t)) for t in targets if "comments" in t.lower()]
    return [p for p in paths if p in names and "threaded" not in p.lower()]


def workbook_nodes(z: zipfile.ZipFile, only: list[str] | None = None, rest: bool = True) -> list[tuple]:
    """(seg_id, text, sheet, row, col) of string cells, properties, comments and what else there is."""
    out, notes = [], []
    composed = lambda t: unicodedata.normalize("NFC", t)
    names, shared = set(z.namelist()), shared_strings(z)
    for name, part in sheet_parts(z):
        if only is not None and part not in only:
            continue
        cells = []
        for c in ET.fromstring(z.read(part)).iter():
            if tag(c) == "c":
                value = next((v.text or "" for v in c if tag(v) == "v"), "")
                kind = c.get("t")
                text = shared[int(value)] if kind == "s" and value else _text_of(c) if kind == "inlineStr" else value if kind == "str" else None
                cells.append((c.get("r"), *address(c.get("r")), text))
        top, left = min((r for _, r, _, _ in cells), default=0), min((c for _, _, c, _ in cells), default=0)
        out += [(f"{name}!{a}", composed(text), name, r - top, c - left) for a, r, c, text in cells if text]
        for path in comment_parts(z, part):
            root = ET.fromstring(z.read(path))
            authors, seen = [a.text or "" for a in root.iter() if tag(a) == "author"], {}
            for c in (x for x in root.iter() if tag(x) == "comment"):
                i = seen[c.get("ref")] = seen.get(c.get("ref"), -1) + 1
                for side, text in (("t", _text_of(c)), ("a", authors[int(c.get("authorId", 0))] if authors else "")):
                    if text:
                        notes.append((f"xlsxcomment::{name}!{c.get('ref')}#{i}::{side}", composed(text), None, None, None))
    if not rest:
        return out + notes
    for part in fixed.PROPERTY_PARTS[:2]:
        for e in ET.fromstring(z.read(part)).iter() if part in names else ():
            if (key := fixed.WORKBOOK_PROPERTIES.get(tag(e).lower())) and e.text:
                out.append((f"xlsxprops::{key}", composed(e.text), None, None, None))
    part = fixed.PROPERTY_PARTS[2]
    for e in ET.fromstring(z.read(part)) if part in names else ():
        if (value := "".join(e.itertext())) and any(tag(v) in ("lpwstr", "lpstr") for v in e):
            out.append((f"xlsxcustprops::{e.get('name')}", composed(value), None, None, None))
    return out + notes + _extras(z, ".xlsx")


#: Formats that are archives of parts.
ARCHIVES = (*fixed.PARTS, ".xlsx")


def archive_nodes(z: zipfile.ZipFile, ext: str, only: list[str] | None = None, rest: bool = True) -> list[tuple]:
    """(seg_id, text, sheet, row, col) of an archive, or of some of its ``text_parts`` and, if asked for, what lies outside these."""
    return workbook_nodes(z, only, rest) if ext == ".xlsx" else _packed(z, ext, only, rest)


def csv_rows(data: bytes) -> list[list[str]]:
    return list(csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"), newline="")))


def nodes_of(ext: str, data: bytes, readers: dict[str, Reader]) -> list[tuple]:
    """(seg_id, text, sheet, row, col) of a file; text nodes outside tables have no place."""
    if ext == ".txt":
        return [("doc", unicodedata.normalize("NFC", data.decode("utf-8", "replace")), None, None, None)]
    if ext == ".csv":
        return [(f"r{r}c{c}", unicodedata.normalize("NFC", x), "", r, c) for r, row in enumerate(csv_rows(data)) for c, x in enumerate(row) if x]
    if ext in ARCHIVES:
        with opened(data) as z:
            return archive_nodes(z, ext)
    if ext in readers:
        return [(i, unicodedata.normalize("NFC", t), None, None, None) for i, t in readers[ext](data) if t]
    raise ValueError(f"no reader for {ext or 'files without an extension'}")


def read_nodes(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """NODE rows of files (path, content). An unknown extension is an error."""
    given = dict(readers or {})

    def rows(batches):
        for pdf in batches:
            for path, ext, data in zip(pdf["path"], pdf["ext"], pdf["content"], strict=True):
                made = [(path, ext, i, *node) for i, node in enumerate(nodes_of(ext, bytes(data), given))]
                frame = pd.DataFrame(made, columns=["path", "ext", "seq", "seg_id", "text", "sheet", "row", "col"])
                yield frame.astype({"row": "Int32", "col": "Int32"})

    return files.select("path", file_extension(F.col("path")).alias("ext"), "content").mapInPandas(rows, NODE)


def read_segments(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """``marked`` nodes of files (path, content): each file is parsed once, and its nodes are stored in the shared folder."""
    return marked(stored(read_nodes(files, readers)))


def marked(nodes: DataFrame) -> DataFrame:
    """(path, ext, seq, seg_id, text, is_header, forced_category, name_hint_only) of NODE rows.

    In sheets the best of the first five rows is the header; in tables of documents it is the first row, if there are two or
    more. Texts are composed; empty ones are left out."""
    nodes = nodes.withColumn("__cells", F.col("ext").isin(*_CELLS))
    keep = ("path", "ext", "seq", "seg_id", "text", "is_header", "forced_category", "name_hint_only")
    plain = nodes.where("sheet IS NULL").select("path", "ext", "seq", "seg_id", "text", F.lit(False).alias("is_header"), F.lit(None).cast("string").alias("forced_category"), F.lit(False).alias("name_hint_only"))
    sheets = mark_cells(nodes.where("sheet IS NOT NULL AND __cells"), ["path", "sheet"]).select(*keep)
    # cells of documents may hold several nodes: the words of a header are the cell's
    tables = nodes.where("sheet IS NOT NULL AND NOT __cells")
    tall = tables.groupBy("path", "sheet").agg(F.max("row").alias("last")).where("last >= 1").select("path", "sheet")
    heads = tables.where("row = 0").join(tall, ["path", "sheet"], "left_semi").groupBy("path", "sheet", "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"))
    named = header_columns(heads, ["path", "sheet"], 1).select("path", "sheet", "col", "category", "name_hint")
    with_header = named.select("path", "sheet", F.lit(True).alias("has")).distinct()
    header = F.coalesce(F.col("has") & (F.col("row") == 0), F.lit(False))
    placed = tables.join(with_header, ["path", "sheet"], "left").join(named, ["path", "sheet", "col"], "left").select(
        "path", "ext", "seq", "seg_id", "text", header.alias("is_header"), F.when(~header, F.col("category")).alias("forced_category"), (~header & F.coalesce(F.col("name_hint"), F.lit(False))).alias("name_hint_only")
    )
    return plain.unionByName(sheets).unionByName(placed)


def image_segments(meta: DataFrame, column: str = "meta") -> DataFrame:
    """meta with seg_id and text for each listed key of its map<string,string> that holds more than blanks."""
    pairs = F.filter(F.array(*(F.struct(F.lit(f"exif::{k}").alias("seg_id"), F.trim(F.element_at(F.col(column), k)).alias("text")) for k in fixed.IMAGE_KEYS)), lambda x: F.coalesce(x["text"] != "", F.lit(False)))
    return meta.select("*", F.inline(pairs))
