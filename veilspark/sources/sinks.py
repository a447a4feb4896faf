"""Masked segments back into files."""

from __future__ import annotations

import csv
import io
import re
import unicodedata
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.operators.control import file_extension, output_name
from veilspark.sources import extras
from veilspark.sources.files import archive_nodes, comment_parts, csv_rows, decoded, node_id, opened, parts_of, shared_strings, sheet_parts, tag


def _encoded(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _nodes(xml: str, pattern: str, name, masked: dict[str, str]) -> str:
    """The part with the inner text of its numbered nodes replaced."""
    count = iter(range(len(xml)))

    def swap(m: re.Match) -> str:
        new = masked.get(name(next(count)))
        low, high = m.start(2) - m.start(), m.end(2) - m.start()
        return m[0] if new is None or not m[2] else m[0][:low] + _encoded(new) + m[0][high:]

    return re.sub(pattern, swap, xml)


def _rezip(data: bytes, change) -> bytes:
    """The archive with each entry as change(name, bytes) gives it."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for info in z.infolist():
            to.writestr(info, change(info.filename, z.read(info)))
    return out.getvalue()


def _changed(data: bytes, ext: str, masked: dict[str, str]) -> dict[str, str]:
    """Old texts of an archive's segments that are masked, with their new ones."""
    with opened(data) as z:
        return {old: masked[seg] for seg, old, *_ in archive_nodes(z, ext) if seg in masked and masked[seg] != old}


def _repeated(xml: str, changed: dict[str, str]) -> str:
    """Texts between tags and attributes that repeat a masked segment whole, such as caches of charts, follow it."""
    if not changed:
        return xml
    now = lambda t: changed.get(decoded(t))
    swap = lambda m: m[0] if not m[1].strip() or (new := now(m[1])) is None else f"{m[0][0]}{_encoded(new).replace(chr(34), '&quot;')}{m[0][-1]}"
    return re.sub('"([^"<>]*)"', swap, re.sub(">([^<>]+)<", swap, xml))


def _packed(data: bytes, ext: str, masked: dict[str, str]) -> bytes:
    with opened(data) as z:
        parts = set(parts_of(z.namelist(), ext))
    changed = _changed(data, ext, masked)

    def change(name: str, body: bytes) -> bytes:
        if ext == ".hwpx" and name == fixed.PREVIEW:
            return masked.get(f"{name}#0", body.decode("utf-8", "replace")).encode()
        if not name.endswith((".xml", ".rels")):
            return body
        xml = extras.replaced(ext, name, body.decode("utf-8", "replace"), masked, _encoded)
        if name in parts:
            xml = _nodes(xml, fixed.TEXT_NODE[ext], lambda i: node_id(ext, name, i), masked)
        elif ext != ".hwpx" and name in fixed.PROPERTY_PARTS:
            xml = _nodes(xml, fixed.PROPERTY_NODE, lambda i: f"docprops::{name}#{i}", masked)
        elif not name.endswith(".rels") and name != "[Content_Types].xml":
            xml = _repeated(xml, changed)
        return xml.encode()

    return _rezip(data, change)


def _parsed(body: bytes) -> ET.Element:
    for prefix, uri in (x for _, x in ET.iterparse(io.BytesIO(body), events=["start-ns"])):
        if not re.fullmatch(r"ns\d+", prefix):  # such names are the serialiser's own
            ET.register_namespace(prefix, uri)
    return ET.fromstring(body)


def _serialised(root: ET.Element) -> bytes:
    """XML without mention, in a list of ignorable prefixes, of one that is declared no more."""
    xml = ET.tostring(root, encoding="unicode")
    known = set(re.findall(r"xmlns:([^=\s]+)=", xml))
    listed = lambda m: f'{m[1]}"{" ".join(p for p in m[2].split() if p in known)}"'
    return ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + re.sub(r'(:Ignorable=)"([^"]*)"', listed, xml)).encode()


def _emptied(e: ET.Element) -> str:
    """Removes all inside an element; its name's part for the namespace."""
    for child in list(e):
        e.remove(child)
    e.text = None
    return e.tag[: -len(tag(e))]


def _sheet(root: ET.Element, name: str, shared: list[str], masked: dict[str, str]) -> None:
    """String cells become inline strings, masked or as they are, so that none needs the table of shared strings."""
    for c in (e for e in root.iter() if tag(e) == "c"):
        kind, new = c.get("t"), masked.get(f"{name}!{c.get('r')}")
        if kind == "s" and new is None:
            value = next((v.text for v in c if tag(v) == "v"), None)
            new = shared[int(value)] if value else None
        if new is not None and kind in ("s", "str", "inlineStr"):
            space = _emptied(c)
            c.set("t", "inlineStr")
            ET.SubElement(ET.SubElement(c, f"{space}is"), f"{space}t").text = new


def _comments(root: ET.Element, name: str, masked: dict[str, str]) -> None:
    authors, seen = [a for a in root.iter() if tag(a) == "author"], {}
    for c in (x for x in root.iter() if tag(x) == "comment"):
        i = seen[c.get("ref")] = seen.get(c.get("ref"), -1) + 1
        text, author = (masked.get(f"xlsxcomment::{name}!{c.get('ref')}#{i}::{side}") for side in "ta")
        if text is not None:
            for e in (x for x in c if tag(x) == "text"):
                space = _emptied(e)
                ET.SubElement(e, f"{space}t").text = text
        if author is not None and authors:
            authors[int(c.get("authorId", 0))].text = author


def _properties(root: ET.Element, name: str, masked: dict[str, str]) -> None:
    if name == fixed.PROPERTY_PARTS[2]:
        for e in root:
            if (new := masked.get(f"xlsxcustprops::{e.get('name')}")) is not None:
                for v in (x for x in e if tag(x) in ("lpwstr", "lpstr")):
                    v.text = new
        return
    for e in root.iter():
        if (key := fixed.WORKBOOK_PROPERTIES.get(tag(e).lower())) and (new := masked.get(f"xlsxprops::{key}")) is not None:
            e.text = new


def _echoes(root: ET.Element, changed: dict[str, str]) -> None:
    """Other parts, such as caches of pivot tables, names of table columns and notes in drawings, may repeat a masked text whole."""
    now = lambda t: changed.get(unicodedata.normalize("NFC", t), t) if t else t
    for e in root.iter():
        e.text, e.tail = now(e.text), now(e.tail)
        for k, v in e.attrib.items():
            e.set(k, now(v))


def _workbook(data: bytes, masked: dict[str, str]) -> bytes:
    """Masked strings in cells, comments and properties; nothing is left in the table of shared strings, and no other part
    repeats a masked text. Links, defined names and threaded comments are segments of their own. Numbers and formulas without
    text stay."""
    with opened(data) as z:
        sheets, shared = {part: name for name, part in sheet_parts(z)}, shared_strings(z)
        notes = {path: name for part, name in sheets.items() for path in comment_parts(z, part)}
    changed = _changed(data, ".xlsx", masked)

    def change(name: str, body: bytes) -> bytes:
        if name == "[Content_Types].xml" or not name.endswith((".xml", ".vml", ".rels")):
            return body
        if extras.has_places(".xlsx", name):
            body = extras.replaced(".xlsx", name, body.decode("utf-8", "replace"), masked, _encoded).encode()
        if name.endswith(".rels"):
            return body
        root = _parsed(body)
        if name in sheets:
            _sheet(root, sheets[name], shared, masked)
        elif name == "xl/sharedStrings.xml":
            _emptied(root)
            root.attrib.update(count="0", uniqueCount="0")
        elif name in notes:
            _comments(root, notes[name], masked)
        elif name in fixed.PROPERTY_PARTS:
            _properties(root, name, masked)
        else:
            _echoes(root, changed)
        return _serialised(root)

    return _rezip(data, change)


def _csv(data: bytes, masked: dict[str, str]) -> bytes:
    out = io.StringIO()
    csv.writer(out, lineterminator="\r\n").writerows([masked.get(f"r{r}c{c}", x) for c, x in enumerate(row)] for r, row in enumerate(csv_rows(data)))
    return out.getvalue().removesuffix("\r\n").encode()


def _image(masked: dict[str, str]) -> str:
    lines = [f"- {k}: {masked[f'exif::{k}']}" for k in fixed.IMAGE_KEYS if masked.get(f"exif::{k}")]
    foot = ["", "---", fixed.IMAGE_FOOTER, *lines, ""] if lines else []
    return masked.get("ocr", "") + "\n".join(foot)


def written(ext: str, data: bytes, masked: dict[str, str]) -> bytes:
    """The bytes of a file with its segments replaced. Formats without a way back become their segments' lines."""
    if ext == ".txt":
        return masked.get("doc", "").encode()
    if ext == ".csv":
        return _csv(data, masked)
    if ext in fixed.TEXT_NODE:
        return _packed(data, ext, masked)
    if ext == ".xlsx":
        return _workbook(data, masked)
    if ext in (".png", ".jpg", ".jpeg", ".webp"):
        return _image(masked).encode()
    return "\n".join(masked.values()).encode()


def write_masked(files: DataFrame, segments: DataFrame) -> DataFrame:
    """(path, name, content): files (path, content) with the masked texts of segments (path, seq, seg_id, masked).

    The segments of one file meet in one row; files meet each other nowhere."""
    def rows(batches):
        for pdf in batches:
            made = [written(e, bytes(c), {x["seg_id"]: x["masked"] for x in s} if s is not None else {}) for e, c, s in zip(pdf["ext"], pdf["content"], pdf["segments"], strict=True)]
            yield pd.DataFrame({"path": pdf["path"], "name": pdf["name"], "content": made})

    by_file = segments.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "seg_id", "masked"))).alias("segments"))
    joined = files.select("path", "content").join(by_file, "path", "left")
    name = output_name(F.regexp_extract("path", r"[^/]*$", 0))
    return joined.select("path", name.alias("name"), file_extension(F.col("path")).alias("ext"), "content", "segments").mapInPandas(rows, "path string, name string, content binary")
