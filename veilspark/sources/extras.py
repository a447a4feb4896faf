"""Places in office archives, besides the running text and cells, where people leave personal data: headers and footers, notes,
comments and their authors, links, defined names, drawings. They are segments like any other, so nothing there stays unmasked."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Place:
    """Texts of the parts that ``part`` fits: the group t of ``item``, as an attribute or between tags."""

    formats: tuple[str, ...]
    part: re.Pattern
    item: re.Pattern
    mark: str
    attribute: bool = False


def _attribute(element: str, name: str) -> re.Pattern:
    return re.compile(rf'<(?:\w+:)?(?:{element})\b[^>]*?\b{name}="(?P<t>[^"]*)"')


def _inside(element: str) -> re.Pattern:
    return re.compile(rf"<(?P<e>(?:\w+:)?(?:{element}))(?:\s[^>]*)?>(?P<t>[^<]*)</(?P=e)>")


_OFFICE = (".docx", ".pptx", ".xlsx")
#: A relationship that leads out of the archive, as links and mail addresses do.
_OUTSIDE = re.compile(r'<(?:\w+:)?\w+\b[^>]*?\bTarget="(?P<t>[A-Za-z][A-Za-z0-9+.-]*:[^"]*)"')
PLACES = [
    Place((".docx",), re.compile(r"^word/(?:header|footer|footnotes|endnotes|comments)\d*\.xml$"), re.compile(r"<w:t(?:\s[^>]*)?>(?P<t>[^<]*)</w:t>"), "text"),
    Place((".docx",), re.compile(r"^word/[^/]+\.xml$"), re.compile(r'\b(?:w|w15):(?:author|initials)="(?P<t>[^"]*)"'), "author", True),
    Place((".pptx",), re.compile(r"^ppt/(?:comments|slideMasters|slideLayouts|notesMasters|handoutMasters)/[^/]+\.xml$"), _inside("t|text"), "text"),
    Place((".pptx",), re.compile(r"^ppt/(?:commentAuthors|authors)\.xml$"), _attribute("cmAuthor|author", "name"), "author", True),
    Place((".xlsx",), re.compile(r"^xl/worksheets/[^/]+\.xml$"), _attribute("hyperlink", "display"), "display", True),
    Place((".xlsx",), re.compile(r"^xl/worksheets/[^/]+\.xml$"), _attribute("hyperlink", "tooltip"), "tooltip", True),
    Place((".xlsx",), re.compile(r"^xl/worksheets/[^/]+\.xml$"), _inside("(?:odd|even|first)(?:Header|Footer)"), "margin"),
    Place((".xlsx",), re.compile(r"^xl/workbook\.xml$"), _inside("definedName"), "name"),
    Place((".xlsx",), re.compile(r"^xl/threadedComments/[^/]+\.xml$"), _inside("text"), "thread"),
    Place((".xlsx",), re.compile(r"^xl/persons/[^/]+\.xml$"), _attribute("person", "displayName"), "person", True),
    Place((".xlsx",), re.compile(r"^xl/(?:drawings|diagrams)/[^/]+\.xml$"), _inside("t"), "drawing"),
    Place(_OFFICE, re.compile(r"\.rels$"), _OUTSIDE, "link", True),
]


def _found(ext: str, part: str, xml: str):
    for place in PLACES:
        if ext in place.formats and place.part.search(part):
            for i, m in enumerate(place.item.finditer(xml)):
                yield f"{part}@{place.mark}#{i}", m.start("t"), m.end("t"), place.attribute


def has_places(ext: str, part: str) -> bool:
    return any(ext in p.formats and p.part.search(part) for p in PLACES)


def read(ext: str, part: str, xml: str, decoded) -> list[tuple[str, str]]:
    """(seg_id, text) of the places of a part that hold text."""
    return [(seg, decoded(xml[a:b])) for seg, a, b, _ in _found(ext, part, xml) if b > a]


def replaced(ext: str, part: str, xml: str, masked: dict[str, str], encoded) -> str:
    """The part with the texts of its places replaced."""
    cuts = sorted((a, b, masked[seg], attribute) for seg, a, b, attribute in _found(ext, part, xml) if b > a and seg in masked)
    out, at = [], 0
    for a, b, new, attribute in cuts:
        out += [xml[at:a], encoded(new).replace('"', "&quot;") if attribute else encoded(new)]
        at = b
    return "".join([*out, xml[at:]])
