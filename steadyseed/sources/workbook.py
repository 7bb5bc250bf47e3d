"""Cells of one .xlsx file, with the standard library only."""

from __future__ import annotations

from collections.abc import Iterator
import io
import re
from xml.etree import ElementTree
import zipfile

# The namespaces of the Office Open XML spreadsheet format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _sheet_path(archive: zipfile.ZipFile, sheet: int) -> str:
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    wanted = book.findall(f"{MAIN}sheets/{MAIN}sheet")[sheet].get(RELATION)
    links = ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
    target = next(link.get("Target") for link in links if link.get("Id") == wanted)
    return target.lstrip("/") if target.startswith("/") else "xl/" + target


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - ord("A") + 1
    return number - 1


def sheet_rows(content: bytes, sheet: int = 0) -> Iterator[list[str | None]]:
    """Rows of the sheet as text, gaps as None, read as a stream of elements."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter(f"{MAIN}t")))
        with archive.open(_sheet_path(archive, sheet)) as stream:
            for _, element in ElementTree.iterparse(stream):
                if element.tag != f"{MAIN}row":
                    continue
                cells: list[str | None] = []
                for cell in element.findall(f"{MAIN}c"):
                    at = _column_number(cell.get("r")) if cell.get("r") else len(cells)
                    cells.extend([None] * (at + 1 - len(cells)))
                    cells[at] = _cell_text(cell, shared)
                element.clear()
                yield cells


def _cell_text(cell, shared: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    value = cell.findtext(f"{MAIN}v")
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    return value
