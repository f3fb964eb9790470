"""Chapters and sections out of zipped documents ``(path, content)``; each file is unpacked in its own row."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

#: Characters of text after which a batch of rows is handed over.
CHARS = 1 << 22


def _name(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _all(root: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in root.iter() if _name(e.tag) == name]


def epub_chapters(content: bytes) -> list[tuple[int, str | None, str | None, str | None]]:
    """(spine place, href, html, why it was skipped) in the order of the spine; a broken archive is one skipped row."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        package = _all(ElementTree.fromstring(z.read("META-INF/container.xml")), "rootfile")[0].attrib["full-path"]
        opf = ElementTree.fromstring(z.read(package))
    except (zipfile.BadZipFile, KeyError, IndexError, ElementTree.ParseError) as e:
        return [(0, None, None, f"unreadable: {type(e).__name__}")]
    manifest = {e.attrib.get("id", ""): e.attrib for e in _all(opf, "item")}
    names, out = set(z.namelist()), []
    for i, ref in enumerate(_all(opf, "itemref")):
        item = manifest.get(ref.attrib.get("idref", ""))
        if item is None:
            out.append((i, None, None, "missing manifest item"))
            continue
        href = posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(item.get("href", "").split("#")[0].split("?")[0])))
        if "html" not in item.get("media-type", ""):
            out.append((i, href, None, "unsupported media type"))
        elif href not in names:
            out.append((i, href, None, "missing file"))
        else:
            out.append((i, href, z.read(href).decode("utf-8", "replace"), None))
    return out


def hwpx_paragraphs(content: bytes) -> list[tuple[int, str | None, str | None, str | None]]:
    """(place, section, paragraph text, why it was skipped); sections by the spine, else by name, so section10 stands before section2."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        names = z.namelist()
        sections: list[str] = []
        for spine in (n for n in names if n.lower().endswith("content.hpf")):
            root = ElementTree.fromstring(z.read(spine))
            hrefs = {e.attrib.get("id"): e.attrib.get("href", "") for e in _all(root, "item")}
            sections = [h for e in _all(root, "itemref") if "section" in (h := hrefs.get(e.attrib.get("idref"), "")) and h in names]
        sections = sections or sorted(n for n in names if n.rpartition("/")[2].startswith("section") and n.endswith(".xml"))
        out: list[tuple] = []
        for s in sections:
            for p in _all(ElementTree.fromstring(z.read(s)), "p"):
                out.append((len(out), s, "".join(t.text or "" for t in _all(p, "t")), None))
        return out
    except (zipfile.BadZipFile, ElementTree.ParseError) as e:
        return [(0, None, None, f"unreadable: {type(e).__name__}")]


def unpacked(files: DataFrame, kind: str) -> DataFrame:
    """``path, place, part, text, skipped`` of EPUB (``epub``) or HWPX (``hwpx``) files."""
    read = {"epub": epub_chapters, "hwpx": hwpx_paragraphs}[kind]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=["path", "place", "part", "text", "skipped"])
        for part in parts:
            rows, chars = [], 0
            for path, content in zip(part["path"], part["content"]):
                for r in read(content):
                    rows.append((path, *r))
                    chars += len(r[2] or "")
                if chars > CHARS:
                    yield frame(rows)
                    rows, chars = [], 0
            yield frame(rows)

    return files.select("path", "content").mapInPandas(run, "path string, place int, part string, text string, skipped string")
