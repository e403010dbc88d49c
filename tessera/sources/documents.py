"""Texts out of files of several formats, and records out of the envelopes of catalogues."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from posixpath import dirname, join, normpath
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import _Text

#: Bounds of a safe archive: bytes in all, and how far a member may be packed; fixed values.
ZIP_BYTES, ZIP_RATIO = 512 << 20, 200
#: Parts of a book's files that hold no text of the work, and elements of an edition that don't; fixed values.
APPARATUS = ("colophon", "uncopyright", "imprint", "copyright-page", "copyright_page")
TEI_APPARATUS = frozenset({"teiheader", "note", "fw", "figdesc", "app", "back"})
#: Formats from the best to the worst; fixed order.
FORMATS = ("txt", "epub", "html", "xhtml", "xml", "tei", "pdf")


class UnsafeFile(ValueError):
    """A file that isn't opened: it declares entities or a document type, or unpacks to too much."""


def safe_xml(data: bytes) -> ET.Element:
    """The root of an XML document that declares no type and no entities."""
    if re.search(rb"<!\s*(?:DOCTYPE|ENTITY)", data, re.I):
        raise UnsafeFile("document types and entities aren't read")
    return ET.fromstring(data)


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1].lower() if isinstance(e.tag, str) else ""


def _all(root: ET.Element, name: str) -> list[ET.Element]:
    return [e for e in root.iter() if _name(e) == name]


def _first(root: ET.Element, name: str) -> str:
    return next((" ".join("".join(e.itertext()).split()) for e in _all(root, name)), "")


def safe_zip(data: bytes) -> zipfile.ZipFile:
    """An archive whose members stay within it and within the bounds of size."""
    z = zipfile.ZipFile(io.BytesIO(data))
    total = 0
    for m in z.infolist():
        total += m.file_size
        if m.filename.startswith("/") or ".." in m.filename.split("/") or total > ZIP_BYTES or m.file_size > ZIP_RATIO * max(m.compress_size, 1):
            raise UnsafeFile(f"{m.filename} isn't unpacked")
    return z


def decode(data: bytes) -> str:
    """By the mark at the beginning, else UTF-8, else Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def page(markup: str) -> str:
    """A page's text; blocks on lines of their own."""
    p = _Text()
    p.feed(markup)
    p.close()
    lines = (re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in "".join(p.out).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def epub(data: bytes) -> str:
    """The chapters of an EPUB in the order of its spine, without colophons and imprints; chapters that can't be read are left out."""
    z = safe_zip(data)
    package = next((e.get("full-path") for e in _all(safe_xml(z.read("META-INF/container.xml")), "rootfile")), None)
    root = safe_xml(z.read(package))
    files = {e.get("id"): e.get("href") for e in _all(root, "item")}
    texts = []
    for ref in _all(root, "itemref"):
        name = files.get(ref.get("idref"))
        if not name or any(a in f"{ref.get('idref')} {name}".lower() for a in APPARATUS):
            continue
        try:
            texts.append(page(decode(z.read(normpath(join(dirname(package), unquote(name)))))))
        except KeyError:
            continue
    return "\n\n".join(t for t in texts if t)


def tei(data: bytes) -> str:
    """The text of a TEI edition, or of any XML document, without its apparatus; paragraphs, heads and lines end with a break."""
    root = safe_xml(data)
    body = next(iter(_all(root, "text")), root) if _name(root) in ("tei", "tei.2", "teicorpus") else root
    out: list[str] = []

    def walk(e: ET.Element) -> None:
        todo = [(e, False)]
        while todo:
            x, done = todo.pop()
            if done:
                if _name(x) in ("p", "head", "l", "ab", "div", "title", "item"):
                    out.append("\n\n" if _name(x) in ("p", "head", "div") else "\n")
                out.append(x.tail or "" if x is not e else "")
            elif _name(x) in TEI_APPARATUS or not isinstance(x.tag, str):
                out.append(x.tail or "")
            else:
                out.append(re.sub(r"\s+", " ", x.text or ""))
                todo.append((x, True))
                todo += [(c, False) for c in reversed(x)]

    walk(body)
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in "".join(out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


_SHOWN = re.compile(rb"\[((?:\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ|(\((?:\\.|[^\\()])*\))\s*(?:Tj|['\"])|(T\*|Td|TD|ET)")
_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def pdf(data: bytes) -> str:
    """The text layer of a PDF in the order of its streams; empty for pictures of pages."""
    out: list[bytes] = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        try:
            body = zlib.decompress(m[1])
        except zlib.error:
            body = m[1]
        if b"BT" not in body:
            continue
        for shown in _SHOWN.finditer(body):
            if shown[3]:
                out.append(b"\n")
            else:
                for s in _STRING.findall(shown[1] or shown[2]):
                    out.append(re.sub(rb"\\([0-7]{1,3}|.)", lambda e: bytes([int(e[1], 8) & 255]) if e[1][:1].isdigit() else _ESCAPES.get(e[1], e[1]), s))
    return re.sub(r"\n{2,}", "\n", decode(b"".join(out))).strip()


def extracted(data: bytes, kind: str) -> str:
    """The text of a file by its type; an error for a type that isn't known."""
    if kind in ("application/epub+zip", "application/zip", "epub"):
        return epub(data)
    if kind in ("text/html", "application/xhtml+xml", "html"):
        return page(decode(data))
    if kind in ("application/xml", "text/xml", "application/tei+xml", "xml", "tei"):
        return tei(data)
    if kind in ("application/pdf", "pdf"):
        return pdf(data)
    if kind in ("text/plain", "txt"):
        return decode(data).replace("\r\n", "\n").strip()
    raise ValueError(f"unknown type {kind!r}")


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def extract_text(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
    """``(text, error)`` of whole files; a file that can't be read has an error and no text, a null one neither."""

    def one(data: bytes | None, k: str | None) -> tuple[str | None, str | None]:
        if data is None:
            return None, None
        try:
            return extracted(bytes(data), k or ""), None
        except Exception as e:  # noqa: BLE001  one bad file must not end the job
            return None, f"{type(e).__name__}: {e}"

    return pd.DataFrame([one(d, k) for d, k in zip(content, kind)], columns=["text", "error"])


def format_rank(name: str) -> int:
    """A format's place from the best; unknown ones come last."""
    return FORMATS.index(name) if name in FORMATS else len(FORMATS)


_RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "title", "language", "kind", "rights", "date")] + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("creators", "subjects", "links")])
_PAGE = T.StructType([T.StructField("records", T.ArrayType(_RECORD)), T.StructField("next", T.StringType()), T.StructField("total", T.LongType())])


def _dublin_core(e: ET.Element, name: str) -> dict:
    each = lambda n: [" ".join("".join(x.itertext()).split()) for x in _all(e, n) if "".join(x.itertext()).strip()]
    ids = each("identifier")
    links = [i for i in ids if re.match(r"https?://", i)]
    return {"id": name or next((i for i in ids if i not in links), ids[0] if ids else None), "title": next(iter(each("title")), None), "language": next(iter(each("language")), None), "kind": next(iter(each("type")), None), "rights": next(iter(each("rights")), None), "date": next(iter(each("date")), None), "creators": each("creator"), "subjects": each("subject"), "links": links}


def catalogue_page(data: bytes) -> dict:
    """Records, the next page's token and the total of an OAI-PMH, SRU or OPDS/Atom answer; deleted records are left out."""
    root = safe_xml(data)
    kind = _name(root)
    if kind == "oai-pmh":
        live = [r for r in _all(root, "record") if not any(h.get("status") == "deleted" for h in _all(r, "header"))]
        token = next(iter(_all(root, "resumptiontoken")), None)
        size = token.get("completeListSize") if token is not None else None
        return {"records": [_dublin_core(r, next((_first(h, "identifier") for h in _all(r, "header")), "")) for r in live], "next": (token.text or "").strip() or None if token is not None else None, "total": int(size) if size else None}
    if kind == "searchretrieveresponse":
        total, following = _first(root, "numberofrecords"), _first(root, "nextrecordposition")
        return {"records": [_dublin_core(r, "") for r in _all(root, "record")], "next": following or None, "total": int(total) if total.isdigit() else None}
    if kind == "feed":
        rows = []
        for e in _all(root, "entry"):
            row = _dublin_core(e, _first(e, "id"))
            row["creators"] = [_first(a, "name") for a in _all(e, "author")] or row["creators"]
            row["subjects"] = [c.get("label") or c.get("term") for c in _all(e, "category")] or row["subjects"]
            row["date"] = row["date"] or _first(e, "issued") or _first(e, "updated") or None
            row["links"] = [x.get("href") for x in _all(e, "link") if x.get("href") and "acquisition" in (x.get("rel") or "")]
            rows.append(row)
        following = next((x.get("href") for x in root if _name(x) == "link" and x.get("rel") == "next"), None)
        return {"records": rows, "next": following, "total": None}
    raise ValueError(f"unknown envelope {kind!r}")


@F.pandas_udf(_PAGE)
def catalogue_pages(content: pd.Series) -> pd.DataFrame:
    """:func:`catalogue_page` of each answer; null for a null one, an error for one that can't be read."""
    return pd.DataFrame([{"records": None, "next": None, "total": None} if c is None else catalogue_page(c if isinstance(c, bytes) else str(c).encode()) for c in content], columns=["records", "next", "total"])


def alto(data: bytes) -> str:
    """The words of an ALTO page, a line a line and a blank line between blocks; a word broken over a line end is whole."""
    blocks = []
    for b in _all(safe_xml(data), "textblock"):
        lines = []
        for line in _all(b, "textline"):
            words = []
            for s in _all(line, "string"):
                if s.get("SUBS_TYPE") == "HypPart2":
                    continue
                words.append(s.get("SUBS_CONTENT") if s.get("SUBS_TYPE") == "HypPart1" else s.get("CONTENT") or "")
            lines.append(" ".join(w for w in words if w))
        blocks.append("\n".join(x for x in lines if x))
    return "\n\n".join(b for b in blocks if b)
