"""Files of all formats as records: text, Markdown, MHTML, DOCX, PDF, captions."""

from __future__ import annotations

import email
import io
import re
import zipfile
from collections.abc import Iterator
from email import policy
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.unicode import decode_bytes
from ..operators.planning import reader_for

#: Labels of header lines, by field.
LABELS = {
    "original_author": "原作者|原文作者|original author",
    "current_publisher": "当前发布者|发布账号|页面账号|转发账号|账号|公众号|publisher",
    "author": "作者|author",
    "published_at": "发布时间|发布日期|日期|published|date",
}
FIELDS = ["title", "author_or_account", "current_publisher", "original_author", "published_at", "original_url", "body", "resource_references", "detected_encoding", "error"]
SCHEMA = "title string, author_or_account string, current_publisher string, original_author string, published_at string, original_url string, body string, resource_references array<string>, detected_encoding string, error string"


def header_fields(body: str) -> dict[str, str]:
    """What the first 30 lines that are not blank say in ``label: value`` form, the first hit of each field."""
    out: dict[str, str] = {}
    for line in [x.strip() for x in body.splitlines() if x.strip()][:30]:
        if m := re.match(r"#{1,6}\s+(.+)$", line):
            out.setdefault("title", m[1].strip())
        for field, names in LABELS.items():
            if m := re.match(rf"(?:{names})\s*[:：]\s*(.+)$", line, re.I):
                out.setdefault(field, m[1].strip())
        if m := re.search(r"https?://[^\s)>\]]+", line):
            out.setdefault("url", m[0].rstrip(".,;，。；"))
    return out


FRONT = re.compile(r"\A[ \t]*---[ \t]*\n(.*?)(?:(?<=\n)|\A)[ \t]*---[ \t]*(?:\n|\Z)", re.S)
ENTRY = re.compile(r"^([^:\n]+):(.*)$", re.M)


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """The key: value lines of a leading block between ``---`` lines, and the text after it; a block that does not end
    is text.  Keys in lower case; entries without a key or a value do not count, the last of a key does."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    block = FRONT.match(text)
    if not block:
        return {}, text
    entries = ((k.strip().lower(), v.strip().strip("'\"")) for k, v in ENTRY.findall(block[1]))
    return {k: v for k, v in entries if k and v}, text[block.end() :]


def structured(text: str) -> str:
    lines = [x.rstrip() for x in text.replace("\r\n", "\n").replace("\r", "\n").replace("\u00a0", " ").split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


#: Keys of front matter and header lines for each field, in order of preference.
SOURCES = {
    "title": (("title",), "title"),
    "author_or_account": (("author", "account"), "author"),
    "current_publisher": (("publisher", "account"), "current_publisher"),
    "original_author": (("original_author",), "original_author"),
    "published_at": (("date", "published_at"), "published_at"),
    "original_url": (("url", "source_url"), "url"),
}


def from_text(data: bytes, markdown: bool) -> dict:
    """A text, or Markdown, which keeps its indentation and whose front matter is taken off; a blank one is an error."""
    from .html import first, tidy

    text, encoding = decode_bytes(data)
    front, rest = front_matter(text) if markdown else ({}, text)
    body = structured(rest) if markdown else tidy(rest)
    if not body:
        raise ValueError("the file has no text")
    head = header_fields(body)
    return {field: first(*(front.get(k) for k in keys), head.get(line)) for field, (keys, line) in SOURCES.items()} | {"body": body, "detected_encoding": encoding}


def from_html(data: bytes, url: str | None = None, title: str | None = None, declared: str | None = None) -> dict:
    from .html import extract

    text, encoding = decode_bytes(data, declared=declared)
    record = extract(text, url, title)
    record.pop("html_meta")
    return record | {"detected_encoding": encoding}


def from_mhtml(data: bytes) -> dict:
    """The first HTML part, else the first plain one; Subject and Content-Location fill in."""
    message = email.message_from_bytes(data, policy=policy.default)
    parts = [p for p in message.walk() if not p.is_multipart()]
    for kind in ("text/html", "text/plain"):
        for p in parts:
            if p.get_content_type() == kind:
                raw = p.get_payload(decode=True) or b""
                where = str(p.get("Content-Location") or message.get("Content-Location") or "") or None
                subject = str(message.get("Subject") or "") or None
                if kind == "text/html":
                    return from_html(raw, where, subject, p.get_content_charset())
                record = from_text(raw, False)
                return record | {"title": record["title"] or subject, "original_url": record["original_url"] or where}
    raise ValueError("no text part")


def from_docx(data: bytes) -> dict:
    """All paragraphs in order, those in tables included, and the core properties."""
    from .html import tidy

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
        core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else None
    lines = []
    for p in root.iter(f"{w}p"):
        lines.append("".join(x.text or "" if x.tag == f"{w}t" else "\t" if x.tag == f"{w}tab" else "\n" if x.tag in (f"{w}br", f"{w}cr") else "" for x in p.iter()))
    body = tidy("\n".join(lines))
    known = {x.tag.rpartition("}")[2]: (x.text or "").strip() for x in core} if core is not None else {}
    head = header_fields(body)
    return {
        "title": known.get("title") or head.get("title"), "author_or_account": known.get("creator") or head.get("author"), "current_publisher": head.get("current_publisher"),
        "original_author": head.get("original_author"), "published_at": known.get("created") or head.get("published_at"), "original_url": head.get("url"), "body": body, "detected_encoding": "docx-xml",
    }


def from_pdf(data: bytes, reader=None) -> dict:
    """The text layer; pages without any text are an error, never an empty success.  reader: a function of a binary
    file that gives an object with ``pages``; by default that of pypdf, where it is installed."""
    from .html import tidy

    if reader is None:
        try:
            from pypdf import PdfReader as reader
        except ImportError as e:
            raise RuntimeError("reading PDF needs pypdf") from e
    pdf = reader(io.BytesIO(data))
    if getattr(pdf, "is_encrypted", False) and not pdf.decrypt(""):
        raise ValueError("the file is encrypted")
    body = tidy("\n\n".join(p.extract_text() or "" for p in pdf.pages))
    if not body:
        raise ValueError("no text layer: the file needs OCR")
    head, meta = header_fields(body), getattr(pdf, "metadata", None)
    known = lambda k: getattr(meta, k, None) if meta is not None else None
    return {
        "title": known("title") or head.get("title"), "author_or_account": known("author") or head.get("author"), "current_publisher": head.get("current_publisher"),
        "original_author": head.get("original_author"), "published_at": head.get("published_at"), "original_url": head.get("url"), "body": body, "detected_encoding": "pdf-text",
    }


def from_caption(data: bytes, kind: str) -> dict:
    from .captions import cues

    text, encoding = decode_bytes(data, "transcript")
    return {"body": "\n".join(t for _, _, t in cues(text, kind)), "detected_encoding": encoding}


READERS = {
    "html": from_html, "mhtml": from_mhtml, "text": lambda d: from_text(d, False), "markdown": lambda d: from_text(d, True), "docx": from_docx, "pdf": from_pdf,
}


def discover(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, length, modificationTime, content of the files that a reader takes, without outputs and hidden folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{html,htm,mhtml,mht,txt,md,docx,pdf,srt,vtt,HTML,HTM,MHTML,MHT,TXT,MD,DOCX,PDF,SRT,VTT}").load(folder)
    skip = r"/(?:\.git|__pycache__|[^/]*_files|[^/]*\.files|[^/]*_processed)/"
    return files.where(~F.col("path").rlike(skip))


def extract_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, format, the record of each file and error: what cannot be read has an error and no body."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, kind, data in zip(b["path"], b["format"], b["content"]):
                row = {"path": p, "format": kind}
                try:
                    if data is None:
                        raise ValueError("no content")
                    if kind in ("caption",):
                        row |= from_caption(bytes(data), p.rpartition(".")[2].lower())
                    elif kind in READERS:
                        row |= READERS[kind](bytes(data))
                    else:
                        raise ValueError("no reader takes this format")
                except Exception as e:  # one file must not end the job
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield filled(pd.DataFrame(rows, columns=["path", "format", *FIELDS]))

    from .html import filled

    rows = files.select(F.col(path).alias("path"), reader_for(F.col(path)).alias("format"), F.col(content).alias("content"))
    return rows.mapInPandas(each, f"path string, format string, {SCHEMA}")


def batch_counts(extracted: DataFrame) -> DataFrame:
    return extracted.agg(F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count("*").alias("total"))
