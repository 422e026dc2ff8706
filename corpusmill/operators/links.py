"""Links of Markdown files: spans, targets, closure and rebasing."""

from __future__ import annotations

import itertools
import posixpath
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

_FENCE = re.compile(r"^[ ]{0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^[ ]{0,3}\1[`~]*[ \t]*$|\Z)", re.M | re.S)
_TICKS = re.compile(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_DEFINITION = re.compile(r"^[ ]{0,3}\[[^\]\n]+\]:[ \t]*(<[^>\n]*>|\S+)", re.M)
_ATTRIBUTE = re.compile(r"""\b(?:src|href)\s*=\s*(?:"([^"]*)"|'([^']*)')""", re.I)
_SCHEME = re.compile(r"^[a-z][a-z0-9+.-]*:", re.I)
REMOTE = ("http:", "https:", "mailto:", "data:", "tel:")


def masked(text: str) -> str:
    """Code blanked out, at equal length."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    return _TICKS.sub(blank, _FENCE.sub(blank, text))


def spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, destination, form) of inline links, reference definitions and src or href attributes, in order."""
    clean, out = masked(text), []
    at = clean.find("](")
    while at >= 0:
        k = at + 2
        while k < len(clean) and clean[k] in " \t":
            k += 1
        if clean[k : k + 1] == "<":
            end = clean.find(">", k)
            if end >= 0:
                out.append((k + 1, end, text[k + 1 : end], "inline"))
        else:
            end, depth = k, 0
            while end < len(clean) and not clean[end].isspace():
                if clean[end] == "\\":
                    end += 1
                elif clean[end] == "(":
                    depth += 1
                elif clean[end] == ")":
                    if not depth:
                        break
                    depth -= 1
                end += 1
            end = min(end, len(clean))
            if end > k:
                out.append((k, end, text[k:end], "inline"))
        at = clean.find("](", at + 2)
    for m in _DEFINITION.finditer(clean):
        a, b = m.span(1)
        if clean[a] == "<":
            a, b = a + 1, b - 1
        out.append((a, b, text[a:b], "definition"))
    for m in _ATTRIBUTE.finditer(clean):
        a, b = m.span(1) if m[1] is not None else m.span(2)
        out.append((a, b, text[a:b], "attribute"))
    return sorted(set(out))


def target(raw: str, folder: str, absolute: bool = True) -> tuple[str | None, str, str]:
    """(path, suffix, kind): where a destination leads from a folder; suffix is its query and fragment.

    kind: local, remote (also anchors and protocol-relative ones), or error (unknown scheme; absolute if not wanted).
    """
    dest = re.sub(r"\\([\\()<>\[\]#&?%])", r"\1", raw.strip())
    low = dest.lower()
    if not dest or dest.startswith(("#", "//")) or low.startswith(REMOTE):
        return None, "", "remote"
    if _SCHEME.match(dest):
        return None, "", "error"
    m = re.match(r"[^?#]*", dest)
    path, suffix = unquote(m[0]), dest[m.end() :]
    if path.startswith("/"):
        return (posixpath.normpath(path), suffix, "local") if absolute else (None, suffix, "error")
    return posixpath.normpath(posixpath.join(folder, path)), suffix, "local"


def link_spans(files: DataFrame, absolute: bool = True) -> DataFrame:
    """src, start, end, dest, form, resolved, suffix, kind: a row for each link of files (path, text)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, s, e, d, f, *target(d, posixpath.dirname(p), absolute)) for p, t in zip(b["path"], b["text"]) if p and t for s, e, d, f in spans(t)]
            yield pd.DataFrame(rows, columns=["src", "start", "end", "dest", "form", "resolved", "suffix", "kind"])

    return files.select("path", "text").mapInPandas(each, "src string, start int, end int, dest string, form string, resolved string, suffix string, kind string")


def resolve(links: DataFrame, files: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """links with ``status``: remote, found, missing, outside (of all roots) or error."""
    there = files.select(F.col("path").alias("resolved")).distinct().withColumn("_there", F.lit(True))
    inside = F.lit(True)
    if roots:
        inside = F.lit(False)
        for r in roots:
            inside = inside | F.col("resolved").startswith(r.rstrip("/") + "/")
    status = F.when(F.col("kind") != "local", F.col("kind")).when(~inside, "outside").when(F.col("_there"), "found").otherwise("missing")
    return links.join(there, "resolved", "left").withColumn("status", status).drop("_there")


def closure(edges: DataFrame, starts: DataFrame, expand: Column | None = None, rounds: int | None = None) -> DataFrame:
    """start, node: all that can be reached from each start (node) over edges (src, dst), itself included.

    Only nodes for which ``expand`` (a condition on ``node``) holds are followed.  Each round follows what the last one
    reached for the first time, so circles end; rounds are written to the checkpoint folder.
    ``rounds`` bounds them: if the last one still reaches new nodes, that is an error.
    """
    edges = edges.select("src", "dst").distinct()
    seen = front = cut(starts.select(F.col("node").alias("start"), "node").distinct())
    for n in itertools.count(1):
        follow = front.where(expand) if expand is not None else front
        new = follow.alias("f").join(edges.alias("e"), F.col("f.node") == F.col("e.src")).select("start", F.col("dst").alias("node")).distinct()
        front = cut(new.join(seen, ["start", "node"], "left_anti"))
        if not front.limit(1).count():
            return seen
        if rounds is not None and n > rounds:
            raise ValueError(f"nodes more than {rounds} links away from a start")
        seen = cut(seen.union(front))


def rebase(files: DataFrame, moves: DataFrame, links: DataFrame) -> DataFrame:
    """path, text: files (path, text) with the destinations of their local links rewritten for moves (src, new_folder).

    Spans are replaced from the right, so all other characters stay as they are.
    """
    local = links.where("kind = 'local'").groupBy(F.col("src").alias("path")).agg(F.collect_list(F.struct("start", "end", "resolved", "suffix")).alias("spans"))
    rows = files.select("path", "text").join(local, "path").join(moves.select(F.col("src").alias("path"), "new_folder"), "path")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for text, found, folder in zip(b["text"], b["spans"], b["new_folder"]):
                for s in sorted(found, key=lambda x: -x["start"]):
                    new = quote(posixpath.relpath(s["resolved"], folder or "."), safe="/._-~()") + s["suffix"]
                    text = text[: s["start"]] + new + text[s["end"] :]
                texts.append(text)
            yield pd.DataFrame({"path": b["path"], "text": texts})

    return rows.mapInPandas(each, "path string, text string").unionByName(files.select("path", "text").join(local.select("path"), "path", "left_anti"))
