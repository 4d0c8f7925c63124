"""Word packages as entity rows, read in executors from their bytes with the standard library."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quirewise.functions.text import CAPTION, NUMBERED, plain
from quirewise.sources.files import SourceError, read_binary

# Limits of a package, and names of its XML.
MOST_ENTRIES, MOST_PART, MOST_TOTAL, MOST_COMMENT = 20_000, 150 * 2**20, 600 * 2**20, 20_000
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
W14 = "{http://schemas.microsoft.com/office/word/2010/wordml}"
W15 = "{http://schemas.microsoft.com/office/word/2012/wordml}"
CID = "{http://schemas.microsoft.com/office/word/2016/wordml/cid}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
CORE = "{http://purl.org/dc/elements/1.1/}title"
REFERENCE_HEADING = re.compile(r"^(references?( list)?|bibliography|works cited|literature cited|sources|reference)$", re.I)
LIST_MARK = re.compile(r"^\s*(?:\[\d+\]|\d+[.)]|[-•*])\s+")
HEADING_STYLE = re.compile(r"^heading\s*(\d+)$", re.I)
_CAPTION = re.compile(CAPTION)
_NUMBERED = re.compile(NUMBERED)

SCHEMA = "path string, entity string, ord int, payload string"


class Package:
    """A ZIP package within limits; its parts are parsed without entities or document types."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, OSError, ValueError) as e:
            raise SourceError(f"not a ZIP package ({e})") from e
        sizes = [i.file_size for i in self.zip.infolist()]
        if len(sizes) > MOST_ENTRIES:
            raise SourceError(f"too many entries ({len(sizes)})")
        if sum(sizes) > MOST_TOTAL or max(sizes, default=0) > MOST_PART:
            raise SourceError("the package expands beyond the limits")

    def part(self, name: str, optional: bool = False) -> ET.Element | None:
        try:
            raw = self.zip.read(name)
        except KeyError:
            return None
        except (zipfile.BadZipFile, OSError, RuntimeError) as e:
            if optional:
                return None
            raise SourceError(f"cannot read {name} ({e})") from e
        lead = raw.lower()
        try:
            if b"<!doctype" in lead or b"<!entity" in lead:
                raise SourceError(f"{name} declares a document type or entities")
            return ET.fromstring(raw)
        except (ET.ParseError, SourceError) as e:
            if optional:
                return None
            raise SourceError(f"malformed XML in {name} ({e})") from e


@dataclass
class _Para:
    story: str
    cell: tuple[int, int, int] | None
    style: str | None = None
    outline: int | None = None
    listed: bool = False
    image: bool = False
    bold: bool = True
    runs: int = 0
    text: str = ""
    number: int = 0
    before: int = 0


@dataclass
class _Story:
    """What one pass over a story finds: paragraphs, tables, revisions, ranges of comments."""

    name: str
    paras: list[_Para] = field(default_factory=list)
    tables: list[dict] = field(default_factory=list)
    tracked: list[dict] = field(default_factory=list)
    ranges: dict[str, list[tuple[_Para, str]]] = field(default_factory=dict)
    starts: dict[str, _Para | None] = field(default_factory=dict)
    marks: dict[str, _Para] = field(default_factory=dict)


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def read_story(root: ET.Element, name: str = "body") -> _Story:
    """S5, S6. A story in document order, as text after accepting all revisions.

    Events come from one explicit stack, so depth of nesting costs no recursion.
    """
    story = _Story(name)
    open_ranges: list[str] = []
    last: _Para | None = None
    # A task is (element, what it is in): cell, paragraph, enclosing revision, whether deleted.
    stack: list[tuple] = [(c, None, None, None, False) for c in reversed(list(root))]

    def push(children, *state) -> None:  # noqa: ANN001, ANN002
        stack.extend((c, *state) for c in reversed(list(children)))

    def add(para: _Para, revision: dict | None, deleted: bool, text: str) -> None:
        if revision is not None:
            revision["text"] += text
        if not deleted:
            para.text += text
            for r in open_ranges:
                story.ranges[r].append((para, text))

    while stack:
        e, cell, para, revision, deleted = stack.pop()
        if callable(e):
            e()
            continue
        tag = _tag(e)
        if tag == "commentRangeStart" or tag == "commentRangeEnd":
            ident = e.get(W + "id")
            if ident is not None and tag == "commentRangeStart":
                story.ranges.setdefault(ident, [])
                story.starts[ident] = para or last
                if ident not in open_ranges:
                    open_ranges.append(ident)
            elif ident in open_ranges:
                open_ranges.remove(ident)
        elif tag == "AlternateContent":
            choice = e.find(MC + "Choice")
            push(choice if choice is not None else (), cell, para, revision, deleted)
        elif tag == "sdt":
            push(e.find(W + "sdtContent") if e.find(W + "sdtContent") is not None else (), cell, para, revision, deleted)
        elif para is None:
            if tag == "p":
                p = _Para(name, cell)
                props = e.find(W + "pPr")
                if props is not None:
                    get = lambda k: None if props.find(W + k) is None else props.find(W + k).get(W + "val")  # noqa: B023, E731
                    p.style, level = get("pStyle"), get("outlineLvl")
                    p.outline = int(level) if level and level.isdigit() else None
                    p.listed = props.find(W + "numPr") is not None
                story.paras.append(p)
                last = p if cell is None else last
                push(e, cell, p, None, False)
            elif tag == "tbl" and cell is not None:
                for row in reversed(e.findall(W + "tr")):
                    for c in reversed(row.findall(W + "tc")):
                        push(c, cell, None, None, False)
            elif tag == "tbl":
                t = {"index": len(story.tables), "rows": [], "after": last}
                story.tables.append(t)
                for r, row in reversed(list(enumerate(e.findall(W + "tr")))):
                    cells = row.findall(W + "tc")
                    t["rows"].insert(0, [""] * len(cells))
                    for c, box in reversed(list(enumerate(cells))):
                        push(box, (t["index"], r, c), None, None, False)
            elif tag in ("customXml", "ins", "del", "moveTo", "moveFrom", "sdtContent"):
                push(e, cell, None, None, False)
        elif tag in ("ins", "moveTo", "del", "moveFrom"):
            gone = tag in ("del", "moveFrom")
            change = {"kind": "deletion" if gone else "insertion", "id": e.get(W + "id") or "", "author": e.get(W + "author") or "", "date": e.get(W + "date"), "moved": tag.startswith("move"), "para": para, "text": ""}
            stack.append((lambda x=change: story.tracked.append(x) if x["text"].strip() else None, None, None, None, False))
            push(e, cell, para, change, gone or deleted)
        elif tag == "r":
            words = "".join(x for x in e.itertext()).strip()
            if words:
                para.runs += 1
                para.bold &= e.find(W + "rPr") is not None and e.find(W + "rPr").find(W + "b") is not None
            push(e, cell, para, revision, deleted)
        elif tag in ("t", "delText"):
            add(para, revision, deleted, e.text or "")
        elif tag == "tab":
            add(para, revision, deleted, "\t")
        elif tag in ("br", "cr"):
            add(para, revision, deleted, " " if e.get(W + "type") in (None, "textWrapping") else "")
        elif tag == "noBreakHyphen":
            add(para, revision, deleted, "-")
        elif tag == "commentReference":
            if e.get(W + "id") is not None:
                story.marks.setdefault(e.get(W + "id"), para)
        elif tag in ("drawing", "pict", "object"):
            para.image = True
        elif tag in ("hyperlink", "smartTag", "fldSimple", "customXml", "bdo", "dir", "sdtContent"):
            push(e, cell, para, revision, deleted)
    n = 0
    for p in story.paras:
        if p.cell is None and p.text.strip():
            n += 1
            p.number = n
        p.before = n
        if p.cell is not None and p.text.strip():
            t, r, c = p.cell
            box = story.tables[t]["rows"][r]
            box[c] = f"{box[c]}\n{p.text.strip()}" if box[c] else p.text.strip()
    return story


def _plain(e: ET.Element) -> str:
    put = {"tab": "\t", "br": " ", "cr": " "}
    return "".join((x.text or "") if _tag(x) == "t" else put.get(_tag(x), "") for x in e.iter())


def comment_rows(pkg: Package) -> list[dict]:
    """S7. Comments with the ids of their paragraphs, their parent paragraph and whether they are done."""
    root = pkg.part("word/comments.xml")
    if root is None:
        return []
    extra = pkg.part("word/commentsExtended.xml", optional=True)
    more = {} if extra is None else {x.get(W15 + "paraId"): (x.get(W15 + "paraIdParent"), x.get(W15 + "done")) for x in extra.iter(W15 + "commentEx")}
    idroot = pkg.part("word/commentsIds.xml", optional=True)
    lasting = {} if idroot is None else {x.get(CID + "paraId"): x.get(CID + "durableId") for x in idroot.iter(CID + "commentId")}
    out = []
    for c in root.iter(W + "comment"):
        if c.get(W + "id") is None:
            continue
        paras = list(c.iter(W + "p"))
        ids = [p.get(W14 + "paraId") for p in paras if p.get(W14 + "paraId")]
        parent, done = next((more[i] for i in reversed(ids) if i in more), (None, None))
        texts = [t for t in map(_plain, paras) if t.strip()]
        text = "\n".join(texts).strip()
        out.append(
            {
                "id": c.get(W + "id"), "author": c.get(W + "author") or "", "initials": c.get(W + "initials") or "", "date": c.get(W + "date"),
                "text": text[:MOST_COMMENT] + "…" * (len(text) > MOST_COMMENT), "truncated": len(text) > MOST_COMMENT, "para_ids": ids, "parent_para": parent,
                "resolved": None if done is None else done in ("1", "true"), "durable_id": next((lasting[i] for i in ids if i in lasting), None),
            }
        )
    of = {i: c["id"] for c in out for i in c["para_ids"]}
    for c in out:
        c["parent_id"] = of.get(c.pop("parent_para"))
        c.pop("para_ids")
    return out


def read_document(data: bytes, comments: bool = True, numbered_headings: bool = True) -> dict[str, list[dict]]:
    """S1. The entities of one Word file: document, paragraphs, sections, tables, cells, refs, tracked, notes, comments.

    Without styled headings, short numbered lines count as headings if asked for.
    """
    pkg = Package(data)
    main = pkg.part("word/document.xml")
    body = None if main is None else main.find(W + "body")
    if body is None:
        raise SourceError("no document body")
    styles = pkg.part("word/styles.xml", optional=True)
    names = {} if styles is None else {s.get(W + "styleId"): s.find(W + "name").get(W + "val") for s in styles.iter(W + "style") if s.find(W + "name") is not None}
    core = pkg.part("docProps/core.xml", optional=True)
    title = "" if core is None else (core.findtext(".//" + CORE) or "").strip()
    story = read_story(body)
    lines = [p for p in story.paras if p.number]

    def level(p: _Para) -> int:
        m = HEADING_STYLE.match((names.get(p.style) or p.style or "").strip()) or HEADING_STYLE.match((p.style or "").strip())
        return int(m[1]) if m else p.outline + 1 if p.outline is not None and p.outline < 9 else 0

    levels = [level(p) for p in lines]
    if numbered_headings and not any(levels):
        for k, p in enumerate(lines):
            t = p.text.strip()
            m = _NUMBERED.match(t)
            if m and len(t) <= 120 and t[-1] not in ".,;:" and ((p.runs and p.bold) or len(t.split()) <= 10):
                levels[k] = m[1].count(".") + 1
    sections = [{"id": "S0", "heading": "", "level": 0, "parent_id": None, "heading_paragraph": None}]
    above: list[dict] = []
    paragraphs = []
    for p, lv in zip(lines, levels):
        style, text = names.get(p.style) or p.style or "", p.text.strip()
        if lv:
            above = [s for s in above if s["level"] < lv]
            sections.append({"id": f"S{len(sections)}", "heading": text, "level": lv, "parent_id": above[-1]["id"] if above else None, "heading_paragraph": p.number})
            above.append(sections[-1])
        elif not title and style.lower() == "title":
            title = text
        paragraphs.append({"number": p.number, "text": text, "style": style, "is_heading": bool(lv), "heading_level": lv, "is_list_item": p.listed or style.lower().startswith("list"), "has_image": p.image, "section_id": sections[-1]["id"]})
    section_at = {p["number"]: p["section_id"] for p in paragraphs}
    text_at = {p["number"]: p["text"] for p in paragraphs}
    tables, cells = [], []
    for t in story.tables:
        after = t["after"].before if t["after"] is not None else 0
        caption = label = None
        for n in (after, after + 1):
            m = _CAPTION.match(text_at.get(n, "").strip())
            if m and m[1].lower().startswith("tab"):
                caption, label = text_at[n], f"Table {m[2]}"
                break
        tables.append({"index": t["index"], "caption": caption, "label": label, "section_id": section_at.get(after, "S0"), "after_paragraph": after})
        cells += [{"table_index": t["index"], "row": r, "col": c, "text": x.strip()} for r, row in enumerate(t["rows"]) for c, x in enumerate(row)]
    stories = [story]
    for part, kind, tag in (("word/footnotes.xml", "footnote", "footnote"), ("word/endnotes.xml", "endnote", "endnote")):
        root = pkg.part(part, optional=True)
        for note in () if root is None else root:
            if _tag(note) == tag and note.get(W + "type") not in ("separator", "continuationSeparator", "continuationNotice"):
                stories.append(read_story(note, f"{kind} {note.get(W + 'id') or '?'}"))
    notes = [{"kind": s.name.split()[0], "id": s.name.split()[1], "text": "\n".join(p.text.strip() for p in s.paras if p.text.strip())} for s in stories[1:]]
    tracked = []
    for s in stories:
        for c in s.tracked:
            p, row = c["para"], {k: c[k] for k in ("id", "kind", "author", "date", "moved")} | {"text": c["text"].strip(), "story": s.name, "paragraph": None, "section_id": None, "table_index": None, "cell": None}
            if s is story:
                if p.cell is not None:
                    t = tables[p.cell[0]]
                    row |= {"table_index": p.cell[0], "cell": p.cell[1:], "section_id": t["section_id"], "paragraph": t["after_paragraph"]}
                else:
                    row |= {"paragraph": p.before, "section_id": section_at.get(p.before, "S0")}
            tracked.append(row)
    under: dict[str, bool] = {}
    for s in sections:
        under[s["id"]] = under.get(s["parent_id"], False) or bool(s["heading"] and REFERENCE_HEADING.match(plain(_title(s["heading"])).strip(" :")))
    refs = []
    for p in paragraphs:
        raw = LIST_MARK.sub("", p["text"]).strip()
        if under[p["section_id"]] and not p["is_heading"] and len(raw.split()) >= 3:
            refs.append({"index": len(refs), "raw": raw, "paragraph": p["number"]})
    said = _anchored(comment_rows(pkg), stories, tables, sections, section_at) if comments else []
    return {"document": [{"title": title}], "paragraphs": paragraphs, "sections": sections, "tables": tables, "cells": cells, "refs": refs, "tracked": tracked, "notes": notes, "comments": said}


def _title(heading: str) -> str:
    m = re.match(r"^\s*chapter\s+\d+\s*[:.\-–—]?\s*(.*)$", heading, re.I) or re.match(r"^\s*\d+(?:\.\d+)*[.)]?\s+(\S.*)$", heading)
    return m[1] if m and m[1] else heading


def _anchored(said: list[dict], stories: list[_Story], tables: list[dict], sections: list[dict], section_at: dict[int, str]) -> list[dict]:
    """J11. Comments with the text and place they are attached to; the body goes before notes, a range before a mark."""
    heading = {s["id"]: s["heading"] for s in sections}
    for c in said:
        s = next((x for x in stories if c["id"] in x.ranges), None)
        chunks = s.ranges[c["id"]] if s else []
        paras = list(dict.fromkeys(id(p) for p, _ in chunks))
        by = {id(p): p for p, _ in chunks}
        texts = ["".join(t for p, t in chunks if id(p) == i).strip() for i in paras]
        held = [by[i] for i in paras] or ([s.starts[c["id"]]] if s and s.starts.get(c["id"]) else [])
        if s is None:
            s = next((x for x in stories if c["id"] in x.marks), None)
            held = [s.marks[c["id"]]] if s else []
        place = {"section_id": None, "section": None, "paragraph_start": None, "paragraph_end": None, "table_index": None, "cell": None, "note": None}
        if held:
            a, z = held[0], held[-1]
            if s is not stories[0]:
                place["note"] = f"in {s.name}"
            elif a.cell is not None:
                place |= {"table_index": a.cell[0], "cell": a.cell[1:], "section_id": tables[a.cell[0]]["section_id"]}
            else:
                start, end = a.before, z.before if z.cell is None else a.before
                place |= {"section_id": section_at.get(start, "S0"), "paragraph_start": start or None, "paragraph_end": end if end != start else None}
            place["section"] = heading.get(place["section_id"]) or None
        c |= {"anchor_text": "\n".join(t for t in texts if t)[:MOST_COMMENT], "anchor": place}
    return said


# The typed form of each entity.
_STR, _INT, _BOOL = S.StringType(), S.IntegerType(), S.BooleanType()
_row = lambda **kinds: S.StructType([S.StructField(k, v) for k, v in kinds.items()])
_PLACE = _row(section_id=_STR, section=_STR, paragraph_start=_INT, paragraph_end=_INT, table_index=_INT, cell=S.ArrayType(_INT), note=_STR)
ENTITIES = {
    "document": _row(title=_STR),
    "paragraphs": _row(number=_INT, text=_STR, style=_STR, is_heading=_BOOL, heading_level=_INT, is_list_item=_BOOL, has_image=_BOOL, section_id=_STR),
    "sections": _row(id=_STR, heading=_STR, level=_INT, parent_id=_STR, heading_paragraph=_INT),
    "tables": _row(index=_INT, caption=_STR, label=_STR, section_id=_STR, after_paragraph=_INT),
    "cells": _row(table_index=_INT, row=_INT, col=_INT, text=_STR),
    "refs": _row(index=_INT, raw=_STR, paragraph=_INT),
    "tracked": _row(id=_STR, kind=_STR, author=_STR, date=_STR, text=_STR, moved=_BOOL, paragraph=_INT, section_id=_STR, table_index=_INT, cell=S.ArrayType(_INT), story=_STR),
    "notes": _row(kind=_STR, id=_STR, text=_STR),
    "comments": _row(id=_STR, author=_STR, initials=_STR, date=_STR, text=_STR, truncated=_BOOL, anchor_text=_STR, anchor=_PLACE, parent_id=_STR, resolved=_BOOL, durable_id=_STR),
    "error": _row(message=_STR),
}


def read_docx(spark: SparkSession, path: str | list[str], comments: bool = True, numbered_headings: bool = True) -> DataFrame:
    """path, entity, ord, payload of all .docx files under a path; a file that cannot be read gives one row of entity `error`.

    Without comments their parts are not even parsed. Use `entity` for typed tables.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    found = read_document(bytes(content), comments, numbered_headings)
                except Exception as e:  # one bad file must not lose the others
                    found = {"error": [{"message": f"{type(e).__name__}: {e}"}]}
                rows = [(path, kind, k, json.dumps(x, ensure_ascii=False)) for kind, items in found.items() for k, x in enumerate(items)]
                yield pd.DataFrame(rows, columns=["path", "entity", "ord", "payload"])

    return read_binary(spark, path, "*.docx").mapInPandas(run, SCHEMA)


def entity(rows: DataFrame, name: str) -> DataFrame:
    """One entity of read_docx as a typed table: path, ord and its fields."""
    return rows.filter(F.col("entity") == name).select("path", "ord", F.from_json("payload", ENTITIES[name]).alias("x")).select("path", "ord", "x.*")
