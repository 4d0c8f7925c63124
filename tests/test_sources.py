"""Readers, over files built here."""

import io
import zipfile

import pytest

from quirewise.sources import docx as D
from quirewise.sources import reports as R
from quirewise.sources.files import SourceError, UnsupportedFile, check_docx, confine, digests, read_binary, safe_write

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" xmlns:w15="http://schemas.microsoft.com/office/word/2012/wordml" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'


def p(inner, style=None, extra=""):
    props = f'<w:pPr>{f"""<w:pStyle w:val="{style}"/>""" if style else ""}{extra}</w:pPr>'
    return f"<w:p>{props}{inner}</w:p>"


def r(text):
    return f"<w:r><w:t>{text}</w:t></w:r>"


def package(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {NS}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>')
        for name, xml in parts.items():
            z.writestr(f"word/{name}.xml", xml)
    return out.getvalue()


BODY = (
    p(r("Front matter"))
    + p(r("1 Methods"), "H1")
    + p(r("We ") + '<w:ins w:id="7" w:author="Ann" w:date="2024-01-01T00:00:00Z">' + r("now ") + '</w:ins><w:del w:id="8" w:author="Ann"><w:r><w:delText>never </w:delText></w:r></w:del><w:commentRangeStart w:id="0"/>' + r("sample") + '<w:commentRangeEnd w:id="0"/><w:r><w:commentReference w:id="0"/></w:r>' + r(" users."))
    + p("")
    + p(r("1.1 Detail"), "H2")
    + p(r("Table 2. Counts"))
    + "<w:tbl><w:tr><w:tc>" + p(r("Item")) + "</w:tc><w:tc>" + p(r("N")) + "</w:tc></w:tr><w:tr><w:tc>" + p(r("a")) + p(r("b")) + "</w:tc><w:tc>" + p(r("3")) + "</w:tc></w:tr></w:tbl>"
    + p(r("References"), "H1")
    + p(r("[1] Doe J. On things (2019)."), extra='<w:numPr/>')
)
COMMENTS = f'<w:comments {NS}><w:comment w:id="0" w:author="Rev"><w:p w14:paraId="A1">{r("Explain.")}</w:p></w:comment><w:comment w:id="1" w:author="Ann"><w:p w14:paraId="A2">{r("Done")}</w:p></w:comment></w:comments>'
EXTENDED = f'<w15:commentsEx {NS}><w15:commentEx w15:paraId="A1" w15:done="1"/><w15:commentEx w15:paraId="A2" w15:paraIdParent="A1" w15:done="0"/></w15:commentsEx>'
NOTES = f'<w:footnotes {NS}><w:footnote w:type="separator" w:id="0">{p(r("-"))}</w:footnote><w:footnote w:id="2">{p(r("A note."))}</w:footnote></w:footnotes>'


def test_document():
    d = D.read_document(package(BODY, comments=COMMENTS, commentsExtended=EXTENDED, footnotes=NOTES))
    assert [x["text"] for x in d["paragraphs"]] == ["Front matter", "1 Methods", "We now sample users.", "1.1 Detail", "Table 2. Counts", "References", "[1] Doe J. On things (2019)."]
    assert [(s["id"], s["parent_id"], s["level"]) for s in d["sections"]] == [("S0", None, 0), ("S1", None, 1), ("S2", "S1", 2), ("S3", None, 1)]
    assert d["tables"] == [{"index": 0, "caption": "Table 2. Counts", "label": "Table 2", "section_id": "S2", "after_paragraph": 5}]
    assert [(c["row"], c["col"], c["text"]) for c in d["cells"]] == [(0, 0, "Item"), (0, 1, "N"), (1, 0, "a\nb"), (1, 1, "3")]
    assert [(t["kind"], t["text"], t["paragraph"], t["section_id"]) for t in d["tracked"]] == [("insertion", "now", 3, "S1"), ("deletion", "never", 3, "S1")]
    assert d["refs"] == [{"index": 0, "raw": "Doe J. On things (2019).", "paragraph": 7}]
    assert d["notes"] == [{"kind": "footnote", "id": "2", "text": "A note."}]
    first, second = d["comments"]
    assert (first["anchor_text"], first["anchor"]["paragraph_start"], first["resolved"], first["parent_id"]) == ("sample", 3, True, None)
    assert (second["parent_id"], second["resolved"]) == ("0", False)
    assert D.read_document(package(BODY, comments="<bad"), comments=False)["comments"] == []


def test_numbered_lines_are_headings_only_without_styles():
    d = D.read_document(package(p(r("2.3 Sampling plan")) + p(r("Text here."))))
    assert [x["heading_level"] for x in d["paragraphs"]] == [2, 0]
    assert D.read_document(package(p(r("2.3 Sampling plan"))), numbered_headings=False)["paragraphs"][0]["heading_level"] == 0


@pytest.mark.parametrize("data", [b"no zip", package("<w:p>")[:-30], package("").replace(b"word/document.xml", b"word/documenx.xml")])
def test_bad_packages(data):
    with pytest.raises(SourceError):
        D.read_document(data)


def test_entities_are_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>')
    with pytest.raises(SourceError):
        D.read_document(out.getvalue())


def test_scan(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(package(BODY, comments=COMMENTS))
    (tmp_path / "b.docx").write_bytes(b"broken")
    rows = D.read_docx(spark, str(tmp_path))
    assert D.entity(rows, "paragraphs").count() == 7
    assert D.entity(rows, "error").count() == 1
    assert D.entity(rows, "comments").select("anchor.paragraph_start").first()[0] == 3
    got = digests(read_binary(spark, str(tmp_path))).collect()
    assert len(got) == 2 and all(len(x["sha256"]) == 64 for x in got)


REPORT = """# Report
## Reviewer 2
### Minor points
1. Please define the scale
   used in Table 2.
   - and its range
2) Fix the typo.

**Reviewer 3**

Comment 4: Why was it dropped?

| No | Section | Comment |
|----|---------|---------|
| 7. | 2.1 | Add a figure |
| 8 | | |

---
It reads well. You should cite more."""


def test_blocks():
    assert R.parse_blocks(REPORT) == [
        ("heading", "Report", 1, None, ""), ("heading", "Reviewer 2", 2, None, ""), ("heading", "Minor points", 3, None, ""),
        ("item", "Please define the scale used in Table 2. and its range", 0, "1", ""), ("item", "Fix the typo.", 0, "2", ""),
        ("heading", "Reviewer 3", 3, None, ""), ("item", "Why was it dropped?", 0, "4", ""), ("item", "Add a figure", 0, "7", "2.1"),
        ("paragraph", "It reads well. You should cite more.", 0, None, ""),
    ]
    assert R.parse_blocks("") == []
    assert R.row_blocks(["A", "B"], [["x", "y"]]) == [("paragraph", "x y", 0, None, "")]


def test_report_requests(spark, tmp_path):
    (tmp_path / "r.md").write_text(REPORT)
    (tmp_path / "q.txt").write_text("It reads well. You should cite more. Please add a table.")
    blocks = R.read_reports(spark, str(tmp_path / "r.md")).unionByName(R.read_reports(spark, str(tmp_path / "q.txt")))
    got = {(x["report_id"][-4:], x["id"]): (x["reviewer"], x["severity"], x["section"], x["comment_text"]) for x in R.report_requests(blocks).collect()}
    assert got["r.md"[-4:], "RT-001"] == ("Reviewer 2", "minor", None, "Please define the scale used in Table 2. and its range")
    assert got["r.md", "RT-003"][:2] == ("Reviewer 3", None)
    assert got["r.md", "RT-004"][2:] == ("2.1", "Add a figure")
    assert [got["q.txt"[-4:], f"RT-00{k}"][3] for k in (1, 2)] == ["You should cite more.", "Please add a table."]
    assert {x["report_id"][-4:]: x["ignored"] for x in R.ignored_sentences(blocks).collect()} == {"r.md": 2, ".txt": 1}


def test_docx_report(spark, tmp_path):
    (tmp_path / "r.docx").write_bytes(package(p(r("Reviewer 1"), "H1") + p(r("1. Fix this.")) + "<w:tbl><w:tr><w:tc>" + p(r("Comment")) + "</w:tc></w:tr><w:tr><w:tc>" + p(r("Add that")) + "</w:tc></w:tr></w:tbl>" + p(r("Listed"), extra="<w:numPr/>")))
    got = [tuple(x)[2:6] for x in R.read_reports(spark, str(tmp_path / "r.docx")).orderBy("ord").collect()]
    assert got == [("heading", "Reviewer 1", 1, None), ("item", "Fix this.", 0, "1"), ("item", "Add that", 0, "1"), ("item", "Listed", 0, None)]
    with pytest.raises(UnsupportedFile):
        R.read_reports(spark, "x.pdf")


GOOD = "version: 1\nissues:\n- comment: Fix it\n  location: {paragraph: 3, table: 1}\n- id: X\n  comment: Add\n  severity: minor\n  parts: [a, b]\n"


def test_yaml(spark, tmp_path):
    (tmp_path / "i.yml").write_text(GOOD)
    got = R.read_issues(spark, str(tmp_path / "i.yml")).collect()
    assert [(x["id"], x["paragraph_start"], x["table_index"], x["parts"]) for x in got] == [("RT-001", 3, 0, []), ("X", None, None, ["a", "b"])]


@pytest.mark.parametrize("bad", ["version: 2\nissues: []", "version: 1\nissues:\n- comment: ' '", "version: 1\nissues:\n- comment: a\n  extra: 1", "version: 1\nissues:\n- {comment: a, id: x}\n- {comment: b, id: x}", "just text", "version: 1\nissues:\n- {comment: a, category: NONE}", "version: 1\nissues: [", "version: 1\nissues: !!python/object:os.x {}", "version: 1\nissues:\n- {comment: a, location: {paragraph: 0}}", "version: 1\nissues: []\nmore: 1"])
def test_bad_yaml(bad):
    with pytest.raises(SourceError):
        R.parse_issues_yaml(bad)


def test_gates(tmp_path):
    (tmp_path / "a.doc").write_text("")
    for bad in ("missing.docx", "a.doc", "."):
        with pytest.raises(SourceError):
            check_docx(str(tmp_path / bad))
    with pytest.raises(SourceError):
        confine(str(tmp_path / ".." / "x"), str(tmp_path))
    assert confine(str(tmp_path / "x"), str(tmp_path)).name == "x"
    (tmp_path / "in").write_text("keep")
    with pytest.raises(SourceError):
        safe_write(str(tmp_path / "in"), "lost", (str(tmp_path / "in"),))
    safe_write(str(tmp_path / "out"), "text")
    assert (tmp_path / "in").read_text() == "keep"


def test_audit_version(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"schema_version": 1, "mode": "issues_file"}')
    assert R.read_audit(spark, str(tmp_path / "a.json"), "schema_version int, mode string").first()["mode"] == "issues_file"
    (tmp_path / "b.json").write_text('{"schema_version": 2}')
    with pytest.raises(SourceError):
        R.read_audit(spark, str(tmp_path / "b.json"), "schema_version int, mode string")
