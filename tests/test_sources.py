import io
import json
import os
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from evidloom import sinks
from evidloom.sources import artefacts as A
from evidloom.sources import files as S
from evidloom.sources.udtf import TermFinder


def office(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


DOCX = office({"word/document.xml": '<w:document xmlns:w="w"><w:p><w:t> Access </w:t><w:t>review</w:t><w:t> </w:t></w:p></w:document>'})
XLSX = office({
    "xl/sharedStrings.xml": '<sst xmlns="s"><si><t>shared</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>',
    "xl/worksheets/sheet1.xml": '<w xmlns="s"><row><c t="s"><v>1</v></c><c t="inlineStr"><is><t>inline</t></is></c><c><v>42</v></c><c t="s"><v>9</v></c></row></w>',
    "xl/worksheets/sheet0.xml": '<w xmlns="s"><row><c t="s"><v>0</v></c></row></w>',
})


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    files = {
        "a.txt": "plain ä".encode(), "b.md": b"# title", "c.csv": b'x,"a, b",\n,,\n' + b",".join([b"k"] * 25), "d.json": json.dumps({"b": [1, None, True], "a": {"k": "v"}}).encode(), "e.docx": DOCX, "f.xlsx": XLSX,
        "g.pdf": b"%PDF-1.4 broken", "h.png": b"\x89PNG", "i.bin": b"??", "j.docx": b"not a zip", "k.json": b"{", "l.txt": b"", "p.txt": b" \n", "m.txt": b"a\x00b", "n.txt": b"bad \xff utf", "node_modules/skip.txt": b"x", "sub/deep/o.TXT": b"deep",
    }
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    return str(root)


def test_documents(spark, folder):
    got = {r.path.split("/")[-1]: r for r in S.read_documents(S.scan(spark, folder)).collect()}
    assert "skip.txt" not in got and "l.txt" not in got and len(got) == 15
    text = {n: (r.status, r.text) for n, r in got.items()}
    assert text["a.txt"] == ("parsed", "plain ä") and text["b.md"] == ("parsed", "# title") and text["o.TXT"] == ("parsed", "deep")
    assert text["c.csv"] == ("parsed", "x | a, b\n" + " | ".join(["k"] * 20)) and got["c.csv"].truncated
    assert text["d.json"] == ("parsed", "a\nk\nv\nb\n1\ntrue")
    assert text["e.docx"] == ("parsed", "Access\nreview") and text["f.xlsx"] == ("parsed", "shared\nrich\ninline\n42")
    assert got["g.pdf"].status == "error" and got["g.pdf"].reason in ("pdf_library_missing", "parse_failed")
    assert text["p.txt"][0] == "empty"
    assert text["h.png"] == ("ocr_required", None) and text["i.bin"] == ("unsupported", None)
    assert got["j.docx"].reason == got["k.json"].reason == "parse_failed" and got["m.txt"].reason == "binary_content" and text["n.txt"] == ("parsed", "bad � utf")


def test_scan_by_pattern(spark, folder):
    assert {r.source_type for r in S.scan(spark, folder, "*.{md,txt,pdf}").select("source_type").collect()} == {"text", "markdown", "pdf"}


def test_limits():
    assert S.json_text(json.dumps(list(range(600))).encode())[1] and len(S.json_text(json.dumps(list(range(600))).encode())[0].split("\n")) == 500
    assert S.csv_text(b"x\n" * 400)[1] and S.csv_text(("y" * 300).encode())[0].endswith("...")
    with pytest.raises(ValueError):
        S.pdf_text(b"")


def test_pages(spark, folder):
    df = spark.createDataFrame([(bytearray(b"%PDF broken"),)], "content binary")
    rows = df.lateralJoin(S.PdfPages(F.col("content").outer())).collect()
    assert len(rows) == 1 and rows[0].page_no == 0 and rows[0].reason


def test_term_finder(spark):
    df = spark.createDataFrame([("Risk and risk owner", 10), (None, 0)], "t string, o int")
    rows = df.lateralJoin(TermFinder(F.lit("one document"), F.col("t").outer(), F.col("o").outer(), F.lit("risk|risk owner"))).select("pos", "term").collect()
    assert sorted(map(tuple, rows)) == [(-1, "risk"), (-1, "risk owner"), (10, "risk"), (19, "risk owner")]


def test_artefacts(spark, tmp_path):
    def put(name, body):
        (tmp_path / name).write_text(body if isinstance(body, str) else json.dumps(body))
        return str(tmp_path / name)

    q = put("q.csv", 'question_id,question\nq1,"Is it, so?"\n,second  one\nq1,again\n,\n')
    got = [(r.question_id, r.question, r.problem) for r in A.questionnaire(spark, q).collect()]
    assert sorted(got) == [("q1", "Is it, so?", "repeated_id"), ("q1", "again", "repeated_id"), ("question_002", "second one", None), ("question_004", "", "blank")]
    store = put("store.json", {"schema_version": "1", "evidence": [{"evidence_id": "EV-1", "mapped_controls": ["A"], "review_required": True}]})
    row = A.evidence_store(spark, store).first()
    assert (row.evidence_id, row.mapped_controls, row.review_required) == ("EV-1", ["A"], True)
    cat = put("cat.json", {"catalog_id": "c", "controls": [{"control_id": "A", "maps_to": ["B"]}, {"control_id": "B", "maps_to": []}]})
    cross = put("map.json", {"mappings": [{"source_control_id": "B", "maps_to": ["A", "A"]}]})
    controls, edges = A.control_catalog(spark, [cat], cross)
    assert controls.count() == 2 and {tuple(r) for r in edges.collect()} == {("A", "B"), ("B", "A")}
    train = put("t.json", {"items": [{"text": "x", "label": "l"}, {"item_id": "i", "text": "y", "label": "l"}]})
    assert {r.item_id for r in A.training_items(spark, train).collect()} >= {"i"}
    assert A.training_items(spark, put("t.csv", "item_id,text,label\n,x,l\n")).first().item_id.startswith("item-")
    review = put("r.csv", "finding_id,category,control_area,document,evidence_level,status,finding,recommended_manual_check,source_reference,review_status,review_note,reviewer,reviewed_at\nF-1" + "," * 12 + "\n")
    assert A.review_csv(spark, review).first().finding_id == "F-1"
    lines = put("l.jsonl", json.dumps({"sequence": 1, "details": {"a": "b"}}) + "\n")
    assert A.json_objects(spark, lines, A.LEDGER, lines=True).first().details == {"a": "b"}
    with pytest.raises(Exception, match="(?i)malformed|failfast|parse"):
        A.json_objects(spark, put("bad.json", "{"), A.LEDGER).collect()
    db = str(tmp_path / "x.db")
    with sqlite3.connect(db) as c:
        c.execute("create table answers (id text not null, n integer, c real)")
        c.execute("insert into answers values ('a', 1, 0.5)")
    assert tuple(A.sqlite_table(db, "answers", spark).first()) == ("a", 1, 0.5)
    with pytest.raises(ValueError):
        A.sqlite_table(db, "none", spark)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], "=x"), (2, None, None)], "id int, xs array<string>, note string")
    sinks.write_csv(df, f"file://{tmp_path}/csv", single=True)
    part = next(p for p in os.listdir(tmp_path / "csv") if p.endswith(".csv"))
    assert (tmp_path / "csv" / part).read_text() == "id,xs,note\n1,a;b,'=x\n2,,\n"
    sinks.write_json(df, f"file://{tmp_path}/j")
    sinks.write_json(df, f"file://{tmp_path}/j", "append")
    assert spark.read.json(f"file://{tmp_path}/j").count() == 4
    sinks.dual_write(df, f"file://{tmp_path}/private", f"file://{tmp_path}/shared", ["id"])
    assert spark.read.json(f"file://{tmp_path}/shared").columns == ["id"]
    text = sinks.markdown_report("T", {"S": df})
    assert "| 1 | a, b | =x |" in text and "<p>" in sinks.html_report(text) and "&lt;" in sinks.html_report("<b>")
    with pytest.raises(ValueError):
        sinks.rows_of(spark.range(20), 10)
    sinks.bundle(f"{tmp_path}/bundle", {"rows": df}, {"name": "n"})
    manifest = json.loads((tmp_path / "bundle" / "manifest.json").read_text())
    assert set(manifest["sha256"]) == {"rows"}
    sinks.bundle(f"{tmp_path}/bundle", {"rows": df}, {"name": "n2"})
    (tmp_path / "bundle" / "strange").write_text("x")
    with pytest.raises(FileExistsError):
        sinks.bundle(f"{tmp_path}/bundle", {"rows": df}, {})

    def fail(where):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        sinks.staged(f"{tmp_path}/half", fail)
    assert not [p for p in os.listdir(tmp_path) if p.startswith("half")]
