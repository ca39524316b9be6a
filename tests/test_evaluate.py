import hashlib
import io
import json
import zipfile

from pyspark.sql import functions as F

from evidloom.__main__ import main
from evidloom.functions import patterns as P
from evidloom.operators import evaluate as E
from evidloom.plans.pipeline import run_folder


def test_documents_and_gate(spark):
    expected = spark.createDataFrame([("d1", ["a", "b"], ["z"], ["Owner"], 2), ("d2", ["a"], ["b"], None, 1), ("d3", ["a"], None, None, 1), ("d4", None, None, None, None)], "doc string, categories array<string>, forbidden array<string>, terms array<string>, least int")
    found = spark.createDataFrame([("d1", "a", "the OWNER"), ("d1", "b", "x"), ("d2", "a", "y"), ("d2", "b", "y"), ("d9", "a", "y")], "doc string, category string, passage string")
    got = E.evaluate_documents(expected, found, "doc")
    rows = {r.doc: r for r in got.collect()}
    assert [rows[d].passed for d in ("d1", "d2", "d3", "d4")] == [True, False, False, True]
    assert rows["d2"].forbidden_found == ["b"] and rows["d3"].missing == ["a"] and not rows["d3"].enough
    s = E.summary(got)
    assert tuple(s.first()) == (4, 2, 0.75)
    checks = {r.check: r.ok for r in E.gate(s, rate=F.col("hit_rate") >= 0.7, all_passed=F.col("passed") == F.col("documents"), unknown=F.lit(None).cast("boolean")).collect()}
    assert checks == {"rate": True, "all_passed": False, "unknown": False, "all": False}
    assert tuple(E.summary(got.limit(0)).first()) == (0, 0, None)


def test_small_functions(spark):
    df = spark.createDataFrame([(["x", "y", "x", "q"], "We are fully compliant"), ([], None)], "cats array<string>, t string")
    got = df.select(E.map_controls(F.col("cats"), {"x": ["C2", "C1"], "y": ["C1", "C3"]}, ["C1", "C2"]).alias("c"), E.forbidden_claim(F.col("t"), ["fully compliant", "certified"]).alias("f")).collect()
    assert [(r.c, r.f) for r in got] == [(["C2", "C1"], True), ([], False)]
    assert E.with_model(df, "m", "1").first().model.trained_at == "1970-01-01T00:00:00Z"


def test_dataset(spark):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    manifest = spark.createDataFrame([("s/a.txt", sha(b"a"), "text"), ("s/b.txt", sha(b"x"), "text"), ("s/c.pdf", sha(b"c"), "text"), ("s/d.txt", sha(b"d"), "text"), ("s/e.txt", sha(b"e"), "text")], "local_path string, sha256 string, file_type string")
    files = spark.createDataFrame([("file:/r/s/a.txt", sha(b"a"), "text", 1), ("file:/other/a.txt", sha(b"?"), "text", 1), ("file:/r/s/b.txt", sha(b"b"), "text", 1), ("file:/r/s/c.pdf", sha(b"c"), "pdf", 1), ("file:/r/s/d.txt", sha(b"d"), "text", 10**9)], "path string, sha256 string, source_type string, length long")
    assert {tuple(r) for r in E.dataset_problems(manifest, files).collect()} == {("s/b.txt", "hash"), ("s/c.pdf", "type"), ("s/d.txt", "too_large"), ("s/e.txt", "missing")}


def test_folder(spark, tmp_path, capsys):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.md").write_text("MFA is documented and tested by the owner.\npassword = hunter2")
    (root / "b.txt").write_text("nothing to see")
    (root / "c.png").write_bytes(b"x")
    got = run_folder(spark, str(root))
    docs = {r.path.rpartition("/")[2]: r for r in got.documents.collect()}
    assert (docs["a.md"].chunk_count, docs["a.md"].evidence_count, docs["a.md"].topics) == (1, 1, ["mfa"]) and docs["c.png"].status == "ocr_required" and docs["b.txt"].evidence_count == 0
    assert {r.type for r in got.findings.collect()} == {"secret"} and sorted(r.status for r in got.verdicts.collect()) == ["block", "pass", "warn"]
    assert {r.topic: r.status for r in got.coverage.collect()}["mfa"] == "partial"
    assert main(["list"]) == 0 and "p5_found" in capsys.readouterr().out
    assert main(["folder", str(root), str(tmp_path / "out")]) == 1 and "mfa" in (tmp_path / "out" / "report.md").read_text()
    assert main(["run", "p4_found", "/root/testdata/sf0.001", f"file://{tmp_path}/rows", "--format", "csv"]) == 0


def test_folder_verdicts_are_over_whole_files(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    office = io.BytesIO()
    with zipfile.ZipFile(office, "w") as z:
        z.writestr("word/document.xml", "<d xmlns:w='w'><w:t>password = hunter2</w:t></d>")
    bodies = {
        "row.csv": "k\n" * 400 + "password=hunter2\n", "cell.csv": ",".join(["k"] * 25 + ["password=hunter2"]), "scalar.json": json.dumps([*range(600), "password=hunter2"]), "line.json": json.dumps(["k" * 9 + " "] * 900 + ["password=hunter2"]),
        "escape.json": '["a\\u0040b.example", "password\\u003dhunter2"]', "broken.json": "{ password=hunter2", "far.txt": "k\n" * 600_000 + "password=hunter2", "conf.yaml": "password: hunter2", "notes.rst": "password: hunter2",
        "key.pem": "k", "x.zip": "k", "y.db": "k", "prod.env": "k", ".env": "k", "my-secrets.txt": "k", "_hidden.txt": "k", "n.txt": "a\x00b", "latin.txt": b"\xe4", "tool.xyz": "k", "ok.txt": "nothing", "ok.csv": "a,b", "d.docx": office.getvalue(),
    }
    for name, body in bodies.items():
        (root / name).write_bytes(body if isinstance(body, bytes) else body.encode())
    got = run_folder(spark, str(root))
    names = {r.document_id: r.path.rpartition("/")[2] for r in [*got.documents.collect(), *got.skipped.collect()]}
    status = {names[r.document_id]: (r.status, r.scanned) for r in got.verdicts.collect()}
    low = {"_hidden.txt", "n.txt", "latin.txt", "tool.xyz"}
    assert status.keys() == bodies.keys() and {n for n, (s, _) in status.items() if s == "warn"} == low and {n for n, s in status.items() if s == ("pass", True)} == {"ok.txt", "ok.csv"}
    assert all(status[n][0] == "block" for n in bodies.keys() - low - {"ok.txt", "ok.csv"})
    reasons = {r.path.rpartition("/")[2]: r.reason for r in got.skipped.collect()}
    assert (reasons[".env"], reasons["x.zip"], reasons["n.txt"], reasons["latin.txt"], reasons["d.docx"]) == ("secret_file", "forbidden_input", "binary_content", "not_utf8", "unsupported_type")
    found = {(names[r.document_id], r.line, r.type) for r in got.findings.collect()}
    assert {("row.csv", 401, "secret"), ("line.json", 1, "secret"), ("escape.json", None, "email"), ("far.txt", 600001, "secret")} <= found


def test_long_lines_are_read_as_short_ones(spark):
    values = ["a@b.example", "password = hunter2", "10.0.0.1", "8.8.8.8", "host.lan", "ghp_abcdefghijklmnop", "+49 30 1234567", "DE89370400440532013000", "token", "plain"]
    line = " ; ".join(values[k * 7 % 10] for k in range(3000))
    want = sorted(tuple(r) for k in values for r in P.long_line(k))
    got = P.long_line(line)
    assert sorted(set(got)) == want and len(got) == 300 * len(want)
    df = spark.createDataFrame([(1, line), (2, "\n".join(values))], "k int, t string")
    rows = P.scan_lines(df, "k", "t").collect()
    assert sorted((r.type, r.severity, r.match) for r in rows if r.k == 2) == want and len([r for r in rows if r.k == 1]) == 300 * len(want)
