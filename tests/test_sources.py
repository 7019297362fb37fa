import pytest

from loamsift.sources import loaders as L


def test_text_markdown_and_html():
    assert [(s[0], s[1], s[2]) for s in L.load_text("one\n\n\n\n# Two\nx\n\nthree")[3]] == [("one", 0, None), ("# Two\nx", 1, "Two"), ("three", 2, None)]
    raw, text, meta, sections = L.load_markdown("---\ntitle: Test Document\nauthor: Test Author\n---\n\nintro\n# A\nbody\n## B\nmore\n")
    assert meta == {"title": "Test Document", "author": "Test Author"} and text.startswith("intro")
    assert [(s[2], s[3]) for s in sections] == [(None, 0), ("A", 1), ("B", 2)]
    _, text, meta, sections = L.load_html("<html><head><title>T</title><style>x{}</style></head><body><nav>no</nav><h1>One</h1><p>a &amp; b</p><h2>Two</h2><section><p>c</p></section><script>d()</script></body></html>")
    assert meta == {"title": "T"} and "no" not in text.split("\n") and "d()" not in text
    assert [(s[2], s[3], s[0]) for s in sections] == [("One", 1, "One\na & b"), ("Two", 2, "Two\nc")]


def test_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.MD").write_bytes(b"# H\r\ntext\r\n")
    (tmp_path / "sub" / "b.txt").write_text("plain")
    (tmp_path / "c.html").write_bytes(b"\xff\xfe broken")
    (tmp_path / "d.csv").write_text("x")
    rows = {r.file_name: r for r in L.load_directory(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.MD", "b.txt", "c.html"}
    assert rows["a.MD"].clean_text == "# H\ntext\n"
    assert rows["c.html"].error and rows["c.html"].clean_text is None
    assert rows["b.txt"].doc_id == L.doc_id_of(str(tmp_path / "sub" / "b.txt")) and len(rows["b.txt"].doc_id) == 12
    with pytest.raises(ValueError):
        L.load_file(spark, str(tmp_path / "d.csv"))
    docs = L.load_directory(spark, str(tmp_path)).where("error IS NULL")
    L.save_documents(docs, str(tmp_path / "out"))
    assert L.load_processed(spark, str(tmp_path / "out"), rows["b.txt"].doc_id).first().clean_text == "plain"
    assert L.sections(docs).where("source_file = 'b.txt'").first().content == "plain"


def test_uploads(spark):
    a, b = L.load_upload(spark, "note", b"hello").first(), L.load_upload(spark, "note", b"hello").first()
    assert a.doc_id == b.doc_id and a.file_extension == ".txt" and a.clean_text == "hello"


def test_discovery_in_order_and_by_name(spark, tmp_path):
    (tmp_path / "z").mkdir()
    for name in ("b.md", "z/a.TXT", "c.csv"):
        (tmp_path / name).write_text("x")
    root = str(tmp_path)
    assert [(r.path, r.name) for r in L.discover(spark, root).collect()] == [(f"{root}/b.md", "b.md"), (f"{root}/z/a.TXT", "z/a.TXT")]
    assert [r.name for r in L.discover(spark, root, [f"{root}/z/a.TXT", "/other/q.md"]).collect()] == ["z/a.TXT", "q.md"]
    assert L.discover(spark, root + "/missing").count() == 0


def test_a_folder_is_saved_raw_and_processed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("---\nsource_file: other.md\nfile_size_bytes: 7\nlast_modified: soon\n---\n# H\ntext")
    (tmp_path / "in" / "b.txt").write_bytes(b"\xff\xfe")
    docs = L.process_directory(spark, str(tmp_path / "in"), str(tmp_path / "raw"), str(tmp_path / "done"))
    rows = {r.file_name: r for r in docs.collect()}
    assert rows["b.txt"].error and rows["a.md"].source_file == "other.md" and rows["a.md"].file_size_bytes == 7 and rows["a.md"].last_modified > 1e9
    raw = spark.read.parquet(str(tmp_path / "raw")).collect()
    assert [(r.doc_id, r.file_extension) for r in raw] == [(rows["a.md"].doc_id, ".md")] and raw[0].raw_content.startswith("---")
    assert L.load_processed(spark, str(tmp_path / "done")).count() == 1
    L.save_json(docs.where("error IS NULL"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().clean_text.startswith("# H")


def test_pdf_pages_become_sections(monkeypatch):
    import sys
    import types

    class Page:
        def __init__(self, text):
            self.text = text

        def extract_text(self):
            return self.text

    class Pdf:
        pages = [Page("1. Scope\nfirst\n\nsecond part"), Page(None), Page("LAST PAGE\nend")]

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

    monkeypatch.setitem(sys.modules, "pdfplumber", types.SimpleNamespace(open=lambda _: Pdf()))
    raw, text, meta, sections = L.load_bytes(".pdf", b"%PDF")
    assert meta == {"page_count": "2"} and "--- Page 3 ---" in raw and text.endswith("end")
    assert [(s[2], s[4]) for s in sections] == [("1. Scope", 1), (None, 1), ("LAST PAGE", 3)]
