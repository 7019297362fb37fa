"""Loading text, Markdown, HTML and PDF files into one document table with sections."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import written

EXTENSIONS = (".txt", ".md", ".markdown", ".html", ".htm", ".pdf")
SECTION = T.StructType([T.StructField("content", T.StringType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("section_heading", T.StringType()), T.StructField("heading_level", T.IntegerType()), T.StructField("page_number", T.IntegerType()), T.StructField("char_count", T.IntegerType())])
DOCUMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("doc_id", "source_path", "source_file", "file_name", "file_extension")]
    + [T.StructField("file_size_bytes", T.LongType()), T.StructField("last_modified", T.DoubleType()), T.StructField("raw_content", T.StringType()), T.StructField("clean_text", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("sections", T.ArrayType(SECTION)), T.StructField("error", T.StringType())]
)
# What is a heading, and front matter.
_HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
_FRONT = re.compile(r"\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\Z)", re.S)


def doc_id_of(path: str) -> str:
    """The first twelve hex digits of the MD5 of the absolute path."""
    return hashlib.md5(path.encode()).hexdigest()[:12]


def _section(content: str, index: int, heading: str | None, level: int | None = None, page: int | None = None) -> tuple:
    return (content, index, heading, level, page, len(content))


def load_text(raw: str) -> tuple[str, str, dict, list]:
    """Sections are paragraphs; the index counts blank ones too."""
    out = []
    for i, part in enumerate(re.split(r"\n\s*\n", raw)):
        part = part.strip()
        if part:
            heads = [x.strip().lstrip("#").strip() for x in part.split("\n") if x.strip().startswith("#")]
            out.append(_section(part, i, heads[0] if heads else None))
    return raw, raw, {}, out


def front_matter(raw: str) -> tuple[dict[str, str], str]:
    """The YAML front matter as strings, and the text after it. What can't be read as YAML stays in the text."""
    m = _FRONT.match(raw)
    if not m:
        return {}, raw
    try:
        import yaml

        data = yaml.safe_load(m[1])
    except ImportError:
        data = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in m[1].split("\n")) if k.strip()}
    except Exception:
        return {}, raw
    if not isinstance(data, dict):
        return {}, raw
    return {str(k): str(v) for k, v in data.items()}, raw[m.end() :].strip()


def load_markdown(raw: str) -> tuple[str, str, dict, list]:
    meta, text = front_matter(raw)
    out, lines, heading, level = [], [], None, 0

    def close() -> None:
        body = "\n".join(lines).strip()
        if body:
            out.append(_section(body, len(out), heading, level))

    for line in text.split("\n"):
        m = _HEADING.match(line)
        if m:
            close()
            lines, heading, level = [], m[2].strip(), len(m[1])
        lines.append(line)
    close()
    return raw, text, meta, out


class _Page(HTMLParser):
    """Text nodes and headed sections of a page, without scripts, styles and page furniture."""

    DROP = {"script", "style", "nav", "footer", "header"}
    BLOCKS = {"p", "div", "section", "article", "li", "td", "th", "pre", "blockquote", "body"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.drop, self.in_title, self.title = 0, False, None
        self.texts: list[str] = []
        self.sections: list[tuple[str | None, int, list[str]]] = [(None, 0, [])]
        self.level = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.DROP:
            self.drop += 1
        elif tag == "title":
            self.in_title = True
        elif re.fullmatch(r"h[1-6]", tag) and not self.drop:
            self.level = int(tag[1])
            self.sections.append(("", self.level, []))

    def handle_endtag(self, tag: str) -> None:
        if tag in self.DROP:
            self.drop = max(0, self.drop - 1)
        elif tag == "title":
            self.in_title = False
        elif re.fullmatch(r"h[1-6]", tag):
            self.level = 0

    def handle_data(self, data: str) -> None:
        t = data.strip()
        if not t or self.drop:
            return
        self.texts.append(t)
        if self.in_title:
            self.title = (self.title or "") + t
            return
        heading, level, body = self.sections[-1]
        if self.level:
            self.sections[-1] = (heading + t, level, body)
        else:
            body.append(t)


def load_html(raw: str) -> tuple[str, str, dict, list]:
    """The heading level of a section is that of its own heading, and nested text comes out once."""
    p = _Page()
    p.feed(raw)
    p.close()
    out = []
    for heading, level, body in p.sections:
        text = "\n".join(([heading] if heading else []) + body).strip()
        if text:
            out.append(_section(text, len(out), heading or None, level))
    return raw, "\n".join(p.texts), {"title": p.title} if p.title else {}, out


def load_pdf(data: bytes) -> tuple[str, str, dict, list]:
    try:
        import io

        import pdfplumber
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pdfplumber") from e
    with pdfplumber.open(io.BytesIO(data)) as pdf:
        pages = [(n, t) for n, t in ((i, x.extract_text()) for i, x in enumerate(pdf.pages, 1)) if t]
    out = []
    for n, text in pages:
        for part in filter(None, (x.strip() for x in re.split(r"\n\s*\n", text))):
            head = next((x.strip() for x in part.split("\n")[:3] if x.strip() and (x.strip().isupper() or re.match(r"\d+\.\s+\w+", x.strip()))), None)
            out.append(_section(part, len(out), head, None, n))
    return "".join(f"\n--- Page {n} ---\n{t}" for n, t in pages), "\n".join(t for _, t in pages), {"page_count": str(len(pages))}, out


def load_bytes(extension: str, data: bytes) -> tuple[str, str, dict, list]:
    """(raw, clean text, metadata, sections) of a file's bytes by its extension."""
    if extension == ".pdf":
        return load_pdf(data)
    raw = data.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
    if extension in (".md", ".markdown"):
        return load_markdown(raw)
    if extension in (".html", ".htm"):
        return load_html(raw)
    if extension == ".txt":
        return load_text(raw)
    raise ValueError(f"unsupported file type: {extension}")


def overridden(meta: dict[str, str]) -> dict:
    """The columns of a document that its front matter names, as far as their values fit."""
    out: dict = {}
    for name, kind in (("source_path", str), ("source_file", str), ("file_name", str), ("file_extension", str), ("file_size_bytes", int), ("last_modified", float)):
        try:
            if name in meta:
                out[name] = kind(meta[name])
        except ValueError:
            pass
    return out


def parse_files(files: DataFrame) -> DataFrame:
    """Documents of files in the schema of ``binaryFile`` (path, modificationTime, length, content). A file that can't be read has its error, not its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(DOCUMENT)
        for b in batches:
            for r in b.to_pylist():
                path = re.sub(r"^file:(?://)?", "", r["path"])
                name = os.path.basename(path)
                ext = os.path.splitext(name)[1].lower()
                row = dict(doc_id=doc_id_of(path), source_path=path, source_file=name, file_name=name, file_extension=ext, file_size_bytes=r["length"], last_modified=r["t"], metadata={}, sections=[])
                try:
                    raw, clean, meta, sections = load_bytes(ext, r["content"])
                    row |= dict(raw_content=raw, clean_text=clean, metadata=meta, sections=[dict(zip(SECTION.names, s)) for s in sections])
                    row |= overridden(meta)
                except Exception as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return files.select("path", F.unix_micros("modificationTime").cast("double").__truediv__(1e6).alias("t"), "length", "content").mapInArrow(run, DOCUMENT)


def load_directory(spark: SparkSession, path: str) -> DataFrame:
    """Documents of all supported files below a folder; the extension's case doesn't matter."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return parse_files(files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*EXTENSIONS)))


def discover(spark: SparkSession, root: str, explicit: list[str] | None = None) -> DataFrame:
    """(path, name): the supported files below a folder in the order of their paths, or those named, and each one's name below the folder."""
    if explicit:
        every = spark.createDataFrame([(i, p) for i, p in enumerate(explicit)], "place long, path string")
        base = F.regexp_replace("path", "^.*/", "")
        return every.orderBy("place").select("path", F.when(F.col("path").startswith(root.rstrip("/") + "/"), F.substr("path", F.lit(len(root.rstrip("/")) + 2))).otherwise(base).alias("name"))
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
        return spark.createDataFrame([], "path string, name string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    inside = F.substring_index("path", root.rstrip("/") + "/", -1)
    return files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*EXTENSIONS)).select("path", inside.alias("name")).orderBy("path")


def load_file(spark: SparkSession, path: str) -> DataFrame:
    if os.path.splitext(path)[1].lower() not in EXTENSIONS:
        raise ValueError(f"unsupported file type: {path}")
    return parse_files(spark.read.format("binaryFile").load(path))


def load_upload(spark: SparkSession, name: str, data: bytes) -> DataFrame:
    """A document of uploaded bytes; its id hashes the name, so the same upload has the same id. A name without extension is text."""
    if not os.path.splitext(name)[1]:
        name = f"{name}.txt"
    one = spark.createDataFrame([(name, len(data), bytearray(data))], "path string, length long, content binary").withColumn("modificationTime", F.current_timestamp())
    return parse_files(one)


def save_raw(docs: DataFrame, path: str) -> None:
    """Writes (doc_id, file_extension, raw_content): a row per document, by extension."""
    docs.select("doc_id", "file_extension", "raw_content").write.mode("append").partitionBy("file_extension").parquet(path)


def save_json(docs: DataFrame, path: str) -> None:
    """Writes a JSON document per line: doc_id, source_path, metadata, clean_text and the sections."""
    docs.select("doc_id", "source_path", "metadata", "clean_text", "sections").write.mode("append").json(path)


def process_directory(spark: SparkSession, path: str, raw: str, processed: str) -> DataFrame:
    """Loads a folder and saves what can be read, raw and processed; gives back all documents, with errors."""
    docs = written(load_directory(spark, path))
    good = docs.where("error IS NULL")
    save_raw(good, raw)
    save_documents(good, processed)
    return docs


def save_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("append").parquet(path)


def load_processed(spark: SparkSession, path: str, doc_id: str | None = None) -> DataFrame:
    """Saved documents, one or all."""
    d = spark.read.schema(DOCUMENT).parquet(path)
    return d if doc_id is None else d.where(F.col("doc_id") == doc_id)


def sections(docs: DataFrame) -> DataFrame:
    """A row per section."""
    return docs.select("doc_id", "source_file", F.explode("sections").alias("s")).select("doc_id", "source_file", "s.*")
