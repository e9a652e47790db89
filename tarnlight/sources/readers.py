"""Readers of file contents: plain text and office packages, as ``rel, text, status, detail``.

Office files are zip packages of XML and read with the standard library; PDF needs an optional library and is ``failed``
without it. Contents come and go in Arrow batches; a broken file is a row with a status and no error of the job.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.functions import text as T
from tarnlight.sources.corpus import EXTRACT_LIMIT

SNIFF, CONTROL_SHARE = 8192, 0.30
OLE2 = bytes.fromhex("D0CF11E0A1B11AE1")
CONTROLS = bytes(c for c in range(32) if c not in b"\t\n\f\r")


def binary(head: bytes) -> bool:
    """Whether the first bytes are no text: a NUL, or too many control characters."""
    return b"\0" in head or len(head) > 0 and sum(head.count(bytes([c])) for c in CONTROLS) / len(head) > CONTROL_SHARE


def _local(node):
    return node.tag.rpartition("}")[2]


def _texts(node, name="t"):
    return "".join(n.text or "" for n in node.iter() if _local(n) == name)


def _cells(rows, cell):
    for row in rows:
        values = [" ".join(filter(None, (_texts(p).strip() for p in c.iter() if _local(p) == "p"))) for c in row if _local(c) == cell]
        if any(values):
            yield " | ".join(values)


def docx(z: zipfile.ZipFile) -> str:
    """Paragraphs of the body, then the rows of its tables."""
    body = next(n for n in ElementTree.fromstring(z.read("word/document.xml")).iter() if _local(n) == "body")
    lines = [t for p in body if _local(p) == "p" and (t := _texts(p)).strip()]
    for table in (n for n in body if _local(n) == "tbl"):
        lines += _cells((r for r in table if _local(r) == "tr"), "tc")
    return "\n".join(lines)


def _numbered(z, pattern):
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def pptx(z: zipfile.ZipFile) -> str:
    out = []
    for i, name in enumerate(_numbered(z, r"ppt/slides/slide(\d+)\.xml"), 1):
        out.append(f"\n--- SLIDE {i} ---")
        tree = ElementTree.fromstring(z.read(name))
        for shape in (n for n in tree.iter() if _local(n) in ("sp", "graphicFrame")):
            if _local(shape) == "sp":
                out += [t for p in shape.iter() if _local(p) == "p" and (t := _texts(p).strip())]
            else:
                out += _cells((r for r in shape.iter() if _local(r) == "tr"), "tc")
        notes = f"ppt/notesSlides/notesSlide{re.search(r'(\d+)', name)[1]}.xml"
        if notes in z.namelist() and (t := " ".join(filter(None, (_texts(p).strip() for p in ElementTree.fromstring(z.read(notes)).iter() if _local(p) == "p")))):
            out.append(f"[Notes] {t}")
    return "\n".join(out)


def sheets(z: zipfile.ZipFile):
    """Name and part of each sheet in the workbook's order, by its relations; without them, by the parts' numbers."""
    named = [(n.get("name"), next((v for k, v in n.attrib.items() if k.endswith("}id")), None)) for n in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(n) == "sheet"]
    rels = "xl/_rels/workbook.xml.rels"
    if rels not in z.namelist():
        return zip([name for name, _ in named], _numbered(z, r"xl/worksheets/sheet(\d+)\.xml"), strict=False)
    targets = {n.get("Id"): n.get("Target", "") for n in ElementTree.fromstring(z.read(rels)) if _local(n) == "Relationship"}
    parts = ((name, targets.get(key, "")) for name, key in named)
    parts = ((name, t.lstrip("/") if t.startswith("/") else f"xl/{t}") for name, t in parts)
    return [(name, part) for name, part in parts if part in z.namelist()]


def xlsx(z: zipfile.ZipFile) -> str:
    shared = [_texts(n) for n in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(n) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
    out = []
    for name, part in sheets(z):
        out.append(f"\n=== SHEET: {name} ===")
        for row in (n for n in ElementTree.fromstring(z.read(part)).iter() if _local(n) == "row"):
            cells: dict[int, str] = {}
            for k, c in enumerate(n for n in row if _local(n) == "c"):
                at = 0
                for letter in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                    at = at * 26 + ord(letter) - 64
                value = _texts(c, "v") or _texts(c)
                cells[at - 1 if at else k] = shared[int(value)] if c.get("t") == "s" and value else {"1": "True", "0": "False"}.get(value, value) if c.get("t") == "b" else value
            values = [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]
            if any(v.strip() for v in values):
                out.append("\t".join(values))
    return "\n".join(out)


def pdf(content: bytes, passwords=("",)) -> str:
    from pdfminer.high_level import extract_text

    error: Exception | None = None
    for p in passwords:
        try:
            return extract_text(io.BytesIO(content), password=p)
        except Exception as e:  # noqa: BLE001  the next password may do
            error = e
    raise error


def read_secrets(spark, *paths: str) -> dict[str, str]:
    """Passwords by part of a path, from the first of the JSON files that is there and holds an object; none otherwise."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            continue
        stream = fs.open(at)
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        except ValueError:
            continue
        finally:
            stream.close()
        return {k: v for k, v in found.items() if isinstance(v, str)} if isinstance(found, dict) else {}
    return {}


def passwords_for(rel: str, secrets: dict[str, str]) -> list[str]:
    """No password first, then those whose key is in the path, in the order given."""
    return ["", *(v for k, v in secrets.items() if k in rel)]


def describe(error: Exception, content: bytes, asked: int = 0) -> str:
    """Why a file couldn't be read, and what to do; ``asked``: passwords that were tried."""
    kind = type(error).__name__
    if kind == "PDFPasswordIncorrect":
        return "an encrypted PDF: none of its passwords fits" if asked else "an encrypted PDF: it has no password in the secrets"
    if kind == "PSEOF":
        return "not a complete PDF: it ends in the middle"
    if content.startswith(OLE2):
        return "an old or encrypted office file: save it in a current format without a password"
    if isinstance(error, zipfile.BadZipFile):
        return "not a complete office file: it may have been cut off"
    return f"{type(error).__name__}: {error}"[:300]


def read_one(rel: str, ext: str, content: bytes, secrets: dict[str, str]) -> tuple[str | None, str, str]:
    """Text, status and detail of one file."""
    if len(content) > EXTRACT_LIMIT:
        return None, "skipped", f"{len(content)} bytes"
    try:
        if ext in T.TEXT_TYPES:
            if binary(content[:SNIFF]):
                return None, "unsupported", "not text"
            text = content.decode("utf-8", "replace")
        elif ext in (".docx", ".pptx", ".xlsx", ".xlsm"):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                text = {".docx": docx, ".pptx": pptx}.get(ext, xlsx)(z)
        elif ext == ".pdf":
            text = pdf(content, passwords_for(rel, secrets))
        else:
            return None, "unsupported", f"no reader for {ext or 'files without a type'}"
    except Exception as e:  # noqa: BLE001  whatever a broken file raises is its status
        return None, "failed", describe(e, content, len(passwords_for(rel, secrets)) - 1)
    text = re.sub(r"[\x00-\x08\x0B\x0E-\x1F\x7F]", "", text)
    return text, "ok" if text.strip() else "empty", ""


def extracted(files: DataFrame, secrets: dict[str, str] | None = None) -> DataFrame:
    """``rel, text, status, chars, detail`` of ``files(rel, size, content)``. Secrets never become a column."""
    known = dict(secrets or {})

    def run(batches):
        for b in batches:
            got = [read_one(r, e, bytes(c), known) for r, e, c in zip(b["rel"], b["ext"], b["content"], strict=True)]
            yield pd.DataFrame({"rel": b["rel"], "text": [g[0] for g in got], "status": [g[1] for g in got], "chars": [len(g[0] or "") for g in got], "detail": [g[2] for g in got]})

    rows = files.select("rel", T.extension(F.col("rel")).alias("ext"), F.when(F.col("size") <= EXTRACT_LIMIT, F.col("content")).otherwise(F.lit(b"")).alias("content"), "size")
    big = rows.filter(F.col("size") > EXTRACT_LIMIT).select("rel", F.lit(None).cast("string").alias("text"), F.lit("skipped").alias("status"), F.lit(0).cast("long").alias("chars"), F.concat(F.col("size"), F.lit(" bytes")).alias("detail"))
    rest = rows.filter(F.col("size") <= EXTRACT_LIMIT).select("rel", "ext", "content")
    return rest.mapInPandas(run, "rel string, text string, status string, chars long, detail string").unionByName(big)


def table_of_tsv(spark, path: str, columns: list[str], key: str) -> DataFrame:
    """A tab-separated state file, checked: header and row lengths must be right; of a repeated key the last row counts."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    head = lines.orderBy("at").limit(1).collect()
    if not head:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    if head[0]["value"].split("\t") != columns:
        raise ValueError(f"{path}: its header isn't {columns}")
    cells = F.split("value", "\t", -1)
    rows = lines.filter(F.col("at") != head[0]["at"]).filter(F.trim("value") != "")
    bad = F.raise_error(F.concat(F.lit(f"{path}: a row has another number of cells or a NUL: "), F.substring("value", 1, 80)))
    rows = rows.select("at", F.when((F.size(cells) == len(columns)) & ~F.col("value").contains("\0"), cells).otherwise(bad).alias("c"))
    rows = rows.select("at", *(F.nullif(F.col("c")[i], F.lit("")).alias(c) for i, c in enumerate(columns)))
    return rows.groupBy(key).agg(*(F.max_by(c, "at").alias(c) for c in columns if c != key)).select(*columns)
