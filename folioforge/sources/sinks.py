"""Writers: JSON lines, CSV with a byte-order mark, one Markdown or Word document for each key, guarded overwriting, quarantine."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines; characters stay as they are."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV files with a header that begins with a byte-order mark; the columns named, in that order."""
    named = df.select(*columns)
    named.toDF("﻿" + columns[0], *columns[1:]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _paragraph(text: str) -> str:
    runs = '</w:t><w:br/><w:t xml:space="preserve">'.join(escape(t) for t in text.split("\n"))
    return f'<w:p><w:r><w:t xml:space="preserve">{runs}</w:t></w:r></w:p>'


def docx_bytes(parts: Iterable[str | list[list[str]]]) -> bytes:
    """A Word file of paragraphs (text) and tables (rows of cells); linear in their size."""
    body = []
    for p in parts:
        if isinstance(p, str):
            body.append(_paragraph(p))
        else:
            rows = ("<w:tr>" + "".join(f"<w:tc>{_paragraph(c)}</w:tc>" for c in r) + "</w:tr>" for r in p)
            body.append(f"<w:tbl>{''.join(rows)}</w:tbl>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS)
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W}"><w:body>{"".join(body)}</w:body></w:document>')
    return out.getvalue()


def docx_files(docs: DataFrame, name: str, paragraphs: str) -> DataFrame:
    """(name, content) of one Word file for each row, made by the executors from an array of paragraphs."""

    def run(batches):
        for b in batches:
            made = [docx_bytes([p for p in ps or () if p is not None]) for ps in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["name", "content"])

    return docs.select(docs[name].cast("string").alias("name"), paragraphs).mapInArrow(run, "name string, content binary")


def markdown(rows: DataFrame, doc: str, section: str, title: str, body: str, order: str) -> DataFrame:
    """(doc, text): one Markdown document for each doc; a heading where the section changes, one for each row, and its body."""
    from pyspark.sql.window import Window

    before = F.lag(section).over(Window.partitionBy(doc).orderBy(order))
    opens = before.isNull() | (before != F.col(section))
    part = F.concat(F.when(opens, F.concat(F.lit("# "), F.coalesce(section, F.lit("")), F.lit("\n\n"))).otherwise(""), F.lit("## "), F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "), F.lit("\n\n"), F.coalesce(body, F.lit("")), F.lit("\n"))
    each = rows.withColumn("__part", part).groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__part").alias("p")))).alias("ps"))
    return each.select(doc, F.array_join(F.transform("ps", lambda x: x["p"]), "\n").alias("text"))


def quarantined(rows: DataFrame, ok: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows by a condition; null is bad."""
    good = F.coalesce(F.expr(ok), F.lit(False))
    return rows.where(good), rows.where(~good)


def publish(df: DataFrame, path: str, root: str) -> None:
    """Overwrite `path`, which must lie below `root`, with `df`; an empty result is refused."""
    if not path.rstrip("/").startswith(root.rstrip("/") + "/") or ".." in path.split("/"):
        raise ValueError(f"{path} isn't below {root}")
    if df.isEmpty():
        raise ValueError("nothing to publish")
    df.write.mode("overwrite").parquet(path)


def append_usage(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Append ledger rows; a null cache_miss becomes what of the prompt wasn't cached."""
    miss = F.coalesce("cache_miss", F.greatest(F.coalesce("prompt_tokens", F.lit(0)) - F.coalesce("cache_hit", F.lit(0)), F.lit(0)))
    rows.withColumn("cache_miss", miss).write.mode("append").json(path)


def write_json_by(df: DataFrame, path: str, key: str) -> None:
    """JSON, one folder for each value of a key; a key's rows are brought together first, so that it has few files."""
    df.repartition(F.col(key)).write.mode("overwrite").partitionBy(key).json(path)


def docx_subset(content: bytes, keep: list[int]) -> bytes:
    """The Word file with only the body children at these indices, and the page settings; everything else in the package stays, so styles and images still resolve."""
    from xml.etree import ElementTree as ET

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    root = ET.fromstring(parts["word/document.xml"])
    body = next(n for n in root.iter() if n.tag.rpartition("}")[2] == "body")
    for i, child in enumerate(list(body)):
        if i not in set(keep) and child.tag.rpartition("}")[2] != "sectPr":
            body.remove(child)
    parts["word/document.xml"] = ET.tostring(root, encoding="utf-8", xml_declaration=True)
    return _zipped(parts)


def docx_merge(contents: list[bytes], page_break: bool = True) -> bytes:
    """The bodies of Word files one after another in the package of the first. Of the others, what refers to their own package (images, links) is left out."""
    from xml.etree import ElementTree as ET

    with zipfile.ZipFile(io.BytesIO(contents[0])) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    root = ET.fromstring(parts["word/document.xml"])
    body = next(n for n in root.iter() if n.tag.rpartition("}")[2] == "body")
    last = next((c for c in body if c.tag.rpartition("}")[2] == "sectPr"), None)
    if last is not None:
        body.remove(last)
    for content in contents[1:]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            other = ET.fromstring(z.read("word/document.xml"))
        if page_break:
            body.append(ET.fromstring(f'<w:p xmlns:w="{_W}"><w:r><w:br w:type="page"/></w:r></w:p>'))
        for child in next((n for n in other.iter() if n.tag.rpartition("}")[2] == "body"), ()):
            if child.tag.rpartition("}")[2] == "sectPr":
                continue
            for parent in list(child.iter()):
                for node in list(parent):
                    if any("/relationships}" in a for n in node.iter() for a in n.attrib) and node.tag.rpartition("}")[2] in ("drawing", "pict", "hyperlink"):
                        parent.remove(node)
            body.append(child)
    if last is not None:
        body.append(last)
    parts["word/document.xml"] = ET.tostring(root, encoding="utf-8", xml_declaration=True)
    return _zipped(parts)


def _zipped(parts: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()
