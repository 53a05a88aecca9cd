"""Readers: Word files, recogniser output, ledgers, CSV with a byte-order mark, JSON lines, handout tables."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.scan import running_sum

BLOCKS = "source_doc string, ord int, body_index int, kind string, text string, char_start int, char_end int, error string"
LEDGER = "seq long, ts double, stage string, item_id string, provider string, model string, thinking string, effort string, prompt_tokens long, cache_hit long, cache_miss long, completion_tokens long, reasoning_tokens long, seconds double"
FURNITURE = ("header", "footer", "page_number", "seal")


def listing(spark: SparkSession, path: str, extension: str, recursive: bool = True) -> DataFrame:
    """(path, length, content) of the files with an extension below a folder, without editors' lock files (~$...). An empty folder gives none.

    Content is read by the executors when it is used, one file a row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.where(~F.rlike("path", F.lit(r"(^|/)(~|%7E)(\$|%24)[^/]*$"))).select("path", "length", "content")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def node_text(node: ET.Element) -> str:
    """Text of an XML node: runs, tabs and line breaks in document order, whatever the namespace."""
    return "".join(n.text or "" if _local(n.tag) == "t" else "\t" if _local(n.tag) == "tab" else "\n" if _local(n.tag) in ("br", "cr") else "" for n in node.iter())


def docx_blocks(content: bytes) -> list[tuple[int, str, str, int, int]]:
    """(body_index, kind, text, char_start, char_end) of a Word file: one block for each paragraph with text, one for each table row, cells joined by ' | '.

    Offsets are those in the blocks' texts joined by newlines. Raises KeyError without word/document.xml; a file without body has none.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    body = next((n for n in root.iter() if _local(n.tag) == "body"), None)
    out, pos = [], 0
    for index, child in enumerate(body if body is not None else ()):
        if _local(child.tag) == "p":
            texts = [("p", node_text(child).strip())]
        elif _local(child.tag) == "tbl":
            rows = [n for n in child if _local(n.tag) == "tr"]
            texts = [("tbl", " | ".join(t for c in r if _local(c.tag) == "tc" and (t := node_text(c).strip()))) for r in rows]
        else:
            continue
        for kind, text in texts:
            if text:
                out.append((index, kind, text, pos, pos + len(text)))
                pos += len(text) + 1
    return out


def read_docx(files: DataFrame) -> DataFrame:
    """The blocks of Word files (path, content). A file that can't be read gives one row with `error` instead."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name = path.rpartition("/")[2]
                try:
                    rows = [(name, i, *x, None) for i, x in enumerate(docx_blocks(content))]
                except Exception as e:
                    rows = [(name, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])]
                cols = list(zip(*rows)) or [()] * 8
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["source_doc", "ord", "body_index", "kind", "text", "char_start", "char_end", "error"])

    return files.select("path", "content").mapInArrow(run, BLOCKS)


def handout_tables(files: DataFrame, headers: dict[str, list[str]]) -> DataFrame:
    """(source_doc, list, row, cells) of tables whose first row is one of `headers`, white space apart; other tables give one row with list null and cells their header."""

    def run(batches):
        key = lambda s: "".join(s.split())
        for b in batches:
            out = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        root = ET.fromstring(z.read("word/document.xml"))
                except Exception:
                    continue
                for t in (n for n in root.iter() if _local(n.tag) == "tbl"):
                    rows = [[node_text(c).strip() for c in r if _local(c.tag) == "tc"] for r in t if _local(r.tag) == "tr"]
                    if not rows:
                        continue
                    name = next((k for k, h in headers.items() if [*map(key, h)] == [*map(key, rows[0])]), None)
                    out += [(path.rpartition("/")[2], name, i, r) for i, r in enumerate(rows[1:])] if name else [(path.rpartition("/")[2], None, 0, rows[0])]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.string()))], names=["source_doc", "list", "row", "cells"])

    return files.select("path", "content").mapInArrow(run, "source_doc string, list string, row int, cells array<string>")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines ledger; lines that are no JSON are dropped, a missing path is an empty ledger."""
    schema = LEDGER
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, all columns strings, a byte-order mark taken off the first name."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*(c.lstrip("﻿").strip('"') for c in df.columns))


def recognised_blocks(lines: DataFrame) -> DataFrame:
    """(doc, place, page, seq, label, text) of recogniser output: rows (doc, line, body), body a JSON result with layoutParsingResults / prunedResult / parsing_res_list.

    Pages count on over the lines of a document. Furniture is dropped first. Within a page a block's rank is twice its block_order; one without order comes right
    after the block before it, the first at 1. `place` is page x 10,000 + rank; seq, the block's position among those of the page, orders blocks of one place. Null labels
    are text, null contents empty.
    """
    block = "struct<block_label:string,block_content:string,block_order:int>"
    result = f"struct<result:struct<layoutParsingResults:array<struct<prunedResult:struct<parsing_res_list:array<{block}>>>>>>"
    parsed = lines.select("doc", "line", F.from_json("body", result)["result"]["layoutParsingResults"].alias("pages"))
    sized = parsed.select("doc", "line", F.greatest(F.size("pages"), F.lit(0)).alias("size"), "pages")
    pages = running_sum(sized, "doc", ["line"], "size", "before").select("doc", "before", F.posexplode("pages").alias("p", "r"))
    kept = F.filter("r.prunedResult.parsing_res_list", lambda b: ~F.coalesce(b["block_label"].isin(*FURNITURE), F.lit(False)))
    none = F.array().cast("array<int>")
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0))
    ranks = F.aggregate(kept, none, lambda a, b: F.concat(a, F.array(F.coalesce(b["block_order"] * 2, last(a) + 1))))
    blocks = pages.select("doc", (F.col("before") + F.col("p")).alias("page"), F.posexplode(F.arrays_zip(kept.alias("b"), ranks.alias("rank"))).alias("seq", "x"))
    return blocks.select("doc", (F.col("page") * 10000 + F.col("x.rank")).alias("place"), "page", "seq", F.coalesce("x.b.block_label", F.lit("text")).alias("label"), F.coalesce("x.b.block_content", F.lit("")).alias("text"))


def content_list(rows: DataFrame) -> DataFrame:
    """(doc, place, page, label, text) of the other recogniser's list (doc, idx, type, text, text_level, page_idx, table_body): headings by level, discarded blocks dropped."""
    label = F.when(F.coalesce("text_level", F.lit(0)) > 0, "paragraph_title").otherwise(F.col("type"))
    text = F.when(F.col("type") == "table", F.col("table_body")).otherwise(F.col("text"))
    keep = ~F.coalesce(F.col("type").isin("header", "footer", "page_number", "discarded"), F.lit(False))
    return rows.where(keep).select("doc", (F.col("page_idx") * 10000 + F.col("idx")).alias("place"), F.col("page_idx").alias("page"), label.alias("label"), text.alias("text"))
