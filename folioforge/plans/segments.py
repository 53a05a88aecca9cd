"""Queries of the segmenter and what hangs on it, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import reply
from folioforge.operators import segmenter
from folioforge.plans.catalogue import query, table
from folioforge.plans.texts import _packed_sql, _strip
from folioforge.rules import DEFAULT

_case = "CASE " + " ".join(f"WHEN regexp_matches({_strip('line')}, '(?i){DEFAULT.openings[s]}') THEN '{s}'" for s in DEFAULT.order) + " END"
_STARTS = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l),
starts AS (SELECT * FROM (SELECT doc_id, CAST(pos AS BIGINT) AS pos, {_case} AS section, {_strip("line")} AS line FROM p) WHERE section IS NOT NULL)"""


@query(f"WITH {_STARTS} SELECT * FROM starts")
def section_starts(spark, d):
    return segmenter.section_starts(table(spark, d, "documents"), "doc_id", "text")


@query(None)
def segment_index(spark, d):
    """Item texts cut into the sections they open, with the answers of their own text."""
    docs = table(spark, d, "items").where("item_id is not null").groupBy(F.col("item_id").alias("doc")).agg(F.min("text").alias("text"))
    segs = segmenter.segments(docs, "doc", "text")
    return segmenter.with_answers(segs, docs, "doc", "text").select("item_id", "doc", "section", "pos", "slice_end", "char_count", "answer_count", segmenter.answer_text(F.col("answers")).alias("answers"))


_alias = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DEFAULT.aliases.items())
_own = ", ".join(f"'{s}'" for s in DEFAULT.order)


@query(f"SELECT item_id, item_label, coalesce(CASE split_part(trim(item_label), '-', 1) {_alias} END, CASE WHEN lower(split_part(trim(item_label), '-', 1)) IN ({_own}) THEN lower(split_part(trim(item_label), '-', 1)) END, 'unknown') AS section FROM items")
def alias_map(spark, d):
    return table(spark, d, "items").select("item_id", "item_label", segmenter.section_of(F.split_part(F.trim("item_label"), F.lit("-"), F.lit(1))).alias("section"))


@query("""WITH b AS (SELECT DISTINCT * FROM blocks), s AS (SELECT source_doc, CAST(5 AS INT) AS low, CAST(9 AS INT) AS high FROM papers)
SELECT source_doc, low, high, coalesce((SELECT string_agg(text, chr(10) ORDER BY ord, text) FROM b WHERE b.source_doc = s.source_doc AND body_index >= low AND body_index < high), '') AS body FROM s""")
def span_bodies(spark, d):
    s = table(spark, d, "papers").select("source_doc", F.lit(5).alias("low"), F.lit(9).alias("high"))
    return segmenter.body_text(s, table(spark, d, "blocks").distinct(), "source_doc", "body_index", "text", "low", "high", "ord")


@query(r"""WITH b AS (SELECT DISTINCT source_doc, ord, text FROM blocks) SELECT source_doc, "at", CAST(coalesce((SELECT max(ord) + 1 FROM b WHERE b.source_doc = c.source_doc AND ord < c."at" AND trim(text) <> '' AND NOT regexp_matches(text, '^[A-G]\.|^\d+[-—~]')), 0) AS INT) AS moved
FROM (SELECT source_doc, CAST(max(ord) AS INT) AS "at" FROM b GROUP BY 1) c""")
def above_junk(spark, d):
    b = table(spark, d, "blocks").select("source_doc", "ord", "text").distinct()
    return segmenter.above_junk(b, "source_doc", "ord", "text", b.groupBy("source_doc").agg(F.max("ord").alias("at")), "at", r"^[A-G]\.|^\d+[-—~]")


@query("""SELECT doc_id, CASE WHEN strpos(text, '参考答案') > 0 THEN trim(CASE WHEN c IS NULL THEN b ELSE substring(b, 1, c - 1) END) END AS answers FROM (SELECT doc_id, text, b, least(CASE WHEN strpos(b, 'Paragraph') > 1 THEN strpos(b, 'Paragraph') END, CASE WHEN strpos(b, '56.') > 1 THEN strpos(b, '56.') END, CASE WHEN strpos(b, '【') > 1 THEN strpos(b, '【') END) AS c FROM (SELECT doc_id, text, substring(text, strpos(text, '参考答案') + 4) AS b FROM documents))""")
def between_markers(spark, d):
    return table(spark, d, "documents").select("doc_id", segmenter.between(F.col("text"), "参考答案", "Paragraph", ["56.", "【"]).alias("answers"))


@query("SELECT doc_id, coalesce(CASE WHEN trim(section) <> '' THEN section END, CASE WHEN trim(doc_kind) <> '' THEN doc_kind END, CASE WHEN trim(lang) <> '' THEN lang END) AS label FROM documents")
def first_label(spark, d):
    return table(spark, d, "documents").select("doc_id", segmenter.first_text(F.col("section"), F.col("doc_kind"), F.col("lang")).alias("label"))


@query(_packed_sql(1500) + " SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk) AS INT) AS unit, body FROM packed WHERE length(body) >= 200")
def rough_units(spark, d):
    return segmenter.rough_units(table(spark, d, "documents"), "doc_id", "text", 1500)


@query("SELECT entry_id, json_extract_string(payload, '$.word') AS word FROM raw_entries WHERE json_valid(payload)")
def unwrapped_idea(spark, d):
    r = table(spark, d, "raw_entries")
    said = F.when(F.col("entry_id") % 3 == 0, F.concat(F.lit('{"ideas":['), F.col("payload"), F.lit("]}"))).when(F.col("entry_id") % 3 == 1, F.concat(F.lit('{"ideas":'), F.col("payload"), F.lit("}"))).otherwise(F.col("payload"))
    return r.select("entry_id", F.get_json_object(reply.idea(said), "$.word").alias("word"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 0 THEN least(l_linenumber / l_quantity, 1.0) END AS done FROM lineitem")
def log_progress(spark, d):
    line = F.concat(F.lit("score ("), F.col("l_linenumber").cast("string"), F.lit("/"), F.col("l_quantity").cast("int").cast("string"), F.lit(") ok"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", reply.progress(line).alias("done"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ['pStyle', 'spacing', 'rPr', 'zz'] ELSE ['pStyle', 'ind', 'jc'] END AS children FROM orders")
def fixed_order(spark, d):
    mixed = F.when(F.col("o_orderkey") % 2 == 0, F.array(*map(F.lit, ("zz", "rPr", "pStyle", "spacing")))).otherwise(F.array(*map(F.lit, ("jc", "ind", "pStyle"))))
    return table(spark, d, "orders").select("o_orderkey", reply.reordered(mixed, ["pStyle", "spacing", "ind", "jc", "rPr"]).alias("children"))
