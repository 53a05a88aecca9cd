"""Queries of projections, gates, chunks, fallbacks, readers and sinks, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioforge.functions import reply
from folioforge.operators import extract, rank, segment, summary
from folioforge.plans.catalogue import query, table
from folioforge.plans.texts import _strip
from folioforge.session import shared_dir
from folioforge.sources import files, sinks

# ---- answers and gates


@query("""SELECT p_partkey, CAST(56 + i AS INT) AS number, string_split(p_name, ' ')[CAST(i + 1 AS INT)] AS answer FROM part, range(2) t(i)""")
def grammar_tokens(spark, d):
    """The line of 57 ends before another number and before the text does: the token after it counts."""
    words = F.split("p_name", " ")
    said = F.concat(F.lit("56. "), words[0], F.lit("\n57. "), words[1], F.lit(" and more\n\nThe end of the key."))
    return extract.answer_words(table(spark, d, "part").select("p_partkey", said.alias("text")), "p_partkey", "text")


_RUN = r"(?m)^[\s]*(\d{1,2})\s*[-—~－–]+\s*(\d{1,2})\s*[.．、:：]?\s*([A-G]{2,})(?:$|[^0-9A-Za-z_\x{4e00}-\x{9fff}])"


@query(rf"""WITH r AS (SELECT doc_id, text, list_filter(list_zip(regexp_extract_all(text, '{_RUN}', 1), regexp_extract_all(text, '{_RUN}', 2), regexp_extract_all(text, '{_RUN}', 3)),
  lambda m: CAST(m[2] AS INT) > CAST(m[1] AS INT) AND length(m[3]) = CAST(m[2] AS INT) - CAST(m[1] AS INT) + 1)[1] AS m FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '来源[：:]') THEN 'source' END, CASE WHEN regexp_matches(text, '【导语】|【\d+题详解】|【详解】') THEN 'explanation' END,
  CASE WHEN regexp_matches(text, '参考范文|One possible version') THEN 'model essay' END, CASE WHEN contains(text, '**') THEN 'markdown' END,
  'key ' || CAST(m[1] AS INT) || '-' || CAST(m[2] AS INT) || ' ' || m[3], CASE WHEN regexp_matches(text, '【\d+题详解】') THEN 'explained' END], lambda x: x IS NOT NULL) AS found FROM r""")
def forbidden_text(spark, d):
    """What each document holds that a sheet for students must not."""
    return table(spark, d, "documents").select("doc_id", extract.forbidden(F.coalesce("text", F.lit(""))).alias("found"))


# ---- chunks of a token budget

_tok = lambda c: f"greatest(1, CAST(floor(length({c}) / 2.6) AS INT))"
_lines = lambda p: f"list_filter(list_transform(string_split({p}, chr(10)), lambda y: {_strip('y')}), lambda y: y <> '')"


@query(rf"""WITH RECURSIVE d AS (SELECT doc_id, {_strip("text")} AS t FROM documents WHERE {_strip("text")} <> ''),
p AS (SELECT doc_id, flatten(list_transform(list_filter(list_transform(regexp_split_to_array(t, '\n\s*\n'), lambda x: {_strip("x")}), lambda x: x <> ''), lambda x: CASE WHEN {_tok("x")} <= 420 THEN [x] ELSE {_lines("x")} END)) AS ps FROM d WHERE {_tok("t")} > 2100),
t AS (SELECT doc_id, unnest(ps) AS x, generate_subscripts(ps, 1) AS r FROM p),
g AS (SELECT doc_id, r, x, {_tok("x")} AS used, 0 AS chunk FROM t WHERE r = 1 UNION ALL
SELECT t.doc_id, t.r, t.x, CASE WHEN g.used + {_tok("t.x")} > 420 THEN {_tok("t.x")} ELSE g.used + {_tok("t.x")} END, CASE WHEN g.used + {_tok("t.x")} > 420 THEN g.chunk + 1 ELSE g.chunk END FROM g JOIN t ON t.doc_id = g.doc_id AND t.r = g.r + 1)
SELECT doc_id, CAST(chunk AS INT) AS chunk, string_agg(x, chr(10) || chr(10) ORDER BY r) AS body FROM g GROUP BY 1, 2
UNION ALL SELECT doc_id, 0, t FROM d WHERE {_tok("t")} <= 2100""")
def token_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(segment.token_chunks(F.col("text"), 2100, 400)).alias("chunk", "body"))


# ---- projections of scores


def _scored(spark, d):
    """Documents as scored items: every third reply is no object."""
    docs = table(spark, d, "documents")
    told = F.to_json(F.struct(F.col("doc_kind").alias("topic"), F.col("n_chars").alias("novelty_score"), F.col("lang").alias("selection_reason"), F.array(F.coalesce("source", F.lit(""))).alias("topic_words"), F.lit("from the reply").alias("item_label")))
    said = F.when(F.col("doc_id") % 3 == 0, F.lit("[1]")).otherwise(told)
    return docs.select(F.col("doc_id").cast("string").alias("item_id"), F.col("source").alias("source_doc"), "section", F.upper("section").alias("display_section"), said.alias("score"), F.col("n_chars").alias("selection_score"))


_told = lambda c: f"CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce(CAST({c} AS VARCHAR), '') END"
_who = f"CAST(doc_id AS VARCHAR) AS item_id, coalesce(source, '') AS source_doc, {_told(chr(39) + 'from the reply' + chr(39))} AS item_label, {_told('doc_kind')} AS topic, {_told('n_chars')} AS novelty_score, {_told('lang')} AS selection_reason, "
_marks = "'' AS topic_category, '' AS difficulty_score, '' AS vocabulary_value_score, '' AS grammar_value_score, '' AS exam_value_score, '' AS recommendation_score, '' AS best_fit_selection_bucket, '' AS classroom_suggestion"


@query(f"SELECT {_who}{_marks}, coalesce(section, '') AS section, coalesce(upper(section), '') AS display_section, '' AS writing_angle_novelty_score, '' AS score_summary FROM documents")
def flat_scores(spark, d):
    return reply.flat_score(_scored(spark, d))


_lists = ", ".join(f"'' AS {c}" for c in reply._LISTS if c != "topic_words")


@query(f"""SELECT {_who}{_marks}, coalesce(section, '') AS section, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '["' || coalesce(source, '') || '"]' END AS topic_words, {_lists} FROM documents""")
def flat_analyses(spark, d):
    return reply.flat_analysis(_scored(spark, d).withColumnRenamed("score", "analysis"))


@query(f"SELECT {_who}{_marks}, coalesce(upper(section), '') AS section, '' AS writing_angle_novelty_score, '' AS score_summary, coalesce(CAST(n_chars AS VARCHAR), '') AS local_selection_score FROM documents")
def shortlist_rows(spark, d):
    return reply.shortlist_row(_scored(spark, d))


_MARKS = {"novelty": "l_quantity", "difficulty": "l_linenumber", "vocabulary": "l_discount", "grammar": "l_tax", "exam": "l_suppkey % 7", "writing": "l_partkey % 5", "recommendation": "l_orderkey % 11"}
_names = [*(k for k in rank.WEIGHTS if k), "listening"]
_section = f"list_extract([{', '.join(repr(n) for n in _names)}], CAST(l_suppkey % {len(_names)} + 1 AS INT))"
_sum = lambda w: " + ".join(f"({_MARKS[k]}) * {float(v)}" for k, v in w.items())


@query(
    f"SELECT l_orderkey, l_linenumber, s AS section, round(CASE s {' '.join(f'WHEN {k!r} THEN {_sum(w)}' for k, w in rank.WEIGHTS.items() if k)} ELSE {_sum(rank.WEIGHTS[None])} END, 6) AS score FROM (SELECT *, {_section} AS s FROM lineitem)"
)
def selection_scores(spark, d):
    li = table(spark, d, "lineitem").withColumn("section", F.element_at(F.array(*map(F.lit, _names)), (F.col("l_suppkey") % len(_names) + 1).cast("int")))
    marks = {k: F.expr(v).cast("double") for k, v in _MARKS.items()}
    return li.select("l_orderkey", "l_linenumber", "section", F.round(rank.selection_score(F.col("section"), marks), 6).alias("score"))


@query("SELECT seq, CASE WHEN seq % 4 = 0 THEN 'whole' WHEN seq % 4 = 1 THEN 'chunked' WHEN coalesce(item_id, '') <> '' THEN 'chunked' ELSE 'whole' END AS mode FROM usage_ledger")
def row_modes(spark, d):
    """Half of the rows say their mode, the others show it by their shape."""
    said = F.when(F.col("seq") % 4 == 0, "whole").when(F.col("seq") % 4 == 1, "chunked").when(F.col("seq") % 4 == 2, "")
    return table(spark, d, "usage_ledger").select("seq", reply.row_mode(said, F.col("item_id"), ("chunked", "whole")).alias("mode"))


# ---- recogniser output


@query("""WITH b AS (SELECT DISTINCT block_id, source_doc, page, label, text, block_order FROM ocr_blocks WHERE source_doc IS NOT NULL AND page IS NOT NULL), g AS (SELECT *, dense_rank() OVER (PARTITION BY source_doc ORDER BY page) - 1 AS pg FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY source_doc, page ORDER BY block_id) AS rn FROM g WHERE coalesce(label, 'text') NOT IN ('header', 'footer', 'page_number', 'seal')),
f AS (SELECT *, last_value(block_order IGNORE NULLS) OVER w AS o, max(CASE WHEN block_order IS NOT NULL THEN rn END) OVER w AS a FROM k WINDOW w AS (PARTITION BY source_doc, page ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT source_doc AS doc, CAST(pg * 10000 + coalesce(2 * o, 0) + rn - coalesce(a, 0) AS BIGINT) AS place, CAST(pg AS BIGINT) AS page, CAST(rn - 1 AS INT) AS seq, coalesce(label, 'text') AS label, coalesce(text, '') AS text FROM f""")
def recognised_places(spark, d):
    """The scanned pages as a recogniser's JSON lines, one for each page, read back in order."""
    b = table(spark, d, "ocr_blocks").where("source_doc is not null and page is not null").select("block_id", "source_doc", "page", F.col("label").alias("block_label"), F.col("text").alias("block_content"), "block_order").distinct()
    pages = b.groupBy("source_doc", "page").agg(F.array_sort(F.collect_list(F.struct("block_id", "block_label", "block_content", "block_order"))).alias("parsing_res_list"))  # a page's blocks
    body = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct("parsing_res_list").alias("prunedResult"))).alias("layoutParsingResults")).alias("result")))
    return files.recognised_blocks(pages.select(F.col("source_doc").alias("doc"), F.col("page").alias("line"), body.alias("body")))


# ---- usage without a ledger, names without a definition


@query("""SELECT coalesce(nullif(stage, ''), '?') AS stage, coalesce(nullif(model, ''), '?') AS model, count(*) AS calls, sum(coalesce(cache_hit, 0)) AS cached, sum(greatest(coalesce(prompt_tokens, 0) - coalesce(cache_hit, 0), 0)) AS fresh,
sum(coalesce(completion_tokens, 0)) AS output FROM usage_ledger GROUP BY 1, 2""")
def usage_from_replies(spark, d):
    """The ledger is empty: usage is added up from the records that replies keep."""
    u = table(spark, d, "usage_ledger")
    record = F.to_json(F.struct(F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"), F.coalesce("cache_hit", F.lit(0)).alias("prompt_cache_hit_tokens"), F.coalesce("completion_tokens", F.lit(0)).alias("completion_tokens")))
    return summary.usage_or_older(u.where("false"), u.select("stage", "model", record.alias("usage"))).drop("seconds")


@query("SELECT DISTINCT source_doc, base AS name FROM forms f WHERE base IS NOT NULL AND NOT EXISTS (SELECT 1 FROM reading r WHERE r.source_doc = f.source_doc AND r.word = f.base)")
def undefined_names(spark, d):
    """Base words of each handout that its reading list doesn't have."""
    forms, reading = table(spark, d, "forms"), table(spark, d, "reading")
    return summary.undefined(forms.select("source_doc", F.col("base").alias("name")), reading.select("source_doc", F.col("word").alias("name")), "source_doc", "name")


# ---- written and read back


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/folioforge-{name}-{uuid.uuid4().hex}"


@query("SELECT source_doc, source, lang, CAST(text_length AS VARCHAR) AS text_length FROM papers WHERE source_doc IS NOT NULL")
def csv_round_trip(spark, d):
    path = _folder(spark, "csv")
    sinks.write_csv(table(spark, d, "papers").where("source_doc is not null"), path, ["source_doc", "source", "lang", "text_length"])
    return files.read_csv(spark, path)


@query("SELECT seq, stage, item_id, model, prompt_tokens, cache_hit, completion_tokens, seconds FROM usage_ledger")
def jsonl_round_trip(spark, d):
    path = _folder(spark, "jsonl")
    sinks.write_jsonl(table(spark, d, "usage_ledger"), path)
    return files.read_ledger(spark, path).select("seq", "stage", "item_id", "model", "prompt_tokens", "cache_hit", "completion_tokens", "seconds")


@query("SELECT source_doc, CAST(i AS INT) AS body_index, p AS text FROM (SELECT source_doc, unnest([source_doc, source, kind]) AS p, unnest([0, 1, 2]) AS i FROM (SELECT source_doc, coalesce(source, '') AS source, coalesce(kind, '') AS kind FROM papers WHERE source_doc IS NOT NULL)) WHERE trim(p) <> ''")
def docx_round_trip(spark, d):
    """Each paper's name, source and kind as a Word file, read back."""
    papers = table(spark, d, "papers").where("source_doc is not null").select("source_doc", F.array("source_doc", F.coalesce("source", F.lit("")), F.coalesce("kind", F.lit(""))).alias("ps"))
    return files.read_docx(sinks.docx_files(papers, "source_doc", "ps").withColumnRenamed("name", "path")).select("source_doc", "body_index", "text")
