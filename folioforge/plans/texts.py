"""Queries of text functions, extraction and segmentation, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import reply, text
from folioforge.operators import extract, segment
from folioforge.plans.catalogue import query, table
from folioforge.rules import DEFAULT

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_strip = lambda c: f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


@query(r"SELECT doc_id, coalesce(len(regexp_extract_all(text, '[A-Za-z]+(?:[-''][A-Za-z]+)?')), 0) AS words FROM documents")
def wordish_count(spark, d):
    return table(spark, d, "documents").select("doc_id", text.wordish(F.col("text")).alias("words"))


@query(r"""SELECT doc_id, coalesce(len(regexp_extract_all(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '(?i)^\s*(Dear\b|To whom)|^\s*(Yours|Sincerely|Best wishes|Best regards|Regards|Faithfully)\b[,.\s]*$')), chr(10)), '[A-Za-z][A-Za-z''’-]*')), 0) AS words FROM documents""")
def essay_words(spark, d):
    return table(spark, d, "documents").select("doc_id", text.essay_words(F.col("text")).alias("words"))


@query("SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(text) / 2.6) AS INT)) END AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query(rf"""SELECT source_doc, coalesce(nullif(substring(regexp_replace(regexp_replace(regexp_replace(source_doc, '(.)\.[^.]*$', '\1'), '{WS}+', '_', 'g'), '[^0-9A-Za-z_\-\x{{4e00}}-\x{{9fff}}]+', '', 'g'), 1, 80), ''), 'doc') AS stem,
coalesce(nullif(regexp_replace(substring(regexp_replace(regexp_replace(source_doc, '{WS}+', '_', 'g'), '[^0-9A-Za-z_\-\x{{4e00}}-\x{{9fff}}]+', '', 'g'), 1, 12), '^_+|_+$', '', 'g'), ''), 'item') AS name FROM papers""")
def safe_names(spark, d):
    c = F.col("source_doc")
    return table(spark, d, "papers").select("source_doc", text.safe_stem(c).alias("stem"), text.safe_name(c, 12).alias("name"))


@query(r"""SELECT source_doc, regexp_replace(regexp_replace(regexp_replace(regexp_replace(source_doc, '(?i)\.(docx|pdf)$', ''), '答案|参考答案|详解|解析|评分标准|评分细则', '', 'g'), '[（）()【】\[\]{}_\-—–\s·、,，。.]+', '', 'g'), '(试题卷?|试卷|答案|参考答案|详解|解析|评分标准|评分细则|版)+$', '') AS title FROM papers""")
def title_key(spark, d):
    return table(spark, d, "papers").select("source_doc", text.title_key(F.col("source_doc"), DEFAULT.answer_words).alias("title"))


@query(rf"SELECT doc_id, CASE WHEN length({_strip('text')}) <= 200 THEN {_strip('text')} ELSE regexp_replace(substring({_strip('text')}, 1, 200), '{WS}+$', '') || chr(10) || '... [' || CAST(length({_strip('text')}) - 200 AS VARCHAR) || ' more]' END AS preview FROM documents")
def preview_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.preview(F.col("text"), 200).alias("preview"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '\*\*|`', '', 'g'), '(?m)^#{1,6}[ \t]+', '', 'g') AS text FROM documents")
def sanitized(spark, d):
    return table(spark, d, "documents").select("doc_id", text.sanitize(F.col("text")).alias("text"))


@query(rf"""SELECT source_doc, ord, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(text, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{WS}+|{WS}+$', '', 'g') AS text FROM blocks""")
def normalized_inline(spark, d):
    return table(spark, d, "blocks").select("source_doc", "ord", text.inline(F.col("text")).alias("text"))


@query("""SELECT section, display_section, items, least_chars, most_chars FROM (SELECT coalesce(s.section, 'unknown') AS section, count(*) AS items, min(length(text)) AS least_chars, max(length(text)) AS most_chars FROM items LEFT JOIN sections s ON lower(trim(items.section)) IN (s.section, lower(s.display_section)) GROUP BY 1) JOIN sections USING (section)""")
def section_alias(spark, d):
    items, sections = table(spark, d, "items"), table(spark, d, "sections")
    names = sections.select(F.explode(F.array_distinct(F.array("section", F.lower("display_section")))).alias("alias"), F.col("section").alias("known"))
    by = items.groupBy(F.lower(F.trim("section")).alias("alias")).agg(F.count(F.lit(1)).alias("n"), F.min(F.length("text")).alias("lo"), F.max(F.length("text")).alias("hi"))  # few rows meet the dimension
    named = by.join(F.broadcast(names), "alias", "left").groupBy(F.coalesce("known", F.lit("unknown")).alias("section"))
    return named.agg(F.sum("n").alias("items"), F.min("lo").alias("least_chars"), F.max("hi").alias("most_chars")).join(F.broadcast(sections), "section").select("section", "display_section", "items", "least_chars", "most_chars")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, i, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l)
SELECT doc_id, CAST(i AS INT) AS line, CAST(s AS INT) AS "start", CAST(s + length(line) AS INT) AS "end", """ + _strip("line") + """ AS stripped FROM o""")
def line_offsets(spark, d):
    return extract.lines(table(spark, d, "documents"), "doc_id", "text")


@query(r"""SELECT doc_id, list_filter(['short', 'replacement', 'control', 'latin', 'run'], lambda x: CASE x WHEN 'short' THEN short ELSE NOT short AND CASE x WHEN 'replacement' THEN rep >= 20 OR rep >= 0.002 * n WHEN 'control' THEN ctl >= 0.02 * n WHEN 'latin' THEN lat + cjk >= 100 AND lat < 0.1 * (lat + cjk) ELSE run >= 2000 END END) AS reasons FROM (
SELECT doc_id, length(t) AS n, length(""" + _strip("t") + r""") < 200 AS short, length(t) - length(replace(t, chr(65533), '')) AS rep, len(regexp_extract_all(t, '[\x00-\x08\x0b\x0c\x0e-\x1f]')) AS ctl, len(regexp_extract_all(t, '[A-Za-z]')) AS lat, len(regexp_extract_all(t, '[\x{4e00}-\x{9fff}]')) AS cjk, coalesce(list_max(list_transform(regexp_split_to_array(t, '""" + WS + r"""+'), lambda x: length(x))), 0) AS run FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""")
def precheck_reasons(spark, d):
    t = F.coalesce("text", F.lit(""))
    n, count = F.length(t), lambda p: F.regexp_count(t, F.lit(p))
    short = F.length(text.strip(t)) < 200
    rep, ctl, lat, cjk = count("�"), count(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), count("[A-Za-z]"), count("[一-鿿]")
    run = F.coalesce(F.array_max(F.transform(F.split(t, text.WS + "+"), F.length)), F.lit(0))
    when = lambda c, name: F.when(~short & c, name)
    reasons = F.array_compact(F.array(F.when(short, "short"), when((rep >= 20) | (rep >= 0.002 * n), "replacement"), when(ctl >= 0.02 * n, "control"), when((lat + cjk >= 100) & (lat < 0.1 * (lat + cjk)), "latin"), when(run >= 2000, "run")))
    return table(spark, d, "documents").select("doc_id", reasons.alias("reasons"))


@query("SELECT doc_id, 'Kind: ' || coalesce(doc_kind, '') || chr(10) || 'Source: ' || coalesce(source, '') || chr(10) || coalesce(text, '') AS prompt FROM documents")
def prompt_render(spark, d):
    return table(spark, d, "documents").select("doc_id", text.filled("Kind: {{KIND}}\nSource: {{SOURCE}}\n{{TEXT}}", KIND=F.col("doc_kind"), SOURCE=F.col("source"), TEXT=F.col("text")).alias("prompt"))


_tokens = ", ".join(f"'{t}'" for t in DEFAULT.leak_tokens + DEFAULT.layout_tokens + DEFAULT.essay_tokens)


@query(f"SELECT DISTINCT item_id, list_filter([{_tokens}], lambda t: contains(coalesce(text, ''), t)) AS tokens FROM items")
def token_leaks(spark, d):
    found = text.contained(F.coalesce("text", F.lit("")), DEFAULT.leak_tokens + DEFAULT.layout_tokens + DEFAULT.essay_tokens)
    return table(spark, d, "items").select("item_id", found.alias("tokens")).distinct()


# ---- answers: text is made from numbers, parsed by the operator, and the twin takes the expected rows from the numbers

_LETTERS = "substring('ABCDEFGABCDEFG', CAST(1 + o_custkey % 7 AS INT), CAST(2 + o_orderkey % 4 AS INT))"


def _keyed(spark, d):
    o = table(spark, d, "orders")
    letters = F.expr(_LETTERS)
    sep = F.element_at(F.array(F.lit("-"), F.lit("—"), F.lit("~"), F.lit("--")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    first = (21 + F.col("o_orderkey") % 5).cast("int")
    line = F.concat(first.cast("string"), sep, (first + F.length(letters) - 1).cast("string"), F.lit(". "), letters)
    return o.select("o_orderkey", F.concat(F.lit("Key\n"), line, F.lit("\n71. C 答案\n")).alias("text"))


@query(f"""SELECT o_orderkey, CAST(21 + o_orderkey % 5 + i AS INT) AS number, substring({_LETTERS}, CAST(i + 1 AS INT), 1) AS answer FROM orders, range(6) t(i) WHERE i < 2 + o_orderkey % 4
UNION ALL SELECT o_orderkey, 71, 'C' FROM orders""")
def answer_ranges(spark, d):
    return extract.answer_letters(_keyed(spark, d), "o_orderkey", "text")


@query("""SELECT p_partkey, CAST(56 + i AS INT) AS number, CASE WHEN i < 2 THEN string_split(p_name, ' ')[CAST(i + 1 AS INT)] ELSE lower(p_type) END AS answer FROM part, range(3) t(i)""")
def grammar_words(spark, d):
    words = F.split("p_name", " ")
    glued = F.concat(F.lit("56. "), words[0], F.lit("57. "), words[1], F.lit(" 58."), F.lower("p_type"))
    return extract.answer_words(table(spark, d, "part").select("p_partkey", glued.alias("text")), "p_partkey", "text")


@query(r"""WITH m AS (SELECT doc_id, unnest(list_zip(regexp_extract_all(text, p, 1), regexp_extract_all(text, p, 2), regexp_extract_all(text, p, 3))) AS m, generate_subscripts(regexp_extract_all(text, p, 1), 1) AS pos
FROM documents, (SELECT '(?m)^[\s]*(\d{1,2})\s*[-—~－–]+\s*(\d{1,2})\s*[.．、:：]?\s*([A-G]{2,})(?:$|[^0-9A-Za-z_\x{4e00}-\x{9fff}])' AS p))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS run, CAST(m[1] AS INT) AS "first", CAST(m[2] AS INT) AS "last", m[3] AS letters FROM m WHERE CAST(m[2] AS INT) > CAST(m[1] AS INT) AND length(m[3]) = CAST(m[2] AS INT) - CAST(m[1] AS INT) + 1""")
def answer_runs(spark, d):
    return extract.answer_runs(table(spark, d, "documents"), "doc_id", "text")


_ranges = ", ".join(f"('{s}', {a}, {b})" for s, (a, b) in DEFAULT.ranges.items() if s.startswith("reading"))


@query(rf"""SELECT DISTINCT item_id, CAST(n AS INT) AS number FROM (SELECT item_id, text, unnest(range(a, b + 1)) AS n FROM items JOIN (VALUES {_ranges}) r(section, a, b) USING (section))
WHERE NOT coalesce(regexp_matches(text, '(?m)^[ \t　]*' || n || '[.．、]'), false)""")
def missing_numbers(spark, d):
    return extract.missing_stems(table(spark, d, "items")).distinct()


@query(r"""WITH r AS (SELECT block_id, unnest(regexp_extract_all(text, '(?is)<tr[^>]*>(.*?)</tr>', 1)) AS r, generate_subscripts(regexp_extract_all(text, '(?is)<tr[^>]*>(.*?)</tr>', 1), 1) - 1 AS i FROM (SELECT DISTINCT * FROM ocr_blocks) WHERE contains(text, '<t')),
c AS (SELECT block_id, i, unnest(regexp_extract_all(r, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1)) AS c, generate_subscripts(regexp_extract_all(r, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1), 1) - 1 AS j FROM r)
SELECT block_id, CAST(i AS INT) AS "row", CAST(j AS INT) AS col, trim(regexp_replace(c, '<[^>]*>', '', 'g')) AS cell FROM c""")
def html_table_cells(spark, d):
    return extract.table_cells(table(spark, d, "ocr_blocks").where(F.contains("text", F.lit("<t"))).distinct(), "block_id", "text")


_MARKERS = [("参考答案", 0.0), ("【答案】", 0.0), ("Paragraph 2", 0.35), ("Key words", 0.4)]
_sql_at = ", ".join(f"CASE WHEN strpos(substring(text, CAST(floor(length(text) * {s}) AS INT) + 1), '{m}') > 0 THEN strpos(substring(text, CAST(floor(length(text) * {s}) AS INT) + 1), '{m}') + CAST(floor(length(text) * {s}) AS INT) - 1 END" for m, s in _MARKERS)


@query(f"SELECT doc_id, CAST(least({_sql_at}) AS INT) AS boundary FROM documents")
def earliest_boundary(spark, d):
    return table(spark, d, "documents").select("doc_id", segment.earliest(F.col("text"), _MARKERS).alias("boundary"))


@query(f"SELECT doc_id, CASE WHEN b IS NULL THEN text ELSE substring(text, 1, b) END AS body, CASE WHEN b IS NULL THEN '' ELSE substring(text, b + 1, 8000) END AS tail FROM (SELECT doc_id, text, CAST(least({_sql_at}) AS INT) AS b FROM documents)")
def tail_split(spark, d):
    docs = table(spark, d, "documents").withColumn("at", segment.earliest(F.col("text"), _MARKERS))
    return docs.select("doc_id", segment.tail_split(F.col("text"), F.col("at"), 8000).alias("s")).select("doc_id", "s.*")


_HEAD = r"^\d{2}\s*[.．]"


@query(rf"""WITH b AS (SELECT DISTINCT * FROM blocks), s AS (SELECT source_doc, char_start, text FROM b WHERE regexp_matches(text, '{_HEAD}')), e AS (SELECT source_doc, max(char_start + length(text)) AS text_end FROM b GROUP BY 1)
SELECT source_doc, char_start, substring(text, 1, 2) AS number, coalesce(lead(char_start) OVER (PARTITION BY source_doc ORDER BY char_start), text_end) AS slice_end FROM s JOIN e USING (source_doc)""")
def segment_slices(spark, d):
    b = table(spark, d, "blocks").distinct()
    ends = b.groupBy("source_doc").agg(F.max(F.col("char_start") + F.length("text")).alias("text_end"))
    starts = b.where(F.rlike("text", F.lit(_HEAD))).join(ends, "source_doc")
    return segment.slices(starts, "source_doc", "char_start", "text_end").select("source_doc", "char_start", F.substring("text", 1, 2).alias("number"), "slice_end")


_OWN, _RESET = r"^\s*(\d{2})\s*[.．]", r"^\s*(第[一二三四]|[A-D]\s*[.．])"


@query(rf"""WITH b AS (SELECT DISTINCT * FROM blocks), m AS (SELECT source_doc, ord, coalesce(TRY_CAST(nullif(regexp_extract(text, '{_OWN}', 1), '') AS INT), CASE WHEN coalesce(regexp_matches(text, '{_RESET}') OR NOT regexp_matches(text, '[\x{{4e00}}-\x{{9fff}}]'), true) THEN -1 END) AS mark FROM b)
SELECT source_doc, ord, nullif(last_value(mark IGNORE NULLS) OVER (PARTITION BY source_doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS owner FROM m""")
def owner_scan(spark, d):
    b = table(spark, d, "blocks").distinct()
    return segment.owners(b, "source_doc", "ord", "text", _OWN, _RESET).select("source_doc", "ord", "owner")


@query(rf"""WITH b AS (SELECT DISTINCT * FROM blocks), m AS (SELECT source_doc, ord, body_index, coalesce(TRY_CAST(nullif(regexp_extract(text, '{_OWN}', 1), '') AS INT), CASE WHEN coalesce(regexp_matches(text, '{_RESET}') OR NOT regexp_matches(text, '[\x{{4e00}}-\x{{9fff}}]'), true) THEN -1 END) AS mark FROM b),
o AS (SELECT source_doc, body_index, nullif(last_value(mark IGNORE NULLS) OVER (PARTITION BY source_doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS owner FROM m),
s AS (SELECT source_doc, owner, min(body_index) AS low, max(body_index) + 1 AS high FROM o WHERE owner IS NOT NULL GROUP BY 1, 2)
SELECT s.source_doc, s.owner, CASE WHEN NOT v THEN s.low END AS low, CASE WHEN NOT v THEN s.high END AS high FROM (SELECT s.*, EXISTS (SELECT 1 FROM s x WHERE x.source_doc = s.source_doc AND x.owner <> s.owner AND x.low < s.high AND x.high > s.low) AS v FROM s) s""")
def owned_spans(spark, d):
    b = table(spark, d, "blocks").distinct()
    return segment.owned_spans(segment.owners(b, "source_doc", "ord", "text", _OWN, _RESET), "source_doc", "body_index")


@query("SELECT l_orderkey, l_linenumber, CAST(floor((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) / 5) AS INT) AS chunk FROM lineitem")
def chunk_five(spark, d):
    return segment.groups_of(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", 5)


def _packed_sql(most: int) -> str:
    return f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, line, length(line) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM (SELECT doc_id, k, {_strip("line")} AS line FROM l) WHERE line <> ''),
g AS (SELECT doc_id, r, line, n + 1 AS used, 0 AS chunk FROM t WHERE r = 1 UNION ALL
SELECT t.doc_id, t.r, t.line, CASE WHEN g.used + t.n > {most} THEN t.n + 1 ELSE g.used + t.n + 1 END, CASE WHEN g.used + t.n > {most} THEN g.chunk + 1 ELSE g.chunk END FROM g JOIN t ON t.doc_id = g.doc_id AND t.r = g.r + 1),
packed AS (SELECT doc_id, CAST(chunk AS INT) AS chunk, string_agg(line, chr(10) ORDER BY r) AS body FROM g GROUP BY 1, 2)"""


@query(_packed_sql(900) + " SELECT * FROM packed")
def pack_by_size(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(segment.packed(F.col("text"), 900)).alias("chunk", "body"))


@query(None)
def canonical_order(spark, d):
    items = table(spark, d, "items").select("source_doc", "item_id", "section").distinct()
    at = items.withColumn("pos", F.pmod(F.xxhash64("item_id"), F.lit(1 << 40)))
    return segment.in_order(at, "source_doc", "pos", "section")


@query("""WITH RECURSIVE t AS (SELECT item_id, seq, coalesce(prompt_tokens, 0) AS n, row_number() OVER (PARTITION BY item_id ORDER BY seq) AS r FROM usage_ledger WHERE item_id IS NOT NULL),
g AS (SELECT item_id, seq, r, n AS running, 0 AS conversation FROM t WHERE r = 1 UNION ALL
SELECT t.item_id, t.seq, t.r, CASE WHEN g.running > 0 AND g.running + t.n > 20000 THEN t.n ELSE g.running + t.n END, CASE WHEN g.running > 0 AND g.running + t.n > 20000 THEN g.conversation + 1 ELSE g.conversation END FROM g JOIN t ON t.item_id = g.item_id AND t.r = g.r + 1)
SELECT item_id, seq, CAST(running AS BIGINT) AS running, CAST(conversation AS INT) AS conversation FROM g""")
def conversation_restart(spark, d):
    turns = table(spark, d, "usage_ledger").where("item_id is not null").select("item_id", "seq", "prompt_tokens")
    return segment.restarts(turns, "item_id", "seq", "prompt_tokens", 20000).select("item_id", "seq", "running", "conversation")


# ---- replies


@query(r"SELECT entry_id, CASE WHEN json_valid(payload) THEN 'whole' ELSE 'raw' END AS how, false AS truncated FROM raw_entries")
def reply_parse(spark, d):
    return table(spark, d, "raw_entries").select("entry_id", reply.parsed_reply("payload").alias("p")).select("entry_id", "p.how", "p.truncated")


@query("SELECT entry_id, 'salvaged' AS how, true AS truncated, CASE WHEN entry_id % length(payload) = 0 THEN 2 ELSE 1 END AS objects FROM raw_entries WHERE json_valid(payload) AND starts_with(payload, '{')")
def json_salvage(spark, d):
    """Two objects in an array, the text cut within the second one."""
    r = table(spark, d, "raw_entries").where(F.startswith("payload", F.lit("{")))
    whole = F.concat(F.lit('{"segments":['), F.col("payload"), F.lit(","), F.col("payload"), F.lit("]}"))
    cut = F.substring(whole, F.lit(1), (F.length(whole) - 2 - F.col("entry_id") % F.length("payload")).cast("int"))
    return r.select("entry_id", reply.parsed_reply(cut).alias("p")).select("entry_id", "p.how", "p.truncated", F.json_array_length(F.get_json_object("p.json", "$.segments")).alias("objects"))


@query("SELECT seq, coalesce(prompt_tokens, 0) AS prompt, coalesce(cache_hit, 0) AS hit, greatest(coalesce(prompt_tokens, 0) - coalesce(cache_hit, 0), 0) AS miss, coalesce(completion_tokens, 0) AS output, coalesce(reasoning_tokens, 0) AS reasoning FROM usage_ledger")
def usage_dialects(spark, d):
    u = table(spark, d, "usage_ledger")
    prompt, hit, out, why = (F.coalesce(c, F.lit(0)) for c in ("prompt_tokens", "cache_hit", "completion_tokens", "reasoning_tokens"))
    why = F.struct(why.alias("reasoning_tokens"))
    one = F.to_json(F.struct(prompt.alias("prompt_tokens"), hit.alias("prompt_cache_hit_tokens"), out.alias("completion_tokens"), why.alias("completion_tokens_details")))
    two = F.to_json(F.struct(prompt.alias("prompt_tokens"), F.struct(hit.alias("cached_tokens")).alias("prompt_tokens_details"), out.alias("completion_tokens"), why.alias("completion_tokens_details")))
    three = F.to_json(F.struct(F.greatest(prompt - hit, F.lit(0)).alias("input_tokens"), hit.alias("cache_read_input_tokens"), out.alias("output_tokens"), why.alias("completion_tokens_details")))
    three = F.when(hit <= prompt, three).otherwise(one)
    said = F.when(F.col("seq") % 3 == 0, one).when(F.col("seq") % 3 == 1, two).otherwise(three)
    return u.select("seq", reply.usage_record(said).alias("u")).select("seq", "u.*")


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 200 > 100 AND o_orderkey % 200 < 150 THEN o_orderkey % 200 END AS INT) AS start_block FROM orders""")
def start_block(spark, d):
    n = (F.col("o_orderkey") % 200).cast("string")
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('{"start_block": '), n, F.lit("}"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('```json\n{"start_block": '), n, F.lit("}\n```"))).otherwise(n)
    return table(spark, d, "orders").select("o_orderkey", reply.start_index(said, F.lit(100), F.lit(150)).alias("start_block"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN least(l_quantity * 4, 90.0) ELSE least(power(2.0, l_linenumber - 1), 60.0) END AS delay,
CAST(CASE WHEN l_suppkey % 2 = 0 THEN least(l_partkey * 3, 64000, 8192) ELSE least(l_partkey, 8192) END AS BIGINT) AS cap, greatest(CAST(floor(l_partkey * 100 * 0.4) AS INT) - 8192, 8000) AS budget FROM lineitem""")
def caps_budgets(spark, d):
    li = table(spark, d, "lineitem")
    after = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") * 4)
    return li.select(
        "l_orderkey", "l_linenumber", reply.retry_delay(F.col("l_linenumber"), after).alias("delay"), reply.output_cap(F.col("l_partkey"), F.col("l_suppkey") % 2 == 0, F.lit(8192)).cast("long").alias("cap"),
        reply.conversation_budget(F.col("l_partkey") * 100, F.lit(8192), F.lit(0.4)).alias("budget"),
    )
