"""Queries of joins, set operations and aggregations, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions.text import number_or_zero
from folioforge.operators import relate, summary
from folioforge.operators.scan import running_sum
from folioforge.plans.catalogue import query, table
from folioforge.rules import DEFAULT
from folioforge.sources.model import Client, answered


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END, v) AS c_acctbal, c_custkey % 3 = 0 AND v IS NOT NULL AS filled FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def fill_missing_left(spark, d):
    left = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).alias("c_acctbal"))
    cached = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return relate.fill_missing(left, cached, "c_custkey", "c_acctbal")


@query("SELECT item_id, source_doc FROM items WHERE source_doc IS NULL OR source_doc NOT IN (SELECT source_doc FROM papers)")
def stale_anti(spark, d):
    return relate.missing(table(spark, d, "items"), table(spark, d, "papers"), "source_doc").select("item_id", "source_doc")


@query("SELECT source_doc, lang FROM papers WHERE source_doc IN (SELECT source_doc FROM items)")
def semi_distinct(spark, d):
    return relate.present(table(spark, d, "papers"), table(spark, d, "items"), "source_doc").select("source_doc", "lang")


@query("SELECT o_custkey, o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_custkey % 5 = 0 UNION ALL SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey % 5 <> 0")
def replace_groups(spark, d):
    old = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return relate.replace_groups(old, old.where("o_custkey % 5 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2), "o_custkey")


@query("SELECT o_orderkey, o_totalprice AS v FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey, -o_totalprice FROM orders WHERE o_orderkey % 4 <> 0")
def resume_union(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    return relate.resume(orders, orders.where("o_orderkey % 4 = 0"), "o_orderkey", lambda todo: todo.select("o_orderkey", (-F.col("v")).alias("v")))


@query("""WITH b AS (SELECT DISTINCT source_doc, body_index, char_start, coalesce(char_end, char_start + length(text)) AS e FROM blocks), s AS (SELECT source_doc, answer_start AS low, first_answer_pos + 400 AS high FROM papers WHERE answer_start IS NOT NULL AND first_answer_pos IS NOT NULL)
SELECT s.source_doc, low, high, CAST(coalesce(min(body_index), 0) AS INT) AS first, CAST(coalesce(max(body_index) + 1, 0) AS INT) AS last FROM s LEFT JOIN b ON b.source_doc = s.source_doc AND char_start < high AND e > low AND e > char_start GROUP BY 1, 2, 3""")
def interval_blocks(spark, d):
    b = table(spark, d, "blocks").select("source_doc", "body_index", "char_start", F.coalesce("char_end", F.col("char_start") + F.length("text")).alias("e")).distinct()
    s = table(spark, d, "papers").where("answer_start is not null and first_answer_pos is not null").select("source_doc", F.col("answer_start").alias("low"), (F.col("first_answer_pos") + 400).alias("high"))
    return relate.overlapping(b, s, "source_doc", "body_index", "char_start", "e", "low", "high")


@query("""SELECT e.event_id, max(v) AS value FROM (SELECT e.event_id, m.t, arg_max(m.value, m.value) AS v, row_number() OVER (PARTITION BY e.event_id ORDER BY m.t DESC NULLS LAST) AS r FROM (SELECT * FROM events WHERE event_type <> 'purchase') e LEFT JOIN (SELECT user_id, ts AS t, value FROM events WHERE event_type = 'purchase') m ON m.user_id = e.user_id AND m.t <= e.ts GROUP BY e.event_id, m.t) e WHERE r = 1 GROUP BY 1""")
def asof_mark(spark, d):
    e = table(spark, d, "events")
    return relate.as_of(e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts", "value"), "user_id", "ts", "value").select("event_id", "value")


@query(None)
def greedy_pairs(spark, d):
    """Papers and answer documents of one source, year apart, matched one to one by the similarity of their titles."""
    from folioforge.functions.text import title_key

    p = table(spark, d, "papers").select("source", "source_doc", "kind", title_key(F.col("source_doc"), DEFAULT.answer_words).alias("t"))
    left, right = p.where("kind = 'paper'"), p.where("kind = 'answers'")
    pairs = left.alias("l").join(right.alias("r"), F.expr("l.source = r.source")).select(F.col("l.source_doc").alias("paper"), F.col("r.source_doc").alias("answers"), F.round(relate.similar("l.t", "r.t"), 9).alias("score"))
    return relate.one_to_one(pairs, "paper", "answers", "score")


@query("""WITH b AS (SELECT DISTINCT source_doc, ord, trim(text) AS line FROM blocks WHERE text IS NOT NULL), g AS (SELECT source_doc, source_doc || '#' || CAST(ord // 12 AS VARCHAR) AS part, line FROM b WHERE length(line) >= 8),
k AS (SELECT DISTINCT source_doc, line FROM b WHERE ord % 12 < 3 + (ord // 12) % 7), h AS (SELECT part, count(*) AS n_lines, count(k.line) AS hits FROM g LEFT JOIN k USING (source_doc, line) GROUP BY 1)
SELECT part, n_lines, hits FROM h WHERE hits >= greatest(2, n_lines * 0.5)""")
def line_match(spark, d):
    """Parts of papers, twelve lines each, of which half stand among the paper's lines that were kept: the first three to nine of each part."""
    b = table(spark, d, "blocks").where("text is not null").select("source_doc", "ord", F.trim("text").alias("line")).distinct()
    lines = b.select("source_doc", F.concat("source_doc", F.lit("#"), F.floor(F.col("ord") / 12).cast("string")).alias("part"), "line")
    kept = b.where(F.col("ord") % 12 < 3 + F.floor(F.col("ord") / 12) % 7).select("source_doc", "line")
    return relate.matched_lines(lines, kept, "source_doc", "part", "line")


@query("""SELECT source_doc, CASE WHEN first_answer_pos <= greatest(400, text_length * 0.15) AND coalesce(question_segments, 0) <= 3 THEN 'answers' WHEN question_segments > 0 THEN CASE WHEN answer_start IS NOT NULL OR first_answer_pos IS NOT NULL THEN 'both' ELSE 'paper' END
WHEN regexp_matches(source_doc, '答案|参考答案|详解|解析|评分标准|评分细则') OR answer_start <= greatest(200, text_length * 0.1) THEN 'answers' ELSE 'unknown' END AS kind FROM papers""")
def doc_kind(spark, d):
    """What a document is, by where its answers begin and whether it has questions."""
    p = table(spark, d, "papers")
    n = F.coalesce("question_segments", F.lit(0))
    top = F.col("first_answer_pos") <= F.greatest(F.lit(400.0), F.col("text_length") * 0.15)
    named = F.rlike("source_doc", F.lit(DEFAULT.answer_words)) | (F.col("answer_start") <= F.greatest(F.lit(200.0), F.col("text_length") * 0.1))
    has = F.col("answer_start").isNotNull() | F.col("first_answer_pos").isNotNull()
    kind = F.when(top & (n <= 3), "answers").when(n > 0, F.when(has, "both").otherwise("paper")).when(named, "answers").otherwise("unknown")
    return p.select("source_doc", kind.alias("kind"))


@query("SELECT item_id, coalesce(TRY_CAST(wordish_count AS DOUBLE), 0) AS words FROM (SELECT DISTINCT item_id, wordish_count FROM items) WHERE coalesce(wordish_count, 0) < 100")
def low_counts(spark, d):
    items = table(spark, d, "items").select("item_id", "wordish_count").distinct()
    return items.select("item_id", number_or_zero(F.col("wordish_count")).alias("words")).where("words < 100")


@query("SELECT source_doc, section FROM (SELECT source_doc, s AS section FROM papers, (VALUES " + ", ".join(f"('{s}')" for s in DEFAULT.order) + ") v(s)) EXCEPT SELECT source_doc, section FROM items")
def missing_sections(spark, d):
    """Sections that a paper should have and hasn't: a set difference."""
    wanted = table(spark, d, "papers").select("source_doc", F.explode(F.array(*(F.lit(s) for s in DEFAULT.order))).alias("section"))
    return wanted.subtract(table(spark, d, "items").select("source_doc", "section"))


@query("SELECT source_doc, char_start, section FROM (SELECT source_doc, char_start, section, row_number() OVER (PARTITION BY source_doc, char_start ORDER BY rank DESC, section DESC) AS r FROM (SELECT source_doc, char_start, 'heading' AS section, 0 AS rank FROM blocks WHERE label IN ('doc_title', 'title', 'paragraph_title') UNION ALL SELECT source_doc, char_start, 'stem', 1 FROM blocks WHERE regexp_matches(text, '^\\d{2}[.]'))) WHERE r = 1")
def starts_union(spark, d):
    """Starts found two ways, one for each place; those of the second way win."""
    b = table(spark, d, "blocks")
    one = b.where(F.col("label").isin("doc_title", "title", "paragraph_title")).select("source_doc", "char_start", F.lit("heading").alias("section"), F.lit(0).alias("rank"))
    two = b.where(F.rlike("text", F.lit(r"^\d{2}[.]"))).select("source_doc", "char_start", F.lit("stem").alias("section"), F.lit(1).alias("rank"))
    return one.unionByName(two).groupBy("source_doc", "char_start").agg(F.max_by("section", F.struct("rank", "section")).alias("section"))


_USE = "count(*) AS calls, sum(coalesce(cache_hit, 0)) AS cached, sum(coalesce(cache_miss, greatest(coalesce(prompt_tokens, 0) - coalesce(cache_hit, 0), 0))) AS fresh, sum(coalesce(completion_tokens, 0)) AS output, round(sum(coalesce(seconds, 0)), 3) AS seconds"


@query(f"SELECT stage, model, {_USE} FROM usage_ledger GROUP BY ALL")
def usage_by_stage_model(spark, d):
    return summary.usage_by(table(spark, d, "usage_ledger"), "stage", "model").withColumn("seconds", F.round("seconds", 3))


@query(f"SELECT stage, {_USE} FROM (SELECT DISTINCT * EXCLUDE (seq) FROM usage_ledger) GROUP BY ALL")
def usage_written_once(spark, d):
    return summary.usage_by(summary.written_once(table(spark, d, "usage_ledger")), "stage").withColumn("seconds", F.round("seconds", 3))


@query("SELECT count(*) AS calls, sum(prompt_tokens) AS prompt, sum(cache_hit) AS cached, round(sum(cache_hit) / sum(prompt_tokens), 9) AS rate FROM usage_ledger")
def usage_hit_rate(spark, d):
    return summary.hit_rate(table(spark, d, "usage_ledger")).withColumn("rate", F.round("rate", 9))


@query("SELECT item_id, calls, tokens FROM (SELECT item_id, count(*) AS calls, sum(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)) AS tokens FROM usage_ledger GROUP BY 1)")
def usage_by_item(spark, d):
    u = table(spark, d, "usage_ledger")
    return u.groupBy("item_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).alias("tokens"))


@query("SELECT stage, model, effort, thinking, count(*) AS n, round(median(seconds), 9) AS median FROM (SELECT *, row_number() OVER (PARTITION BY stage, model, effort, thinking ORDER BY seq DESC) AS r FROM usage_ledger WHERE seconds > 0) WHERE r <= 20 GROUP BY ALL")
def median_last20(spark, d):
    return summary.median_of_last(table(spark, d, "usage_ledger"), ["stage", "model", "effort", "thinking"], "seq", "seconds").withColumn("median", F.round("median", 9))


@query("WITH m AS (SELECT stage, median(seconds) AS m FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY seq DESC) AS r FROM usage_ledger WHERE seconds > 0) WHERE r <= 20 GROUP BY 1) SELECT stage, round(coalesce(m, prior) * n, 6) AS seconds FROM (VALUES ('segment', 0.4, 10), ('score', 2.3, 50), ('review', 4.0, 5), ('explain', 9.5, 18), ('vocab', 6.0, 18), ('other', 1.0, 3)) p(stage, prior, n) LEFT JOIN m USING (stage)")
def prior_fallback(spark, d):
    """Expected seconds of work units: the median of a stage's last calls, or a prior where it has none."""
    m = summary.median_of_last(table(spark, d, "usage_ledger"), ["stage"], "seq", "seconds")
    p = spark.createDataFrame([("segment", 0.4, 10), ("score", 2.3, 50), ("review", 4.0, 5), ("explain", 9.5, 18), ("vocab", 6.0, 18), ("other", 1.0, 3)], "stage string, prior double, units int")
    return p.join(m, "stage", "left").select("stage", F.round(F.coalesce("median", "prior") * F.col("units"), 6).alias("seconds"))


_KEY = "lower(regexp_replace({0}, '^[\\s\\x{{a0}}\\x{{3000}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}]+|[\\s\\x{{a0}}\\x{{3000}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}]+$', '', 'g'))"


@query(f"SELECT entry_id, word, pos, meaning FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY.format('word')} ORDER BY entry_id) AS r FROM reading WHERE {_KEY.format('word')} <> '') WHERE r = 1")
def dedupe_first_word(spark, d):
    return summary.first_of(table(spark, d, "reading").select("entry_id", "word", "pos", "meaning"), ["word"], "entry_id")


@query(f"SELECT entry_id, base, derived, note FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY.format('base')}, {_KEY.format('derived')} ORDER BY entry_id) AS r FROM forms WHERE {_KEY.format('base')} <> '' AND {_KEY.format('derived')} <> '') WHERE r = 1")
def dedupe_pairs(spark, d):
    return summary.first_of(table(spark, d, "forms").select("entry_id", "base", "derived", "note"), ["base", "derived"], "entry_id")


_bare = lambda c: _KEY.format(c)[6:-1]  # noqa: E731  the strip without lower()


@query(rf"""WITH b AS (SELECT entry_id AS o, {_bare("word")} AS word, lower({_bare("word")}) AS key, coalesce(pos, '') AS pos, coalesce(meaning, '') AS meaning FROM reading WHERE {_bare("word")} <> ''),
w AS (SELECT key, arg_min(word, o) AS word, count(*) AS n FROM b GROUP BY 1),
t AS (SELECT key, tag, min((o, i)) AS spot FROM (SELECT key, o, i, {_bare("raw")} AS tag FROM (SELECT key, o, unnest(regexp_split_to_array(pos, '[/、]|\s*&\s*')) AS raw, generate_subscripts(regexp_split_to_array(pos, '[/、]|\s*&\s*'), 1) AS i FROM b)) WHERE tag <> '' GROUP BY 1, 2),
k AS (SELECT key, string_agg(tag, '/' ORDER BY spot) FILTER (WHERE NOT EXISTS (SELECT 1 FROM t x WHERE x.key = t.key AND x.tag <> t.tag AND (starts_with(x.tag, t.tag) OR ends_with(x.tag, t.tag)))) AS kept, string_agg(tag, '/' ORDER BY spot) AS all_tags FROM t GROUP BY 1),
s AS (SELECT key, o, i, {_bare("raw")} AS sense FROM (SELECT key, o, unnest(regexp_extract_all(meaning, '(?:[（(][^）)]*[）)]?|[^；;，,、（(])+')) AS raw, generate_subscripts(regexp_extract_all(meaning, '(?:[（(][^）)]*[）)]?|[^；;，,、（(])+'), 1) AS i FROM b)),
m AS (SELECT key, lower(regexp_replace(regexp_replace(sense, '[（(][^）)]*[）)]', '', 'g'), '[\s\x0b.,，、；;：:\-—“”"'']', '', 'g')) AS sk, o, i, sense FROM s WHERE sense <> ''),
f AS (SELECT key, sk, min((o, i)) AS spot, arg_max(sense, (length(sense), -o, -i)) AS sense FROM m GROUP BY 1, 2),
g AS (SELECT key, string_agg(sense, '；' ORDER BY spot) AS meaning FROM f GROUP BY 1)
SELECT key, word, coalesce(kept, all_tags, '') AS pos, coalesce(meaning, '') AS meaning, n FROM w LEFT JOIN k USING (key) LEFT JOIN g USING (key)""")
def merge_entries(spark, d):
    return summary.merged_entries(table(spark, d, "reading"), "word", "pos", "meaning", "entry_id")


@query("""SELECT c_custkey, p AS pos FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'n./v.' WHEN 1 THEN 'n. phr.' WHEN 2 THEN 'v./adj.' ELSE 'n./adj.' END AS p FROM customer)""")
def merge_tags(spark, d):
    from folioforge.functions.text import merged_pos

    tags = {0: ["n.", "v./n."], 1: ["n. phr.", "n.", "phr."], 2: ["v.", "adj. & v."], 3: ["n.", "adj."]}
    c = F.when(F.lit(False), F.array(F.lit("")))
    for k, v in tags.items():
        c = c.when(F.col("c_custkey") % 4 == k, F.array(*map(F.lit, v)))
    return table(spark, d, "customer").select("c_custkey", merged_pos(c).alias("pos"))


@query("SELECT p_partkey, [split_part(p_name, ' ', 1) || '（a，b；c）', split_part(p_name, ' ', 2), lower(p_type)] AS senses FROM part")
def sense_split(spark, d):
    from folioforge.functions.text import senses

    p = table(spark, d, "part")
    words = F.split("p_name", " ")
    return p.select("p_partkey", senses(F.concat(words[0], F.lit("（a，b；c）；"), words[1], F.lit("、 "), F.lower("p_type"), F.lit("，"))).alias("senses"))


_in = ", ".join(f"'{s}'" for s in DEFAULT.order)
_leak = " OR ".join(f"contains(coalesce(text, ''), '{t}')" for t in DEFAULT.leak_tokens)
GRADED = f"""g AS (SELECT source_doc, sum(n) AS n, list_sort(coalesce(list(section) FILTER (WHERE section IN ({_in})), [])) AS have, count(*) FILTER (WHERE section IN ({_in}) AND n > 1) AS duplicates, sum(issues) AS issues
FROM (SELECT source_doc, section, count(*) AS n, count(*) FILTER (WHERE length(coalesce(text, '')) < 100 OR length(coalesce(text, '')) > 12000 OR {_leak}) AS issues FROM items WHERE source_doc IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
graded AS (SELECT source_doc, CAST(n AS BIGINT) AS n, array_to_string(list_filter([{_in}], lambda s: NOT list_contains(have, s)), ',') AS missing, duplicates, CAST(issues AS BIGINT) AS issues,
CASE WHEN len(have) = 0 OR len(list_filter([{_in}], lambda s: NOT list_contains(have, s) AND s <> 'gap_filling')) >= 3 THEN 'FAIL' WHEN len(list_filter([{_in}], lambda s: NOT list_contains(have, s) AND s <> 'gap_filling')) > 0 OR n < 8 OR n > 12 OR duplicates > 0 OR issues > 0 THEN 'WARN' ELSE 'PASS' END AS grade FROM g)"""


@query(f"WITH {GRADED} SELECT * FROM graded")
def grade_documents(spark, d):
    return summary.graded(table(spark, d, "items"))


@query(f"WITH {GRADED} SELECT grade, count(*) AS papers, round(count(*) / (SELECT count(*) FROM graded), 6) AS share FROM graded GROUP BY 1")
def quality_histogram(spark, d):
    g = summary.graded(table(spark, d, "items")).groupBy("grade").agg(F.count(F.lit(1)).alias("papers"))
    return g.join(F.broadcast(g.agg(F.sum("papers").alias("total"))), how="cross").select("grade", "papers", F.round(F.col("papers") / F.col("total"), 6).alias("share"))


@query("SELECT section, display_section, count(DISTINCT source_doc) AS papers, round(count(DISTINCT source_doc) / (SELECT count(*) FROM papers), 6) AS share FROM sections LEFT JOIN (SELECT section, source_doc FROM items SEMI JOIN papers USING (source_doc)) USING (section) GROUP BY 1, 2")
def section_coverage(spark, d):
    papers = table(spark, d, "papers")
    n = papers.agg(F.count(F.lit(1)).alias("total"))
    by = table(spark, d, "items").join(papers.select("source_doc"), "source_doc", "left_semi").groupBy("section").agg(F.countDistinct("source_doc").alias("papers"))
    joined = F.broadcast(table(spark, d, "sections")).join(by, "section", "left").join(F.broadcast(n), how="cross")
    return joined.select("section", "display_section", F.coalesce("papers", F.lit(0)).alias("papers"), F.round(F.coalesce("papers", F.lit(0)) / F.col("total"), 6).alias("share"))


@query("SELECT count(*) AS items, count(DISTINCT source_doc) AS papers, sum(length(coalesce(text, ''))) AS chars, count(*) FILTER (WHERE length(coalesce(text, '')) < 100) AS short FROM items")
def work_units(spark, d):
    n = F.length(F.coalesce("text", F.lit("")))
    return table(spark, d, "items").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("source_doc").alias("papers"), F.sum(n).alias("chars"), F.count_if(n < 100).alias("short"))


@query("SELECT DISTINCT source_doc, 'start' AS side FROM items WHERE source_doc IS NOT NULL AND source_doc NOT IN (SELECT source_doc FROM blocks) UNION ALL SELECT DISTINCT source_doc, 'end' FROM blocks WHERE source_doc NOT IN (SELECT source_doc FROM items WHERE source_doc IS NOT NULL)")
def unpaired_keys(spark, d):
    return summary.unpaired(table(spark, d, "items").where("source_doc is not null"), table(spark, d, "blocks"), "source_doc")


@query("""SELECT 'item ids repeat only whole rows' AS name, (SELECT count(*) FROM (SELECT item_id FROM (SELECT DISTINCT * FROM items) GROUP BY 1 HAVING count(*) > 1)) AS failures
UNION ALL SELECT 'no leak in writing', (SELECT count(*) FROM items WHERE section IN ('practical_writing', 'continuation_writing') AND contains(text, '参考范文'))
UNION ALL SELECT 'blocks follow their order', (SELECT count(*) FROM (SELECT char_start < lag(char_start) OVER (PARTITION BY source_doc ORDER BY ord) AS bad FROM (SELECT DISTINCT * FROM blocks)) WHERE bad)""")
def finished_checks(spark, d):
    """One row a check of finished data, with how often it fails."""
    from pyspark.sql.window import Window

    items, blocks = table(spark, d, "items"), table(spark, d, "blocks").distinct()
    repeat = items.distinct().groupBy("item_id").count().where("count > 1").agg(F.lit("item ids repeat only whole rows").alias("name"), F.count(F.lit(1)).alias("failures"))
    leak = items.where(F.col("section").isin("practical_writing", "continuation_writing") & F.contains("text", F.lit("参考范文"))).agg(F.lit("no leak in writing").alias("name"), F.count(F.lit(1)).alias("failures"))
    bad = F.col("char_start") < F.lag("char_start").over(Window.partitionBy("source_doc").orderBy("ord"))
    order = blocks.select(bad.alias("bad")).agg(F.lit("blocks follow their order").alias("name"), F.count_if("bad").alias("failures"))
    return repeat.unionByName(leak).unionByName(order)


@query("SELECT DISTINCT item_id, length(coalesce(text, '')) % 10 AS score, 'stub' AS model FROM items")
def stub_score_stage(spark, d):
    """A model stage over items with the arithmetic client that stands in for a model."""
    items = table(spark, d, "items").select("item_id", F.coalesce("text", F.lit("")).alias("prompt")).distinct()
    said = answered(items, "item_id", "prompt", Client())
    return said.select("item_id", F.get_json_object("reply", "$.score").cast("int").alias("score"), "model")


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING max(l_linenumber) > count(DISTINCT l_linenumber)")
def completeness_gate(spark, d):
    """Orders whose line numbers have a gap."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("last"), F.countDistinct("l_linenumber").alias("n"))
    return li.where("last > n").select("l_orderkey")


@query("""WITH b AS (SELECT DISTINCT * FROM ocr_blocks), p AS (SELECT source_doc, page, bool_or(block_order IS NULL) AS byid FROM b GROUP BY 1, 2), n AS (SELECT source_doc, page, count(*) AS c FROM b GROUP BY 1, 2), o AS (SELECT source_doc, page, coalesce(sum(c) OVER (PARTITION BY source_doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT block_id, CAST(before + row_number() OVER (PARTITION BY source_doc, page ORDER BY CASE WHEN byid THEN 0 ELSE block_order END, block_id) AS BIGINT) AS place FROM b JOIN p USING (source_doc, page) JOIN o USING (source_doc, page)""")
def running_page_offset(spark, d):
    """The place of each scanned block in its paper: place within the page, plus the blocks of the pages before."""
    from pyspark.sql.window import Window

    b = table(spark, d, "ocr_blocks").distinct()
    pages = b.groupBy("source_doc", "page").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("block_order").isNull()).alias("byid"))
    place = F.row_number().over(Window.partitionBy("source_doc", "page").orderBy(F.when(F.col("byid"), 0).otherwise(F.col("block_order")), "block_id"))
    return b.join(running_sum(pages, "source_doc", ["page"], "c", "before"), ["source_doc", "page"]).select("block_id", (F.col("before") + place).alias("place"))


@query("SELECT source_doc, coalesce((SELECT min(a.source_doc) FROM papers a WHERE a.kind = 'answers' AND a.source = p.source), source_doc) AS target FROM papers p WHERE kind = 'paper'")
def redirected_papers(spark, d):
    """Papers, each with the first answer document of its source, or itself."""
    p = table(spark, d, "papers")
    pairing = p.where("kind = 'answers'").groupBy("source").agg(F.min("source_doc").alias("answers"))
    return relate.redirected(p.where("kind = 'paper'").select("source", "source_doc"), pairing, "source", "answers").select("source_doc", F.when(F.col("target") == F.col("source"), F.col("source_doc")).otherwise(F.col("target")).alias("target"))


@query("SELECT l_orderkey, string_agg(l_linenumber || '. ' || l_returnflag || chr(10) || 'ships ' || strftime(l_shipdate, '%Y-%m-%d'), chr(10) ORDER BY l_linenumber, l_returnflag, l_shipdate) AS text FROM lineitem GROUP BY 1")
def explanation_text(spark, d):
    from folioforge.functions.reply import explanation_lines

    note = F.array().cast("array<string>")
    q = F.struct(F.col("l_linenumber").alias("number"), F.col("l_returnflag").alias("answer"), F.concat(F.lit("ships "), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("reason"), note.alias("notes"))
    by = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(q)).alias("q"))
    return by.select("l_orderkey", explanation_lines(F.col("q")).alias("text"))


_word, _base, _derived = (_KEY.format(c) for c in ("word", "base", "derived"))


@query(f"""SELECT 'reading' AS list, count(*) AS before, count(DISTINCT {_word}) AS after FROM reading WHERE {_word} <> '' UNION ALL SELECT 'forms', count(*), count(DISTINCT ({_base}, {_derived})) FROM forms WHERE {_base} <> '' AND {_derived} <> ''""")
def merge_counts(spark, d):
    """Rows of the word lists before and after merging by word."""
    from folioforge.functions.text import strip

    low = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))
    one = table(spark, d, "reading").where(low("word") != "").agg(F.lit("reading").alias("list"), F.count(F.lit(1)).alias("before"), F.countDistinct(low("word")).alias("after"))
    two = table(spark, d, "forms").where((low("base") != "") & (low("derived") != "")).agg(F.lit("forms").alias("list"), F.count(F.lit(1)).alias("before"), F.countDistinct(low("base"), low("derived")).alias("after"))
    return one.unionByName(two)
