"""Queries of scores, ranking and ordered output, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions.text import wordish
from folioforge.operators import rank
from folioforge.plans.catalogue import query, table
from folioforge.rules import DEFAULT

#: Weights of (words, characters, stems) by section; the rest take the last.
WEIGHTS = {"reading_a": (3.0, 1.5, 1.0), "reading_b": (1.0, 3.0, 1.5), "cloze": (2.0, 1.0, 2.0), "": (1.0, 1.0, 1.0)}


def scored(spark, d):
    """One row an item with a score of its length and stems, weighted by section."""
    items = table(spark, d, "items")
    words, chars = wordish(F.col("text")) / 1000.0, F.coalesce(F.length("text"), F.lit(0)) / 10000.0
    stems = F.coalesce(F.regexp_count("text", F.lit(r"(?m)^\d{2}\.")), F.lit(0)) / 10.0
    by = lambda k: F.element_at(F.create_map(*(x for s, w in WEIGHTS.items() for x in (F.lit(s), F.lit(w[k])))), F.when(F.col("section").isin(*(s for s in WEIGHTS if s)), F.col("section")).otherwise(""))
    return items.select("item_id", "source_doc", "section", F.round(by(0) * words + by(1) * chars + by(2) * stems, 9).alias("score"), F.length("text").alias("chars"), F.xxhash64("text").alias("same")).distinct().drop("same")  # repeated rows once, without shuffling texts


_case = lambda k: "CASE section " + " ".join(f"WHEN '{s}' THEN {w[k]}" for s, w in WEIGHTS.items() if s) + f" ELSE {WEIGHTS[''][k]} END"
SCORED = rf"""scored AS (SELECT item_id, source_doc, section, round({_case(0)} * (coalesce(len(regexp_extract_all(text, '[A-Za-z]+(?:[-''][A-Za-z]+)?')), 0) / 1000.0) + {_case(1)} * (coalesce(length(text), 0) / 10000.0) + {_case(2)} * (coalesce(len(regexp_extract_all(text, '(?m)^\d{{2}}\.')), 0) / 10.0), 9) AS score, length(text) AS chars FROM (SELECT DISTINCT item_id, source_doc, section, text FROM items))"""


@query(f"WITH {SCORED} SELECT * FROM (SELECT section, item_id, score, CAST(row_number() OVER (PARTITION BY section ORDER BY score DESC, item_id) AS INT) AS rank FROM scored WHERE section IS NOT NULL) WHERE rank <= 2")
def topk_per_section(spark, d):
    """The two best items of each section: the flagship query."""
    return rank.top_of(scored(spark, d).where("section is not null").select("section", "item_id", "score"), "section", [F.desc("score"), F.col("item_id")], 2)


@query(f"""WITH {SCORED}, s AS (SELECT * FROM (SELECT section, item_id, score, row_number() OVER (PARTITION BY section ORDER BY score DESC, item_id) AS rank FROM scored WHERE section IS NOT NULL) WHERE rank <= 6),
p AS (SELECT item_id, min(read_level) AS pick FROM level_labels WHERE read_level >= 5 GROUP BY 1)
SELECT section, item_id, CAST(rank AS INT) AS rank, CAST(place AS INT) AS place FROM (SELECT s.*, row_number() OVER (PARTITION BY section ORDER BY pick NULLS LAST, rank) AS place FROM s LEFT JOIN p USING (item_id)) WHERE place <= 2""")
def shortlist_topup(spark, d):
    short = rank.top_of(scored(spark, d).where("section is not null").select("section", "item_id", "score"), "section", [F.desc("score"), F.col("item_id")], 6)
    picks = table(spark, d, "level_labels").where("read_level >= 5").select("item_id", F.col("read_level").alias("pick"))
    return rank.picked_first(short, picks, "section", "item_id", 2).select("section", "item_id", "rank", "place")


@query(f"WITH {SCORED} SELECT source_doc, item_id FROM (SELECT source_doc, item_id, coalesce(chars >= 1500, false) AS good, bool_or(coalesce(chars >= 1500, false)) OVER (PARTITION BY source_doc) AS any_good FROM scored) WHERE good OR NOT any_good")
def group_safe_filter(spark, d):
    return rank.keep_some(scored(spark, d), "source_doc", F.col("chars") >= 1500).select("source_doc", "item_id")


@query(f"WITH {SCORED}, o AS (SELECT section, source_doc, item_id, chars, row_number() OVER (ORDER BY coalesce(section, ''), source_doc, item_id, chars, score) AS ordinal, lag(coalesce(section, '')) OVER (ORDER BY coalesce(section, ''), source_doc, item_id, chars, score) AS before FROM scored) SELECT section, source_doc, item_id, CAST(ordinal AS BIGINT) AS ordinal, before IS NULL OR before <> coalesce(section, '') AS opens FROM o")
def ordered_report(spark, d):
    rows = scored(spark, d).withColumn("s", F.coalesce("section", F.lit("")))
    return rank.outline(rows, "section", ["s", "source_doc", "item_id", "chars", "score"]).select("section", "source_doc", "item_id", F.col("ordinal").cast("long"), "opens")


@query(f"WITH {SCORED} SELECT section, count(*) AS items, round(avg(coalesce(score, 0)), 6) AS score FROM scored GROUP BY section")
def section_score_avg(spark, d):
    return scored(spark, d).groupBy("section").agg(F.count(F.lit(1)).alias("items"), F.round(F.avg(F.coalesce("score", F.lit(0.0))), 6).alias("score"))


_sections = ", ".join(f"count(*) FILTER (WHERE section = '{s}') AS {s}" for s in DEFAULT.order)


@query(f"SELECT source_doc, {_sections} FROM items GROUP BY source_doc")
def paper_section_pivot(spark, d):
    from folioforge.operators.summary import coverage

    return coverage(table(spark, d, "items"), "source_doc", "section")
