"""Problem 3: records that differ only in white space, letter case, punctuation or field order.

Method. Columns are dictionary-encoded: each distinct raw value is canonicalised once (however many rows hold it), each
distinct canonical value gets an integer - its rank among all of them, counted over range partitions, which is unique and
the same on every run, also when a lost executor's work is done again - and a record becomes the sorted tuple of
(field name, integer). Grouping and joins then move these compact tuples only. Values and tuples that hold a large share
of the rows are looked up through a size-bounded broadcast (operators.skew.heavy_lookup).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators.scan import row_numbers
from folioforge.operators.skew import heavy_lookup
from folioforge.session import written

FIELDS = {"reading": ["word", "pos", "meaning"], "forms": ["base", "base_pos", "derived", "derived_pos", "note"]}
#: White space of any kind and Unicode category P.
NOISE = r"(?U)[\s\p{Z}\x1c-\x1f\p{P}]+"


def canonical(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, NOISE, ""))


def typed_entries(rows: DataFrame, list_name: str, fields: list[str]) -> DataFrame:
    """(entry_id, list, fields ARRAY<STRUCT<name, value>>) of a table with one column for each field; a missing column is an empty field."""
    have = [f for f in fields if f in rows.columns]
    pairs = [F.struct(F.lit(f).alias("name"), rows[f].cast("string").alias("value")) for f in have]
    empty = F.array().cast("array<struct<name:string,value:string>>")
    return rows.select(rows["entry_id"].cast("long").alias("entry_id"), F.lit(list_name).alias("list"), (F.array(*pairs) if pairs else empty).alias("fields"))


def raw_entries(rows: DataFrame) -> DataFrame:
    """The same of JSON objects in payload, whose field names may have any letter case.

    A payload that is no object keeps its text as the field '?payload'; an object's field that isn't a string keeps its JSON text.
    A null list_name is the list ''.
    """
    parsed = F.from_json(rows["payload"], "map<string,string>")
    pairs = F.transform(F.map_entries(parsed), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("name"), e["value"].alias("value")))
    bad = F.when(F.trim(F.coalesce(rows["payload"], F.lit(""))) != "", F.array(F.struct(F.lit("?payload").alias("name"), rows["payload"].alias("value"))))
    return rows.select(rows["entry_id"].cast("long").alias("entry_id"), F.lower(F.trim(F.coalesce(rows["list_name"], F.lit("")))).alias("list"), F.coalesce(pairs, bad, F.array().cast("array<struct<name:string,value:string>>")).alias("fields"))


def encoded(entries: DataFrame) -> DataFrame:
    """(entry_id, list, tuple ARRAY<STRUCT<name, id>>), sorted; equal tuples of one list are copies.

    Null values and values with nothing but white space and punctuation don't appear in the tuple; a record without any other
    has the empty tuple, and all of these are copies of each other. Of a field named twice in one record the value with the smallest integer counts. Rows
    repeated exactly count once; rows of one entry_id that differ are records of their own; records without entry_id are left out, having no identity.
    """
    entries = entries.where("entry_id is not null").select("entry_id", "list", F.xxhash64("fields").alias("rec"), "fields")
    each = entries.select("entry_id", "list", "rec", F.explode("fields").alias("f")).where("f.value is not null")
    cells = written(each.select("entry_id", "list", "rec", F.col("f.name").alias("name"), F.col("f.value").alias("raw")), "cells")
    total = cells.count()
    raws = cells.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).withColumn("canon", canonical(F.col("raw")))
    raws = written(raws.where("canon <> ''"), "raws")
    size = raws.count()
    ids = row_numbers(raws.groupBy("canon").agg(F.count(F.lit(1)).alias("forms")).withColumn("all", F.lit(0)), "all", ["canon"], "id").select("canon", "forms", F.col("id").cast("long").alias("id"))
    dictionary = heavy_lookup(raws.select("raw", "n", "canon"), ids, ["canon"], "forms", size).select("raw", "n", "id")
    coded = heavy_lookup(cells, dictionary, ["raw"], "n", total).select("entry_id", "list", "rec", F.struct("name", "id").alias("c"))
    tuples = coded.groupBy("entry_id", "list", "rec").agg(F.sort_array(F.collect_set("c")).alias("t"))
    once = F.filter("t", lambda x, i: (i == 0) | (F.get("t", i - 1)["name"] != x["name"]))
    tuples = tuples.select("entry_id", "list", "rec", once.alias("tuple"))
    none = F.array().cast("array<struct<name:string,id:bigint>>")
    every = entries.select("entry_id", "list", "rec").distinct().join(tuples, ["entry_id", "list", "rec"], "left")
    return every.select("entry_id", "list", F.coalesce("tuple", none).alias("tuple"))


def copies(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes): members (entry_id, list, tuple); classes (list, tuple, entry_id the smallest, n_copies)."""
    members = written(encoded(entries), "tuples")
    classes = members.groupBy("list", "tuple").agg(F.min("entry_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return members, classes


def all_entries(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    typed = [typed_entries(read(t), t, FIELDS[t]) for t in FIELDS]
    return typed[0].unionByName(typed[1]).unionByName(raw_entries(read("raw_entries")))


def pairs_found(entries: DataFrame) -> DataFrame:
    """(entry_a, entry_b): the smallest entry_id of each set of copies with each other member."""
    members, classes = copies(entries)
    several = classes.where("n > 1")
    joined = heavy_lookup(members, several, ["list", "tuple"], "n", members.count())
    return joined.where("entry_id > first").select(F.col("first").alias("entry_a"), F.col("entry_id").alias("entry_b")).distinct()


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Copies among the word-list entries of reading, forms and raw_entries."""
    return pairs_found(all_entries(spark, sf_dir))


def p3_entries(spark, sf_dir: str) -> DataFrame:
    """Each entry once, under its smallest entry_id, with its number of copies."""
    _, classes = copies(all_entries(spark, sf_dir))
    return classes.select("list", F.col("first").alias("entry_id"), F.col("n").alias("n_copies"))


_SQL = r"""
WITH raw AS (
  SELECT entry_id, lower(trim(coalesce(list_name, ''))) AS list, payload FROM raw_entries),
keyed AS (
  SELECT entry_id, list, lower(trim(k)) AS name, json_extract_string(payload, '$."' || k || '"') AS value
  FROM (SELECT entry_id, list, payload, unnest(json_keys(payload)) AS k FROM raw)),
cells AS (
  SELECT entry_id, list, name, value FROM keyed
  UNION ALL SELECT entry_id, 'reading', unnest(['word', 'pos', 'meaning']), unnest([word, pos, meaning]) FROM reading
  UNION ALL SELECT entry_id, 'forms', unnest(['base', 'base_pos', 'derived', 'derived_pos', 'note']), unnest([base, base_pos, derived, derived_pos, note]) FROM forms),
canon AS (
  SELECT entry_id, list, name, lower(regexp_replace(value, '[\s\p{Z}\p{P}\x0b\x1c-\x1f\x{85}]', '', 'g')) AS v FROM cells),
entries AS (
  SELECT entry_id, list, coalesce(string_agg(name || ':' || v, chr(1) ORDER BY name) FILTER (WHERE v <> ''), '') AS t FROM canon GROUP BY 1, 2),
classes AS (SELECT list, t, min(entry_id) AS first, count(*) AS n FROM entries GROUP BY 1, 2)
"""


SQL = {
    "p3_found": _SQL + "SELECT first AS entry_a, entry_id AS entry_b FROM entries JOIN classes USING (list, t) WHERE entry_id > first",
    "p3_entries": _SQL + "SELECT list, first AS entry_id, n AS n_copies FROM classes",
}
