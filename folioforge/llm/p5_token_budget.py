"""Problem 5: token budget by source, language and section.

Method. A double-array trie over the vocabulary and a count-only Viterbi for each distinct segment (a run of white space
and what follows it: no token spans two), then sums of path lengths by slice. The vocabulary in question is a byte-BPE,
whose encoding isn't the path with the best score; so for it the step's condition is agreement with the token before,
which leaves exactly one path, the tokenizer's own (trie.BpeCount). For a vocabulary of tokens and scores, which every
operator here takes in place of a rank file, the score decides (trie.unigram_count). Texts are reduced to a count before anything is shuffled; the sums are made per paper before
the papers join.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.trie import BpeCount, DoubleArrayTrie, unigram_count
from folioforge.llm.vocab import SEGMENT, SPLIT, TOKENIZERS, WHITE, Memo, read_ranks
from folioforge.operators.skew import heavy_lookup
from folioforge.session import written


def segment_counter(ranks: dict[bytes, int], trie: DoubleArrayTrie):
    """Function from text to its number of tokens."""
    import re

    import regex

    dp, parts, segments = BpeCount(ranks, trie), regex.compile(SPLIT).findall, re.compile(SEGMENT).findall
    piece = Memo(lambda s: dp.count(s.encode()))
    memo = Memo(lambda s: sum(map(piece.__getitem__, parts(s))))
    return lambda text: sum(map(memo.__getitem__, segments(text)))


def spans_segments(token: bytes) -> bool:
    """Whether the token may hold the end of one segment and the beginning of the next."""
    import re

    try:
        return bool(re.search(f"[^{WHITE}][{WHITE}]", token.decode()))
    except UnicodeDecodeError:  # parts of characters; a single byte is in one segment
        return len(token) > 1


def scored_counter(scores: list[float], trie: DoubleArrayTrie, whole: bool):
    """Function from text to its number of tokens under a unigram vocabulary; `whole` where tokens span segments."""
    import re

    if whole:
        return lambda text: unigram_count(trie, scores, text.encode())
    segments = re.compile(SEGMENT).findall
    memo = Memo(lambda s: unigram_count(trie, scores, s.encode()))
    return lambda text: sum(map(memo.__getitem__, segments(text)))


def token_counts(rows: DataFrame, text: str = "text", vocabulary: str | dict[bytes, float] = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` and n_tokens of every row. Null and empty texts have 0 tokens.

    vocabulary: the path of a rank file, or the scores of a unigram vocabulary's tokens.
    """
    if isinstance(vocabulary, dict):
        make, trie = scored_counter, DoubleArrayTrie({t: k for k, t in enumerate(vocabulary)})
        given = (list(vocabulary.values()), trie, any(map(spans_segments, vocabulary)))
    else:
        make, ranks = segment_counter, read_ranks(vocabulary)
        given = (ranks, DoubleArrayTrie(ranks))
    sent = rows.sparkSession.sparkContext.broadcast(given)  # a few MB, given by the vocabulary

    def run(batches):
        count = make(*sent.value)
        for b in batches:
            n = [count(x) if x else 0 for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    keep = list(keep or [])
    schema = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keep) + "n_tokens bigint"
    return rows.select(*(rows[k] for k in keep), rows[text].cast("string").alias("__text")).mapInArrow(run, schema)


def plain_lang(lang):
    """One spelling of a language: lower case, the part before - or _; null, blank and 'und' are 'unknown'."""
    base = F.lower(F.regexp_extract(F.trim(lang), "^([A-Za-z]+)", 1))
    return F.when(base.isNull() | base.isin("", "und"), F.lit("unknown")).otherwise(base)


def counted_once(items: DataFrame, vocabulary: str | dict[bytes, float]) -> DataFrame:
    """(item_id, source_doc, section, n_tokens), one row an item, written.

    Of rows of one item_id that differ the one with the most tokens counts, ties by source_doc and section. Rows without item_id are
    the same item if they are equal in paper, section and number of tokens.
    """
    counted = token_counts(items, "text", vocabulary, ["item_id", "source_doc", "section"])
    alone = F.when(F.col("item_id").isNull(), F.struct("source_doc", "section", "n_tokens"))
    once = counted.groupBy("item_id", alone.alias("alone")).agg(F.max(F.struct("n_tokens", "source_doc", "section")).alias("r"))
    return once.select("item_id", "r.source_doc", F.coalesce("r.section", F.lit("unknown")).alias("section"), "r.n_tokens")


def paper_facts(papers: DataFrame) -> DataFrame:
    facts = papers.where("source_doc is not null").groupBy("source_doc").agg(F.min(F.struct("source", "lang")).alias("p"))
    return facts.select("source_doc", F.coalesce("p.source", F.lit("unknown")).alias("source"), plain_lang(F.col("p.lang")).alias("lang"))


def item_tokens(items: DataFrame, papers: DataFrame, vocabulary: str | dict[bytes, float] = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(item_id, source, lang, section, n_tokens): each item once, with the slices it belongs to.

    Items whose paper is missing, null or has no source are 'unknown' there; null sections too. Null and empty texts have 0 tokens.
    """
    once = written(counted_once(items, vocabulary), "counted").withColumn("paper", F.coalesce("source_doc", F.lit(""))).drop("source_doc")
    unknown = F.lit("unknown")
    used = once.groupBy("paper").agg(F.count(F.lit(1)).alias("n"))
    table = used.join(paper_facts(papers).withColumnRenamed("source_doc", "paper"), "paper", "left").select("paper", "n", F.coalesce("source", unknown).alias("source"), F.coalesce("lang", unknown).alias("lang"))
    return heavy_lookup(once, table, ["paper"], "n", once.count()).select("item_id", "source", "lang", "section", "n_tokens")


def token_budget(items: DataFrame, papers: DataFrame, vocabulary: str | dict[bytes, float] = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(slice, source, lang, section, n_items, n_tokens): totals by paper source and language, and by section.

    slice is 'source_lang' (section null) or 'section' (source and lang null). Items count as in item_tokens. Empty tables give no row.
    """
    once = counted_once(items, vocabulary)
    by_paper = once.groupBy("source_doc", "section").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
    joined = by_paper.join(paper_facts(papers), "source_doc", "left").select(F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("lang", F.lit("unknown")).alias("lang"), "section", "n_items", "n_tokens")
    slices = F.array(
        F.struct(F.lit("source_lang").alias("slice"), F.col("source").alias("source"), F.col("lang").alias("lang"), F.lit(None).cast("string").alias("section")),
        F.struct(F.lit("section").alias("slice"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), F.col("section").alias("section")),
    )
    return joined.select(F.explode(slices).alias("s"), "n_items", "n_tokens").groupBy("s").agg(F.sum("n_items").alias("n_items"), F.sum("n_tokens").alias("n_tokens")).select("s.*", "n_items", "n_tokens")


def p5_tokens(spark, sf_dir: str) -> DataFrame:
    """Tokens of each item by byte_bpe_50k, with its source, language and section."""
    return item_tokens(spark.read.parquet(f"{sf_dir}/items.parquet"), spark.read.parquet(f"{sf_dir}/papers.parquet"))


def p5_token_budget(spark, sf_dir: str) -> DataFrame:
    """Tokens of items by byte_bpe_50k, by paper source and language and by section."""
    return token_budget(spark.read.parquet(f"{sf_dir}/items.parquet"), spark.read.parquet(f"{sf_dir}/papers.parquet"))
