"""Boundaries, ordered slices, budgets and state along a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folioforge.functions.text import strip, token_estimate
from folioforge.operators.scan import forward_fill, row_numbers
from folioforge.rules import DEFAULT, RulePack
from folioforge.session import written


def earliest(text: Column, markers: list[tuple[str, float]]) -> Column:
    """0-based offset of the earliest marker, each looked for from a share of the text on; null if there is none, or for null.

    A marker's first place at or after its share counts.
    """
    n = F.length(text)
    found = []
    for marker, share in markers:
        from_ = F.floor(n * share).cast("int") + 1
        found.append(F.nullif(F.position(F.lit(marker), text, from_), F.lit(0)))
    return F.least(*found, F.lit(None).cast("int")) - 1


def tail_split(text: Column, at: Column, most: int = 30000) -> Column:
    """STRUCT<body, tail>: the text before and from an offset; all of it is body if that is null. The tail ends after `most` characters."""
    body = F.when(at.isNull(), text).otherwise(F.substring(text, F.lit(1), at))
    tail = F.when(at.isNull(), F.lit("")).otherwise(F.substring(text, at + 1, F.lit(most)))
    return F.struct(body.alias("body"), tail.alias("tail"))


def slices(starts: DataFrame, key: str, pos: str, end: str) -> DataFrame:
    """`starts` with slice_end: the next start of the same key, or the column `end` for the last. Equal positions end at each other's start."""
    back = starts.withColumn("__back", -F.col(pos))
    following = forward_fill(back, key, ["__back"], pos, "__following", before=True)
    return following.withColumn("slice_end", F.coalesce("__following", end)).drop("__back", "__following")


def in_order(starts: DataFrame, key: str, pos: str, section: str, rules: RulePack = DEFAULT) -> DataFrame:
    """(key, pos, section) of the longest run of starts whose sections rise strictly in the pack's order along pos; of equally long ones that which ends earliest.

    Starts with the same position count in the pack's order. One round for each section, in order: for each length of run so far its earliest end is kept, and the section's earliest
    start after that end makes a run one longer. A round is an aggregation of minima by key, so a key with very many starts is never gathered.
    """
    ranks = F.create_map(*(x for s in rules.order for x in (F.lit(s), F.lit(rules.rank(s)))))
    known = written(starts.select(key, F.col(pos).cast("long").alias("pos"), F.element_at(ranks, F.col(section)).alias("r")).where("r is not null"), "starts")
    n = len(rules.order)
    run = "struct<pos:bigint,path:array<struct<pos:bigint,r:int>>>"
    tails = [F.expr(f"cast(struct({-(1 << 62)}L as pos, array() as path) as {run})"), *(F.expr(f"cast(null as {run})") for _ in range(n))]
    state = known.select(key).distinct().select(key, *(t.alias(f"t{k}") for k, t in enumerate(tails)))
    for r in range(n):
        own = known.where(F.col("r") == r).join(state.select(key, *(F.col(f"t{k}.pos").alias(f"p{k}") for k in range(r + 1))), key)
        least = own.groupBy(key).agg(*(F.min(F.when(F.col("pos") > F.col(f"p{k}"), F.col("pos"))).alias(f"m{k}") for k in range(r + 1)))
        joined = state.join(least, key, "left")
        new = [F.col("t0")]
        for k in range(1, n + 1):
            if k > r + 1:
                new.append(F.col(f"t{k}"))
                continue
            m, old = F.col(f"m{k - 1}"), F.col(f"t{k}")
            longer = F.struct(m.alias("pos"), F.concat(F.col(f"t{k - 1}.path"), F.array(F.struct(m.alias("pos"), F.lit(r).alias("r")))).alias("path")).cast(run)
            new.append(F.when(m.isNotNull() & (old.isNull() | (m < old["pos"])), longer).otherwise(old))
        state = joined.select(key, *(c.alias(f"t{k}") for k, c in enumerate(new)))
        if r % 3 == 2:
            state = written(state, "runs")
    longest = F.coalesce(*(F.col(f"t{k}.path") for k in range(n, 0, -1)))
    each = state.select(key, F.explode(longest).alias("p"))
    names = F.array(*(F.lit(s) for s in rules.order))
    return each.select(key, F.col("p.pos").alias(pos), F.element_at(names, F.col("p.r") + 1).alias(section))


def packed(text: Column, most: int) -> Column:
    """ARRAY<STRING>: non-blank stripped lines put together greedily; a chunk is closed when a line would make it longer than `most`, newlines counted.

    A line longer than that is a chunk of its own. Null gives null, a blank text no chunk.
    """
    kept = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    return _greedy(kept, lambda x: F.length(x) + 1, most + 1, "\n")


def _greedy(parts: Column, size, most: int, between: str) -> Column:
    """ARRAY<STRING>: consecutive parts joined, a chunk closed when the next part's size would take its sizes' sum beyond `most`."""
    none = F.array().cast("array<string>")
    sized = F.transform(parts, lambda x: F.struct(x.alias("x"), size(x).cast("int").alias("n")))
    closed = lambda a: F.concat(a["done"], F.array(F.array_join(a["open"], between)))

    def step(a: Column, p: Column) -> Column:
        flush = (F.size(a["open"]) > 0) & (a["n"] + p["n"] > most)
        return F.struct(
            F.when(flush, closed(a)).otherwise(a["done"]).alias("done"),
            F.when(flush, F.array(p["x"])).otherwise(F.concat(a["open"], F.array(p["x"]))).alias("open"),
            (F.when(flush, F.lit(0)).otherwise(a["n"]) + p["n"]).alias("n"),
        )

    start = F.struct(none.alias("done"), none.alias("open"), F.lit(0).alias("n"))
    return F.aggregate(sized, start, step, lambda a: F.when(F.size(a["open"]) > 0, closed(a)).otherwise(a["done"]))


def token_chunks(text: Column, budget: int, least: int = 2000, count=token_estimate) -> Column:
    """ARRAY<STRING>: a text that fits a conversation's budget of tokens whole, else pieces of at most a fifth of it (`least` tokens at the least), as the conversation holds all
    pieces and their replies.

    Pieces are paragraphs, put together greedily with an empty line between; a paragraph too large by itself goes in line by line, and a line is never split. count: tokens of a
    text column. Null gives null, a blank text no piece.
    """
    most, whole = max(budget // 5, least), strip(text)
    paragraphs = F.filter(F.transform(F.split(whole, r"\n\s*\n"), strip), lambda x: x != "")
    lines = lambda p: F.filter(F.transform(F.split(p, "\n"), strip), lambda x: x != "")
    parts = F.flatten(F.transform(paragraphs, lambda p: F.when(count(p) <= most, F.array(p)).otherwise(lines(p))))
    return F.when(whole.isNull(), F.lit(None)).when(whole == "", F.array().cast("array<string>")).when(count(whole) <= budget, F.array(whole)).otherwise(_greedy(parts, count, most, "\n\n"))


def groups_of(df: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """`df` with `chunk`: consecutive rows of a key, `size` to a chunk, from 0."""
    ranked = row_numbers(df, key, [order], "__rank")
    return ranked.withColumn("chunk", F.floor((F.col("__rank") - 1) / size).cast("int")).drop("__rank")


def owners(blocks: DataFrame, key: str, order: str, text: str, head: str, reset: str) -> DataFrame:
    """`blocks` with `owner`: the number that the last line matching `head` (a pattern with one group) names, up to a line matching `reset` or without Chinese characters.

    Lines that match both are heads. Rows before the first head, and null texts, have none and end a stretch.
    """
    number = F.nullif(F.regexp_extract(text, head, 1), F.lit("")).try_cast("int")
    stops = F.coalesce(F.rlike(text, F.lit(reset)) | ~F.rlike(text, F.lit("[一-鿿]")), F.lit(True))
    # one marker column: the number at a head, -1 where a stretch ends, null where it goes on
    mark = F.when(number.isNotNull(), number).when(stops, F.lit(-1))
    filled = forward_fill(blocks.withColumn("__mark", mark), key, [order], "__mark", "owner")
    return filled.withColumn("owner", F.nullif("owner", F.lit(-1))).drop("__mark")


def owned_spans(owned: DataFrame, key: str, index: str) -> DataFrame:
    """(key, owner, low, high): each owner's [low, high) of indices; null bounds where another owner's index lies within."""
    spans = owned.where("owner is not null").groupBy(key, "owner").agg(F.min(index).alias("low"), (F.max(index) + 1).alias("high"))
    # spans sorted by low overlap iff one begins before the furthest end so far, or ends after the next begins
    w = Window.partitionBy(key).orderBy("low", "high", "owner")
    before = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("low").over(w.rowsBetween(1, Window.unboundedFollowing))
    void = F.coalesce(F.col("low") < before, F.lit(False)) | F.coalesce(F.col("high") > after, F.lit(False))
    return spans.withColumn("void", void).select(key, "owner", F.when(~F.col("void"), F.col("low")).alias("low"), F.when(~F.col("void"), F.col("high")).alias("high"))


def restarts(turns: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """`turns` with `conversation` and `running`: a running total of size along a key that starts anew when it would exceed the budget; conversations count from 0.

    The total depends on where it last began, which no window expresses: a key's rows are scanned in order, in
    Arrow batches of which one is held at a time. Null sizes count as 0.
    """
    import pyarrow as pa

    schema = T.StructType([*turns.schema.fields, T.StructField("conversation", T.IntegerType()), T.StructField("running", T.LongType())])

    def scan(batches):
        last, total, n = object(), 0, 0
        for b in batches:
            keys, sizes = b.column(b.schema.get_field_index(key)).to_pylist(), b.column(b.schema.get_field_index(size)).to_pylist()
            conversation, running = [], []
            for k, s in zip(keys, sizes):
                s = s or 0
                if k != last:
                    last, total, n = k, 0, 0
                if total and total + s > budget:
                    total, n = 0, n + 1
                total += s
                conversation.append(n)
                running.append(total)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(conversation, pa.int32()), pa.array(running, pa.int64())], names=[*b.schema.names, "conversation", "running"])

    return turns.repartition(F.col(key)).sortWithinPartitions(key, order).mapInArrow(scan, schema)
