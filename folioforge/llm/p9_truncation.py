"""Problem 9: documents that were cut off.

Method. Positives are made by cutting intact values: at the lengths that pile up in their source or anywhere, with or without something left
at the cut. Hashed logistic regression on how a text closes - its last characters, word and line, punctuation and open
quotes, how the text is punctuated elsewhere, whether its last word occurs as a whole word inside other texts, and whether its length
is one at which texts of its source pile up - is fitted on a bounded sample on the driver, without the values that fits on other values
find cut already. Then every record is scored. Cut values are commoner in training than among the records; how common they are there is estimated
from all scores by expectation maximisation and moves the log-odds; a record counts as cut where these are above 0.

Corpus statistics (lengths by source, words inside texts) are counted over all documents. Words are looked up by a join that splits hot
words (operators.skew.heavy_lookup).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.skew import hash_sample, heavy_lookup
from folioforge.session import dropped, written

SAMPLE, HASHED, CUTS = 12_000, 1 << 15, 2

_letters = re.compile("[A-Za-z]+")
_ellipsis = re.compile(r"\s*[\[(（]?\s*(\.{2,}|…+)\s*[\])）]?$")
_tail_word = re.compile(r"[A-Za-z]+$")
_runs = re.compile(r"(\d{1,3})\s*[-—~－–]+\s*(\d{1,3})\s*[.．、:：]?\s*([A-G]*)$")
_numbered = re.compile(r"(\d{1,3})\s*[.．]\s*([A-Za-z]*)$")
_option = re.compile(r"(?:^|\s{2,})([A-G])\s*[.．](?=\s|$)")
_closing = re.compile(r"[.!?。！？][\"”’')）】]*$|[”】》）)]$")
_shapes = [(re.compile("[a-z]+"), "a"), (re.compile("[A-Z]+a?"), "A"), (re.compile("[0-9]+"), "0"), (re.compile("[一-鿿]+"), "中"), (re.compile(r"[ \t]+"), " ")]
#: What may be left or added at a cut.
ADDED = ["", "", "", "", " ", "...", "…", "\n", "\r\n", " [...]", " ...", "-"]


def shape(s: str) -> str:
    """`s` with each run of letters, capitals, digits or Chinese characters as one character."""
    for pattern, to in _shapes:
        s = pattern.sub(to, s)
    return s


def describe(text: str, kind: str | None, limit: bool) -> tuple[list[str], list[str], str]:
    """Features, those to be crossed with how common the last word is, and that word ('' if the text doesn't end in Latin letters)."""
    stripped = text.rstrip()
    left = repr(text[len(stripped) :][:2])
    m = _ellipsis.search(stripped[-12:])
    dots = m[1][0] if m else ""
    base = stripped[: len(stripped) - len(m[0])] if m else stripped
    line = base[base.rfind("\n") + 1 :]
    before = base[: len(base) - len(line)].rstrip()
    before = before[before.rfind("\n") + 1 :]
    end, word = shape(base[-24:]), _tail_word.search(base[-40:])
    word = word[0] if word else ""
    near = base[-400:]
    words = len(_letters.findall(near)) + near.count("，") * 4
    stops = sum(map(near.count, ".!?。！？"))
    style = "none" if not stops else "rare" if stops * 40 < words else "usual"
    style += "|low" if not any(c.isupper() for c in near) else "|Up"
    options = _option.findall(line)
    opened = [c for c in _option.findall(base[-300:])]
    run, number = _runs.search(line), _numbered.search(line)
    if run:
        size = int(run[2]) - int(run[1]) + 1
        runs = "full" if len(run[3]) == size else "short" if len(run[3]) < size else "long"
        runs += f"|{len(_runs.findall(line))}|{len(re.findall('[-—~－–]+', line)) % 2}"
    elif number and len(re.findall(r"\d+\s*[.．]", line)) > 1:
        runs = f"words|{int(number[1]) % 5}|{int(number[1])}"
    else:
        runs = "no"
    first = line.split(None, 1)[0].lower() if line.split() else ""
    lead = shape(line[:14])[:5]
    closed = "yes" if _closing.search(base[-6:]) else "no"
    quotes = ("'" if text.count('"') % 2 else "") + ("“" if text.count("“") > text.count("”") else "") + ("(" if sum(map(text.count, "(（《【")) > sum(map(text.count, ")）》】")) else "")
    form = f"opt{options[-1]}" if options else "run" if runs != "no" else "sign" if re.match(r"(?i)(yours|best wishes|sincerely|regards)", before) else "par" if first.startswith("paragraph") else "talk" if re.match(r"[A-Za-z][:：]", line) else lead[:3] if len(line) < 60 else "long"
    size = min(6, len(line) // 12)
    whole = shape(line) if len(line) < 48 else "-"
    lim = "L" if limit else ""
    short = "short" if len(base) < 40 and "\n" not in base else ""
    feats = [
        "1", f"e1={end[-1:]}|{closed}|{style}", f"e2={end[-2:]}", f"e3={end[-3:]}|{dots}", f"e5={end[-5:]}|{style}", f"left={left}|{closed}", f"dots={dots}|{form}", f"lim={lim}|{closed}", f"lim={lim}|{style}|{closed}",
        f"form={form}|{closed}", f"form={form}|{style}", f"runs={runs}", f"runs={runs}|{end[-1:]}", f"whole={whole}", f"first={first[:12]}|{closed}", f"lead={lead}|{closed}|{size}", f"quotes={quotes}|{closed}", f"kind={kind}|{closed}|{style}", f"kind={kind}|{end[-2:]}",
        f"kind={kind}|{form}", f"w={word.lower()}|{style}", f"w={word.lower()}|{closed}", f"opts={''.join(opened[-4:])}|{form[:3]}", f"short={short}|{kind}|{style}", f"prev={shape(before[-6:])[-2:]}|{form}|{closed}", f"style={style}|{closed}|{bool(word)}",
    ]
    cross = [form, f"{style}|{closed}", f"{dots}|{form == 'par'}", f"{lim}|{closed}", f"{kind}|{closed}", f"{short}|{end[-3:]}", f"cap{word[:1].isupper()}|{form}"]
    return feats, cross, word.lower()


def hashed(names: list[str]) -> list[int]:
    import xxhash

    return [xxhash.xxh32_intdigest(s) % HASHED for s in names]


def cut(text: str, limits: list[int], rng) -> tuple[str, bool] | None:
    """The text cut within a sentence, and whether at one of `limits`; None if it is too short or the cut would leave it complete."""
    fitting = [x for x in limits if x < len(text)]
    if fitting and rng.random() < 0.5:
        at, limit = fitting[rng.integers(len(fitting))], True
    else:
        if len(text) < 30:
            return None
        at, limit = int(rng.integers(max(12, len(text) // 5), len(text) - 2)), False
    kept = text[:at]
    added = ADDED[rng.integers(len(ADDED))]
    if limit:
        kept = kept[: at - len(added)] + added
    else:
        kept += added
    rest, core = text[at:], kept[: len(kept) - len(added)].rstrip()
    if not core or _closing.search(core[-6:]) or rest.startswith("\n") or rest[:1] == "\r" or not rest.strip():
        return None  # cut between sentences or lines
    return kept, limit


def fit(rows: list[np.ndarray], y: np.ndarray, rounds: int = 60, decay: float = 2e-5, seed: int = 5) -> np.ndarray:
    """Weights of logistic regression over rows of hashed features, by AdaGrad on mini-batches."""
    rng, w, g2 = np.random.default_rng(seed), np.zeros(HASHED), np.full(HASHED, 1e-6)
    if not rows:
        return w
    sizes = np.array([len(r) for r in rows])
    flat, start = np.concatenate(rows), np.concatenate([[0], np.cumsum(sizes)])
    width = int(sizes.max())
    table = np.full((len(rows), width), -1)
    for i in range(len(rows)):
        table[i, : sizes[i]] = flat[start[i] : start[i + 1]]
    for k in range(rounds):
        order = rng.permutation(len(rows))
        for at in np.array_split(order, max(1, len(order) // 256)):
            t = table[at]
            ok = t >= 0
            z = np.where(ok, w[np.where(ok, t, 0)], 0).sum(1)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) / len(at)
            g = np.bincount(t[ok], np.repeat(d, ok.sum(1)), HASHED) + decay * w
            g2 += g * g
            w -= 0.15 * g / np.sqrt(g2)
    return w


def fit_intact(rows: list[np.ndarray], y: np.ndarray, half: np.ndarray, passes: int = 3) -> tuple[np.ndarray, float]:
    """Weights, and the share of cut values in what they were fitted on: fitted without the values (y 0) that were cut already: those that a fit on the other half of the values finds cut. half: 0 or 1 of each row, the same for a value and its cuts."""
    keep = np.ones(len(rows), bool)
    for _ in range(passes):
        held = np.zeros(len(rows))
        for h in (0, 1):
            train = np.flatnonzero(keep & (half == h))
            w = fit([rows[i] for i in train], y[train], 10)
            for i in np.flatnonzero(half != h):
                held[i] = w[rows[i]].sum()
        keep = (y == 1) | (held < 0)
    train = np.flatnonzero(keep)
    return fit([rows[i] for i in train], y[train], 15), float(y[train].mean())


def real_share(scores: np.ndarray, n: np.ndarray, fitted: float, rounds: int = 300) -> float:
    """The share of cut values where score `scores` occurs `n` times, if the weights were fitted on a share of `fitted`: by expectation maximisation."""
    logit = lambda p: np.log(p / (1 - p))
    share = fitted
    for _ in range(rounds):
        share = float(np.clip((n / (1 + np.exp(-np.clip(scores + logit(share) - logit(fitted), -60, 60)))).sum() / n.sum(), 1e-9, 1 - 1e-9))
    return share


def _described(docs: DataFrame, common: list[int] | None = None) -> DataFrame:
    """(row, y, feats ARRAY<INT>, cross ARRAY<STRING>, word, df) of docs (row, text, kind, limit, own): y is 0 for a text as it stands, 1 for a cut one.

    Given `common` (lengths to cut at where `own`, those of the source, is null), each text also comes cut. Without it, rows of y -1 tell in how many
    texts (df) each word stands before the last word; they are summed in each task before they leave it.
    """

    def run(batches):
        from collections import Counter

        import xxhash

        n: Counter = Counter()

        def counts():
            empty = pa.nulls(len(n))
            got = pa.RecordBatch.from_arrays(
                [empty.cast(pa.int64()), pa.array([-1] * len(n), pa.int32()), empty.cast(pa.list_(pa.int32())), empty.cast(pa.list_(pa.string())), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=names
            )
            n.clear()
            return got

        names = ["row", "y", "feats", "cross", "word", "df"]
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                out = []
                for row, text, kind, limit, own in zip(*(c.to_pylist() for c in batch.slice(i, 1000).columns)):
                    out.append((row, 0, *describe(text, kind, limit)))
                    if common is None:
                        n.update({w.lower() for w in set(_letters.findall(text[: text.rstrip().rfind(" ") + 1]))})
                        continue
                    own, rng = own or [], np.random.default_rng(xxhash.xxh32_intdigest(text))
                    for _ in range(CUTS):
                        c = cut(text, own or common, rng)
                        if c:
                            out.append((row, 1, *describe(c[0], kind, c[1] or len(c[0]) in own)))
                cols = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array([hashed(f) for f in cols[2]], pa.list_(pa.int32())), pa.array(cols[3], pa.list_(pa.string())), pa.array(cols[4], pa.string()), pa.nulls(len(out), pa.int64())],
                    names=names,
                )
                if len(n) > 200_000:
                    yield counts()
        if n:
            yield counts()

    return docs.select("row", "text", "kind", "limit", "own").mapInArrow(run, "row long, y int, feats array<int>, cross array<string>, word string, df long")


def piled_lengths(sizes: DataFrame, support: int = 5) -> DataFrame:
    """(source, size, n): for each source, the lengths that 1 % of its documents and at least `support` of them share, and that are ten times as common as those around.

    sizes: (source, size, n), in how many documents of the source each length stands. A source's lengths depend on its own documents alone; it has at most a hundred.
    """
    of = sizes.groupBy("source").agg(F.sum("n").alias("all"))
    some = sizes.where(F.col("n") >= support).join(of, "source").where("n >= 0.01 * all").drop("all")
    around = some.select("source", F.col("size").alias("at"), F.explode(F.sequence(F.col("size") - 10, F.col("size") + 10)).alias("size")).join(sizes, ["source", "size"])
    around = around.groupBy("source", F.col("at").alias("size")).agg(F.sum("n").alias("around"))
    return some.join(around, ["source", "size"]).where("n >= 0.33 * around").select("source", "size", "n")


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", kind: str = "doc_kind", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score, cut): log-odds that each document was cut, and whether it counts as cut.

    Null, empty and blank texts, and tables without any text long enough to be cut, have no row. Null sources count as
    one source; null kinds are a kind. Repeated rows and null keys are kept as they are. About `sample` documents are cut for training.
    """
    spark = docs.sparkSession
    plain = docs.select(docs[key].cast("long").alias("row"), docs[text].cast("string").alias("text"), docs[kind].cast("string").alias("kind"), F.coalesce(docs[source].cast("string"), F.lit("")).alias("source"))
    full = plain.where("text rlike '[^\\\\s]'")
    sizes = written(full.groupBy("source", F.length("text").alias("size")).agg(F.count(F.lit(1)).alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    limits = written(piled_lengths(sizes), "limits")
    dropped(sizes)
    # a table of at most a hundred rows a source: broadcast by the planner where its size allows
    known = full.withColumn("size", F.length("text")).join(limits.select("source", "size", F.lit(True).alias("limit")), ["source", "size"], "left").withColumn("limit", F.coalesce("limit", F.lit(False)))
    described = written(_described(known.withColumn("own", F.lit(None).cast("array<int>"))), "described")
    vocabulary = written(described.where("y = -1").groupBy("word").agg(F.sum("df").alias("df")), "words")

    def with_df(rows: DataFrame) -> DataFrame:
        rows = rows.where("y >= 0").drop("df")
        used = rows.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        table = used.join(vocabulary, "word", "left").select("word", "n", F.coalesce("df", F.lit(0)).alias("df"))
        found = heavy_lookup(rows.where("word <> ''"), table, ["word"], "n", max(1, total))
        return found.select(*rows.columns, "df").unionByName(rows.where("word = ''").withColumn("df", F.lit(None).cast("long")))

    def level(df: int | None) -> str:
        return "-" if df is None else "0" if df == 0 else str(int(np.log10(df / total) * 2)) if df > 2 else "few"

    def indices(feats, cross, df) -> list[int]:
        k = level(df)
        return feats + hashed([f"K={k}"] + [f"K={k}|{c}" for c in cross])

    own = limits.groupBy("source").agg(F.collect_list("size").alias("own"))  # at most a hundred of a source
    some = hash_sample(known.where("size >= 12"), ["row", "text"], sample, total).join(own, "source", "left")
    common = [r["size"] for r in limits.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "size").limit(100).collect()]
    got = with_df(written(_described(some, common), "sample")).orderBy("row", "y", "word", F.xxhash64("feats", "cross")).select("y", "feats", "cross", "df", F.pmod(F.xxhash64("row"), F.lit(2)).alias("half")).toArrow()  # about `sample` x (1 + CUTS) rows
    w, fitted = np.zeros(HASHED), 0.5
    if got.num_rows:
        rows = [np.unique(indices(f, c, d)) for f, c, d in zip(got["feats"].to_pylist(), got["cross"].to_pylist(), got["df"].to_pylist())]
        y = got["y"].to_numpy().astype(float)
        w, fitted = fit_intact(rows, y, got["half"].to_numpy())
    sent = spark.sparkContext.broadcast(w)

    def run(batches):
        w = sent.value
        for b in batches:
            s = [float(w[np.unique(indices(f, c, d))].sum()) for f, c, d in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["row", "score"])

    result = written(with_df(described).select("row", "feats", "cross", "df").mapInArrow(run, "row long, score double"), "scores")
    by = result.groupBy(F.round(F.greatest(F.least("score", F.lit(30.0)), F.lit(-30.0)), 1).alias("s")).agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most 601 rows
    shift = 0.0
    if by.num_rows and 0 < fitted < 1:
        real = real_share(by["s"].to_numpy(), by["n"].to_numpy(), fitted)
        shift = float(np.log(real / (1 - real)) - np.log(fitted / (1 - fitted)))
    score = F.col("score") + F.lit(shift)
    return result.select(F.col("row").alias(key), score.alias("score"), (score > 0).alias("cut"))


def _docs(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def p9_found(spark, sf_dir: str) -> DataFrame:
    """Documents that were cut off."""
    return scored(_docs(spark, sf_dir)).where("cut").select("doc_id").distinct()


def p9_sources(spark, sf_dir: str) -> DataFrame:
    """For each source its documents, how many of them were cut off, and that share. A null source is a row of its own."""
    docs = _docs(spark, sf_dir)
    found = scored(docs).where("cut").select("doc_id").distinct().withColumn("cut", F.lit(1))
    joined = docs.select("doc_id", "source").join(found, "doc_id", "left")
    n = joined.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.coalesce(F.sum("cut"), F.lit(0)).alias("n_cut"))
    return n.withColumn("share", F.col("n_cut") / F.col("n_documents"))
