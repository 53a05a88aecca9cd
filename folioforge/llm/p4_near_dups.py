"""Problem 4: groups of items whose texts share most runs of three words.

Method. Circulant MinHash: one permutation of the hashed shingles' positions, and one of hash values of which the k-th coordinate
reads the copy shifted by k, give all coordinates of a signature; a shingle contributes one contiguous slice of the second
permutation. Bands of coordinates find candidates, 256 one-bit coordinates remove those far from the threshold (5 standard deviations below
it), and the rest are verified exactly on the texts. How many bands of how many coordinates there are follows from the threshold and the
chance to miss a link (`shape`): for 0.5, 80 bands of 4, by which a link at 0.5 is missed with a chance of 0.6 %, at 0.6 of 0.002 %.

Items with the same set of shingles form one class. A class is banded once, however many items it has and tasks meet it: bands are made distinct
after the shuffle that joins them. Links are between classes; only near_pairs expands them into pairs of items.

Bands are joined with themselves by sort-merge join, whose skewed keys adaptive execution splits; no bucket is gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.graph import components
from folioforge.session import written

BITS, PLACES = 256, 1 << 20
MISSED = 0.006  # the chance that the bands miss a link at the threshold


def shape(least: float, missed: float = MISSED) -> tuple[int, int, int]:
    """(bands, rows, bits): how many bands of how many coordinates find similarities from `least` on but for `missed` of those at `least`, and how many of the bits agree at least."""
    if not 0 < least <= 1:
        raise ValueError(f"no similarity between 0 and 1: {least}")
    rows = 16 if least > 0.84 else max(1, round(np.log(1 / 16) / np.log(least)))
    bands = int(np.ceil(np.log(missed) / np.log(1 - least**rows))) if least < 1 else 1
    agree = (1 + least) / 2  # the chance of a bit to agree
    return bands, rows, int(BITS * agree - 5 * np.sqrt(BITS * agree * (1 - agree)))


_odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_is_word = np.zeros(256, bool)
_is_word[48:58] = _is_word[97:123] = True


class Powers:
    """Powers of an odd number and of its inverse, modulo 2^64."""

    base = 0x9E3779B97F4A7C15 | 1
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = 1 << (n - 1).bit_length()
            inverse = pow(cls.base, -1, 1 << 64)
            one = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
            cls.up, cls.down = one(cls.base), one(inverse)
        return cls.up, cls.down


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): 64-bit hashes of all words of the texts in order, and how many each text has.

    Words are runs of a-z and 0-9 of the lower-cased text and single Chinese characters. All texts are split and hashed at once, over their bytes:
    a word's hash is a difference of prefix sums of bytes times powers, shifted to the word's start.
    """
    # The only other characters whose lower case holds one of a-z.
    raw = [(t if t.isascii() else t.replace("\u212a", "k").replace("\u0130", "i\u0307")).encode("utf-8", "replace") if t else b"" for t in texts]
    starts = np.cumsum([0, *(len(r) + 1 for r in raw)])
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    low = _lower[buf]
    word = _is_word[low]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]  # a separator ends the buffer, so every word ends
    up, down = Powers.to(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(np.where(word, low, np.uint8(0)).astype(np.uint64) * up[: len(buf)], out=sums[1:])
    hashes = mixed((sums[end] - sums[begin]) * down[begin])
    lead = np.flatnonzero((buf >= 0xE4) & (buf <= 0xE9))
    if len(lead):
        point = ((buf[lead].astype(np.int64) & 15) << 12) | ((buf[lead + 1].astype(np.int64) & 63) << 6) | (buf[lead + 2] & 63)
        ok = (point >= 0x4E00) & (point <= 0x9FFF)
        begin = np.concatenate([begin, lead[ok]])
        hashes = np.concatenate([hashes, mixed(point[ok].astype(np.uint64) * _odd[1] + _odd[2])])
        order = np.argsort(begin, kind="stable")
        begin, hashes = begin[order], hashes[order]
    return hashes, np.diff(np.searchsorted(begin, starts))


def shingles(text: str | None, width: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words; empty if there are fewer words."""
    return shingle_batch([text], width)[0]


def shingle_batch(texts: list[str | None], width: int = 3) -> list[np.ndarray]:
    """shingles() of each text, with the arithmetic done once for all of them."""
    if not texts:
        return []
    flat, sizes = words_of(texts)
    n = max(0, len(flat) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = (total + flat[k : k + n]) * _odd[k % 3]
    total, ends = mixed(total), np.cumsum(sizes)
    out = []
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        s = total[a : max(a, b - width + 1)]
        s.sort()
        fresh = np.empty(len(s), bool)
        fresh[:1] = True
        np.not_equal(s[1:], s[:-1], out=fresh[1:])
        out.append(s[fresh])
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


class Circulant:
    """Signatures of sets of shingles."""

    def __init__(self, coordinates: int = 320, seed: int = 11):
        pi = np.random.default_rng(seed).permutation(PLACES).astype(np.uint32)
        self.rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:coordinates]]), coordinates)
        self.first = np.uint64(0x2545F4914F6CDD1D)  # the first permutation, of the hashed universe, is a mix of the bits

    def signature(self, s: np.ndarray) -> np.ndarray:
        at = (mixed(s ^ self.first) & np.uint64(PLACES - 1)).astype(np.int64)
        out = self.rows[at[:256]].min(axis=0)
        for k in range(256, len(at), 256):
            np.minimum(out, self.rows[at[k : k + 256]].min(axis=0), out=out)
        return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Of each signature, one 64-bit key for each band, which differs between bands."""
    parts = signatures[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        key = mixed((key ^ parts[:, :, k]) * _odd[k % 3])
    return key.view(np.int64)


def bits(signatures: np.ndarray) -> np.ndarray:
    """Of each signature, one bit of each of 256 coordinates, as four integers."""
    low = mixed(signatures[:, :BITS].astype(np.uint64)) & np.uint64(1)
    return np.packbits(low.astype(np.uint8), axis=1).view(np.int64)


def _class(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sketched(rows: DataFrame, least: float) -> DataFrame:
    """(id, cls, cls2, n, b0..b3, keys) of rows (id, text) that have a shingle; keys, one for each band, only where a task meets a class first."""
    bands, per, _ = shape(least)

    def run(batches):
        make, seen = Circulant(max(BITS, bands * per)), set()
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                sets = shingle_batch(part.column(1).to_pylist())
                at = [k for k, s in enumerate(sets) if len(s)]
                if at:
                    classes = np.array([_class(sets[k]) for k in at], np.int64)
                    signatures = np.stack([make.signature(sets[k]) for k in at])
                    if len(seen) > 1_000_000:  # a class met again is banded again, and made distinct later
                        seen.clear()
                    fresh = []
                    for c in classes[:, 0].tolist():
                        fresh.append(c not in seen)
                        seen.add(c)
                    keys = band_keys(signatures[fresh], bands, per).reshape(-1).astype(np.int32)  # their lower halves; the band's number makes up for the rest
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(bands * f for f in fresh)]), pa.int32()), pa.array(keys), mask=pa.array([not f for f in fresh]))
                    n = np.array([len(sets[k]) for k in at], np.int64)
                    numbers = [classes[:, 0], classes[:, 1], n, *bits(signatures).T]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *(pa.array(np.ascontiguousarray(c)) for c in numbers), lists], names=["id", "cls", "cls2", "n", "b0", "b1", "b2", "b3", "keys"])

    return rows.mapInArrow(run, "id string, cls long, cls2 long, n long, b0 long, b1 long, b2 long, b3 long, keys array<int>")


def class_links(rows: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity): pairs of classes, a < b, whose similarity is at least `least`, verified on the texts. rows: (id, text)."""
    each = sketches.where("keys is not null").select(F.posexplode("keys").alias("band", "key"), "cls")
    bands = each.select((F.col("band") * F.lit(1 << 32) + F.col("key")).alias("key"), "cls").repartition("key").distinct()  # by the partitioning that the join needs
    near = bands.alias("x").join(bands.alias("y"), F.expr("x.key = y.key and x.cls < y.cls")).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
    one = sketches.groupBy("cls").agg(F.min_by(F.struct("id", "n", "b0", "b1", "b2", "b3"), "id").alias("s"))
    x, y = one.select(F.col("cls").alias("a"), F.col("s").alias("x")), one.select(F.col("cls").alias("b"), F.col("s").alias("y"))
    agree = sum((F.bit_count(F.expr(f"~(x.b{k} ^ y.b{k})")) for k in range(4)), F.lit(0))
    likely = near.join(x, "a").join(y, "b").where(F.expr(f"least(x.n, y.n) >= {least} * greatest(x.n, y.n)")).where(agree >= shape(least)[2])
    likely = written(likely.select("a", "b", F.col("x.id").alias("ida"), F.col("y.id").alias("idb")), "likely")

    def run(batches):
        for b in batches:
            out = []
            for i in range(0, b.num_rows, 250):
                part = b.slice(i, 250)
                texts = [t for k in (2, 3) for ts in part.column(k).to_pylist() for t in ts]
                of = {t: s for t, s in zip(texts, shingle_batch(texts))}
                for ca, cb, ta, tb in zip(*(c.to_pylist() for c in part.columns)):
                    sa, sb = (next(of[t] for t in ts if len(of[t]) and (len(ts) == 1 or _class(of[t])[0] == c)) for ts, c in ((ta, ca), (tb, cb)))
                    if (v := similarity(sa, sb)) >= least:
                        out.append((ca, cb, v))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["a", "b", "similarity"])

    wanted = likely.select(F.explode(F.array("ida", "idb")).alias("id")).distinct()
    some = rows.join(wanted, "id", "left_semi")
    # one text an id, unless rows of one id differ
    texts = some.groupBy("id").agg(F.collect_set("text").alias("texts"))
    both = likely.join(texts.select(F.col("id").alias("ida"), F.col("texts").alias("ta")), "ida").join(texts.select(F.col("id").alias("idb"), F.col("texts").alias("tb")), "idb")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, similarity double")


def named(items: DataFrame, key: str, text: str) -> DataFrame:
    return items.select(items[key].cast("string").alias("id"), items[text].cast("string").alias("text")).where("id is not null and text is not null")


def near_classes(items: DataFrame, key: str = "item_id", text: str = "text", least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, cls), the class of each id by its set of shingles; links (a, b, similarity) between different classes, a < b.

    Copies aren't expanded into pairs, so both tables grow with the items and with the links between different texts alone.
    """
    rows = named(items, key, text)
    sketches = written(sketched(rows, least), "sketches")
    return sketches.select("id", "cls").distinct(), written(class_links(rows, sketches, least), "links")


def near_pairs(items: DataFrame, key: str = "item_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(item_a, item_b), item_a < item_b: all pairs of different ids with similarity of at least `least`.

    Null ids and texts, and texts of fewer than three words, have no pair. Repeated rows count once; if rows of one id differ, each text counts.
   
    """
    rows = named(items, key, text)
    sketches = written(sketched(rows, least), "sketches")
    links = written(class_links(rows, sketches, least), "links")
    members = sketches.select("id", "cls", "cls2").distinct()
    x, y = members.select(F.col("id").alias("i"), F.col("cls").alias("a"), F.col("cls2").alias("a2")), members.select(F.col("id").alias("j"), F.col("cls").alias("b"), F.col("cls2").alias("b2"))
    copies = x.join(y, F.expr("a = b and a2 = b2 and i < j")).select("i", "j")
    others = links.join(x, "a").join(y, "b").where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return copies.unionByName(others).distinct().select(F.col("i").alias("item_a"), F.col("j").alias("item_b"))


def near_groups(items: DataFrame, key: str = "item_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(item_id, group, links): each item's group - the smallest item of those it is linked with, directly or through others - and how many other classes
    it is linked with. Items without text or of fewer than three words are groups of their own. Null ids are left out.
    """
    rows = named(items, key, text)
    sketches = written(sketched(rows, least), "sketches")
    links = written(class_links(rows, sketches, least), "links")
    n = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    joined = sketches.select("id", "cls").distinct().join(components(links).withColumnRenamed("node", "cls"), "cls", "left").join(n, "cls", "left")
    joined = joined.select("id", F.coalesce("component", "cls").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    names = joined.groupBy("component").agg(F.min("id").alias("group"))
    best = joined.join(names, "component").groupBy("id").agg(F.min("group").alias("group"), F.max("links").alias("links"))
    ids = items.select(items[key].cast("string").alias("id")).where("id is not null").distinct()
    return ids.join(best, "id", "left").select(F.col("id").alias(key), F.coalesce("group", "id").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))


def p4_found(spark, sf_dir: str) -> DataFrame:
    """Pairs of items with similarity of at least 0.5."""
    return near_pairs(spark.read.parquet(f"{sf_dir}/items.parquet"))


def p4_groups(spark, sf_dir: str) -> DataFrame:
    """The group of each item."""
    return near_groups(spark.read.parquet(f"{sf_dir}/items.parquet"))


_SHINGLES = """w AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[a-z0-9]+|[\\x{4e00}-\\x{9fff}]') AS w FROM items WHERE item_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS s FROM w WHERE len(w) >= 3),
n AS (SELECT item_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS both FROM s a JOIN s b USING (s) WHERE a.item_id < b.item_id GROUP BY 1, 2),
p AS (SELECT c.a, c.b, c.both = x.n AND c.both = y.n AS same FROM c JOIN n x ON x.item_id = c.a JOIN n y ON y.item_id = c.b WHERE c.both >= 0.5 * (x.n + y.n - c.both))"""

SQL = {
    "p4_found": f"WITH {_SHINGLES} SELECT a AS item_a, b AS item_b FROM p",
    "p4_groups": f"""WITH RECURSIVE {_SHINGLES},
e AS (SELECT a AS u, b AS v, same FROM p UNION ALL SELECT b, a, same FROM p),
r AS (SELECT DISTINCT item_id AS u, item_id AS m FROM items WHERE item_id IS NOT NULL UNION SELECT e.v, r.m FROM r JOIN e ON e.u = r.u WHERE r.m < e.v),
g AS (SELECT u AS item_id, min(m) AS "group" FROM r GROUP BY 1),
k AS (SELECT x.u AS item_id, min(y) AS cls FROM (SELECT item_id AS u, item_id AS y FROM n UNION ALL SELECT u, v FROM e WHERE same) x GROUP BY 1),
l AS (SELECT e.u AS item_id, count(DISTINCT k.cls) AS links FROM e JOIN k ON k.item_id = e.v WHERE NOT e.same GROUP BY 1)
SELECT g.item_id, g."group", coalesce(l.links, 0) AS links FROM g LEFT JOIN l USING (item_id)""",
}
