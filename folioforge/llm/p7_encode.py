"""Problem 7: the corpus encoded with a public tokenizer, by reuse of content-defined chunks.

Method. Over the UTF-8 bytes of a batch a rolling hash of the last 16 bytes marks chunk ends by content (vectorised),
so that a passage shared by several documents falls into the same chunks wherever it stands. A chunk is encoded by itself, once
in a worker for all documents that share it as long as the memo, bounded in bytes, holds it; the chunks that went longest unasked go first. A chunk end
may lie within a token; so the join of two chunks is repaired: the text from a place before it to a place after it is re-encoded, both
chosen where the encoding is certain to agree with that of the whole text - white space after a printable ASCII character, where no piece of the
tokenizer's splitter can span - and is widened to the next such places, over whole chunks if need be, until tokens of the chunks on both sides
end and begin there too. So both sides agree exactly, and the result is that of encoding the whole text.

There is no shuffle; README has the measured costs of sharing chunks across workers.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioforge.llm.vocab import TOKENIZERS, Encoder, read_ranks

WINDOW, MEMO_BYTES = 16, 48 << 20


def _gear() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_ends(buf: np.ndarray, bits: int = 8) -> np.ndarray:
    """Positions after which a chunk ends: where the hash of the last 16 bytes has `bits` zero bits (chunks of 2^bits bytes on average), between characters."""
    h, w = _gear()[buf], 1
    while w < WINDOW:
        g = h.copy()
        g[w:] += h[:-w] << np.uint32(w)
        h, w = g, 2 * w
    at = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    at = at[at < len(buf)]
    while len(at) and (inside := (buf[at] & 0xC0) == 0x80).any():
        at = at + inside
        at = at[at < len(buf)]
    return np.unique(at)


def certain(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places where no token can span: before white space after a printable ASCII character, and the documents' ends."""
    return np.union1d(np.flatnonzero(((buf[1:] == 32) | (buf[1:] == 10)) & (buf[:-1] > 32) & (buf[:-1] < 127)) + 1, np.concatenate([starts, ends]))


class ChunkEncoder:
    """Ids of batches of texts. `encoded` counts the chunks that weren't in the memo, `chunks` all."""

    def __init__(self, ranks: dict[bytes, int], bits: int = 8, most: int = MEMO_BYTES):
        self.encoder, self.bits, self.most = Encoder(ranks), bits, most
        self.sizes = [0] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = self.encoded = self.chunks = 0

    def of(self, chunk: bytes) -> bytes:
        """The chunk's ids by itself."""
        self.chunks += 1
        ids = self.memo.get(chunk)
        if ids is None:
            ids = self.older.pop(chunk, None)
            if ids is None:
                ids = self.encoder.bytes_of(chunk.decode())
                self.encoded += 1
            if 2 * self.held > self.most:
                self.older, self.memo, self.held = self.memo, {}, 0
            self.memo[chunk] = ids
            self.held += len(chunk) + len(ids) + 150
        return ids

    def batch(self, texts: pa.Array) -> pa.ListArray:
        """One list of ids for each text, empty for null and empty texts."""
        texts = texts.cast(pa.large_string()).fill_null("")
        data = texts.buffers()[2]
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        if not data or offsets[-1] == offsets[0]:
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.int32()))
        whole = memoryview(data)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        buf, raw = np.frombuffer(whole, np.uint8), bytes(whole)
        sure = certain(buf, offsets[:-1], offsets[1:])
        bounds = np.union1d(chunk_ends(buf, self.bits), offsets)  # chunks, none over two documents
        edges, places, docs = bounds.tolist(), sure.tolist(), offsets.tolist()
        low = np.searchsorted(sure, bounds[:-1], "left").tolist()  # a chunk's first certain place
        high = (np.searchsorted(sure, bounds[1:], "right") - 1).tolist()  # and its last
        out, at, size = [], 0, 0  # all before `at` is encoded, in `size` ids
        pieces, counts, sizes = [0], [0], self.sizes
        for k in range(len(edges) - 1):
            first, last = low[k], high[k]
            if first >= last:
                continue  # no two certain places within: left to the repair of joins
            begin, ids = edges[k], self.of(raw[edges[k] : edges[k + 1]])
            token = memoryview(ids).cast("i")
            i, pos, j, end = 0, begin, len(token), edges[k + 1]
            while pos != places[first] or end != places[last]:  # until tokens begin and end at the places, which are moved in where they don't
                if pos < places[first]:
                    pos += sizes[token[i]]
                    i += 1
                elif pos > places[first]:
                    first += 1
                elif end > places[last]:
                    j -= 1
                    end -= sizes[token[j]]
                else:
                    last -= 1
                if first >= last:
                    break
            if first >= last:
                continue
            if at < places[first]:
                size += self.repaired(raw, at, places[first], docs, out, pieces, counts, size)
            out.append(ids[4 * i : 4 * j])
            size += j - i
            at = places[last]
            pieces.append(at)
            counts.append(size)
        if at < edges[-1]:
            size += self.repaired(raw, at, edges[-1], docs, out, pieces, counts, size)
        first = np.array(counts)[np.searchsorted(np.array(pieces), offsets)]
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(np.frombuffer(b"".join(out), np.int32), pa.int32()))

    def repaired(self, raw: bytes, a: int, b: int, offsets: list[int], out: list, pieces: list, counts: list, size: int) -> int:
        """Re-encodes a..b, document by document, onto `out`; how many ids that gives."""
        lo, hi = bisect_right(offsets, a), bisect_left(offsets, b)
        n = 0
        for x, y in pairwise([a, *offsets[lo:hi], b]) if lo < hi else ((a, b),):
            ids = self.encoder.bytes_of(raw[x:y].decode())
            out.append(ids)
            n += len(ids) // 4
            pieces.append(y)
            counts.append(size + n)
        return n


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", bits: int = 8) -> DataFrame:
    """(key, ids): the ids of every row's text, without special tokens.

    Strings that look like special tokens are ordinary text. Null and empty texts give an empty list; a null key and
    repeated rows are kept as they are; other columns, whatever their names, are not read. An empty table gives none.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        enc = ChunkEncoder(ranks.value, bits)
        for b in batches:
            for i in range(0, b.num_rows, 1000):  # bounds what a batch of ids takes
                part = b.slice(i, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), enc.batch(part.column(1))], names=["key", "ids"])

    return docs.select(docs[key], docs[text].cast("string")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def p7_ids(spark, sf_dir: str) -> DataFrame:
    """doc_id and ids of every row of documents by byte_bpe_50k."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
