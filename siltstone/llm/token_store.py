"""Token ids of a corpus in wavelet-matrix shards: compact, with access, counting and occurrence lookup in place.

A shard file holds the ids of some documents in a row.  Bit-plane b (from the highest bit) has bit b of every id, in the
order that stably sorting by the planes before it gives: all ids with a 0 there, then all with a 1.  Counts of ones before
every 512th bit give rank in constant time and select by binary search, and through the planes access(i), rank(id, i),
select(id, k) and count(id) in one step a bit, without decoding anything else.
"""

from __future__ import annotations

import re
import struct
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import docs_of, process_cache, table, written

#: Unicode White_Space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Latin letters and digits, and punctuation that is part of no contraction or special token.
PLAIN = "A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
STOPS = ".,;:!?%&#@()$*+=/~-"
#: Chunks that byte-level BPE never merges with their neighbours: white space with a run of plain characters before
#: punctuation or space, such punctuation before plain characters or space, else all up to the next white space.
CHUNK = re.compile(f"[{SPACE}]*[{PLAIN}]+(?=[{SPACE}{STOPS}]|\\Z)|[{SPACE}]*[{STOPS}]+(?=[{PLAIN}{SPACE}]|\\Z)|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+", re.S)

#: Chunks that are one word for the merges: the pre-tokeniser would not cut them.
WORD = re.compile("[ ]?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+|[" + STOPS + "]+)").fullmatch

MAGIC = b"WMTX1\0\0\0"
BLOCK = 512

#: Ids a shard has at least, unless its partition ends; entries of the cache of encoded chunks at most.
SHARD_TOKENS = 1 << 20
CACHE = 1_200_000
#: Characters of a remembered chunk at most.
LONG = 64


class WaveletMatrix:
    """Bit-planes over unsigned ids below 2**bits; ``planes`` are packed little-endian, ``ranks`` ones before each block."""

    def __init__(self, n: int, bits: int, planes: list, ranks: list):
        self.n, self.bits, self.planes, self.ranks = n, bits, planes, ranks
        self.zeros = [n - int(r[-1]) for r in ranks]

    @classmethod
    def build(cls, ids) -> WaveletMatrix:
        import numpy as np

        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        kind = np.uint16 if bits <= 16 else np.uint32
        now = ids.astype(kind)
        planes, ranks = [], []
        for b in range(bits - 1, -1, -1):
            bit = (now & kind(1 << b)) != 0
            plane = np.packbits(bit, bitorder="little")
            planes.append(plane)
            ranks.append(cls._ranks(plane))
            now = np.concatenate([now[~bit], now[bit]])
        return cls(len(ids), bits, planes, ranks)

    @staticmethod
    def _ranks(plane):
        import numpy as np

        ones = np.bitwise_count(np.pad(plane, (0, -len(plane) % (BLOCK // 8))).reshape(-1, BLOCK // 8)).sum(1, dtype=np.uint32)
        return np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])

    def _bit(self, p: int, i: int) -> int:
        return int(self.planes[p][i >> 3]) >> (i & 7) & 1

    def _rank1(self, p: int, i: int) -> int:
        """Ones among the first i bits of plane p."""
        import numpy as np

        block, at = i // BLOCK, i // BLOCK * (BLOCK // 8)
        count = int(self.ranks[p][block]) + int(np.bitwise_count(self.planes[p][at : i >> 3]).sum())
        return count + ((int(self.planes[p][i >> 3]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def _select(self, p: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of plane p: its block by binary search, then within it."""
        import numpy as np

        lo, hi = 0, len(self.ranks[p]) - 1
        before = lambda x: int(self.ranks[p][x]) if bit else x * BLOCK - int(self.ranks[p][x])
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if before(mid) <= k else (lo, mid)
        own = np.unpackbits(self.planes[p][lo * (BLOCK // 8) : (lo + 1) * (BLOCK // 8)], bitorder="little")
        return lo * BLOCK + int(np.flatnonzero(own == bit)[k - before(lo)])

    def access(self, i: int) -> int:
        value = 0
        for p in range(self.bits):
            bit = self._bit(p, i)
            ones = self._rank1(p, i)
            i = self.zeros[p] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        if token >> self.bits:
            return 0, 0
        for p in range(self.bits):
            a, b = self._rank1(p, lo), self._rank1(p, hi)
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if token >> (self.bits - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, end: int) -> int:
        """How often the token is among the first ``end`` ids."""
        lo, hi = self._range(token, end)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0); IndexError if there are fewer."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            i = self._select(p, bit, i - self.zeros[p] if bit else i)
        return i

    def decode(self):
        """All ids at once: from the last plane back to the first."""
        import numpy as np

        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for p in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[p], count=self.n, bitorder="little").view(bool)
            out = np.empty(self.n, kind)
            z = self.zeros[p]
            out[~bit] = now[:z]
            out[bit] = now[z:] | kind(1 << (self.bits - 1 - p))
            now = out
        return now


def shard_bytes(doc_ids, sizes, ids) -> bytes:
    """The file of one shard: magic, counts, compressed document table, compressed planes with their ranks."""
    import numpy as np
    import pyarrow as pa

    tree = WaveletMatrix.build(ids)
    parts = [doc_ids.astype("<i8").tobytes(), sizes.astype("<i8").tobytes()]
    parts += [np.ascontiguousarray(x).tobytes() for pair in zip(tree.planes, tree.ranks, strict=True) for x in pair]
    packed = [pa.compress(x, codec="zstd", asbytes=True) if x else b"" for x in parts]
    head = MAGIC + struct.pack("<qqqq", len(doc_ids), tree.n, tree.bits, len(parts))
    return head + struct.pack(f"<{2 * len(parts)}q", *(v for a, b in zip(parts, packed, strict=True) for v in (len(a), len(b)))) + b"".join(packed)


def open_shard(data: bytes) -> tuple:
    """(doc_ids, sizes, WaveletMatrix) of a shard file."""
    import numpy as np
    import pyarrow as pa

    if data[:8] != MAGIC:
        raise ValueError("not a shard file")
    _, n, bits, parts = struct.unpack_from("<qqqq", data, 8)
    lengths = struct.unpack_from(f"<{2 * parts}q", data, 40)
    at, out = 40 + 16 * parts, []
    for raw, packed in zip(lengths[::2], lengths[1::2], strict=True):
        out.append(pa.decompress(data[at : at + packed], raw, codec="zstd", asbytes=True) if raw else b"")
        at += packed
    planes = [np.frombuffer(x, np.uint8) for x in out[2::2]]
    ranks = [np.frombuffer(x, np.uint32) for x in out[3::2]]
    return np.frombuffer(out[0], "<i8"), np.frombuffer(out[1], "<i8"), WaveletMatrix(n, bits, planes, ranks)


class _Known(dict):
    """Ids of chunks, encoded when they are first asked for and remembered.  It starts anew when it is full, and long chunks,
    which are rare, aren't remembered, so that it stays bounded in entries and bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        if len(chunk) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = ids
        return ids


class ChunkEncoder:
    """Whole texts to ids.  Chunks are encoded by the tokenizers library once and remembered."""

    def __init__(self, tokenizer_json: str):
        import gc
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.cache = process_cache(f"bpe-{hash(tokenizer_json)}")
        if "tokenizer" not in self.cache:
            from tokenizers import Tokenizer

            self.cache["tokenizer"] = Tokenizer.from_str(tokenizer_json)
            self.cache["known"] = _Known(None)
            gc.freeze()  # the collector would walk through all that is remembered, which has no cycles
        self.tokenizer, self.known = self.cache["tokenizer"], self.cache["known"]
        self.known.encode = self._encode
        self.merge = self.tokenizer.model.tokenize
        # Byte-level BPE shows bytes as characters: printable ones of Latin-1 as they are, the others from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.space = chr(self.shown[32])

    def _encode(self, chunk: str) -> bytes:
        """Words go straight to the library's merges, other chunks through its pre-tokeniser."""
        bare = chunk[1:] if chunk[0] == " " else chunk
        if bare.isascii() and (bare.isalpha() or bare.isdigit()):  # most words: their bytes are shown as they are
            return array("I", [t.id for t in self.merge(bare if bare is chunk else self.space + bare)]).tobytes()
        if WORD(chunk):
            return array("I", [t.id for t in self.merge(chunk.encode().decode("latin-1").translate(self.shown))]).tobytes()
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, CHUNK.findall(text)))


def write_tokens(documents: DataFrame, tokenizer_json: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode all documents in ascending doc_id order and write shards to the shared folder; the written table has
    part (range of doc_ids), seq (shard within it), first_doc, n_docs, n_tokens and file (the shard's bytes).

    A null or empty text has the end id alone.  Rows without a doc_id are left out; rows that repeat one are all written,
    in the order of their texts.  Memory: one shard, or one document that is longer.
    """
    docs = docs_of(documents).filter("doc_id is not null").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    sent = documents.sparkSession.sparkContext.broadcast(tokenizer_json)  # the vocabulary file: fixed size

    def run(it):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode, end = ChunkEncoder(sent.value), struct.pack("<I", end_id)
        part, seq, ids, sizes, parts, total = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush():
            data = shard_bytes(np.array(ids, np.int64), np.array(sizes, np.int64), np.frombuffer(b"".join(parts), "<u4"))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((part, seq, ids[0], len(ids), total, data), kinds, strict=True)], names=["part", "seq", "first_doc", "n_docs", "n_tokens", "file"])

        for batch in it:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                x = encode(text.as_py()) + end
                ids.append(doc)
                sizes.append(len(x) // 4)
                parts.append(x)
                total += len(x) // 4
                if total >= shard_tokens:
                    yield flush()
                    seq, ids, sizes, parts, total = seq + 1, [], [], [], 0
        if ids:
            yield flush()

    return written(docs.mapInArrow(run, "part int, seq int, first_doc long, n_docs long, n_tokens long, file binary"), "tokens")


def read_tokens(shards: DataFrame) -> DataFrame:
    """Read shard files back: doc_id, start (ids of all documents before), n_tokens and ids_crc32 for every document."""

    def run(it):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in it:
            for part, seq, file in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("file"), strict=True):
                docs, sizes, tree = open_shard(file.as_buffer().to_pybytes())
                ids = tree.decode().astype("<u4")
                at = np.concatenate([[0], np.cumsum(sizes)])
                crc = [zlib.crc32(ids[at[i] : at[i + 1]]) for i in range(len(docs))]
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(at[:-1]), pa.array(sizes), pa.array(crc, pa.int64())],
                    names=["doc_id", "part", "seq", "at", "n_tokens", "ids_crc32"],
                )

    docs = shards.select("part", "seq", "file").mapInArrow(run, "doc_id long, part int, seq int, at long, n_tokens long, ids_crc32 long")
    # Ids before a shard: those of earlier parts (one row for each partition of the writer) and of earlier shards in its part.
    from pyspark.sql import Window

    w = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    within = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).alias("within"))
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    base, rows = 0, []
    for r in totals:
        rows.append((r["part"], base))
        base += r["n"]
    parts = shards.sparkSession.createDataFrame(rows, "part int, base long")
    before = within.join(F.broadcast(parts), "part").select("part", "seq", (F.col("base") + F.col("within")).alias("before"))
    return docs.join(before, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """op10: whole ``documents`` through shard files and back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    with open(tokenizer, encoding="utf-8") as f:
        return read_tokens(write_tokens(table(spark, sf_dir, "documents"), f.read(), end_id))
