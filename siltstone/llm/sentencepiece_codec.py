"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback.

Pieces and scores are read from a SentencePiece model file.  A unigram file's scores are log-probabilities and used as
they are.  A BPE file has merge ranks instead; its r-th piece gets the log-probability of a Zipf law, log(1 / (r * H)),
so that the same vocabulary can be decoded by likelihood.

No piece has the white-space marker after another character, so the best path of a text is the best paths of its units
(markers and what follows) in a row, and units are remembered.  A character that is in no longer piece is a unit alone.
"""

from __future__ import annotations

import math
import re
import struct
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import docs_of, process_cache, table

MARK = chr(0x2581)
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)

#: Units remembered by a worker at most, and characters of a remembered unit at most.
CACHE = 300_000
LONG = 64


def _fields(data: bytes):
    """(field number, value) of a protocol-buffer message: ints, floats as 4 raw bytes, bytes."""
    i = 0

    def number():
        nonlocal i
        shift = value = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, data[i : i + n]
            i += n


def double_array(words: list[tuple[bytes, int]]) -> tuple[array, array, array]:
    """base, check and value of a double-array trie; a node's child by byte c is base[node] + c + 1 if check there is the node."""
    tree: list[dict] = [{}]
    value_of = [-1]
    for word, value in words:
        node = 0
        for c in word:
            if c not in tree[node]:
                tree[node][c] = len(tree)
                tree.append({})
                value_of.append(-1)
            node = tree[node][c]
        value_of[node] = value
    size = 2 * len(tree) + 1024
    used = bytearray(size)
    used[0] = 1
    base, check, value = (array("i", [fill]) * size for fill in (0, -1, -1))
    place, start = {0: 0}, 1
    queue = [0]
    for node in queue:
        kids = sorted(tree[node])
        if not kids:
            continue
        start = used.find(0, start)
        at = start
        while True:
            at = used.find(0, at)
            b = at - kids[0] - 1
            if b >= 0 and b + 257 < size and not any(used[b + c + 1] for c in kids):
                break
            at += 1
            if at + 300 > size:
                used.extend(bytes(size))
                for a, fill in ((base, 0), (check, -1), (value, -1)):
                    a.extend([fill] * size)
                size *= 2
        here = place[node]
        base[here] = b
        for c in kids:
            to = b + c + 1
            used[to] = 1
            check[to] = here
            kid = tree[node][c]
            value[to] = value_of[kid]
            place[kid] = to
            queue.append(kid)
    return base, check, value


class Codec:
    """A vocabulary with its trie.  ``Codec.read(bytes of a model file)``; fixed size, so it can be broadcast."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], dummy_prefix: bool):
        self.pieces, self.scores, self.kinds, self.dummy_prefix = pieces, scores, kinds, dummy_prefix
        words = [(p.encode(), i) for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k in (NORMAL, USER)]
        self.base, self.check, self.value = double_array(words)
        self.unknown = kinds.index(UNKNOWN) if UNKNOWN in kinds else 0
        self.unknown_score = min((scores[i] for _, i in words), default=0.0) - 10.0
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == BYTE}
        longer = [pieces[i] for _, i in words if len(pieces[i]) > 1]
        self.by_units = all(MARK not in p.lstrip(MARK) for p in longer)
        self.inner = "".join(sorted({c for p in longer for c in p} - {MARK}))
        self.surface = [
            p.replace(MARK, " ").encode() if k in (NORMAL, USER, UNUSED) else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b""
            for p, k in zip(pieces, kinds, strict=True)
        ]

    @classmethod
    def read(cls, data: bytes) -> Codec:
        pieces, scores, kinds, dummy, model_type = [], [], [], True, 1
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    piece, score, kind = (v.decode(), score, kind) if n == 1 else (piece, struct.unpack("<f", v)[0], kind) if n == 2 else (piece, score, v) if n == 3 else (piece, score, kind)
                pieces.append(piece)
                scores.append(score)
                kinds.append(kind)
            elif number == 2:
                model_type = next((v for n, v in _fields(value) if n == 3), 1)
            elif number == 3:
                spec = dict(_fields(value))
                dummy = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only models with the identity normaliser that keep white space are supported")
        if model_type != 1:
            ranked = sorted((i for i, k in enumerate(kinds) if k == NORMAL), key=lambda i: -scores[i])
            total = math.log(sum(1 / r for r in range(1, len(ranked) + 1)))
            for r, i in enumerate(ranked, 1):
                scores[i] = -math.log(r) - total
        return cls(pieces, scores, kinds, dummy)

    def ready(self) -> None:
        """What a worker needs besides: the splitting pattern, plain lists, the units it remembers."""
        self.split = re.compile(f"{MARK}*[{re.escape(self.inner)}]+|{MARK}+|[^{MARK}]", re.S).findall if self.by_units and self.inner else lambda text: [text]
        self.tables = (list(self.base), list(self.check), list(self.value))
        self.known: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best path; of equal ones that whose last step starts first."""
        b = text.encode()
        n = len(b)
        base, check, value = self.tables
        size, scores, unknown = len(base), self.scores, self.unknown_score
        best, step = [-math.inf] * (n + 1), [(0, 0)] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            c = b[i]
            width = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            score, node, alone = best[i], 0, False
            for j in range(i, n):
                to = base[node] + b[j] + 1
                if to >= size or check[to] != node:
                    break
                node = to
                v = value[to]
                if v >= 0:
                    s = score + scores[v]
                    if s > best[j + 1]:
                        best[j + 1], step[j + 1] = s, (i, v)
                    if j + 1 - i == width:
                        alone = True
            if not alone and score + unknown > best[i + width]:
                best[i + width], step[i + width] = score + unknown, (i, -1)
            i += width
        ids: list[int] = []
        while n:
            i, v = step[n]
            if v >= 0:
                ids.append(v)
            elif all(x in self.bytes for x in b[i:n]):
                ids.extend(self.bytes[x] for x in reversed(b[i:n]))
            else:
                ids.append(self.unknown)
            n = i
        ids.reverse()
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian signed 32-bit integers; none for the empty text."""
        if not text:
            return b""
        units = self.split((MARK if self.dummy_prefix else "") + text.replace(" ", MARK))
        known = self.known
        try:
            return b"".join(map(known.__getitem__, units))
        except KeyError:
            out = []
            for u in units:
                x = known.get(u)
                if x is None:
                    x = array("i", self.viterbi(u)).tobytes()
                    if len(u) <= LONG:
                        if len(known) >= CACHE:
                            known.clear()
                        known[u] = x
                out.append(x)
            return b"".join(out)

    def decode(self, ids) -> str:
        text = b"".join(map(self.surface.__getitem__, ids))
        if self.dummy_prefix and text[:1] == b" ":
            text = text[1:]
        return text.decode("utf-8", "replace")


def _worker_codec(sent, key: int) -> Codec:
    cache = process_cache("pieces")
    if cache.get("key") != key:
        codec = sent.value
        codec.ready()
        cache["key"], cache["codec"] = key, codec
    return cache["codec"]


def _sent(df: DataFrame, model: bytes):
    return df.sparkSession.sparkContext.broadcast(Codec.read(model)), hash(model)  # a vocabulary: fixed size


def encode_documents(documents: DataFrame, model: bytes) -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text.  Null and empty texts have no ids."""
    sent, key = _sent(documents, model)

    def run(it):
        import numpy as np
        import pyarrow as pa

        encode = _worker_codec(sent, key).encode
        for batch in it:
            found = [encode(x.as_py()) for x in batch.column("text")]
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(found), np.int32)))], names=["doc_id", "ids"])

    docs = docs_of(documents)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids).  Null ids give the empty text; invalid UTF-8 from byte pieces gives
    replacement characters; an unknown piece gives U+2047 between spaces."""
    sent, key = _sent(encoded, model)

    def run(it):
        import pyarrow as pa

        decode = _worker_codec(sent, key).decode
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([decode(x.as_py() or ()) for x in batch.column("ids")], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(documents: DataFrame, model: bytes) -> DataFrame:
    """Encode and decode every row's whole text in one pass: doc_id, n_ids, n_fallback (byte pieces), ids_crc32, exact
    (whether decoding gives the text back, the marker itself read as a space) and ids."""
    sent, key = _sent(documents, model)

    def run(it):
        import zlib

        import numpy as np
        import pyarrow as pa

        codec = _worker_codec(sent, key)
        is_byte = np.array([k == BYTE for k in codec.kinds])
        for batch in it:
            found, fallback, crc, exact = [], [], [], []
            for x in batch.column("text"):
                text = x.as_py()
                raw = codec.encode(text)
                ids = np.frombuffer(raw, np.int32)
                found.append(ids)
                fallback.append(int(is_byte[ids].sum()))
                crc.append(zlib.crc32(raw))
                exact.append(codec.decode(ids.tolist()) == text.replace(MARK, " "))
            sizes = np.array([len(x) for x in found], np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(fallback, pa.int64()), pa.array(crc, pa.int64()), pa.array(exact), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))],
                names=["doc_id", "n_ids", "n_fallback", "ids_crc32", "exact", "ids"],
            )

    docs = docs_of(documents)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_ids long, n_fallback long, ids_crc32 long, exact boolean, ids array<int>")


def default_model() -> bytes:
    """The installed public vocabulary with byte fallback."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def query(spark, sf_dir: str, model: bytes | None = None) -> DataFrame:
    """op3: whole ``documents`` to ids and back."""
    return round_trip(table(spark, sf_dir, "documents"), model or default_model()).select("doc_id", "n_ids", "n_fallback", "ids_crc32", "exact")
