"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over a text's bytes cuts it into chunks, so an insertion moves only the cuts near it. Chunks that
occur more than once in the whole table are encoded a single time, in the text of their first occurrence. A text's
ids are the ids of its shared chunks and of the stretches between them, put together; each join is then repaired:
a window around it, up to places where the pre-tokenizer always starts anew, is encoded again, and grows until its
ends agree with token boundaries on both sides. A place where white space follows a visible ASCII character is such
a start: no pre-token but white space goes past it, and the pattern never looks back. So the result equals the
encoding of the whole text.

Defined results: a null text counts as empty (no ids, decoded ""); repeated rows and rows of one id with different
texts are each encoded; a null id is kept; an empty table gives an empty one. Columns of the input are kept, but for
those whose names the results take.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import marks_of, materialize, small_batches

#: Mean bytes of a chunk (a power of two) and the least bytes between two cuts.
CHUNK_BYTES = 1024
LEAST_BYTES = 128
#: GPT-2's pattern of pre-tokens and its special string: fixed values of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = {"<|endoftext|>": 50256}
_GEAR = np.random.RandomState(7).randint(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:127] = True


class Codec:
    """A byte-level BPE vocabulary (a file of base64 tokens and ranks)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self.bytes_of = [b""] * (1 + max([*ranks.values(), *SPECIAL.values()]))
        for token, rank in [*ranks.items(), *((s.encode(), i) for s, i in SPECIAL.items())]:
            self.bytes_of[rank] = token
        self.n_bytes = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))

    def encode(self, data: bytes) -> np.ndarray:
        return np.array(self.bpe.encode(data.decode("utf-8"), allowed_special="all"), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def cuts(data: bytes, mean: int = CHUNK_BYTES) -> list[int]:
    """Ends of the chunks of ``data``; cuts never split a character."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < 2 * LEAST_BYTES:
        return [len(b)] if len(b) else []
    h, span = _GEAR[b], 1
    while span < 32:  # the sum over a window of 32 bytes, by doubling
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    found = np.flatnonzero(((h >> np.uint32(8)) & np.uint32(mean - 1)) == 0) + 1
    out, last = [], 0
    for p in found.tolist():
        if p - last >= LEAST_BYTES and len(b) - p >= LEAST_BYTES:
            while p < len(b) and b[p] & 0xC0 == 0x80:
                p += 1
            out.append(last := p)
    return [*out, len(b)]


def restarts(data: bytes) -> np.ndarray:
    """Offsets where the pre-tokenizer starts anew whatever stands on either side; the text's ends are among them."""
    b = np.frombuffer(data, np.uint8)
    inner = np.flatnonzero(_SPACE[b[1:]] & _VISIBLE[b[:-1]]) + 1
    return np.concatenate([[0], inner, [len(b)]])


def assemble(data: bytes, known: dict[int, np.ndarray], bpe: Codec, mean: int = CHUNK_BYTES) -> np.ndarray:
    """Ids of ``data``, of whose chunks ``known`` has the ids of some by position."""
    if not data:
        return np.empty(0, np.uint32)
    ends = cuts(data, mean)
    pieces: list[tuple[int, int, np.ndarray]] = []  # from, to, ids
    k = 0
    while k < len(ends):
        start, first = (ends[k - 1] if k else 0), k
        if k in known:
            pieces.append((start, ends[k], known[k]))
        else:
            while k + 1 < len(ends) and k + 1 not in known:
                k += 1
            pieces.append((start, ends[k], bpe.encode(data[start : ends[k]])))
        k = max(k, first) + 1
    if len(pieces) == 1:
        return pieces[0][2]
    ids = np.concatenate([p[2] for p in pieces])
    at = np.concatenate([[0], np.cumsum(bpe.n_bytes[ids])])  # byte offset of each token boundary
    safe = restarts(data)
    out, done = [], 0  # ids before the boundary ``done`` are out
    joins = [p[1] for p in pieces[:-1]]
    k = 0
    while k < len(joins):
        i = int(np.searchsorted(safe, joins[k], "right")) - 1
        if safe[i] == joins[k]:
            k += 1
            continue
        j, last = i + 1, k
        while True:
            while last + 1 < len(joins) and joins[last + 1] < safe[j]:
                last += 1
            left, right = int(np.searchsorted(at, safe[i])), int(np.searchsorted(at, safe[j]))
            grown = False
            if at[left] != safe[i] or left < done:  # no token boundary of the left side
                i, grown = i - 1, True
            if at[right] != safe[j]:
                j, grown = j + 1, True
            if not grown:
                break
            if i < 0:
                return bpe.encode(data)
        out += [ids[done:left], bpe.encode(data[safe[i] : safe[j]])]
        done, k = right, last + 1
    return np.concatenate([*out, ids[done:]]).astype(np.uint32)


def _data(text: str | None) -> bytes:
    return (text or "").encode("utf-8")


def _chunk_keys(batches, mean: int):
    for batch in batches:
        keys = []
        for text in batch.column(2).to_pylist():
            data, last, own = _data(text), 0, []
            for end in cuts(data, mean):
                own.append(xxhash.xxh3_128_digest(data[last:end]))
                last = end
            keys.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.binary()))], ["__a", "__b", "__keys"])


def _has_marked(data: bytes, marks, mean: int) -> bool:
    last = 0
    for end in cuts(data, mean):
        if marks.has(int.from_bytes(xxhash.xxh3_128_digest(data[last:end])[:8], "big")):
            return True
        last = end
    return False


def _with_marked(batches, marked, mean: int, text_at: int):
    """The rows whose text has a marked chunk."""
    for batch in batches:
        found = [_has_marked(_data(text), marked.value, mean) for text in batch.column(text_at).to_pylist()]
        yield batch.filter(pa.array(found, pa.bool_()))


def _encode_unmarked(batches, marked, path: str, mean: int, text_at: int, names: list[str]):
    """The rows whose text has no marked chunk, with their ids."""
    bpe = codec(path)
    for batch in batches:
        keep, out = [], []
        for text in batch.column(text_at).to_pylist():
            data = _data(text)
            keep.append(not _has_marked(data, marked.value, mean))
            if keep[-1]:
                out.append(bpe.encode(data).astype("<u4"))
        rest = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([x.tobytes() for x in out], pa.binary()), pa.array([len(x) for x in out], pa.int64())], names)


def _encode_owned(batches, path: str, mean: int, text_at: int, owned_at: int):
    bpe = codec(path)
    for batch in batches:
        keys, ids = [], []
        for text, owned in zip(batch.column(text_at).to_pylist(), batch.column(owned_at).to_pylist(), strict=True):
            data = _data(text)
            ends = cuts(data, mean)
            for x in owned:
                k = x["__at"]
                keys.append(x["__key"])
                ids.append(bpe.encode(data[ends[k - 1] if k else 0 : ends[k]]).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.binary())], ["__key", "__ids"])


def _assemble_all(batches, path: str, mean: int, text_at: int, known_at: int, keep: list[int], names: list[str]):
    bpe = codec(path)
    for batch in batches:
        out = []
        for text, known in zip(batch.column(text_at).to_pylist(), batch.column(known_at).to_pylist(), strict=True):
            ids = {x["__at"]: np.frombuffer(x["__ids"], np.uint32) for x in known or ()}
            out.append(assemble(_data(text), ids, bpe, mean).astype("<u4"))
        arrays = [batch.column(i) for i in keep]
        arrays += [pa.array([x.tobytes() for x in out], pa.binary()), pa.array([len(x) for x in out], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with token_ids (binary: little-endian unsigned 32-bit integers) and n_tokens (long) of each whole text.

    Moves: chunk keys (16 bytes for about ``chunk_bytes``), the ids of repeated chunks, and the texts that have a
    repeated chunk; the other texts are encoded where they are read. A bitmap of fixed size over the keys of repeated
    chunks tells the two kinds apart; its false positives only move a text more. No step gathers the rows of a key:
    a repeated chunk's ids are joined to its occurrences, which adaptive execution splits.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("token_ids", "n_tokens")]
    keyed = docs.select(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("__a"), F.xxhash64(F.col(text_col), F.col(id_col).cast("string")).alias("__b"), *keep)
    chunked = keyed.select("__a", "__b", text_col).mapInArrow(functools.partial(_chunk_keys, mean=chunk_bytes), "__a long, __b long, __keys array<binary>")
    chunked = materialize(chunked, "bpe-chunks")
    occurrences = chunked.select("__a", "__b", F.posexplode("__keys").alias("__at", "__key"))
    # a text that stands in several equal rows counts for each of them; its chunks are encoded once all the same
    shared = occurrences.groupBy("__key").agg(F.count("*").alias("__n"), F.min(F.struct("__a", "__b", "__at")).alias("__first")).filter("__n > 1")
    shared = materialize(shared.select("__key", "__first.*"), "bpe-shared")
    marked = docs.sparkSession.sparkContext.broadcast(marks_of(shared.select(F.conv(F.hex(F.substring("__key", 1, 8)), 16, -10).cast("long").alias("key"))))
    sharing = keyed.mapInArrow(functools.partial(_with_marked, marked=marked, mean=chunk_bytes, text_at=keyed.columns.index(text_col)), keyed.schema)
    owners = shared.groupBy("__a", "__b").agg(F.collect_list(F.struct("__at", "__key")).alias("__owned"))
    # all columns go in, so that this join and the last one share one exchange of the texts
    one_each = sharing.join(owners.hint("shuffle_hash"), ["__a", "__b"])
    encoded = one_each.mapInArrow(functools.partial(_encode_owned, path=path, mean=chunk_bytes, text_at=one_each.columns.index(text_col), owned_at=one_each.columns.index("__owned")), "__key binary, __ids binary")
    encoded = encoded.groupBy("__key").agg(F.min("__ids").alias("__ids"))  # equal rows give equal ids
    known = occurrences.join(encoded, "__key").dropDuplicates(["__a", "__b", "__at"]).groupBy("__a", "__b").agg(F.collect_list(F.struct("__at", "__ids")).alias("__known"))
    full = sharing.join(known.hint("shuffle_hash"), ["__a", "__b"], "left")
    columns, names = full.columns, [*keep, "token_ids", "n_tokens"]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
    joined = full.mapInArrow(functools.partial(_assemble_all, path=path, mean=chunk_bytes, text_at=columns.index(text_col), known_at=columns.index("__known"), keep=[columns.index(c) for c in keep], names=names), schema)
    alone = docs.select(*keep).mapInArrow(functools.partial(_encode_unmarked, marked=marked, path=path, mean=chunk_bytes, text_at=keep.index(text_col), names=names), schema)
    return joined.unionByName(alone)


def _decode_all(batches, path: str, ids_at: int, keep: list[int], names: list[str]):
    bpe = codec(path)
    for batch in batches:
        texts = [bpe.decode(np.frombuffer(x or b"", np.uint32)) for x in batch.column(ids_at).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(texts, pa.string())], names)


def decode(encoded: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; special tokens are kept, null ids give an empty text."""
    columns = encoded.columns
    keep = [c for c in columns if c != out_col]
    schema = T.StructType([*(encoded.schema[c] for c in keep), T.StructField(out_col, T.StringType())])
    return encoded.mapInArrow(functools.partial(_decode_all, path=path, ids_at=columns.index(ids_col), keep=[columns.index(c) for c in keep], names=[f.name for f in schema]), schema)

