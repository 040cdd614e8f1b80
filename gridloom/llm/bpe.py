"""BPE encoding and decoding with content-defined chunk reuse (operator 1).

A rolling hash over the last bytes of a text decides where chunks end, so copies of a passage fall
into the same chunks whatever stands around them. A chunk is encoded once per worker (a bounded
dictionary holds the ids of recent chunks, across the tasks of the worker), without looking at its
neighbours. At each join the ids can differ from those of the whole text: a window around the join
is encoded again, from a point before it to a point after it, and grows on both sides until its first
and last ids agree exactly with those of the chunks there at a place where the text splits in any
context (before a blank that follows a non-blank, outside special tokens). Without such a
place the window takes in the whole chunk, at worst the whole text.

Decoding maps ids to bytes and reads the bytes as UTF-8.

Defined cases: null counts as the empty text (no ids, empty decoded text); bytes that are not UTF-8
are read with U+FFFD in their place; texts of any length are encoded whole; repeated rows give
repeated results; an empty table gives an empty result; extra columns do not take part.
"""

from __future__ import annotations

import hashlib
import re
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.bpe_ids import ByteBpe, vocabulary
from gridloom.llm.textops import VOCABULARIES, _BYTE, byte_texts, slices_by_bytes

#: Bytes that the rolling hash sees.
WINDOW = 16
#: Chunks have about 2**CHUNK_BITS bytes, and at least LEAST.
CHUNK_BITS, LEAST = 10, 256
#: Bytes of chunks and ids that a worker remembers.
REMEMBERED = 96 << 20


def chunk_ends(data: np.ndarray, chunk_bits: int = CHUNK_BITS, least: int = LEAST) -> list[int]:
    """Ends of the content-defined chunks of a text; never inside a UTF-8 character."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    rolled, width = _BYTE[data], 1
    while width < WINDOW:  # doubles the bytes seen: h[i] covers data[i - 2 * width + 1 .. i]
        rolled[width:] = rolled[width:] + (rolled[:-width] << np.uint64(width)) * np.uint64(0x9E3779B97F4A7C15)
        width *= 2
    cut = (rolled >> np.uint64(64 - chunk_bits)) == 0
    cut[:-1] &= (data[1:] & 0xC0) != 0x80
    cut[: WINDOW - 1] = False
    ends, last = [], 0
    for e in (np.flatnonzero(cut) + 1).tolist():
        if e - last >= least:
            ends.append(e)
            last = e
    if last < n:
        ends.append(n)
    return ends


#: The text splits before such a blank whatever stands around it.
_SPLIT = re.compile(rb"(?<=[!-~]) ")


def _certain_splits(raw: bytes) -> list[int]:
    """The first two and the last two; nothing where there are fewer than two."""
    first = [m.start() for m in islice(_SPLIT.finditer(raw), 2)]
    if len(first) < 2:
        return []
    last, at = [], len(raw)
    while len(last) < 2:
        at = raw.rfind(b" ", 0, at)
        if 0x20 < raw[at - 1] < 0x7F and at:
            last.append(at)
    return [*first, last[1], last[0]]


class _Chunk(NamedTuple):
    """A chunk's ids, and its first two and last two certain splits: offsets in bytes and in ids."""

    ids: np.ndarray
    first: tuple[int, int, int, int] | None
    last: tuple[int, int, int, int] | None


class ChunkEncoder:
    """Encodes texts chunk by chunk with repaired joins; results equal those for whole texts."""

    def __init__(self, bpe: ByteBpe, chunk_bits: int = CHUNK_BITS, least: int = LEAST, remembered: int = REMEMBERED):
        self.bpe, self.chunk_bits, self.least, self.remembered = bpe, chunk_bits, least, remembered
        self.special = [s.encode() for s in bpe.special]
        self.chunks: dict[bytes, _Chunk] = {}
        self.held = self.reused = self.encoded = self.repairs = 0

    def _chunk(self, raw: bytes) -> _Chunk:
        found = self.chunks.get(raw)
        if found is not None:
            self.reused += 1
            return found
        self.encoded += 1
        ids = self.bpe.encode(raw.decode("utf-8"))
        places = _certain_splits(raw)
        if places:
            at = (np.searchsorted(np.cumsum(self.bpe.token_length[ids]), places, "left") + 1).tolist()
            found = _Chunk(ids, (places[0], at[0], places[1], at[1]), (places[2], at[2], places[3], at[3]))
        else:
            found = _Chunk(ids, None, None)
        self.held += 9 * len(raw) // 2
        if self.held > self.remembered:
            self.chunks, self.held = {}, len(raw)
        self.chunks[raw] = found
        return found

    def encode(self, text: bytes) -> np.ndarray:
        try:
            whole = text.decode("utf-8")
        except UnicodeDecodeError:
            whole = text.decode("utf-8", "replace")
            text = whole.encode("utf-8")
        if any(s in text for s in self.special):
            return self.bpe.encode(whole)
        ends = chunk_ends(np.frombuffer(text, np.uint8), self.chunk_bits, self.least)
        if len(ends) <= 1:
            return self._chunk(text).ids if text else np.zeros(0, np.uint32)
        starts = [0, *ends[:-1]]
        out: list[np.ndarray] = []
        k, here = 0, 0  # ids of chunk k before ``here`` have been put out
        chunk = self._chunk(text[: ends[0]])
        while k + 1 < len(ends):
            left0, at0, left, at = chunk.last or (0, 0, 0, 0)
            begin = starts[k] + left0  # without a split the window takes the chunk in whole
            n = k + 1
            while True:
                following = self._chunk(text[starts[n] : ends[n]])
                if following.first is None and n + 1 < len(ends):
                    n += 1  # no place to agree at: the window grows over this chunk
                    continue
                self.repairs += 1
                if following.first is None:
                    over = self.bpe.encode(text[begin:].decode("utf-8"))
                    right_at = right_same = 0
                else:
                    _, right_at, right, right_end = following.first
                    over = self.bpe.encode(text[begin : starts[n] + right].decode("utf-8"))
                    right_same = right_end - right_at
                same = at - at0
                agreed = np.array_equal(over[:same], chunk.ids[at0:at]) and (
                    not right_same or np.array_equal(over[len(over) - right_same :], following.ids[right_at:right_end])
                )
                if agreed:
                    break
                if n + 1 < len(ends) and following.first is not None:
                    n += 1
                    continue
                return self.bpe.encode(whole)
            out += [chunk.ids[here:at], over[same : len(over) - right_same]]
            if following.first is None:
                return np.concatenate(out)
            chunk, k, here = following, n, right_at
        out.append(chunk.ids[here:])
        return np.concatenate(out)


_ENCODERS: dict[str, ChunkEncoder] = {}


def worker_encoder(path: str) -> ChunkEncoder:
    """One encoder, and so one dictionary of chunks, for each worker process."""
    if path not in _ENCODERS:
        if not _ENCODERS:
            VOCABULARIES.append(_ENCODERS.clear)
        _ENCODERS[path] = ChunkEncoder(ByteBpe.load(path))
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of each whole text."""

    def run(batches):
        encoder = worker_encoder(path)
        for batch in slices_by_bytes(batches, "text", 4 << 20, vocabulary=True):
            ids = [encoder.encode(t) for t in byte_texts(batch, "text")]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"])

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of each array of ids; null ids count as none."""

    def run(batches):
        bpe = ByteBpe.load(path)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], np.uint32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches):
        encoder = worker_encoder(path)
        for batch in slices_by_bytes(batches, "text", 4 << 20, vocabulary=True):
            n, of_ids, of_text = [], [], []
            for text in byte_texts(batch, "text"):
                ids = encoder.encode(text)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                of_text.append(hashlib.sha256(encoder.bpe.decode(ids).encode("utf-8")).hexdigest())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"))
