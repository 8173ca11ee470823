"""SentencePiece encoding and decoding that keeps byte offsets of the source.

The normaliser is written out here: at every position the longest prefix that
the compiled character map knows is replaced, the rest is copied; blanks are
then escaped. An alignment (normalised byte -> source byte) is recorded on the
way, so each piece projects to a byte span of the original text.

The pieces are those of the library: it gets a copy of the model whose own
normaliser is switched off and is fed the text normalised here. No piece of a
suitable vocabulary holds a word mark after other characters, so merges never
cross from one word to the next and every word is encoded once per process and
then looked up; for other vocabularies the text is encoded as a whole.

Compiled map: four bytes (length of the trie), a double-array trie, then the
replacements, each ended by a zero byte. An empty map copies everything.

Null texts count as empty. Every text is encoded whole, whatever its length.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from . import _text as tx

MARK = "▁"
MARK_BYTES = MARK.encode()
CACHE_WORDS = 1 << 19


class CharMap:
    """Longest-prefix replacement by a compiled character map."""

    def __init__(self, blob: bytes):
        self.units = np.zeros(0, np.uint32)
        if blob:
            n = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4:4 + n], "<u4")
            self.texts = blob[4 + n:]
            self.heads = np.array([self._child(0, c) is not None for c in range(256)])

    def _child(self, node: int, c: int) -> int | None:
        u = int(self.units[node])
        at = node ^ ((u >> 10) << ((u & (1 << 9)) >> 6)) ^ c
        return at if at < len(self.units) and int(self.units[at]) & 0x800000FF == c else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes replaced, replacement) of the longest key that starts at ``at``."""
        node, best, end = 0, None, at
        while end < len(data):
            node = self._child(node, data[end])
            if node is None:
                break
            end += 1
            u = int(self.units[node])
            if u >> 8 & 1:
                leaf = node ^ ((u >> 10) << ((u & (1 << 9)) >> 6))
                text = int(self.units[leaf]) & 0x7FFFFFFF
                best = end - at, self.texts[text:self.texts.index(b"\0", text)]
        return best

    def apply(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Mapped bytes and, for each, the source byte it comes from (plus the end)."""
        if not len(self.units):
            return data, np.arange(len(data) + 1)
        heads = np.flatnonzero(self.heads[np.frombuffer(data, np.uint8)])
        out, align, at = [], [], 0
        for h in heads.tolist():
            if h < at or (found := self.longest(data, h)) is None:
                continue
            out += [data[at:h], found[1]]
            align += [np.arange(at, h), np.full(len(found[1]), h)]
            at = h + found[0]
        out.append(data[at:])
        align.append(np.arange(at, len(data) + 1))
        return b"".join(out), np.concatenate(align)


class Encoder:
    """Encodes, projects and decodes with one model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            blob = f.read()
        model = proto.ModelProto()
        model.ParseFromString(blob)
        spec = model.normalizer_spec
        self.map, self.prefix = CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix
        self.squeeze, self.escape = spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        self.full = sentencepiece.SentencePieceProcessor(model_proto=blob)
        spec.precompiled_charsmap = b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        model.ClearField("denormalizer_spec")
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        own = [p.piece for p in model.pieces if p.type not in (2, 3, 6)]
        # byte pieces cover one byte of the normalised text each
        self.width = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in model.pieces])
        self.unknown = model.trainer_spec.unk_id
        self.byte_fallback = model.trainer_spec.byte_fallback
        self.by_word = (self.escape and not self.suffix and model.trainer_spec.model_type == 2 and self.byte_fallback
                        and not any(re.search(f"[^{MARK}]{MARK}", p) for p in own) and not any(p.type == 4 for p in model.pieces))
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.cache: dict[str, bytes] = {}

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text and its alignment to the bytes of ``text``."""
        data, align = self.map.apply(text.encode())
        if self.squeeze:
            b = np.frombuffer(data, np.uint8) == 32
            keep = ~b
            keep[1:] |= b[1:] & ~b[:-1]
            solid = np.flatnonzero(~b)
            keep &= (np.arange(len(b)) > solid[0]) & (np.arange(len(b)) < solid[-1]) | ~b if len(solid) else np.zeros(len(b), bool)
            data, align = bytes(np.frombuffer(data, np.uint8)[keep]), np.append(align[:-1][keep], align[-1])
        if data and self.prefix:
            data, align = (data + b" ", np.append(align, align[-1])) if self.suffix else (b" " + data, np.concatenate((align[:1], align)))
        if self.escape:
            b = np.frombuffer(data, np.uint8)
            align = np.append(np.repeat(align[:-1], np.where(b == 32, len(MARK_BYTES), 1)), align[-1])
            data = data.replace(b" ", MARK_BYTES)
        return data.decode(), align

    def ids(self, normal: str) -> np.ndarray:
        """Piece ids (little-endian unsigned 32-bit) of a normalised text, without begin and end."""
        if not self.by_word:
            return np.array(self.plain.encode(normal), "<u4")
        words, cache = self.words.findall(normal), self.cache
        distinct = set(words)
        fresh = distinct.difference(cache)
        if fresh:
            if len(cache) + len(fresh) > CACHE_WORDS:
                cache.clear()
                fresh = distinct
            fresh = list(fresh)
            for w, ids in zip(fresh, self.plain.encode(fresh, num_threads=1), strict=True):
                cache[w] = struct.pack(f"<{len(ids)}I", *ids)
        return np.frombuffer(b"".join(map(cache.__getitem__, words)), "<u4")

    def encode(self, text: str) -> list[int]:
        """All ids, with begin and end."""
        return [self.full.bos_id(), *self.ids(self.normalise(text)[0]).tolist(), self.full.eos_id()]

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids without begin and end, and the byte span of the source that each covers.

        A span starts at the source of the piece's first normalised byte and ends
        where the next piece starts, so spans are in order and cover the text.
        """
        normal, align = self.normalise(text)
        ids = self.ids(normal)
        if self.byte_fallback:
            widths = self.width[ids]
        else:  # the unknown piece stands for as many characters as it does
            widths = np.array([len(p.surface.encode()) for p in self.plain.encode(normal, out_type="immutable_proto").pieces], int)
        edge = np.concatenate(([0], np.cumsum(widths))).astype(int)
        if edge[-1] != len(normal.encode()):
            raise ValueError("pieces do not cover the normalised text")
        at = align[edge]
        if len(at):
            at[0], at[-1] = 0, len(text.encode())
        return ids, at[:-1], at[1:]

    def decode(self, ids: list[int]) -> str:
        return self.full.decode(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a model file, loaded once per Python worker."""
    return Encoder(path)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` (doc_id, text) with ids (array<int>), starts and ends (byte spans of the pieces between begin and end)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

    def run(it):
        e = encoder(model)
        for b in it:
            for i, t in enumerate(b.column("text").to_pylist()):
                ids, s, f = e.spans(t or "")
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 1), pa.array([[e.full.bos_id(), *ids, e.full.eos_id()]], schema[1].type),
                                                  pa.array([s], schema[2].type), pa.array([f], schema[3].type)], schema=schema)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tx.tidy(run), "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes of every text, in Arrow batches.

    ``covered_bytes`` is the sum of the projected spans: the bytes of the text.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("covered_bytes", pa.int64())])

    def run(it):
        e = encoder(model)
        begin, end_ = np.array([e.full.bos_id()], "<u4"), np.array([e.full.eos_id()], "<u4")
        for b in it:
            out: dict[str, list] = {n: [] for n in schema.names[1:]}
            for t in b.column("text").to_pylist():
                ids, start, end = e.spans(t or "")
                ids = np.concatenate((begin, ids, end_))
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(e.decode(ids.tolist()).encode()).hexdigest())
                out["covered_bytes"].append(int((end - start).sum()))
            yield tx.batches(out | {"doc_id": b.column("doc_id")}, schema)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        tx.tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")
