"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary comes from a ranks file (base64 token, rank). A byte-level model of the tokenizers
library spells every byte as one printable character; the table between the two is built from its
rule. Each match of the split pattern is encoded by itself, and a worker keeps the ids of short
matches, since most matches of a corpus are frequent words. Decoding joins the tokens' bytes by the
reversed table, so that a character split between two tokens comes out whole.

Null texts count as empty (no ids). Texts are taken whole; rows are independent, so that repeated
rows, ties and extra columns need no care. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellforge.llm.common import arrow_batches, with_columns

#: A worker keeps the ids of matches of at most so many characters, and so many of them, at once.
KEEP_CHARS, KEEP_PIECES = 48, 600_000

ENCODED = "ids array<int>, starts array<int>, ends array<int>"


def byte_chars() -> list[str]:
    """The printable character of each byte: itself where it is printable Latin-1, else the next free one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Codec:
    """Encoder and decoder for one ranks file."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex
        from tokenizers import models

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}
        char = byte_chars()
        spell = lambda token: "".join(char[b] for b in token)
        merges = [self._halves(t, ranks) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
        vocab = {spell(t): r for t, r in ranks.items()}
        self.model = models.BPE(vocab=vocab, merges=[(spell(a), spell(b)) for a, b in merges])
        self.table = dict(enumerate(char))
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        back = {c: b for b, c in enumerate(char)}
        for word, rank in vocab.items():
            self.bytes_of[rank] = bytes(back[c] for c in word)
        self.find = regex.compile(pattern).findall
        self.kept: dict[str, bytes] = {}

    @staticmethod
    def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
        """The last merge that makes a token: its bytes are merged by rank until two parts are left."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            i = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], len(ranks) + 1_000_000))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        found = [self.find(t) for t in texts]
        kept = self.kept
        if len(kept) > KEEP_PIECES:
            kept.clear()
        more = {}
        for piece in {p for pieces in found for p in pieces if p not in kept}:
            spelt = piece.encode().decode("latin-1").translate(self.table)
            ids = np.array([t.id for t in self.model.tokenize(spelt)], "<u4").tobytes()
            (kept if len(piece) <= KEEP_CHARS else more)[piece] = ids
        if more:
            return [b"".join(more[p] if p in more else kept[p] for p in pieces) for pieces in found]
        return [b"".join(map(kept.__getitem__, pieces)) for pieces in found]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of each token in characters; tokens inside one character share it."""
        ends = np.cumsum([len(self.bytes_of[i]) for i in np.frombuffer(ids, "<u4").tolist()], dtype=np.int64)
        raw = np.frombuffer(text.encode(), np.uint8)
        char_at = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character that each byte belongs to
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
        return char_at[starts] if len(ends) else starts, (char_at[ends - 1] + 1) if len(ends) else ends


@lru_cache(4)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with ids and, for each token, starts and ends in characters of the text.

    The ranks file is read by every worker at ranks_path, which must exist on each machine.
    """

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        c = codec(ranks_path, pattern)
        texts = [t or "" for t in b.column("_text").to_pylist()]
        ids = c.encode(texts)
        spans = [c.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
        return [pa.array(x, pa.list_(pa.int32())) for x in ([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], [s[0].astype(np.int32) for s in spans], [s[1].astype(np.int32) for s in spans])]

    return with_columns(docs, [F.col(f"`{text}`").cast("string").alias("_text")], ENCODED, make)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """encoded with the decoded bytes of its ids (null: empty)."""

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        c = codec(ranks_path, pattern)
        return [pa.array((c.decode(np.array(i or [], "<u4").tobytes()) for i in b.column("_ids").to_pylist()), pa.binary())]

    return with_columns(encoded, [F.col(f"`{ids}`").alias("_ids")], "decoded binary", make)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (and ids) of each document: encodes, then decodes the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            ids = c.encode([t or "" for t in b.column("text").to_pylist()])
            cols = [b.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array((sha(c.decode(i)) for i in ids), pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    arrow_batches(docs.sparkSession)
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kind)
