"""Byte-level BPE over Arrow batches with the tokenizers library.

Every byte stands for one character of the model's alphabet, so the library's string merges act on
bytes. A rank file gives the merges: each split of a token into two known tokens, in the order of the
token's rank. Texts are cut by the pattern first; each distinct piece is encoded once for a worker.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrella.llm.store import fresh, ship

#: Bytes, about, of the pieces that one worker remembers during a task.
CACHE_BYTES = 96 << 20


def byte_characters() -> dict[int, str]:
    """Printable Latin-1 bytes stand for themselves, the others for the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder for a file of base64 tokens and ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.table = byte_characters()
        back = {c: b for b, c in self.table.items()}
        vocab = {self.characters(k): v for k, v in ranks.items()}
        merges = [(t[:i], t[i:]) for t in sorted(vocab, key=vocab.get) for i in range(1, len(t)) if t[:i] in vocab and t[i:] in vocab]
        self.tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges))
        self.splitter = pre_tokenizers.Split(Regex(pattern), "isolated")
        self.pieces = regex.compile(pattern).findall
        # Code points that Python's tables leave unassigned may be letters to one library and not to the other: the tokenizers library decides.
        odd = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])
        edges = np.flatnonzero(np.diff(odd.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        unsure = re.compile("[" + "".join(f"\\U{a:08x}-\\U{z - 1:08x}" for a, z in edges.tolist()) + "]").search
        # Long-settled blocks are told first: Latin to Greek, punctuation, kana, unified ideographs, Hangul.
        other = re.compile("[^\x00-\u0377\u2010-\u2027\u3041-\u3096\u30a1-\u30fe\u4e00-\u9fff\uac00-\ud7a3]").search
        self.unsure = lambda text: (found := other(text)) and unsure(text, found.start())
        self.bytes_of = {v: bytes(back[c] for c in k) for k, v in vocab.items()}
        self.digits = {v: str(v) for v in vocab.values()}
        self.known: dict[str, list[int]] = {}
        self.held = 0

    def characters(self, data: bytes) -> str:
        return data.decode("latin-1").translate(self.table)

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text, each match of the pattern merged separately, without special tokens."""
        cut = self.pieces(text) if text.isascii() or not self.unsure(text) else [p for p, _ in self.splitter.pre_tokenize_str(text)]
        known = self.known
        if new := [p for p in set(cut) if p not in known]:
            size = self.cost(new)
            if self.held + size > CACHE_BYTES:
                self.forget()
                new = list(set(cut))
                size = self.cost(new)
            self.held += size
            for piece, got in zip(new, self.tokenizer.encode_batch_fast([self.characters(p.encode()) for p in new], add_special_tokens=False), strict=True):
                known[piece] = got.ids
        return list(chain.from_iterable(map(known.__getitem__, cut)))

    @staticmethod
    def cost(pieces: Sequence[str]) -> int:
        """Bytes that pieces and their ids take: up to four for a character, eight for an id, and the objects around them."""
        return 300 * len(pieces) + 12 * sum(map(len, pieces))

    def forget(self) -> None:
        """Empty the memory of pieces: between tasks, and when it would pass ``CACHE_BYTES``; a single text's pieces are held in any case."""
        self.known.clear()
        self.held = 0

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes behind the ids; characters that tokens split come together again before anything reads them as UTF-8."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, ids: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last code point that each token touches; tokens that share a split character overlap there."""
        stops = np.cumsum([len(self.bytes_of[i]) for i in ids], dtype=np.int64)
        begins = (np.frombuffer(self.decode(ids), np.uint8) & 0xC0) != 0x80
        upto = np.append(0, np.cumsum(begins))  # characters that begin before each byte
        starts = np.append(0, stops[:-1]) if len(ids) else stops
        inside = np.append(~begins, False)
        return upto[starts] - inside[starts], upto[stops]


_loaded: dict[tuple[str, str], ByteBPE] = {}


def loaded(path: str, pattern: str) -> ByteBPE:
    """The tokenizer of this worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(path, pattern)
    return _loaded[path, pattern]


#: What ``bpe`` can give of a text.
OUTPUTS = {
    "n_tokens": (T.LongType(), lambda t, ids: len(ids)),
    "ids": (T.ArrayType(T.IntegerType()), lambda t, ids: ids),
    "starts": (T.ArrayType(T.LongType()), lambda t, ids: t.offsets(ids)[0]),
    "ends": (T.ArrayType(T.LongType()), lambda t, ids: t.offsets(ids)[1]),
    "decoded": (T.BinaryType(), lambda t, ids: t.decode(ids)),
    "ids_sha256": (T.StringType(), lambda t, ids: hashlib.sha256(",".join(map(t.digits.__getitem__, ids)).encode()).hexdigest()),
    "decoded_sha256": (T.StringType(), lambda t, ids: hashlib.sha256(t.decode(ids)).hexdigest()),
}


def bpe(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",), outputs: Sequence[str] = ("ids", "starts", "ends", "decoded")) -> DataFrame:
    """The ``keep`` columns and the named ``OUTPUTS`` of every whole text.

    ``path`` must name the rank file on every executor. Null and empty texts have no ids and decode to no bytes; an
    empty table gives an empty result; repeated rows are encoded like any other; a ``keep`` column named as an output stays, and the
    output gets a longer name (``ids_``). No shuffle: a task
    holds one Arrow batch, and batches are bounded in rows and bytes.
    """
    ship(df.sparkSession)
    chosen = df.select(*keep, F.col(text_col).alias("text__"))
    named = dict(zip(outputs, fresh(df.select(*keep), *outputs), strict=True))
    schema = T.StructType([*chosen.schema.fields[:-1], *[T.StructField(named[o], OUTPUTS[o][0]) for o in outputs]])
    arrow = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "decoded": pa.binary(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            own = loaded(path, pattern)
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                got: dict[str, list] = {o: [] for o in outputs}
                for text in batch.column(batch.num_columns - 1):
                    ids = own.encode(text.as_py() or "")
                    for o in outputs:
                        got[o].append(OUTPUTS[o][1](own, ids))
                fields = [*list(batch.schema)[:-1], *[pa.field(named[o], arrow[o]) for o in outputs]]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(got[o], arrow[o]) for o in outputs]], schema=pa.schema(fields))
        loaded(path, pattern).forget()  # an idle worker keeps the model but not the pieces of its last task

    return chosen.mapInArrow(run, schema)
