"""Token ids of texts by a byte-level BPE vocabulary.

The texts of an Arrow batch are cut into pieces all together (``pretokens``); each different piece is merged once and then remembered,
whatever text it comes from. The vocabulary's file is a parameter; every worker reads it itself.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seston.llm.pretokens import piece_starts

#: Pieces that a worker remembers; when there are more it begins anew, which changes no result. Longer pieces aren't remembered.
REMEMBERED, LONG = 500_000, 64


def default_folder() -> str:
    """Where the installed package of public vocabularies has its files."""
    import public_tokenizers

    return public_tokenizers.path("")


class Vocabulary:
    """Byte sequences with their ranks, which are the ids; of two neighbours those whose union has the lowest rank are merged first, the left ones of equals."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that begins here
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop or not alive[j]:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])

    def ids(self, piece: str) -> tuple[int, ...]:
        found = self.known.get(piece)
        if found is None:
            found = self.merge(piece.encode())
            if len(piece) <= LONG:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = found
        return found

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        whole = "".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        starts = piece_starts(np.frombuffer(whole.encode("utf-32-le"), np.uint32), ends)
        cuts = np.searchsorted(starts, np.r_[0, ends]).tolist()
        at = [*starts.tolist(), len(whole)]
        ids = self.ids
        for a, b in zip(cuts, cuts[1:]):
            out: list[int] = []
            for k in range(a, b):
                out.extend(ids(whole[at[k] : at[k + 1]]))
            yield out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode()

    def offsets(self, ids: list[int]) -> list[int]:
        """The byte of the text at which each token begins."""
        return np.r_[0, np.cumsum([len(self.bytes[i]) for i in ids])][: len(ids)].astype(int).tolist()


@lru_cache(2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


#: Characters of texts that are cut into pieces at the same time; a longer text is taken by itself.
TOGETHER = 1 << 22


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group: list[str] = []
    size = 0
    for t in texts:
        if group and size + len(t) > TOGETHER:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def encode_texts(rows: DataFrame, id_col: str = "doc_id", text: str = "text", *, vocabulary: str = "byte_bpe_50k", folder: str | None = None, offsets: bool = False) -> DataFrame:
    """One row per row: id, ``ids``, the token ids of the text as stored, and with ``offsets`` the byte at which each token begins.

    Null and empty text give an empty list; what spells a special token is ordinary text. Repeated ids and a null id are rows like others; an
    empty table gives an empty result; columns beyond the two named are ignored. ``folder`` is where ``<vocabulary>.tiktoken`` lies on every
    executor.
    """
    src = rows.select(F.col(id_col), F.col(text))
    fields = [rows.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("offsets", T.ArrayType(T.IntegerType()))] * offsets
    schema = T.StructType(fields)

    def encode(batches):
        words = load(f"{(folder or default_folder()).rstrip('/')}/{vocabulary}.tiktoken")
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            made = [ids for group in _groups(texts) for ids in words.encode(group)]
            ends = pa.array(np.r_[0, np.cumsum([len(m) for m in made])], pa.int32())
            flat = np.fromiter((i for m in made for i in m), np.int32)
            columns = [batch.column(0), pa.ListArray.from_arrays(ends, pa.array(flat))]
            if offsets:
                columns.append(pa.array([words.offsets(m) for m in made], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return src.mapInArrow(encode, schema)


def decode_ids(rows: DataFrame, ids: str = "ids", name: str = "text", *, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """The text of each row's ids; of null null."""
    def decode(column: pd.Series) -> pd.Series:
        words = load(f"{(folder or default_folder()).rstrip('/')}/{vocabulary}.tiktoken")
        return pd.Series([None if v is None else words.decode(list(v)) for v in column], dtype=object)

    return rows.withColumn(name, F.pandas_udf(decode, "string")(ids))
