"""Documents that take over passages of held-out items, found by spaced seeds and confirmed by alignment.

A seed is the words at a few places of a short window, hashed; the other places don't count, so single words may differ, and masks of
several spans find stretches in which words were dropped or added. The items come in blocks of bounded size; the seeds of a block are a
sorted array that every executor gets, and those of each batch of documents are joined with it at once. Where seeds of a passage
lie together in a document, near one diagonal, a count of equal words along the diagonals and then an edit distance over words decide.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Places of the words of a seed. Of any six words in order with one dropped or added, one mask or another still fits.
MASKS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4))
#: Words of a passage at least, words for each error allowed, and words of a text between seeds of one place at most.
LEAST, PER_ERROR, APART = 13, 6, 20
#: Diagonals taken together; words that seeds must cover on two neighbouring bands: of 13 words, two errors leave a run of at least
#: seven or more than that in runs of three.
BAND, COVERED = 4, 7
#: Words of a text within which seeds must cover that many.
CLOSE = 20
#: Before an alignment: words of LEAST consecutive ones of the passage that must stand within SLACK diagonals of a common one. Of a stretch that
#: counts, the best LEAST consecutive words hold at most three errors, which shift the diagonal by three at most.
EQUAL, SLACK = 10, 2
#: Words of the items of a block at most.
BLOCK_WORDS = 2_000_000

BRACKETS = regex.compile(r"\([^()]{0,300}\)|\[[^\[\]]{0,300}\]")
INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}]+")
HYPHEN = regex.compile(r"(?<=\w)-[ \t]*\r?\n\s*(?=\w)")
INNER = regex.compile(r"(?<=\d)[.,'’](?=\d{3})|(?<=\w)['’](?=\w)")
WORD = regex.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Words without case, marks, invisible characters and punctuation; numbers without separators, words without a break at a line's end."""
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKD", text))
    if "-" in text:
        text = HYPHEN.sub("", text)
    return WORD.findall(INNER.sub("", text).casefold())


class Items:
    """A block of items: their words as numbers, and the sorted hashes of all their seeds with item and place."""

    def __init__(self, passages: list[tuple[int, str]]):
        self.ids = [i for i, _ in passages]
        split = [words(p) for _, p in passages]
        self.number: dict[str, int] = {}
        self.words = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in ws], np.int64) for ws in split]
        keys, items, places = [], [], []
        for k, ws in enumerate(self.words):
            for n, mask in enumerate(MASKS):
                made = seed_keys(ws, n, mask)
                keys.append(made)
                items.append(np.full(len(made), k))
                places.append(np.arange(len(made)))
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.item = np.concatenate(items)[order] if items else np.zeros(0, np.int64)
        self.place = np.concatenate(places)[order] if places else np.zeros(0, np.int64)

    def numbers(self, text: list[str]) -> np.ndarray:
        """The text's words as the items' numbers, 0 of words that no item has."""
        get = self.number.get
        return np.fromiter((get(w, 0) for w in text), np.int64, len(text))


def seed_keys(numbers: np.ndarray, n: int, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of the seed that begins at each place; 0 where one of its words is unknown."""
    size = len(numbers) - mask[-1]
    if size <= 0:
        return np.zeros(0, np.uint64)
    key, known = np.full(size, n + 1, np.uint64), np.ones(size, bool)
    for a in mask:
        part = numbers[a : a + size]
        known &= part > 0
        key = (key ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return np.where(known, key | np.uint64(1), np.uint64(0))


def takes_over(text: np.ndarray, passage: np.ndarray, least: int = LEAST, per_error: int = PER_ERROR) -> bool:
    """Whether a stretch of at least ``least`` words of the passage, its first and last word included, stands in the text
    with at most one error (word changed, dropped or added) in ``per_error`` words."""
    m, n = len(passage), len(text)
    if m < least or not n:
        return False
    place, far = np.arange(n), 10_000
    cost = np.full((m, n), far)  # by first word: errors of the stretch so far that ends at each word of the text
    length = np.zeros(m, int)
    before = np.full((m, n), far)
    for j in range(m):
        same = text == passage[j]
        before[: j + 1, 1:] = cost[: j + 1, :-1]
        hit = np.where(same, before[: j + 1], far)
        hit[j] = np.where(same, 0, far)
        length[: j + 1] += 1
        if ((hit.min(1) * per_error <= length[: j + 1]) & (length[: j + 1] >= least)).any():
            return True
        now = np.minimum(hit, np.minimum(before[: j + 1], cost[: j + 1]) + 1)
        cost[: j + 1] = np.minimum.accumulate(now - place, axis=1) + place
    return False


def may_take_over(text: np.ndarray, passage: np.ndarray, low: int, high: int) -> bool:
    """Whether EQUAL of LEAST consecutive words of the passage stand in the text within SLACK diagonals (place in the text less place in the passage) of
    one from ``low`` to ``high``: what any stretch that counts has."""
    n, m = len(text), len(passage)
    if m < LEAST or not n:
        return False
    at = np.arange(low - SLACK, high + SLACK + 1)[:, None] + np.arange(m)[None, :]
    same = (at >= 0) & (at < n) & (text[np.clip(at, 0, n - 1)] == passage[None, :])
    near = np.zeros((high - low + 1, m + 1), np.int16)
    for k in range(2 * SLACK + 1):
        near[:, 1:] |= same[k : k + high - low + 1]
    sums = np.cumsum(near, axis=1)
    return bool((sums[:, LEAST:] - sums[:, :-LEAST] >= EQUAL).any())


def found_in(texts: list[np.ndarray], items: Items) -> list[tuple[int, int]]:
    """(number of the text, number of the item) of each text that takes over a stretch of an item's passage."""
    sizes = np.array([len(t) for t in texts])
    if not sizes.sum() or not len(items.key):
        return []
    # texts stand apart by unknown words, so no seed spans two
    gap = MASKS[-1][-1] + 1
    begin = np.r_[0, np.cumsum(sizes + gap)[:-1]]
    whole = np.zeros(int((sizes + gap).sum()), np.int64)
    for b, t in zip(begin, texts):
        whole[b : b + len(t)] = t
    at, entry, span = [], [], []
    for n, mask in enumerate(MASKS):
        key = seed_keys(whole, n, mask)
        live = np.flatnonzero(key)
        first, last = np.searchsorted(items.key, key[live], "left"), np.searchsorted(items.key, key[live], "right")
        many = last - first
        hit = np.flatnonzero(many)
        reps = many[hit]
        entry.append(np.repeat(first[hit] - np.r_[0, np.cumsum(reps)[:-1]], reps) + np.arange(reps.sum()))
        at.append(np.repeat(live[hit], reps))
        span.append(np.full(int(reps.sum()), n))
    at, entry, span = map(np.concatenate, (at, entry, span))
    if not len(at):
        return []
    text = np.searchsorted(begin, at, "right") - 1
    place = at - begin[text]
    item = items.item[entry]
    band = (place - items.place[entry]) // BAND
    cover = np.array(MASKS)[span]  # three places a seed
    rows = np.stack([np.repeat(text, 3), np.repeat(item, 3), np.repeat(band, 3), (place[:, None] + cover).ravel()], 1)
    rows = np.unique(np.concatenate([rows, rows - np.array([0, 0, 1, 0])]), axis=0)  # a band with the one above it
    group = np.cumsum(np.r_[False, (rows[1:, :3] != rows[:-1, :3]).any(1)])
    # only places that are among COVERED close ones
    n = len(rows) - COVERED + 1
    if n < 1:
        return []
    dense = np.flatnonzero((group[COVERED - 1 :] == group[:n]) & (rows[COVERED - 1 :, 3] - rows[:n, 3] < CLOSE))
    keep = np.zeros(len(rows) + 1, np.int64)
    np.add.at(keep, dense, 1)
    np.add.at(keep, dense + COVERED, -1)
    inside = np.cumsum(keep[:-1]) > 0
    rows, group = rows[inside], group[inside]
    if not len(rows):
        return []
    new = np.r_[True, (group[1:] != group[:-1]) | (rows[1:, 3] - rows[:-1, 3] > APART)]
    start = np.flatnonzero(new)
    count = np.diff(np.r_[start, len(rows)])
    out: set[tuple[int, int]] = set()
    for s, c in zip(start[count >= COVERED], count[count >= COVERED]):
        t, k = int(rows[s, 0]), int(rows[s, 1])
        if (t, k) in out:
            continue
        first = max(0, int(rows[s, 3]) - APART)
        part = texts[t][first : int(rows[s + c - 1, 3]) + APART]
        low = int(rows[s, 2]) * BAND - first
        if may_take_over(part, items.words[k], low - 2, low + 2 * BAND + 1) and takes_over(part, items.words[k]):
            out.add((t, k))
    return sorted(out)


def _blocks(items: DataFrame, item_id: str, passage: str):
    """The items in blocks of about BLOCK_WORDS words; one block at a time is on the driver."""
    block: list[tuple[int, str]] = []
    size = 0
    for r in items.select(F.col(item_id), F.col(passage)).filter(F.col(item_id).isNotNull() & F.col(passage).isNotNull()).toLocalIterator():
        n = r[1].count(" ") + 1
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


def leaks(rows: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """(id, item), distinct, of texts that take over at least 13 words of an item's passage, with at most one error in six.

    Case, punctuation and spacing don't count; an interruption in brackets is taken out of a text, but text in brackets may as well be part of
    a passage, so both readings are tried. Null, empty and blank texts and passages, and items without id, give nothing; passages of fewer than
    13 words neither. Repeated rows count once; empty tables give an empty result; columns beyond those named are ignored. A
    text of any length is read whole. Every block of items is one pass over the texts.
    """
    spark = rows.sparkSession
    src = rows.select(F.col(id_col), F.col(text))
    schema = T.StructType([rows.schema[id_col], T.StructField(item_id, T.LongType())])
    out = None
    for block in _blocks(items, item_id, passage):
        shared = spark.sparkContext.broadcast(Items(block))

        def search(batches, shared=shared):
            held = shared.value
            for batch in batches:
                owner, texts = [], []
                for n, s in enumerate(batch.column(1).to_pylist()):
                    if not s:
                        continue
                    bare = BRACKETS.sub(" ", s) if "(" in s or "[" in s else s
                    for t in {s, bare}:
                        numbers = held.numbers(words(t))
                        if np.count_nonzero(numbers) >= COVERED:
                            owner.append(n)
                            texts.append(numbers)
                hits = sorted({(owner[t], k) for t, k in found_in(texts, held)})
                ids = batch.column(0).take(pa.array([n for n, _ in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([held.ids[k] for _, k in hits], pa.int64())], names=schema.names)

        part = src.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out.distinct()
