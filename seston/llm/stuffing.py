"""Texts stuffed with keywords, links or tags: a hidden Markov model labels their lines.

A line, or a window of a longer one, is seen through a few coarse features. Its label is prose, note (footnotes, agendas, remarks), roll (names of voters), link
list, tag list or menu (keywords and offers); labels persist from one piece to the next. What each label shows and how labels follow each
other is learnt here: rules that are certain of themselves label the clear pieces of a bounded sample of texts, counts of these give a
first model, and the likeliest paths of the model for the other pieces of the sample are counted with them again (Viterbi training). All texts
are then labelled by the model; one is a case if most of its words lie in pieces that are a link list, a tag list or a menu.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seston.runtime import settle

PROSE, NOTE, ROLL, LINKS, TAGS, MENU = range(6)
LABELS = ("prose", "note", "roll", "link list", "tag list", "menu")
#: Texts of the training sample at most (about), rounds of counting, and weight of the prior in counts.
SAMPLE, ROUNDS, PRIOR = 4000, 3, 0.5
#: Tokens of a piece at most.
WINDOW = 14
#: Share of the transitions' prior that stays with a label.
STAYS = 0.8

LINK = re.compile(r"https?://\S+|www\.\S+|\[[^\]]*\]\([^)]*\)|\b[\w-]+(?:\.[\w-]+)+/\S*", re.I)
MARKDOWN = re.compile(r"\[[^\]\n]*\]\([^)\n]*\)")
SHOP = re.compile(r"[€$£]\s?\d|\b(?:EUR|USD|GBP|CHF)\s?\d|\d\s?(?:€|EUR\b)|[★☆]{2,}")
NUMBERED = re.compile(r"^\s*(?:\[\d+\]|\(\d+\)|\d+[.)]|[¹²³⁴-⁹*†]+)\s")
WORD = re.compile(r"[^\W\d_]+")
ANY_WORD = re.compile(r"\w+")
ENDS = re.compile(r"[^\W\d_]{2}[.!?]+[\"”»)]*(?:\s|$)")
LINES = re.compile("[\r\n  ]+")
#: Function words of the languages that the corpus is in.
FUNCTION = frozenset(
    "the of and to in for that is we by from on with have has be this must my our it not at what are was were a an i as or if who there here then its "
    "le la les de des du et à pour que nous est par au aux en un une sur dans ne qui je ont plus car sans vos l d ce il cette "
    "der die das und zu für wir den dem ist nicht mit von ein eine einen im auf wer muss ich statt dass sich werden wird sind um "
    "el los las del y una con por no es se su vamos al lo".split()
)
#: Values of each feature: share of links, of tags, of function words, of words in lower case, of repeated pairs of words; end of a sentence, offer, note.
SIZES = (4, 4, 4, 3, 3, 2, 2, 2)
_EDGES = (np.array([1e-9, 0.2, 0.4]), np.array([1e-9, 0.2, 0.4]), np.array([0.05, 0.1, 0.2]), np.array([0.25, 0.4]), np.array([0.1, 0.3]))


def pieces(text: str) -> list[list[str]]:
    """Tokens of lines; of lines of more than WINDOW tokens, windows of that many. A link with blanks in its name is one token."""
    out = []
    for line in LINES.split(text):
        if "](" in line:
            line = MARKDOWN.sub(lambda m: m.group().replace(" ", "\xa0"), line)
        tokens = [t for t in re.split(r"[ \t]+", line) if t.strip()]
        out += [tokens[i : i + WINDOW] for i in range(0, len(tokens), WINDOW)]
    return out


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(values of the features, number of words) of each piece."""
    parts = pieces(text)
    marked = ["://" in text or "](" in text or "/" in text or "www." in text, "#" in text]
    plain, raw = [], []
    for tokens in parts:
        links = [bool(LINK.search(t)) for t in tokens] if marked[0] else [False] * len(tokens)
        n_tags = sum(t[0] == "#" and len(t) > 2 for t in tokens) if marked[1] else 0
        words = WORD.findall(" ".join(t for t, k in zip(tokens, links) if not k)) if any(links) else WORD.findall(" ".join(tokens))
        raw.append((sum(links), n_tags, len(tokens)))
        plain.append(words)
    lower = [[w.lower() for w in ws] for ws in plain]
    flat = [w for ws in lower for w in ws]
    often = {p for p, n in Counter(zip(flat, flat[1:])).items() if n >= 3 and not (p[0] in FUNCTION and p[1] in FUNCTION)}
    values = np.zeros((len(parts), len(SIZES)), np.int8)
    size = np.zeros(len(parts), np.int64)
    for k, (tokens, words, low, (n_links, n_tags, n)) in enumerate(zip(parts, plain, lower, raw)):
        piece = " ".join(tokens)
        m = len(words)
        shares = (n_links / n, n_tags / n, sum(w in FUNCTION for w in low) / m if m else 0.0, sum(w[0].islower() for w in words) / m if m else 0.0, sum(p in often for p in zip(low, low[1:])) / (m - 1) if m > 1 and often else 0.0)
        for f, (s, edges) in enumerate(zip(shares, _EDGES)):
            values[k, f] = sum(s >= e for e in edges)
        values[k, 5] = ENDS.search(piece) is not None
        values[k, 6] = SHOP.search(piece) is not None
        values[k, 7] = NUMBERED.match(piece) is not None
        size[k] = len(ANY_WORD.findall(piece))
    return values, size


def certain(v: np.ndarray) -> np.ndarray:
    """The label of each piece that a rule is certain of, -1 of the others."""
    link, tag, stop, small, again, ends, shop, note = v.T
    out = np.full(len(v), -1)
    out[(small == 0) & (again < 2) & (stop < 2) & (link == 0) & (tag == 0) & (shop == 0)] = ROLL
    out[(stop == 3) & (link < 2) & (tag < 2) & (shop == 0)] = PROSE
    out[(ends == 1) & (stop >= 1) & (link < 2) & (tag < 2) & (shop == 0)] = PROSE
    out[(stop == 0) & (small == 2) & (ends == 0) & (link == 0) & (tag == 0)] = MENU
    out[(again == 2) & (stop <= 1) & (small >= 1) & (ends == 0) & (link == 0) & (tag == 0)] = MENU
    out[(shop == 1) & (ends == 0) & (stop <= 2)] = MENU
    out[tag == 3] = TAGS
    out[link == 3] = LINKS
    out[(note == 1) & (tag == 0) & (link < 3)] = NOTE
    out[(note == 1) & (link == 3) & (ends == 0)] = -1
    return out


class Model:
    """Log-probabilities of first labels, of changes, and of the features' values by label."""

    def __init__(self, start: np.ndarray, change: np.ndarray, shows: list[np.ndarray]):
        def logs(counts: np.ndarray, prior: np.ndarray | float) -> np.ndarray:
            counts = counts + prior
            return np.log(counts / counts.sum(-1, keepdims=True))

        n = len(LABELS)
        stay = np.full((n, n), (1 - STAYS) / (n - 1))
        np.fill_diagonal(stay, STAYS)
        self.start = logs(start, 5.0)
        self.change = logs(change, 20 * stay)
        self.shows = [logs(s, PRIOR) for s in shows]

    def paths(self, values: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest labels of each text's pieces; texts of like length go together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(values)
        order = sorted((k for k in range(len(values)) if len(values[k])), key=lambda k: len(values[k]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and (stop - at + 1) * len(values[order[stop]]) <= 1 << 16:
                stop += 1
            group, at = order[at:stop], stop
            longest = len(values[group[-1]])
            lengths = np.array([len(values[k]) for k in group])
            score = np.zeros((len(group), longest, len(LABELS)))
            for i, k in enumerate(group):
                score[i, : lengths[i]] = sum(s[:, values[k][:, f]].T for f, s in enumerate(self.shows))
            came = np.zeros((len(group), longest, len(LABELS)), np.int8)
            best = self.start + score[:, 0]
            for t in range(1, longest):
                way = best[:, :, None] + self.change
                came[:, t] = way.argmax(1)
                step = way.max(1) + score[:, t]
                best = np.where((t < lengths)[:, None], step, best)
            label = best.argmax(1)
            rows = np.arange(len(group))
            path = np.zeros((len(group), longest), np.int64)
            for t in range(longest - 1, -1, -1):
                inside = t < lengths
                path[inside, t] = label[inside]
                if t:
                    label = np.where(inside, came[rows, t, label], label)
            for i, k in enumerate(group):
                out[k] = path[i, : lengths[i]]
        return out


def counts_of(values: list[np.ndarray], paths: list[np.ndarray]) -> np.ndarray:
    """First labels, changes and shown values counted, in one row; pieces with label -1 are left out."""
    n = len(LABELS)
    start, change, shows = np.zeros(n), np.zeros((n, n)), [np.zeros((n, s)) for s in SIZES]
    for v, p in zip(values, paths):
        if not len(p):
            continue
        if p[0] >= 0:
            start[p[0]] += 1
        both = (p[:-1] >= 0) & (p[1:] >= 0)
        np.add.at(change, (p[:-1][both], p[1:][both]), 1)
        known = p >= 0
        for f, s in enumerate(shows):
            np.add.at(s, (p[known], v[known, f]), 1)
    return np.concatenate([start, change.ravel(), *(s.ravel() for s in shows)])


def model_of(counts: np.ndarray) -> Model:
    n = len(LABELS)
    cuts = np.cumsum([n, n * n, *(n * s for s in SIZES)])
    parts = np.split(counts, cuts[:-1])
    return Model(parts[0], parts[1].reshape(n, n), [p.reshape(n, s) for p, s in zip(parts[2:], SIZES)])


def train(rows: DataFrame, id_col: str, text: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """The model from about ``sample`` texts, picked by a hash of their ids; counted on the executors, so the driver gets a row of counts a batch."""
    n = rows.count()
    part = rows.select(F.col(text).alias("t")) if n <= sample else rows.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(1_000_000 * sample / n) + 1).select(F.col(text).alias("t"))
    part = settle(part.filter(F.length("t") > 0), "lines")
    width = len(LABELS) * (1 + len(LABELS) + sum(SIZES))

    def round_of(model: Model | None) -> np.ndarray:
        def count(batches):
            for batch in batches:
                values = [features(t)[0] for t in batch.column(0).to_pylist()]
                paths = [certain(v) for v in values]
                if model is not None:
                    paths = [np.where(c >= 0, c, p) for c, p in zip(paths, model.paths(values))]
                made = counts_of(values, paths)
                yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(made)], names=["i", "n"])

        total = part.mapInArrow(count, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).collect()  # one row a parameter
        out = np.zeros(width)
        for r in total:
            out[r["i"]] = r["n"]
        return out

    model = model_of(round_of(None))
    for _ in range(rounds):
        model = model_of(round_of(model))
    return model


def stuffed_shares(texts: list[str], model: Model) -> list[float]:
    """Share of the words of each text in pieces that are link lists, tag lists or menus."""
    seen = [features(t) for t in texts]
    paths = model.paths([v for v, _ in seen])
    return [float(n[p >= LINKS].sum() / n.sum()) if n.sum() else 0.0 for (_, n), p in zip(seen, paths)]


def stuffed(rows: DataFrame, *, id_col: str = "doc_id", text: str = "text", least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Ids of texts of which more than ``least`` of the words is stuffing.

    Null, empty and blank texts are no cases. Repeated rows give repeated ids, an empty table gives none, a row with a null id is a row
    like others; columns beyond the two named are ignored. A text of any length is read whole.
    """
    schema = T.StructType([rows.schema[id_col]])
    src = rows.select(F.col(id_col), F.col(text))
    model = train(src, id_col, text, sample)

    def label(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            hit = [s > least for s in stuffed_shares(texts, model)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit, pa.bool_()))], names=schema.names)

    return src.mapInArrow(label, schema)
