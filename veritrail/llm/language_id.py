"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled sample text is built. A document is cut into
phrases, each the longest match that continues to occur in the sample; the count of phrases
times the bits of a pointer into the sample, by length, estimates the cross entropy between
document and language (Ziv and Merhav). The language with the fewest normalised phrases wins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import spare, table

#: Bounds of the labelled sample that the automata are built from, for each language.
SAMPLE_ROWS = 128
ROW_CHARS = 320
#: Parts that the texts of a language are ranked in before their best are ranked together.
DEALS = 32
SAMPLE_CHARS = SAMPLE_ROWS * ROW_CHARS
#: Entries of a language's dense table at most; an automaton that would take more, by many letters, is searched by its edges.
DENSE = 1 << 24
#: Code points of a block. The blocks of a text are parsed side by side, and then as one text, see :func:`parse_blocks`.
BLOCK = 256
#: Code points that are parsed at a time.
STEP = 1 << 20


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _normal(points: np.ndarray) -> np.ndarray:
    """Letters stay; every run of others becomes one 0."""
    points = np.where(_is_letter()[points], points, 0)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    return points[keep]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Next state by symbol, for each state of the minimal automaton of all substrings; the first state is the root."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return go


@dataclass
class Dense:
    """An automaton as a table of all states and classes.

    An entry holds, in its two low bits, the phrases that end with the step and above them the
    place of the next state's row.
    """

    own: np.ndarray
    moves: np.ndarray

    @classmethod
    def of(cls, go: list[dict[int, int]], own: np.ndarray, width: int) -> Dense:
        edges = np.full((len(go), width), -1, np.int64)
        for state, to in enumerate(go):
            edges[state, list(to.keys())] = list(to.values())
        root = edges[0]
        move, phrases = np.where(edges >= 0, edges, np.where(root >= 0, root, 0)), np.where(edges >= 0, 0, np.where(root >= 0, 1, 2))
        phrases[0] = np.where(root >= 0, 0, 1)
        move[:, width - 1], phrases[:, width - 1] = np.arange(len(go)), 0
        return cls(own, (move * width * 4 + phrases).astype(np.uint32).ravel())

    def step(self, state: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after a letter each, and the phrases that end there."""
        move = self.moves[state + row]
        return move >> np.uint32(2), (move & np.uint32(3)).astype(np.uint8)


@dataclass
class Sparse:
    """An automaton as its sorted edges, for a language of many letters."""

    own: np.ndarray
    edges: np.ndarray
    to: np.ndarray
    root: np.ndarray

    @classmethod
    def of(cls, go: list[dict[int, int]], own: np.ndarray, width: int) -> Sparse:
        edges = np.array([state * width + c for state, to in enumerate(go) for c in to], np.int64)
        to = np.array([s for to in go for s in to.values()], np.int64)
        root = np.full(width, -1, np.int64)
        root[list(go[0].keys())] = list(go[0].values())
        order = np.argsort(edges)
        return cls(own, edges[order], to[order], root)

    def step(self, state: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after a letter each, and the phrases that end there."""
        width = len(self.root)
        edge = state * np.int64(width) + row
        at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
        hit, begin, pad = self.edges[at] == edge, self.root[row], row == width - 1
        ended = np.where(pad | hit, 0, np.where(begin >= 0, 1, np.where(state == 0, 1, 2)))
        after = np.where(pad, state, np.where(hit, self.to[at], np.maximum(begin, 0)))
        return after.astype(np.uint32), ended.astype(np.uint8)


def parse_blocks(automaton: Dense | Sparse, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Phrases that end in each block of ``codes[place, block]``, where ``first`` marks the first block of a text.

    The result is that of parsing each text from its start to its end. All blocks are parsed at
    once as if a phrase began with each. A block whose forerunner ends inside a phrase is then
    parsed again from that state, until it comes to the state it had at the same place before:
    from there on nothing changes. If that place lies beyond its end, the next block follows.
    The last phrase of a text ends with it.
    """
    n = codes.shape[1]
    rows = automaton.own[codes]
    states, ended = np.empty(codes.shape, np.uint32), np.empty(codes.shape, np.uint8)
    state = np.zeros(n, np.uint32)
    for t, row in enumerate(rows):
        state, ended[t] = automaton.step(state, row)
        states[t] = state
    begin = np.zeros(n, np.uint32)
    todo = np.flatnonzero(~first)
    while len(todo):
        todo = todo[states[-1, todo - 1] != begin[todo]]
        now = begin[todo] = states[-1, todo - 1]
        open_ = todo
        for t, row in enumerate(rows):
            if not len(open_):
                break
            now, count = automaton.step(now, row[open_])
            differ = now != states[t, open_]
            ended[t, open_], states[t, open_] = count, now
            open_, now = open_[differ], now[differ]
        todo = open_ + 1
        todo = todo[todo < n]
        todo = todo[~first[todo]]
    last = np.append(first[1:], True)
    return ended.sum(0, dtype=np.int64) + (last & (states[-1] != 0))


@dataclass
class LanguageModel:
    """The automata of all languages, each over the letters of its own sample.

    ``classes`` numbers the letters of all samples; the class before the last is that of any
    other letter, the last one (``width - 1``) leaves a state as it is.
    """

    languages: list[str]
    classes: np.ndarray
    automata: list[Dense | Sparse]
    pointer_bits: np.ndarray
    width: int

    def phrases(self, codes: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        """``[language, block]`` counts for ``codes[place, block]``; without ``first`` every block is a text."""
        first = np.ones(codes.shape[1], bool) if first is None else first
        return np.stack([parse_blocks(a, codes, first) for a in self.automata])


def train(samples: dict[str, str]) -> LanguageModel:
    """A model of sample texts by language; languages without a letter in their sample are left out."""
    points = {lang: _normal(_code_points(text))[:SAMPLE_CHARS] for lang, text in sorted(samples.items())}
    points = {lang: p for lang, p in points.items() if (p != 0).any()}
    letters = np.unique(np.concatenate([p[p != 0] for p in points.values()] or [np.zeros(0, np.uint32)]))
    unknown, width = len(letters) + 1, len(letters) + 3
    classes = np.where(_is_letter(), unknown, 0).astype(np.uint32 if width > 1 << 16 else np.uint16)
    classes[letters] = np.arange(1, len(letters) + 1)
    automata: list[Dense | Sparse] = []
    for p in points.values():
        have = np.unique(classes[p[p != 0]])
        own = np.full(width, len(have) + 1, np.uint32)
        own[0], own[have], own[width - 1] = 0, np.arange(1, len(have) + 1), len(have) + 2
        go = suffix_automaton(own[classes[p]].tolist())
        kind = Dense if len(go) * (len(have) + 3) <= DENSE else Sparse
        automata.append(kind.of(go, own, len(have) + 3))
    bits = np.array([math.log2(max(2, len(p))) for p in points.values()])
    return LanguageModel(list(points), classes, automata, bits, width)


def predict(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text.

    The score is 1 minus the winner's entropy over the runner-up's (1 if only one language is
    known). ``und`` with score 0 where a text is null or has no letter, or nothing was learned.
    Equal entropies go to the language that sorts first.
    """
    labels, scores = ["und"] * len(texts), np.zeros(len(texts))
    pending: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal pending, size
        if not pending:
            return
        blocks = np.array([-(-len(c) // BLOCK) for _, c in pending])
        flat = np.full((blocks.sum(), BLOCK), model.width - 1, model.classes.dtype)
        lengths = np.array([len(c) for _, c in pending])
        first = np.concatenate([[0], np.cumsum(blocks)])
        row = np.repeat(first[:-1] * BLOCK, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        flat.reshape(-1)[row] = np.concatenate([c for _, c in pending])
        begins = np.zeros(blocks.sum(), bool)
        begins[first[:-1]] = True
        counts = model.phrases(np.ascontiguousarray(flat.T), begins)
        totals = np.add.reduceat(counts, first[:-1], axis=1).astype(float)
        entropy = totals * model.pointer_bits[:, None] / lengths
        order = np.argsort(entropy, axis=0, kind="stable")
        for j, (i, _) in enumerate(pending):
            labels[i] = model.languages[order[0, j]]
            scores[i] = 1 - entropy[order[0, j], j] / entropy[order[1, j], j] if len(model.languages) > 1 else 1.0
        pending, size = [], 0

    for i, text in enumerate(texts):
        if not text or not model.languages:
            continue
        points = _normal(_code_points(text))
        if not points.any():
            continue
        pending.append((i, model.classes[points]))
        size += len(points)
        if size >= STEP:
            flush()
    flush()
    return labels, scores


def is_held_out(id_col: str = "doc_id"):
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Automata from labelled rows that are not held out.

    A bounded sample: for each language ``ROW_CHARS`` characters, from a hashed place, of the
    ``SAMPLE_ROWS`` distinct texts that hash lowest; many short pieces, so that a row with a
    wrong label weighs little. Copies of a text count once: they are combined by hash before
    the shuffle, and the rank keeps that many hashes of each task, so a language or a text with
    most of the rows costs no more than another.
    """
    text = F.col(text_col)
    start = F.pmod(F.xxhash64(text, F.lit("piece")), F.greatest(F.length(text) - ROW_CHARS, F.lit(0)) + 1).cast("int") + 1
    labelled = docs.where(~is_held_out(id_col) & F.col(lang_col).isNotNull() & text.isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text).alias("order"), F.substring(text, start, F.lit(ROW_CHARS)).alias("text")
    )
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("order"))
    some = labelled.select("lang", "order").distinct().withColumn("deal", F.pmod("order", F.lit(DEALS)))
    some = some.withColumn("rank", rank("lang", "deal")).where(F.col("rank") <= SAMPLE_ROWS)
    lowest = some.withColumn("rank", rank("lang")).where(F.col("rank") <= SAMPLE_ROWS).select("lang", "order", "rank")
    chosen = labelled.join(F.broadcast(lowest), ["lang", "order"]).select("lang", "rank", "text").distinct()
    samples: dict[str, list[str]] = {}
    for row in sorted(chosen.collect(), key=lambda r: (r["lang"], r["rank"], r["text"])):
        samples.setdefault(row["lang"], []).append(row["text"])
    return train({lang: "\n".join(texts) for lang, texts in samples.items()})


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", label_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score; columns of those names are replaced, others kept whatever their names.

    Reads nothing but the text, and all of a long one. See :func:`predict` for null, empty and
    letterless texts and for ties. Repeated rows get the same answer each; an empty table gives
    no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<label string, score double>")
    def parse(column: pa.Array) -> pa.Array:
        labels, scores = [], []
        for i in range(0, len(column), 512):
            a, b = predict(shared.value, column[i : i + 512].to_pylist())
            labels += a
            scores.append(b)
        return pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(np.concatenate(scores or [np.zeros(0)]))], ["label", "score"])

    name = spare(docs, "language")
    found = docs.withColumn(name, parse.asNondeterministic()(F.col(text_col)))
    return found.withColumns({label_col: F.col(f"{name}.label"), score_col: F.col(f"{name}.score")}).drop(name)


def op1_language_id(spark, sf_dir):
    """The language of all ``documents``, by :func:`identify` with a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
