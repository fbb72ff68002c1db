"""Tokenising documents into pieces and packing them by vector best fit."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import Memory, steps
from .scratch import cut, table

#: Words that a worker remembers at most.
REMEMBERED = 400_000
#: Text bytes whose words are numbered together.
STEP = 24 << 20
#: Pieces that are packed together at most on average; a shard leaves about one sequence half full.
SHARD_PIECES = 8192
#: Where Python and the tokenizer differ on what is white space, or words might not stand alone.
_ODD = r"[\x00-\x08\x0e-\x1f\x{7f}-\x{9f}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}]|<\|"
#: Words on whose letters, digits and lower case Python and the tokenizer agree without normalisation.
_LATIN = re.compile("[!-~¡-¬®-ÖØ-įĲ-ňŊ-ž]+")
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_SEPARATOR = "<|endoftext|>"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte: itself if it is one, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of whole texts by a tokenizer that drops white space, from the ids of their words.

    New words in Latin letters are cut into the tokenizer's parts, whose ids its merges give;
    other new words are encoded together in one call, set apart by a special token.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.token_to_id(_SEPARATOR)
        self.words, self.parts = Memory(REMEMBERED), Memory(REMEMBERED)
        self.letters = _byte_letters()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _latin(self, words: list[str]) -> dict[str, bytes]:
        cut = [_ASCII_PARTS.findall(w.lower()) if w.isascii() else _PARTS.findall(w.lower()) for w in words]
        model, letters = self.tokenizer.model, self.letters
        learned = {}
        for p in set().union(*cut).difference(self.parts):
            shown = p if p.isascii() else "".join([letters[b] for b in p.encode()])
            learned[p] = np.array([t.id for t in model.tokenize(shown)], "<u4").tobytes()
        self.parts.learn(learned)
        known = self.parts
        return {w: known[own[0]] if len(own) == 1 else b"".join([known[p] for p in own]) for w, own in zip(words, cut)}

    def _other(self, words: list[str]) -> dict[str, bytes]:
        learned: dict[str, bytes] = {}
        for i in range(0, len(words), 50_000):
            some = words[i : i + 50_000]
            ids = self._ids(_SEPARATOR.join(some))
            ends = np.append(np.flatnonzero(ids == self.separator), len(ids)).tolist()
            if len(ends) != len(some):
                raise RuntimeError("the separator must stand between words only")
            start = 0
            for w, end in zip(some, ends):
                learned[w] = ids[start:end].tobytes()
                start = end + 1
        return learned

    def _table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and the n + 1 offsets."""
        fresh = [w for w in words if w not in self.words]
        latin = [w for w in fresh if _LATIN.fullmatch(w)]
        other = list(set(fresh).difference(latin, ("",))) if len(latin) < len(fresh) else []
        self.words.learn((self._latin(latin) if latin else {}) | (self._other(other) if other else {}))
        known = self.words
        entries = [known[w] if w else b"" for w in words]
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        return np.frombuffer(b"".join(entries), "<u4"), np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, column: pa.Array) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text; null counts as empty.

        Texts are split and their words numbered by Arrow; only distinct words come to Python.
        """
        odd = np.asarray(pc.fill_null(pc.match_substring_regex(column, _ODD), False))
        plain = pc.if_else(pa.array(odd), pa.scalar(None, column.type), column) if odd.any() else column
        split = pc.utf8_split_whitespace(plain)
        coded = split.flatten().dictionary_encode()
        sizes = np.asarray(pc.fill_null(pc.list_value_length(split), 0)).astype(np.int64)
        ids, bounds = self._table(coded.dictionary.to_pylist())
        word = np.asarray(coded.indices)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for at in range(0, len(column), 512):
            some = word[ends[at] : ends[min(at + 512, len(column))]]
            lengths = bounds[some + 1] - bounds[some]
            upto = np.concatenate([[0], np.cumsum(lengths)])
            flat = ids[np.repeat(bounds[some] - upto[:-1], lengths) + np.arange(upto[-1])].tobytes()
            cuts = (4 * upto[ends[at : at + 513] - ends[at]]).tolist()
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                yield self._ids(column[at + k].as_py()).tobytes() if odd[at + k] else flat[a:b]


_tokenizers: dict[str, WordTokenizer] = {}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document.

    A document is its ids and then ``end_id``; so a null or empty text has one piece of one
    token. Only documents of more than ``capacity`` ids are cut, every ``capacity`` ids.
    """
    docs.sparkSession.sparkContext.addFile(tokenizer_path)
    name = tokenizer_path.rsplit("/", 1)[-1]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = SparkFiles.get(name)
        if path not in _tokenizers:
            _tokenizers[path] = WordTokenizer(path)
        for batch in batches:
            for part in steps(batch, "text", STEP):
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), _tokenizers[path].encode(part.column(1))):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each item.

    An item of n tokens demands (n, 1, n squared) of a bin's tokens, documents and attention
    cost. Items come in decreasing length, equal ones in input order. Of the open bins that can
    take an item in every dimension, ``norm`` selects the one with the least weighted norm of
    what is left after it, ``dot`` the one with the largest weighted dot product of demand and
    what is left before it; the oldest on ties. Shares of the capacity are compared. If no bin
    can take it a new one is opened; an item beyond an empty bin is an error.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule must be norm or dot")
    limit, weight = np.array(capacity, float), np.array(weights, float)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    shortest = lengths.min() if len(lengths) else 0
    left = np.empty((3, 64))
    number, used = np.empty(64, np.int64), 0
    opened = 0
    for i in order:
        n = float(lengths[i])
        need = np.array([n, 1.0, n * n])
        if (need > limit).any():
            raise ValueError(f"an item of {int(n)} tokens fits no bin")
        best = -1
        if used:
            free = left[:, :used]
            fits = (free[0] >= n) & (free[1] >= 1.0) & (free[2] >= need[2])
            at = np.flatnonzero(fits)
            if len(at):
                share = free[:, at] / limit[:, None]
                if rule == "norm":
                    best = at[np.argmin(weight @ (share - (need / limit)[:, None]) ** 2)]
                else:
                    best = at[np.argmax((weight * need / limit) @ share)]
        if best < 0:
            if used == left.shape[1]:
                closed = (left[0, :used] < shortest) | (left[1, :used] < 1.0) | (left[2, :used] < shortest * shortest)
                keep = np.flatnonzero(~closed)
                used = len(keep)
                room = max(64, 2 * used)
                left, number = np.concatenate([left[:, keep], np.empty((3, room - used))], 1), np.concatenate([number[keep], np.empty(room - used, np.int64)])
            best = used
            left[:, best], number[best] = limit, opened
            used, opened = used + 1, opened + 1
        bins[i], offsets[i] = number[best], int(limit[0] - left[0, best])
        left[:, best] -= need
        if left[0, best] < shortest:
            used -= 1
            left[:, best : used], number[best : used] = left[:, best + 1 : used + 1].copy(), number[best + 1 : used + 1].copy()
    return bins, offsets


def pack(parts: DataFrame, capacity: int = 4096, most_documents: int | None = None, most_attention: float | None = None, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm") -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``, packed gaplessly into sequences.

    A sequence takes ``capacity`` tokens, ``most_documents`` pieces and ``most_attention`` of
    summed squared lengths; by default the last two bind no more than the first. Pieces are
    dealt evenly into shards by a hash of their place in the table, so that repeated rows are
    spread like others, and each shard is packed by :func:`best_fit`; more input means more
    shards, not larger ones. ``parts`` is written once. No rows give none.
    """
    limits = (float(capacity), float(most_documents or capacity), float(most_attention or capacity * capacity))
    parts = cut(parts, "pieces")
    shards = max(1, -(-parts.count() // SHARD_PIECES))
    schema = parts.schema

    def run(shard: pa.Table) -> pa.Table:
        own = shard.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = best_fit(np.asarray(own["length"]), limits, weights, rule)
        base = own["shard"][0].as_py() << 32
        return own.drop_columns(["shard"]).append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))

    dealt = parts.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return dealt.groupBy("shard").applyInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, **limits) -> DataFrame:
    """Pieces of all documents with their sequence and place.

    Null texts count as empty, and an empty one is a piece of one token. Long texts are cut into
    pieces of ``capacity``. Repeated rows are pieces of their own, a null id stays null, other
    columns are not read, and an empty table gives no rows.
    """
    return pack(pieces(docs, tokenizer_path, capacity), capacity, **limits)


def op6_best_fit_packing(spark, sf_dir):
    """All ``documents`` in sequences of 4096 tokens, by :func:`pack_documents`. As few sequences as it can: the other limits don't bind."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
