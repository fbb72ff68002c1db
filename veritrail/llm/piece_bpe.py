"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

The symbols of many words lie end to end in one numpy array. A round looks up the rank of every
adjacent pair, takes the minimum of each word, merges its occurrences from the left and
compacts; words without a pair leave. Vocabulary and settings are read from the model file.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import Memory
from .scratch import spare, table

_SPACE = "▁"
_WORD = re.compile(" +[^ ]*")
_NONE = np.int64(1) << 62
#: Words that a worker remembers at most.
REMEMBERED = 400_000
#: Words are merged so many at a time.
WORDS = 60_000
#: Words of more symbols are first cut where no piece can reach across.
LONG = 24


@dataclass
class PieceModel:
    pieces: list[str]
    kinds: np.ndarray
    symbol: dict[str, int]
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    exclusive: np.ndarray
    bytes_of: list[int]
    reach: set[str]
    prefix: bool
    unknown: int

    @property
    def size(self) -> int:
        return len(self.pieces)


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    """Reads a ``.model`` file; only BPE models with identity normalisation, as the public 32k file."""
    from sentencepiece import sentencepiece_model_pb2 as schema

    proto = schema.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    if proto.trainer_spec.model_type != 2 or proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only BPE models without text normalisation are supported")
    pieces = [p.piece for p in proto.pieces]
    kinds = np.array([p.type for p in proto.pieces])
    if (kinds == 4).any():
        raise ValueError("user-defined pieces are not supported")
    scores = np.array([p.score for p in proto.pieces])
    normal = [i for i in range(len(pieces)) if kinds[i] in (1, 5)]
    rank = np.zeros(len(pieces), np.int64)
    rank[normal] = np.unique(-scores[normal], return_inverse=True)[1]
    symbol = {pieces[i]: i for i in normal}
    for i in normal:
        for c in pieces[i]:
            symbol.setdefault(c, len(symbol) + len(pieces))
    keys, ranks, merged = [], [], []
    best_start: dict[str, int] = {}
    best_end: dict[str, int] = {}
    for i in normal:
        p = pieces[i]
        for cut in range(1, len(p)):
            left, right = p[:cut], p[cut:]
            best_start[left] = min(best_start.get(left, 1 << 60), int(rank[i]))
            best_end[right] = min(best_end.get(right, 1 << 60), int(rank[i]))
            if left in symbol and right in symbol:
                keys.append((symbol[left] << 32) | symbol[right])
                ranks.append(rank[i])
                merged.append(i)
    order = np.argsort(keys)
    # A merge result that some piece of better or equal rank begins or ends with is merged one at a time.
    exclusive = np.zeros(len(pieces), bool)
    for i in normal:
        p = pieces[i]
        exclusive[i] = min(best_start.get(p, 1 << 60), best_end.get(p, 1 << 60)) <= rank[i]
    byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if kinds[i] == 6}
    reach = {p[j : j + 2] for p in (pieces[i] for i in normal) for j in range(len(p) - 1)}
    return PieceModel(
        pieces, kinds, symbol, np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order], np.array(merged, np.int64)[order], exclusive,
        [byte_ids.get(b, -1) for b in range(256)] if proto.trainer_spec.byte_fallback or byte_ids else [], reach, proto.normalizer_spec.add_dummy_prefix, int(np.flatnonzero(kinds == 2)[0]),
    )


def _look_up(model: PieceModel, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Index of each pair in the model's pairs, or -1."""
    key = (left << 32) | right
    at = np.searchsorted(model.keys, key)
    at[at == len(model.keys)] = 0
    return np.where(model.keys[at] == key, at, -1)


def merge_rounds(model: PieceModel, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges the words ``symbols[bounds[i]:bounds[i + 1]]``; returns final symbols and bounds."""
    words = len(bounds) - 1
    done: list[tuple[np.ndarray, np.ndarray]] = []
    live = np.arange(words)
    word = np.repeat(live, np.diff(bounds))
    symbols = symbols.astype(np.int64)
    pair = np.full(len(symbols), -1, np.int64)
    if len(symbols) > 1:
        pair[:-1] = np.where(word[:-1] == word[1:], _look_up(model, symbols[:-1], symbols[1:]), -1)
    rank_of = np.append(model.ranks, _NONE)
    while len(symbols):
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        rank = rank_of[pair]
        least = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(symbols)))
        finished = least == _NONE
        if finished.any():
            gone = np.repeat(finished, sizes)
            done.append((word[gone], symbols[gone]))
            keep = ~gone
            symbols, word, pair, rank = symbols[keep], word[keep], pair[keep], rank[keep]
            if not len(symbols):
                break
            least, sizes = least[~finished], sizes[~finished]
        # Occurrences of each word's least rank. Ranks that several pieces share, and merges that
        # can give a piece of better rank, go one at a time from the left.
        hit = np.flatnonzero(rank == np.repeat(least, sizes))
        first = np.ones(len(hit), bool)
        first[1:] = word[hit[1:]] != word[hit[:-1]]
        leader = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
        same = pair[hit] == pair[hit[leader]]
        take = first | (same & ~model.exclusive[model.merged[pair[hit[leader]]]])
        # In a run of overlapping occurrences every second one counts.
        chosen = hit[take]
        joined = np.zeros(len(chosen), bool)
        joined[1:] = chosen[1:] == chosen[:-1] + 1
        if joined.any():
            run = np.maximum.accumulate(np.where(joined, 0, np.arange(len(chosen))))
            chosen = chosen[(np.arange(len(chosen)) - run) % 2 == 0]
        symbols[chosen] = model.merged[pair[chosen]]
        keep = np.ones(len(symbols), bool)
        keep[chosen + 1] = False
        fresh = np.zeros(len(symbols), bool)
        fresh[chosen] = True
        symbols, word, pair, fresh = symbols[keep], word[keep], pair[keep], fresh[keep]
        again = fresh.copy()
        again[:-1] |= fresh[1:]
        again = np.flatnonzero(again)
        ahead = np.minimum(again + 1, len(symbols) - 1)
        inside = (ahead > again) & (word[again] == word[ahead])
        pair[again] = np.where(inside, _look_up(model, symbols[again], symbols[ahead]), -1)
    all_words = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
    all_symbols = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
    order = np.argsort(all_words, kind="stable")
    return all_symbols[order], np.searchsorted(all_words[order], np.arange(words + 1))


def _cut(model: PieceModel, word: str) -> list[str]:
    """The word in parts between which no piece reaches."""
    if len(word) <= LONG:
        return [word]
    cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in model.reach), len(word)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:])]


def encode_words(model: PieceModel, words: list[str]) -> list[list[int]]:
    """Ids of each word, spaces already written as the visible space of the vocabulary."""
    parts: list[str] = []
    owner: list[int] = []
    for i, w in enumerate(words):
        for part in _cut(model, w):
            parts.append(part)
            owner.append(i)
    out: list[list[int]] = [[] for _ in words]
    if not parts:
        return out
    points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    seen, inverse = np.unique(points, return_inverse=True)
    extra, ids = {}, np.empty(len(seen), np.int64)
    top = len(model.pieces) + len(model.symbol) + 1
    for j, c in enumerate(map(chr, seen.tolist())):
        ids[j] = model.symbol.get(c, top + j)
        if ids[j] >= len(model.pieces):
            extra[int(ids[j])] = [model.bytes_of[b] for b in c.encode()] if model.bytes_of else [model.unknown]
    symbols, bounds = merge_rounds(model, ids[inverse], np.concatenate([[0], np.cumsum(list(map(len, parts)))]))
    values, limits = symbols.tolist(), bounds.tolist()
    for part, i in enumerate(owner):
        own = values[limits[part] : limits[part + 1]]
        out[i] += [b for s in own for b in extra.get(s, (s,))] if extra else own
    return out


class Encoder:
    """Encodes texts word by word and remembers words between calls, up to a bound."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.words = Memory(REMEMBERED)
        raw = [b"" if k in (2, 3) else bytes([int(p[3:5], 16)]) if k == 6 else p.replace(_SPACE, " ").encode() for p, k in zip(model.pieces, model.kinds.tolist())]
        self.raw = raw

    def split(self, text: str | None) -> list[str]:
        """Words without their first space: runs of spaces with what follows. No piece reaches across."""
        if not text:
            return []
        if _SPACE in text:
            text = text.replace(_SPACE, " ")
        words = text.split(" ")
        if "" in words:
            words = [w[1:] for w in _WORD.findall(" " + text)]
        return words

    def look_up(self, texts: list[list[str]]) -> Memory:
        """Number of ids, the ids joined by commas and the decoded bytes of all words of the texts.

        The memory takes the words that come first, up to its bound; later ones are merged anew.
        """
        known = self.words
        fresh = list(set().union(*texts).difference(known)) if texts else []
        learned = {}
        for i in range(0, len(fresh), WORDS):
            some = fresh[i : i + WORDS]
            for w, ids in zip(some, encode_words(self.model, [_SPACE + w.replace(" ", _SPACE) for w in some])):
                learned[w] = (len(ids), ",".join(map(str, ids)), b"".join([self.raw[t] for t in ids]))
        known.learn(learned)
        return known


def encode(model: PieceModel, text: str | None) -> list[int]:
    """Ids of one text, as ``SentencePieceProcessor.encode`` gives them; null counts as empty."""
    if not text:
        return []
    text = (" " + text if model.prefix else text).replace(" ", _SPACE)
    return [i for ids in encode_words(model, _segments(text)) for i in ids]


def _segments(text: str) -> list[str]:
    """Cut before every run of visible spaces that follows something else."""
    out, start = [], 0
    for i in range(1, len(text)):
        if text[i] == _SPACE and text[i - 1] != _SPACE:
            out.append(text[start:i])
            start = i
    return [*out, text[start:]] if text else []


def decode(model: PieceModel, ids: list[int]) -> str:
    """The text of ids, as ``SentencePieceProcessor.decode`` gives it."""
    parts, first, pending = [], True, b""
    for i in ids:
        kind = model.kinds[i]
        if kind == 6:
            pending += bytes([int(model.pieces[i][3:5], 16)])
            first = False
            continue
        if pending:
            parts.append(_bytes_text(pending))
            pending = b""
        if kind == 3:
            continue
        piece = " ⁇ " if kind == 2 else model.pieces[i].replace(_SPACE, " ")
        if first and model.prefix and kind != 2 and piece.startswith(" "):
            piece = piece[1:]
        parts.append(piece)
        first = False
    if pending:
        parts.append(_bytes_text(pending))
    return "".join(parts)


def _bytes_text(raw: bytes) -> str:
    """Byte pieces as text; a byte that belongs to no character becomes U+FFFD of its own."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_encoders: dict[str, Encoder] = {}


def digest_texts(path: str, texts: list[str | None]) -> tuple[list[int], list[str], list[str]]:
    """Number of ids, SHA-256 of the ids joined by commas, and SHA-256 of the decoded text, by text."""
    if path not in _encoders:
        _encoders[path] = Encoder(load(path))
    encoder = _encoders[path]
    model = encoder.model
    if not model.prefix:
        raise ValueError("a model with a leading dummy space is expected")
    words = list(map(encoder.split, texts))
    known = encoder.look_up(words)
    counts, ids_hash, text_hash = [], [], []
    for own in words:
        entries = [known[w] for w in own]
        counts.append(sum([e[0] for e in entries]))
        ids_hash.append(hashlib.sha256(",".join([e[1] for e in entries]).encode()).hexdigest())
        text_hash.append(hashlib.sha256(b"".join([e[2] for e in entries])[1:]).hexdigest())
    return counts, ids_hash, text_hash


def _on_executors(df: DataFrame, path: str) -> str:
    """Ships the model file with the job; returns the name executors find it by."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode_column(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of every text; null and empty texts have none. A column of that name is replaced."""
    name = _on_executors(docs, path)

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        model = load(SparkFiles.get(name))
        return pa.array([encode(model, t) for t in column.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(ids_col, run(F.col(text_col)))


def decode_column(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of an id column; null ids give the empty text. A column of that name is replaced."""
    name = _on_executors(docs, path)

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        model = load(SparkFiles.get(name))
        return pa.array([decode(model, ids or []) for ids in column.to_pylist()], pa.string())

    return docs.withColumn(text_col, run(F.col(ids_col)))


def encoding_digests(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens, ids_sha256, decoded_sha256`` of every whole text; columns of those names are replaced, others kept.

    A null text counts as empty, and an empty one has no token. Long texts are encoded whole; repeated
    rows get the same answer each; an empty table gives no rows. A worker remembers the pieces
    of a bounded number of words, which changes nothing but the time that a rarer word takes.
    """
    name = _on_executors(docs, path)

    @F.arrow_udf("struct<n_tokens bigint, ids_sha256 string, decoded_sha256 string>")
    def run(column: pa.Array) -> pa.Array:
        parts = [digest_texts(SparkFiles.get(name), column[i : i + 1024].to_pylist()) for i in range(0, len(column), 1024)]
        columns = [[x for part in parts for x in part[k]] for k in range(3)]
        return pa.StructArray.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    own = spare(docs, "encoding")
    found = docs.withColumn(own, run.asNondeterministic()(F.col(text_col)))
    return found.withColumns({c: F.col(f"{own}.{c}") for c in ("n_tokens", "ids_sha256", "decoded_sha256")}).drop(own)


def op5_sentencepiece(spark, sf_dir):
    """Token ids and decoded texts of all ``documents``, by :func:`encoding_digests`."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoding_digests(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")
