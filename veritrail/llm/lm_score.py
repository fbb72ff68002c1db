"""Document scores by the cross-entropy difference of two matched n-gram models.

A target model (trusted documents) and a background model (all documents) have the same
vocabulary, order and smoothing, so their per-token losses can be subtracted: a document that
is more like the target than like the whole corpus scores above zero (Moore and Lewis). Counts
are exact, by 56-bit hashes of words and pairs, and grow with the corpus, but no task or driver
holds them as a whole: blocks of documents get the counts of their own words and pairs, and are
scored from these.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import flat_utf8, steps
from .scratch import cut, spare, table
from .shingles import mix, word_hashes

#: Words that smoothing allows for at least; the distinct words of the corpus if these are more.
WORD_SLOTS = 1 << 17
#: Bytes of the documents that are counted, or scored, together, and of text for each bucket of counts.
BLOCK_BYTES, BUCKET_BYTES = 1 << 23, 1 << 24
#: Ids of targets that are sent to every task at most, of 8 bytes each.
BROADCAST_IDS = 1 << 22
#: Weight of the word model in the pair model, in tokens.
PRIOR = 32.0
#: Bits of the hashes that stand for words and pairs: among 10^12 distinct pairs, one in 70,000 shares its hash.
KEY_BITS = 56
_SHORTER = np.uint64(64 - KEY_BITS)
_START = np.uint64(0x5851F42D4C957F2D)
_RESULT = ("n_tokens", "loss_target", "loss_background", "score")


# --- keys and counts as bytes ------------------------------------------------------------


def _fold(texts: pa.Array) -> np.ndarray:
    """0 or 1 from a hash of the text, so that copies of a text lie in one fold."""
    return np.array([zlib.crc32(t.as_buffer()) & 1 if t.is_valid else 0 for t in texts.cast(pa.binary())], np.int64)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, highest bytes first, which compress."""
    return np.diff(keys, prepend=np.uint64(0)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:].T.tobytes()


def _keys(packed: pa.Scalar) -> np.ndarray:
    planes = np.frombuffer(packed.as_buffer(), np.uint8).reshape(7, -1)
    whole = np.zeros((planes.shape[1], 8), np.uint8)
    whole[:, 1:] = planes.T
    return np.cumsum(whole.view(">u8").ravel().astype(np.uint64), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """``[key, group]`` in the narrowest type that holds them."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return bytes([kind.itemsize]) + zlib.compress(counts.T.astype(kind).tobytes(), 1)


def _counts(packed: pa.Scalar, groups: int) -> np.ndarray:
    data = packed.as_py()
    return np.frombuffer(zlib.decompress(data[1:]), f"u{data[0]}").reshape(groups, -1).T.astype(np.int64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the place of every key among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    fresh = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return ordered[fresh], place


@dataclass
class Block:
    """Words and pairs of a block of documents: the sorted distinct ones, and each token's place among them."""

    words: np.ndarray
    pairs: np.ndarray
    word: np.ndarray
    before: np.ndarray
    pair: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table, text: str) -> Block:
        words, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in rows.select([text]).to_batches():
            for part in steps(batch, text):
                own, bounds = word_hashes(*flat_utf8(part.column(0)))
                words.append(own)
                sizes.append(np.diff(bounds))
        word, bounds = np.concatenate(words), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        before = np.empty_like(word)
        before[1:] = word[:-1]
        starts = bounds[:-1][bounds[:-1] < bounds[1:]]
        before[starts] = _START
        pairs, pair = _distinct(mix(before * np.uint64(0x9FB21C651E98DF25) + word) >> _SHORTER)
        names, place = _distinct(np.append(word, _START) >> _SHORTER)
        previous = np.empty(len(word), np.int64)
        previous[1:] = place[:-2]
        previous[starts] = place[-1]
        return cls(names, pairs, place[:-1], previous, pair, bounds)

    def counts(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By word ``[as word in other documents and in targets, as context in both]``, by pair ``[in both]``."""
        group = np.repeat(target.astype(np.int64), np.diff(self.bounds))
        by = lambda place, n: np.bincount(place * 2 + group, minlength=2 * n).reshape(n, 2)
        n = len(self.words)
        return np.concatenate([by(self.word, n), by(self.before, n)], 1), by(self.pair, len(self.pairs))


def _blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each fold in order, in tables of about ``BLOCK_BYTES``."""
    held: tuple[list, list] = ([], [])
    size = [0, 0]

    def taken(fold: int) -> pa.Table:
        rows = pa.Table.from_batches(held[fold])
        held[fold].clear()
        size[fold] = 0
        return rows

    for batch in batches:
        for part in steps(batch, text, BLOCK_BYTES):
            folds = _fold(part.column(part.schema.get_field_index(text)))
            for fold in (0, 1):
                own = part.filter(pa.array(folds == fold))
                if size[fold] and size[fold] + own.nbytes > BLOCK_BYTES:
                    yield fold, taken(fold)
                if own.num_rows:
                    held[fold].append(own)
                    size[fold] += own.nbytes
    for fold in (0, 1):
        if held[fold]:
            yield fold, taken(fold)


def _dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The runs of sorted keys that lie in a bucket each; buckets are ranges of keys."""
    bucket = ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets)))
    for start, end in zip(cuts, [*cuts[1:], len(keys)]):
        yield int(bucket[start]), slice(start, end)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


# --- models ------------------------------------------------------------------------------


@dataclass
class Models:
    """A target and a background model over the same corpus, by the frames that they are counted from."""

    corpus: DataFrame
    targets: DataFrame
    id_col: str
    text_col: str


def fit(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Models:
    """Models of all documents, and of those whose ids ``targets`` holds; counted where :func:`score` needs them."""
    return Models(docs, targets, id_col, text_col)


def _losses(block: Block, words: np.ndarray, pairs: np.ndarray, tokens: np.ndarray, vocabulary: int) -> np.ndarray:
    """``[target or background, token]``: negative log probability after the word before.

    ``words`` and ``pairs`` are the counts of the block's own in the other fold, as
    :meth:`Block.counts` has them; ``tokens`` those of other documents and of targets there.
    """
    out = np.empty((2, len(block.word)))
    size = float(tokens[1])
    scale = size / max(1.0, float(tokens.sum()))
    for model in (0, 1):
        total = lambda c: (c[:, 1] if model == 0 else (c[:, 0] + c[:, 1]) * scale).astype(float)  # noqa: E731, B023
        word, context, pair = total(words[:, :2]), total(words[:, 2:]), total(pairs)
        alone = (word[block.word] + 1.0) / (size + vocabulary)
        out[model] = -np.log((pair[block.pair] + PRIOR * alone) / (context[block.before] + PRIOR))
    return out


#: What a block of documents is for: its counts are added up, it asks for those of all, or both.
_COUNTS, _ASKS = 1, 2


def _dealt_blocks(docs: DataFrame, text_col: str, role: int, mark: Mark | None = None) -> DataFrame:
    """``block, role, fold, docs``: documents of a fold in compressed blocks of about ``BLOCK_BYTES`` of text, with a column of marks if asked."""
    schema = "block long, role int, fold int, docs binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (role << 60) | (TaskContext.get().partitionId() << 28)
        for i, (fold, own) in enumerate(_blocks(batches, text_col)):
            own = mark.add(own) if mark else own
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
                out.write_table(own.combine_chunks())
            yield _batch([(first + i, role, fold, sink.getvalue().to_pybytes())], schema)

    return cut(docs.mapInArrow(deal, schema), "lm-blocks")


def _opened(docs: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(docs.as_buffer()).read_all()


@dataclass
class Mark:
    """Sorted ids of targets, to tell them where the documents are dealt."""

    ids: Broadcast
    id_col: str
    flag: str

    def add(self, rows: pa.Table) -> pa.Table:
        known, own = self.ids.value, rows[self.id_col].combine_chunks()
        values = np.asarray(pc.fill_null(own.cast(pa.int64()), 0))
        at = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
        hit = (known[at] == values) if len(known) else np.zeros(len(values), bool)
        return rows.append_column(self.flag, pa.array(hit & np.asarray(own.is_valid())))


def _flagged(models: Models, flag: str) -> tuple[DataFrame, Mark | None]:
    """The corpus, and what tells its targets: up to ``BROADCAST_IDS`` whole numbers as a mark, else a column from a join by shuffle."""
    docs, name = models.corpus, spare(models.corpus, "target_id")
    good = models.targets.select(F.col(models.id_col).alias(name)).where(F.col(name).isNotNull()).distinct()
    whole = all(isinstance(f.schema[c].dataType, T.IntegralType) for f, c in ((docs, models.id_col), (good, name)))
    if whole and good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = np.sort(np.asarray(good.select(F.col(name).cast("long")).toArrow()[name].combine_chunks()))
        return docs, Mark(docs.sparkSession.sparkContext.broadcast(ids), models.id_col, flag)
    good = good.withColumn(flag, F.lit(True)).hint("merge")
    return docs.join(good, F.col(models.id_col) == F.col(name), "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop(name), None


def score(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens, loss_target, loss_background, score``; columns of those names are replaced.

    Losses are means per token in nats; ``score`` is background less target. A null text, or one
    without a word, has 0 tokens and null losses and score. Every document of the corpus counts,
    and repeated rows or ids as often as they occur; a target id marks all rows that have it, a
    null id none. Documents are dealt to two folds by text and scored by models of the other
    fold, so neither their own counts nor those of a copy speak for them. Background counts are
    scaled to the target's number of tokens, so that smoothing weighs as much in both. An empty
    corpus leaves the smoothing only; empty ``docs`` give no rows. Texts are read whole, a long
    one is a block by itself.

    Blocks of documents add up their own words and pairs, and send the distinct ones, with their
    counts, to buckets by ranges of hashes; there are more buckets for more text. A bucket adds
    the counts and returns the sums to each block that asked, which is scored from them. The
    driver gets a few sums.
    """
    flag = spare(models.corpus, "is_target", docs)
    own = docs is models.corpus and text_col == models.text_col
    docs = docs.drop(*(c for c in _RESULT if c != text_col))
    corpus, mark = _flagged(models, flag)
    size = int(corpus.agg(F.sum(F.octet_length(models.text_col))).head()[0] or 0)
    buckets = max(1, -(-size // BUCKET_BYTES))
    if own:
        dealt = _dealt_blocks(corpus.drop(*(c for c in _RESULT if c != text_col)), text_col, _COUNTS | _ASKS, mark)
    else:
        told = F.col(models.id_col).alias(spare(docs, "doc_id_")) if mark else F.col(flag)
        mark = mark and Mark(mark.ids, spare(docs, "doc_id_"), flag)
        counting = corpus.select(F.col(models.text_col).alias(text_col), told)
        dealt = _dealt_blocks(counting, text_col, _COUNTS, mark).unionByName(_dealt_blocks(docs, text_col, _ASKS))
    part = "kind int, bucket int, block long, fold int, asks boolean, keys binary, counts binary"
    replied = "block long, kind int, bucket int, counts binary, sums array<long>"
    result = T.StructType([*docs.schema, *(T.StructField(c, T.LongType() if c == "n_tokens" else T.DoubleType()) for c in _RESULT)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, role, fold, packed in zip(*(batch.column(c).to_pylist() for c in ("block", "role", "fold")), batch.column("docs")):
                rows = _opened(packed)
                block, asks = Block.of(rows, text_col), bool(role & _ASKS)
                counts = block.counts(np.asarray(rows[flag])) if role & _COUNTS else (None, None)
                for kind, (keys, own) in enumerate(zip((block.words, block.pairs), counts)):
                    packs = lambda run: None if own is None else _pack_counts(own[run])  # noqa: E731, B023
                    yield _batch([(kind, b, name, fold, asks, _pack_keys(keys[run]), packs(run)) for b, run in _dealt(keys, buckets)], part)

    def add(rows: pa.Table) -> pa.Table:
        kind, bucket = rows["kind"][0].as_py(), rows["bucket"][0].as_py()
        width = (4, 2)[kind]
        found, folds = [_keys(k) for k in rows["keys"]], rows["fold"].to_pylist()
        bounds = np.concatenate([[0], np.cumsum([len(k) for k in found])])
        keys, place = _distinct(np.concatenate(found))
        total = np.zeros((2, len(keys), width), np.int64)
        for i, packed in enumerate(rows["counts"]):
            if packed.is_valid:
                total[folds[i], place[bounds[i] : bounds[i + 1]]] += _counts(packed, width)
        sums = [*total[:, :, :2].sum(1).ravel().tolist(), int(total[:, :, :2].any((0, 2)).sum())]
        out = [(None, kind, bucket, None, sums)]
        for i, (name, asks) in enumerate(zip(rows["block"].to_pylist(), rows["asks"].to_pylist())):
            if asks:
                out.append((name, kind, bucket, _pack_counts(total[1 - folds[i], place[bounds[i] : bounds[i + 1]]]), None))
        return pa.Table.from_batches([_batch(out, replied)])

    def finish(dealt: pa.Table, replies: pa.Table) -> pa.Table:
        own = _opened(dealt["docs"][0])
        block = Block.of(own, text_col)
        replies = replies.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        found: list[list[np.ndarray]] = [[np.zeros((0, 4), np.int64)], [np.zeros((0, 2), np.int64)]]
        for kind, packed in zip(replies["kind"].to_pylist(), replies["counts"]):
            found[kind].append(_counts(packed, (4, 2)[kind]))
        other = 1 - dealt["fold"][0].as_py()
        both = _losses(block, np.concatenate(found[0]), np.concatenate(found[1]), tokens[2 * other : 2 * other + 2], vocabulary)
        total = np.concatenate([np.zeros((2, 1)), np.cumsum(both, axis=1)], 1)
        n = np.diff(block.bounds)
        mean = (total[:, block.bounds[1:]] - total[:, block.bounds[:-1]]) / np.maximum(n, 1)
        own = own.select([c for c in own.column_names if c != flag])
        for name, values in zip(_RESULT, (n, mean[0], mean[1], mean[1] - mean[0])):
            own = own.append_column(name, pa.array(n) if name == "n_tokens" else pa.array(np.round(values, 6), mask=n == 0))
        return own

    replies = cut(dealt.mapInArrow(count, part).groupBy("kind", "bucket").applyInArrow(add, replied), "lm-replies")
    sums = replies.where("kind = 0 AND block IS NULL").agg(*(F.coalesce(F.sum(F.col("sums")[i]), F.lit(0)) for i in range(5))).head()
    tokens, vocabulary = np.array(sums[:4]), max(WORD_SLOTS, sums[4])
    asking, answers = dealt.where(F.col("role") >= _ASKS), replies.where("block IS NOT NULL").drop("sums")
    return asking.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, result)


def trusted(labels: DataFrame) -> DataFrame:
    """Ids of documents that every label calls good and none toxic."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id")


def op3_lm_score(spark, sf_dir):
    """Every document against the documents labelled as good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, trusted(table(spark, sf_dir, "labels")))).drop("text")
