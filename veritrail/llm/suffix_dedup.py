"""Removal of repeated byte strings with suffix buckets refined by bucket pointers.

Every string of ``LENGTH`` bytes holds one anchor: its leftmost q-gram of least hash. Equal
strings have equal anchors at equal places, so only anchors that occur twice matter, and the
strings around equal anchors are all that has to be sorted together. There, suffixes start in
buckets of equal q-grams, and each bucket is refined by the buckets of later offsets, whose
refinements are used in turn, until the buckets are those of equal strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import flat_utf8, steps
from .jaccard_join import _width, mark_shared
from .scratch import cut, table
from .shingles import mix
from .streams import whole_groups

LENGTH = 100
#: Bytes of an anchor; a string of LENGTH has LENGTH - ANCHOR + 1 places for it.
ANCHOR = 32
#: Text bytes of one vectorised step.
STEP = 1 << 20
#: Anchors of more texts are long lists, whose contexts are dealt into parts; documents of a part, on average.
LONG_LIST, PART_DOCS = 4096, 16_384
#: Bytes whose places are told apart by so many bits.
_PLACE_BITS = np.uint64(28)
PIECE = 1 << 27


# --- anchors -----------------------------------------------------------------------------


def anchor_runs(data: np.ndarray, offsets: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring string starts with a common anchor: hash of the anchor, first and last start.

    Places count from the start of ``data``; a run lies in one document. More than ``piece``
    bytes, so a very long document, are read in pieces that share the strings on their borders.
    """
    found = []
    for at in range(0, max(1, len(data)), piece):
        end = min(len(data), at + piece + LENGTH - 1)
        inside = np.unique(np.clip(offsets, at, end)) - at
        tokens, first, last = _piece_runs(data[at:end], inside if len(inside) > 1 else np.zeros(2, np.int64))
        found.append((tokens, first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*found))


def _piece_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    n = len(data)
    if n < LENGTH:
        return none
    value, width, factor = mix(data.astype(np.uint64) + np.uint64(1)), 1, 0x9E3779B97F4A7C15
    while width < ANCHOR:
        value = value[: n - 2 * width + 1] * np.uint64(factor) + value[width:]
        width, factor = 2 * width, (factor * factor) & 0xFFFFFFFFFFFFFFFF | 1
    value = mix(value)
    place = np.arange(len(value), dtype=np.uint64)
    least = (value >> _PLACE_BITS << _PLACE_BITS) | place
    room, width = LENGTH - ANCHOR + 1, 1
    while 2 * width <= room:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if room > width:
        least = np.minimum(least[: len(least) - (room - width)], least[room - width :])
    inside = np.zeros(n + 1, np.int32)
    ends = np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1])
    np.add.at(inside, offsets[:-1], 1)
    np.add.at(inside, ends, -1)
    starts = np.flatnonzero(np.cumsum(inside)[: len(least)] > 0)
    if not len(starts):
        return none
    anchor = (least[starts] & np.uint64((1 << 28) - 1)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return value[anchor[first]], starts[first], starts[last]


_CONTEXTS = ["token", "doc_id", "key", "start", "end", "context", "long"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, key, text``: an even 64-bit key of the text; the odd number after it stands for a second place in the same text."""
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit(-2))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.col(text_col).alias("text"))


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, key, n, sha``."""
    for batch in batches:
        for part in steps(batch, limit=STEP):
            data, offsets = flat_utf8(part.column(2))
            shas = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(offsets)), pa.array(shas, pa.binary())], ["doc_id", "key", "n", "sha"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``token, hi``: anchors with the key of their text, and once more with the odd key if the text repeats them."""
    for batch in batches:
        for part in steps(batch, limit=STEP):
            data, offsets = flat_utf8(part.column(1))
            tokens, first, _ = anchor_runs(data, offsets)
            if not len(tokens):
                continue
            doc = np.searchsorted(offsets, first, "right") - 1
            token, owner = tokens.view(np.int64), np.asarray(part.column(0))[doc]
            order = np.lexsort((token, doc))
            token, owner, doc = token[order], owner[order], doc[order]
            same = np.zeros(len(token), bool)
            same[1:] = (token[1:] == token[:-1]) & (doc[1:] == doc[:-1])
            third = same.copy()
            third[1:] &= same[:-1]
            third[:1] = False
            owner = owner + same
            keep = ~third
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(owner[keep])], ["token", "hi"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``token, doc_id, key, start, end, context, long`` of the rows' repeated anchors: the bytes of all strings of a run.

    A context that its document has before is a copy as a whole; of such there is only a row
    without a context for each stretch of them.
    """
    for batch in batches:
        for part in steps(batch, limit=STEP):
            column = {f.name: part.column(i) for i, f in enumerate(part.schema)}
            data, offsets = flat_utf8(column["text"])
            tokens, first, last = anchor_runs(data, offsets)
            tokens, doc = tokens.view(np.int64), np.searchsorted(offsets, first, "right") - 1
            bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
            chosen, flags = [], []
            for d in range(part.num_rows):
                own = tokens[bounds[d] : bounds[d + 1]]
                for name in ("short", "long"):
                    wanted = np.asarray(column[name][d].values)
                    if len(wanted):
                        hit = np.flatnonzero(np.isin(own, wanted)) + bounds[d]
                        chosen.append(hit)
                        flags.append(np.full(len(hit), name == "long"))
            if not chosen:
                continue
            at, flag = np.concatenate(chosen), np.concatenate(flags)
            raw = data.tobytes()
            bodies = [raw[a : b + LENGTH] for a, b in zip(first[at].tolist(), last[at].tolist())]
            own, seen, kept, copies = doc[at].tolist(), set(), [], []
            for i, body in enumerate(bodies):
                if (own[i], body) in seen:
                    copies.append(i)
                else:
                    seen.add((own[i], body))
                    kept.append(i)
            starts = first[at] - offsets[doc[at]]
            ids, keys = (column[c].take(pa.array(doc[at])) for c in ("doc_id", "key"))
            rows = pa.array(kept, pa.int64())
            ends = starts + np.array([len(x) for x in bodies])
            arrays = [ids.take(rows), keys.take(rows), pa.array(starts[kept]), pa.array(ends[kept]), pa.array([bodies[i] for i in kept], pa.binary()), pa.array(flag[kept])]
            yield pa.RecordBatch.from_arrays([pa.array(tokens[at[kept]]), *arrays], _CONTEXTS)
            if copies:
                order = np.array(copies)[np.lexsort((starts[copies], doc[at[copies]]))]
                apart = np.ones(len(order), bool)
                apart[1:] = (doc[at[order[1:]]] != doc[at[order[:-1]]]) | (starts[order[1:]] > ends[order[:-1]])
                begin = np.flatnonzero(apart)
                stop = np.maximum.reduceat(ends[order], begin)
                whole, n = pa.array(order[begin]), len(begin)
                arrays = [ids.take(whole), keys.take(whole), pa.array(starts[order[begin]]), pa.array(stop), pa.nulls(n, pa.binary()), pa.nulls(n, pa.bool_())]
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), *arrays], _CONTEXTS)


# --- buckets -----------------------------------------------------------------------------


def refine(pointer: np.ndarray, offsets: list[int], starts: np.ndarray) -> np.ndarray:
    """Bucket pointers of ``starts`` after sorting each bucket by the buckets of later offsets.

    ``pointer`` holds for every place the number of suffixes in smaller buckets. Buckets of one
    suffix are left as they are; the others get pointers that tell their refined buckets apart.
    """
    out = np.full(len(pointer), -1, np.int64)
    own = pointer[starts]
    many = np.bincount(own, minlength=len(pointer) + 1)[own] > 1
    out[starts[~many]] = own[~many]
    at = starts[many]
    if not len(at):
        return out
    keys = [pointer[at + d] for d in reversed(offsets)]
    order = np.lexsort((*keys, own[many]))
    at = at[order]
    new = np.ones(len(at), bool)
    new[1:] = pointer[at[1:]] != pointer[at[:-1]]
    bucket = new.copy()
    for d in offsets:
        new[1:] |= pointer[at[1:] + d] != pointer[at[:-1] + d]
    place = np.arange(len(at))
    group_start = np.maximum.accumulate(np.where(bucket, place, 0))
    refined_start = np.maximum.accumulate(np.where(new, place, 0))
    out[at] = pointer[at] + refined_start - group_start
    return out


def string_buckets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all strings of ``LENGTH`` bytes inside the contexts, and a pointer by bucket of equal strings."""
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(data))
    q = 8
    grams = np.zeros(len(data), np.uint64)
    for k in range(q):
        shifted = np.zeros(len(data), np.uint64)
        shifted[: len(data) - k] = data[k:]
        grams = (grams << np.uint64(8)) | shifted
    starts = np.flatnonzero(room >= q)
    pointer = np.full(len(data), -1, np.int64)
    order = starts[np.argsort(grams[starts], kind="stable")]
    new = np.ones(len(order), bool)
    new[1:] = grams[order[1:]] != grams[order[:-1]]
    pointer[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    depth = q
    while depth < LENGTH:
        reach = min(3 * depth, LENGTH)
        offsets = [depth, 2 * depth] if reach == 3 * depth else [d for d in (depth, LENGTH - depth) if d <= LENGTH - depth]
        starts = np.flatnonzero(room >= reach)
        pointer = refine(pointer, sorted(set(offsets)), starts)
        depth = reach
    return starts, pointer[starts]


def _runs(found: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs of neighbouring starts in one row."""
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1] + 1) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(found)) - 1


def _refine_block(block: pa.RecordBatch, bounds: np.ndarray, column: int, firsts: bool) -> tuple[pa.RecordBatch | None, pa.RecordBatch | None]:
    """Spans ``doc_id, key, start, end`` of later copies in a block of groups, and, if asked, the first copies ``doc_id, key, start, digest``.

    From ``column`` on stand doc_id, key, start and context, in that order in each group. A context
    that equals an earlier one of its group is a copy as a whole; only others are refined, and
    only where a group has several.
    """
    contexts = block.column(column + 3).to_pylist()
    starts, docs, keys = np.asarray(block.column(column + 2)), block.column(column), block.column(column + 1)
    whole, chosen = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        seen: set[bytes] = set()
        own = []
        for i in range(a, b):
            if contexts[i] in seen:
                whole.append(i)
            else:
                seen.add(contexts[i])
                own.append(i)
        if len(own) > 1 or firsts:
            chosen += own
    row, begin, end = [np.array(whole, np.int64)], [starts[whole]], [starts[whole] + np.array([len(contexts[i]) for i in whole], np.int64)]
    first_copies = None
    if chosen:
        sizes = np.array([len(contexts[i]) for i in chosen])
        limits = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join([contexts[i] for i in chosen]), np.uint8)
        chosen = np.array(chosen)
        places, bucket = string_buckets(data, limits)
        group = np.searchsorted(bounds, chosen, "right")[np.searchsorted(limits, places, "right") - 1]
        order = np.lexsort((places, group, bucket))
        again = np.zeros(len(order), bool)
        again[1:] = (bucket[order[1:]] == bucket[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
        found = np.sort(places[order[again]])
        if len(found):
            r = np.searchsorted(limits, found, "right") - 1
            first, last = _runs(found, r)
            base = starts[chosen[r[first]]] - limits[r[first]]
            row.append(chosen[r[first]])
            begin.append(found[first] + base)
            end.append(found[last] + base + LENGTH)
        if firsts:
            places = np.sort(places[order[~again]])
            r = np.searchsorted(limits, places, "right") - 1
            raw = data.tobytes()
            digests = [hashlib.blake2b(raw[p : p + LENGTH], digest_size=16).digest() for p in places.tolist()]
            at = pa.array(chosen[r])
            arrays = [docs.take(at), keys.take(at), pa.array(places - limits[r] + starts[chosen[r]]), pa.array(digests, pa.binary())]
            first_copies = pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "start", "digest"])
    row = pa.array(np.concatenate(row))
    if not len(row):
        return None, first_copies
    arrays = [docs.take(row), keys.take(row), pa.array(np.concatenate(begin)), pa.array(np.concatenate(end))]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "start", "end"]), first_copies


_SPAN = ["doc_id", "key", "start", "end"]
_SPAN_TYPES = "doc_id long, key long, start long, end long"


def _refine_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of rows ``token, doc_id, key, start, context`` sorted by the first four."""
    for block, bounds in whole_groups(batches, 1, rows=2000):
        spans, _ = _refine_block(block, bounds, 1, False)
        if spans is not None:
            yield spans


def _refine_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans, and first copies with their digest, of rows ``token, part, doc_id, key, start, context`` sorted by the first five."""
    for block, bounds in whole_groups(batches, 2, rows=2000):
        spans, first = _refine_block(block, bounds, 2, True)
        if spans is not None:
            yield pa.RecordBatch.from_arrays([*spans.columns, pa.nulls(spans.num_rows, pa.binary())], [*_SPAN, "digest"])
        if first is not None:
            yield pa.RecordBatch.from_arrays([*first.columns[:3], pc.add(first.column(2), LENGTH), first.column(3)], [*_SPAN, "digest"])


def _long_spans(contexts: DataFrame, parts: int) -> DataFrame:
    """Spans for anchors with very many places.

    Their contexts are dealt into parts by document, and each part is refined by itself. What
    is first in its part is then compared between parts by its digest: the first place of each
    string comes from an aggregate with map-side combining, others are copies after all.
    """
    dealt = contexts.select("token", F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)).cast("int").alias("part"), "doc_id", "key", "start", "context")
    rows = dealt.repartition(_width(contexts.sparkSession), "token", "part").sortWithinPartitions("token", "part", "doc_id", "key", "start")
    found = cut(rows.mapInArrow(_refine_parts, f"{_SPAN_TYPES}, digest binary"), "parts")
    firsts, place = found.where("digest IS NOT NULL"), F.struct("doc_id", "key", "start")
    winners = firsts.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    again = firsts.join(winners, "digest").where(place != F.col("first"))
    return found.where("digest IS NULL").select(*_SPAN).unionByName(again.select(*_SPAN))


# --- result ------------------------------------------------------------------------------


def _kept(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and what is left."""
    left, at, runs, removed = [], 0, 0, 0
    for start, end in sorted(spans):
        if start > at or (runs == 0 and start == at):
            left.append(data[at:start])
            runs, removed, at = runs + 1, removed + end - start, end
        elif end > at:
            removed, at = removed + end - at, end
    left.append(data[at:])
    return removed, runs, b"".join(left)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, limit=STEP):
            data, offsets = flat_utf8(part.column(1))
            raw, rows = data.tobytes(), []
            for i, spans in enumerate(part.column(2).to_pylist()):
                own = raw[offsets[i] : offsets[i + 1]]
                removed, runs, left = _kept(own, [(s["start"], min(s["end"], len(own))) for s in spans or []])
                rows.append((len(own), removed, runs, hashlib.sha256(left).hexdigest()))
            columns = list(zip(*rows))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_list: int = LONG_LIST) -> DataFrame:
    """``doc_id, key, spans`` (array of start, end) of the documents that hold a repeated string; spans may overlap.

    ``key`` is that of the text, see :func:`remove_repeats` for one id on several texts.
    """
    texts = _keyed(docs, id_col, text_col).where("doc_id IS NOT NULL")
    width = _width(docs.sparkSession)
    profiles = cut(texts.mapInArrow(_profiles, "doc_id long, key long, n long, sha binary"), "profiles")
    first = profiles.groupBy("sha").agg(F.min("doc_id").alias("first"), F.first("key").alias("key"), F.first("n").alias("n"))
    first = cut(first.where(f"n >= {LENGTH}"), "first")
    copies = profiles.select("doc_id", "sha").join(first, "sha").where("doc_id <> first").select("doc_id", "key", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))

    anchors = texts.select("key", "text").mapInArrow(_anchors, "token long, hi long").repartition(width, "token").sortWithinPartitions("token", "hi")
    shared = anchors.mapInArrow(lambda batches: mark_shared(batches, long_list), "hi long, token long, long boolean")
    shared = shared.withColumn("key", F.col("hi").bitwiseAND(F.lit(-2)))
    tokens = lambda long, name: F.collect_set(F.when(F.col("long") == long, F.col("token"))).alias(name)
    listed = shared.groupBy("key").agg(tokens(False, "short"), tokens(True, "long"))
    wanted = cut(listed.join(first.select(F.col("first").alias("doc_id"), "key"), "key"), "wanted")
    held = texts.join(wanted.hint("merge"), ["doc_id", "key"]).select("doc_id", "key", "text", "short", "long")
    contexts = cut(held.mapInArrow(_contexts, f"token long, {_SPAN_TYPES}, context binary, long boolean"), "contexts")
    order = ("token", "doc_id", "key", "start")
    short = contexts.where("NOT long").select(*order, "context").repartition(width, "token").sortWithinPartitions(*order)
    parts = max(16, -(-profiles.count() // PART_DOCS))
    spans = (
        short.mapInArrow(_refine_groups, _SPAN_TYPES)
        .unionByName(_long_spans(contexts.where("long"), parts))
        .unionByName(copies)
        .unionByName(contexts.where("context IS NULL").select(*_SPAN))
    )
    return spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_list: int = LONG_LIST) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    A byte goes if it is covered by a string of ``LENGTH`` bytes of the UTF-8 text that also
    starts earlier: in a document of smaller id, or earlier in the same one, overlaps included.
    Strings are those of the input and never cross documents. A null text counts as empty.
    Rows that repeat a document are that document. Several texts of one id are documents of
    their own, in the order of a 64-bit key of the text. A row without an id neither loses bytes
    nor counts as earlier. An empty table gives no rows; columns but the two named are not read.
    Very long texts are read in pieces that overlap.
    """
    spans = cut(repeated_spans(docs, id_col, text_col, long_list), "spans")
    both = _keyed(docs, id_col, text_col).join(spans.hint("merge"), ["doc_id", "key"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_suffix_dedup(spark, sf_dir):
    """Repeated strings of all ``documents`` by :func:`remove_repeats`."""
    return remove_repeats(table(spark, sf_dir, "documents"))
