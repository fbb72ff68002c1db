"""N-gram Jaccard join by T-occurrence search.

Documents are sets of hashed word shingles. Sets that reach the threshold share a minimum
number of shingles (T), also within prefixes of a global order; this finds the few documents
that can have a partner at all. Those are gathered by a shingle they share, and each group is
searched with an inverted index by DivideSkip: short lists are merged, long ones are probed,
and documents that reach the required overlap are linked. What remains between groups is
counted over the short lists of shared shingles, with room for the long ones, and every pair
that can still reach T is verified.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import flat_utf8, steps
from .components import connected_components
from .scratch import cut, spare, table
from .shingles import shingle_sets
from .streams import whole_groups

SHINGLE_WORDS = 5
#: Similarity in percent from which two documents link.
PERCENT = 75
#: Lists of more documents are long: they are probed, not merged.
LONG_LIST = 64
#: Shingles of the documents that are searched together, about.
GROUP_SHINGLES = 2_000_000


# --- bounds ------------------------------------------------------------------------------


def least_share(n):
    """Shingles of a set of n that any partner must have: ceil(n * PERCENT / 100)."""
    return -(-n * PERCENT // 100)


def required_overlap(n, m):
    """Smallest intersection of sets of n and m with 100 * intersection >= PERCENT * union."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def prefix_common(n):
    """Shared shingles that the prefix of a set of n must show: ceil(0.08 n)."""
    return -(-n * 8 // 100)


def prefix_size(n):
    """Length of the prefix: the first ``prefix_common(n)`` shingles shared with any partner lie in it."""
    return n - least_share(n) + prefix_common(n)


# --- search ------------------------------------------------------------------------------


def merge_counts(lists: list[array], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of at least ``least`` of the ascending lists, and in how many they are."""
    if sum(map(len, lists)) > 500:
        counts = np.bincount(np.concatenate([np.frombuffer(x, np.int64) for x in lists]))
        members = np.flatnonzero(counts >= least)
        return members, counts[members]
    members, counts = [], []
    heap = [(x[0], k, 0) for k, x in enumerate(lists) if x]
    heapq.heapify(heap)
    while heap:
        member, count = heap[0][0], 0
        while heap and heap[0][0] == member:
            _, k, place = heap[0]
            count += 1
            if place + 1 < len(lists[k]):
                heapq.heapreplace(heap, (lists[k][place + 1], k, place + 1))
            else:
                heapq.heappop(heap)
        if count >= least:
            members.append(member)
            counts.append(count)
    return np.array(members, np.int64), np.array(counts, np.int64)


def divide_skip(index: dict[int, array], query: list[int], least: int) -> dict[int, int]:
    """Documents of the index that share at least ``least`` shingles with the query, and how many."""
    lists = [index[t] for t in query if t in index]
    if len(lists) < least or least < 1:
        return {}
    lists.sort(key=len)
    aside = min(least - 1, int(least / (0.01 * math.log2(len(lists[-1]) + 1) + 1))) if len(lists[-1]) > 4 else 0
    members, counts = merge_counts(lists[: len(lists) - aside], least - aside)
    for k in range(len(lists) - aside, len(lists)):
        if not len(members):
            break
        own = np.frombuffer(lists[k], np.int64)
        at = np.searchsorted(own, members)
        at[at == len(own)] = 0
        counts = counts + (own[at] == members)
        keep = counts + (len(lists) - k - 1) >= least
        if not keep.all():
            members, counts = members[keep], counts[keep]
    return dict(zip(members.tolist(), counts.tolist()))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets, by binary probes of the longer one."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def link_groups(sets: list[np.ndarray], known: list[int] | None = None) -> list[int]:
    """For each set the place of the first set of its component; links are exact. Sets come by size.

    ``known`` labels sets that are in one component already.

    Pairs inside a component need no test. So the largest component has an index of its own,
    which is searched only for sets that don't link to one of its last members at once: a
    group of thousands of near copies takes about one test for each.
    """
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            a, b = min(a, b), max(a, b)
            parent[b] = a
            members[a] += members[b]

    members = [1] * len(sets)
    large: int | None = None
    recent: list[int] = []
    indexes: tuple[dict[int, array], dict[int, array]] = ({}, {})
    seen: dict[int, int] = {}
    for i, own in enumerate(sets):
        n, query = len(own), own.tolist()
        inside = False
        if known is not None:
            join(i, seen.setdefault(known[i], i))
        if large is not None:
            inside = root(i) == root(large)
            for j in [] if inside else recent:
                if overlap(own, sets[j]) >= required_overlap(n, len(sets[j])):
                    join(i, j)
                    inside = True
                    break
        for index in indexes[:1] if inside else indexes:
            for j, count in divide_skip(index, query, least_share(n)).items():
                if count >= required_overlap(n, len(sets[j])):
                    join(i, j)
        top = root(i)
        if members[top] >= 16 and (large is None or root(large) == top or members[top] > members[root(large)]):
            if large is None or root(large) != top:
                # Another component leads: only its later members go to the second index.
                for t, places in indexes[1].items():
                    indexes[0][t] = array("q", sorted([*indexes[0].get(t, ()), *places]))
                indexes[1].clear()
                recent = []
            large = top
        is_large = large is not None and root(large) == top
        if is_large:
            recent = [i, *recent[:2]]
        target = indexes[1] if is_large else indexes[0]
        for t in query:
            if t in target:
                target[t].append(i)
            else:
                target[t] = array("q", (i,))
    return [root(i) for i in range(len(sets))]


# --- stages ------------------------------------------------------------------------------


def _sets(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    values, bounds = shingle_sets(*flat_utf8(part.column(part.schema.get_field_index("text"))), SHINGLE_WORDS)
    return (values ^ np.uint64(1 << 63)).view(np.int64), bounds  # keeps the order


def _digest(own: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, key, n, hi, lo`` of ``doc_id, key, text``: size and digest of each document's set."""
    for batch in batches:
        for part in steps(batch):
            values, bounds = _sets(part)
            marks = [_digest(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            digests = [pa.array([m[k] for m in marks], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(bounds)), *digests], ["doc_id", "key", "n", "hi", "lo"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``token, hi``: the prefix of each document's set; once for equal sets of a step."""
    for batch in batches:
        for part in steps(batch):
            values, bounds = _sets(part)
            tokens, owners, seen = [], [], set()
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if b > a:
                    hi, _ = _digest(values[a:b])
                    if hi not in seen:
                        seen.add(hi)
                        size = prefix_size(b - a)
                        tokens.append(values[a : a + size])
                        owners.append(np.full(size, hi))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(owners))], ["token", "hi"])


def mark_shared(batches: Iterator[pa.RecordBatch], limit: int = LONG_LIST) -> Iterator[pa.RecordBatch]:
    """``hi, token, long`` of sorted postings ``token, hi`` whose token has two owners at least.

    ``long`` are those with over ``limit``. Needs no more of a list than shows that it is long;
    the rest of it streams through.
    """
    token, owner = np.zeros(0, np.int64), np.zeros(0, np.int64)
    previous: tuple | None = None
    streaming: int | None = None

    def rows(t: np.ndarray, h: np.ndarray, long: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(t), pa.array(long)], ["hi", "token", "long"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t, h = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        fresh = np.ones(len(t), bool)
        fresh[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
        fresh[0] = previous != (t[0], h[0])
        previous = (t[-1], h[-1])
        token, owner = np.concatenate([token, t[fresh]]), np.concatenate([owner, h[fresh]])
        if not len(token):
            continue
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.append(starts, len(token)))
        flowing = token[starts] == streaming if streaming is not None else np.zeros(len(starts), bool)
        long = flowing | (sizes > limit)
        out = long | (sizes > 1)
        if not long[-1]:
            out[-1] = False
        keep = np.repeat(out, sizes)
        if keep.any():
            yield rows(token[keep], owner[keep], np.repeat(long, sizes)[keep])
        if long[-1]:
            streaming, token, owner = token[-1], token[:0], owner[:0]
        else:
            streaming, token, owner = None, token[starts[-1] :], owner[starts[-1] :]
    if len(token) > 1:
        yield rows(token, owner, np.zeros(len(token), bool))


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``cid, n, tokens`` of rows ``cid, hi, text`` whose set has the digest ``hi``."""
    for batch in batches:
        for part in steps(batch):
            values, bounds = _sets(part)
            his = part.column(1).to_pylist()
            keep = [i for i in range(part.num_rows) if _digest(values[bounds[i] : bounds[i + 1]])[0] == his[i]]
            tokens = pa.array([values[bounds[i] : bounds[i + 1]].tobytes() for i in keep], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), pa.array(np.diff(bounds)[keep]), tokens], ["cid", "n", "tokens"])


def _set_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``token, hi`` of every member of the sets ``cid, tokens``."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            sizes = np.asarray(pc.binary_length(part.column(1))).astype(np.int64) // 8
            tokens = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.repeat(np.asarray(part.column(0)), sizes))], ["token", "hi"])


def _search_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``cid, comp`` for rows ``home, part, n, cid, tokens`` sorted by these; equal cids count once."""
    for block, bounds in whole_groups(batches, 2, rows=2000):
        ids = block.column(3).to_pylist()
        comps = list(ids)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a > 1:
                sets = [np.frombuffer(x.as_buffer(), np.int64) for x in block.column(4).slice(a, b - a)]
                for i, r in enumerate(link_groups(sets)):
                    comps[a + i] = ids[a + r]
        yield pa.RecordBatch.from_arrays([block.column(3), pa.array(comps, pa.int64())], ["cid", "comp"])


def _search(sets: DataFrame) -> DataFrame:
    """Local components of ``cid, n, home, tokens`` among documents with a common home.

    A home with more shingles than a group may have is dealt into parts by document.
    """
    spark = sets.sparkSession
    parts = sets.groupBy("home").agg(F.ceil(F.sum("n") / GROUP_SHINGLES).cast("int").alias("parts")).where("parts > 1")
    dealt = sets.join(parts, "home", "left").withColumn("part", F.pmod(F.xxhash64("cid"), F.coalesce("parts", F.lit(1))).cast("int"))
    rows = dealt.select("home", "part", "n", "cid", "tokens")
    found = rows.repartition(_width(spark), "home", "part").sortWithinPartitions("home", "part", "n", "cid").mapInArrow(_search_groups, "cid long, comp long")
    return found.join(dealt.select("cid", "home", "part"), "cid")


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b``: known components that link, from rows ``family, block, n, cid, comp, tokens`` sorted by the first four."""
    for block, bounds in whole_groups(batches, 2, rows=2000):
        comps = block.column(4).to_pylist()
        pairs = set()
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = comps[a:b]
            if len(set(own)) > 1:
                sets = [np.frombuffer(x.as_buffer(), np.int64) for x in block.column(5).slice(a, b - a)]
                pairs |= {(own[i], own[r]) for i, r in enumerate(link_groups(sets, own)) if own[i] != own[r]}
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def _long_links(member: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: components that link though their documents may share long lists only.

    Both documents of such a pair have enough shingles on long lists to reach the threshold.
    Those documents are gathered in families, joined by the long lists on which more than one
    component is left, and each family is searched. A family of more shingles than a group may
    have is dealt into parts, and every two parts are searched together in a task of their own.
    """
    held = member.where("many >= least").select("cid", "comp", F.explode("long").alias("token"))
    mixed = held.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("cid").alias("b")).where("low <> high").select("token", "b")
    edges = held.join(mixed, "token").select(F.col("cid").alias("a"), "b")
    family = connected_components(edges).select(F.col("node").alias("cid"), F.col("component").alias("family"))
    rows = cut(sets.select("cid", "n", "tokens").join(family, "cid").join(member.select("cid", "comp"), "cid"), "family-sets")
    parts = rows.groupBy("family").agg(F.ceil(F.sum("n") / GROUP_SHINGLES).cast("int").alias("parts"))
    dealt = rows.join(parts, "family").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = dealt.select("family", (F.least("part", "other") * F.col("parts") + F.greatest("part", "other")).alias("block"), "n", "cid", "comp", "tokens")
    sorted_blocks = blocks.repartition(_width(member.sparkSession), "family", "block").sortWithinPartitions("family", "block", "n", "cid")
    return sorted_blocks.mapInArrow(_search_blocks, "a long, b long")


def _width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _cross_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``x, y`` for rows ``token, cid, n, comp, home, part``: pairs of a list that no search has compared.

    Both in one component, or in one searched group, or of sizes too far apart, are left out.
    """
    xs: list[np.ndarray] = []
    ys: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal xs, ys, size
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys))], ["x", "y"])
        xs, ys, size = [], [], 0
        return out

    for block, bounds in whole_groups(batches, 1):
        cid, n, comp, home, part = (np.asarray(block.column(k)) for k in range(1, 6))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a < 2 or (comp[a:b] == comp[a]).all():
                continue
            for i in range(a, b - 1):
                rest = slice(i + 1, b)
                apart = (comp[rest] != comp[i]) & ((home[rest] != home[i]) | (part[rest] != part[i]))
                apart &= (100 * np.minimum(n[rest], n[i]) >= PERCENT * np.maximum(n[rest], n[i])) & (cid[rest] != cid[i])
                if apart.any():
                    other = cid[rest][apart]
                    xs.append(np.minimum(other, cid[i]))
                    ys.append(np.maximum(other, cid[i]))
                    size += len(other)
                    if size >= 50_000:
                        yield flush()
    if size:
        yield flush()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b`` of the pairs ``a, b, x_tokens, y_tokens`` whose sets reach the threshold."""
    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), np.int64) for k in (2, 3))
            if overlap(x, y) >= required_overlap(len(x), len(y)):
                keep.append(i)
        chosen = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1)], ["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``a, b`` pairs whose sets reach the threshold."""
    tokens = sets.select("cid", "tokens")
    both = pairs.join(tokens.toDF("a", "a_tokens"), "a").join(tokens.toDF("b", "b_tokens"), "b")
    return both.select("a", "b", "a_tokens", "b_tokens").mapInArrow(_verify, "a long, b long")


def _merge_leaders(member: DataFrame, sets: DataFrame) -> DataFrame:
    """``member`` with components joined whose first documents link and share long lists.

    Groups of very many near copies fall into several components, as not all copies hold the
    shingle that gathers most of them. On every long list the first document of the component
    with most of its documents is tested against those of the others: a number of tests that
    grows with the components, where pairs across them would grow with the square of the group.
    Only tests are saved; what is not joined here is searched for as before.
    """
    for _ in range(2):
        held = member.where("many >= least").select("comp", F.explode("long").alias("token")).groupBy("token", "comp").agg(F.count(F.lit(1)).alias("docs"))
        most = held.groupBy("token").agg(F.max_by("comp", F.struct("docs", "comp")).alias("a"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("token", "a")
        star = held.join(most, "token").where("comp <> a").groupBy("a", F.col("comp").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
        size = member.where("cid = comp").select("cid", "least")
        star = star.join(size.toDF("a", "a_least"), "a").join(size.toDF("b", "b_least"), "b").where("2 * shared >= least(a_least, b_least)").select("a", "b")
        top = connected_components(_verified(star, sets))
        if not top.head(1):
            break
        member = cut(member.join(top, F.col("comp") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "comp")).drop("node", "component"), "member")
    return member


def _text_key(text) -> Column:
    """64 bits by which the texts of one id are told apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` for every row.

    Words are runs of bytes other than white space (space, 0x09-0x0D) with A-Z as a-z; the set
    holds the distinct runs of five words, or the whole sequence of fewer words. Two documents
    link when 100 * intersection >= 75 * union; ``component_id`` is the smallest id reachable,
    ``class_id`` that of documents with the same set. A document without words (null or empty
    text) links with nothing: both are its own id. Rows without an id take part like others,
    and are named only where no document of theirs has an id. Repeated rows are one document;
    one id on two texts is two, each with the links of its text. An empty table gives no rows;
    columns but the two named are not read. Shingles are compared by 64-bit hashes.
    """
    return _labelled(docs, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, key, n, class_id, component_id, kept`` for every row; ``kept`` tells the one document of its component that stays."""
    spark = docs.sparkSession
    width = _width(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    profiles = cut(texts.mapInArrow(_profiles, "doc_id long, key long, n long, hi long, lo long"), "profiles")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first")
    classes = profiles.where("n > 0").groupBy("hi", "lo").agg(first, F.first("n").alias("n"))
    classes = cut(classes.select("hi", "lo", "n", "first.*").withColumn("cid", F.monotonically_increasing_id()), "classes")

    # Documents of whose prefix enough shingles have another owner.
    postings = texts.select("text").mapInArrow(_postings, "token long, hi long").repartition(width, "token").sortWithinPartitions("token", "hi")
    shared = postings.mapInArrow(mark_shared, "hi long, token long, long boolean").groupBy("hi").agg(F.count(F.lit(1)).alias("shared"))
    prefixed = cut(shared.join(classes, "hi").where(f"shared >= {_sql_prefix_common(_sql_least_share('n'))}").select("cid", "hi", F.col("doc_id").alias("first_id"), F.col("key").alias("first_key")), "prefixed")
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key"))
    wanted = texts.join(prefixed.hint("merge"), same).select("cid", "hi", "text")
    sets = cut(wanted.mapInArrow(_set_rows, "cid long, n long, tokens binary").dropDuplicates(["cid"]), "sets")

    # Of these, documents of whose whole set enough shingles have another owner among them.
    postings = sets.select("cid", "tokens").mapInArrow(_set_postings, "token long, hi long").repartition(width, "token").sortWithinPartitions("token", "hi")
    shared = postings.mapInArrow(mark_shared, "hi long, token long, long boolean")
    listed = shared.groupBy(F.col("hi").alias("cid")).agg(F.collect_list(F.when(~F.col("long"), F.col("token"))).alias("short"), F.collect_list(F.when(F.col("long"), F.col("token"))).alias("long"))
    live = listed.join(sets.select("cid", "n"), "cid").where(f"size(short) + size(long) >= {_sql_least_share('n')}")
    live = cut(live.withColumn("home", F.coalesce(F.array_min("short"), F.array_min("long"))), "live")
    sets = cut(sets.join(live.select("cid", "home"), "cid"), "live-sets")

    # Search within groups of a common shingle.
    found = cut(_search(sets), "found")
    split = found.where("part > 0").select("home").distinct()
    if split.head(1):
        # Homes that were dealt into parts: search among the parts' representatives.
        heads = found.join(split, "home", "left_semi").where("cid = comp").select("cid")
        merged = _search(sets.join(heads, "cid", "left_semi")).select(F.col("cid").alias("comp"), F.col("comp").alias("head"))
        found = cut(found.join(merged, "comp", "left").select("cid", F.coalesce("head", "comp").alias("comp"), "home", "part"), "found")

    # Pairs across groups that can still reach the threshold.
    member = live.join(found.drop("home"), "cid").withColumns({"many": F.size("long"), "least": F.expr(_sql_least_share("n"))})
    member = _merge_leaders(cut(member, "member"), sets)
    columns = ("token", "cid", "n", "comp", "home", "part")
    by_token = lambda rows: rows.repartition(width, "token").sortWithinPartitions("token", "comp", "cid").mapInArrow(_cross_pairs, "x long, y long")
    short = by_token(member.withColumn("token", F.explode("short")).select(*columns))
    size = member.select("cid", "n", "many")
    counted = short.groupBy("x", "y").agg(F.count(F.lit(1)).alias("few"))
    sized = counted.join(size.toDF("x", "x_n", "x_many"), "x").join(size.toDF("y", "y_n", "y_many"), "y")
    needed = f"({PERCENT} * (x_n + y_n) + {99 + PERCENT}) div {100 + PERCENT}"
    possible = cut(sized.where(f"few + least(x_many, y_many) >= {needed}").select(F.col("x").alias("a"), F.col("y").alias("b")), "possible")
    comp = member.select("cid", "comp")
    edges = _verified(possible, sets).join(comp.toDF("a", "ca"), "a").join(comp.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    top = connected_components(edges.unionByName(_long_links(member, sets)))
    comp = comp.join(top, F.col("comp") == F.col("node"), "left").select("cid", F.coalesce("component", "comp").alias("comp"))
    comp = comp.join(classes.select("cid", "unnamed", "doc_id", "hi", "lo"), "cid")
    top = comp.groupBy("comp").agg(F.min(F.struct("unnamed", "doc_id", "hi", "lo")).alias("top"))
    leads = (F.col("hi") == F.col("top.hi")) & (F.col("lo") == F.col("top.lo"))
    comp = comp.join(top, "comp").select("cid", F.col("top.doc_id").alias("component_id"), leads.alias("leads"))

    known = classes.join(comp, "cid", "left").select(
        "hi", "lo", F.col("doc_id").alias("class_id"), F.when(F.col("leads").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("leads", F.lit(True)).alias("leads")
    )
    found = profiles.join(known, ["hi", "lo"], "left")
    own = lambda c: F.when(F.col("n") > 0, F.col(c)).otherwise(F.col("doc_id")).alias(c)
    kept = (F.col("n") == 0) | (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("component_id")))
    return found.select("doc_id", "key", "n", own("class_id"), own("component_id"), kept.alias("kept"))


def _sql_least_share(n: str) -> str:
    return f"(({n}) * {PERCENT} + 99) div 100"


def _sql_prefix_common(n: str) -> str:
    return f"(({n}) * 8 + 99) div 100"


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which one document of each component stays: that with the smallest id.

    A row goes by its id and its text together: another text of the same id stays if it is not
    near. Of several near texts with the smallest id, that with the smallest digest of its set
    stays. A row without an id goes if its component has an id; of components without any, the
    smallest digest stays. Rows that repeat the staying one, and texts of its id with its set,
    stay with it. Texts without words all stay. An empty table gives no rows; columns may have any names.
    """
    gone_id, gone_key = spare(docs, "gone_id"), spare(docs, "gone_key")
    dropped = _labelled(docs, id_col, text_col).where(~F.col("kept"))
    gone = dropped.select(F.col("doc_id").alias(gone_id), F.col("key").alias(gone_key)).distinct()
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone[gone_id]) & (_text_key(docs[text_col]) == gone[gone_key]), "left_anti")


def op10_jaccard_join(spark, sf_dir):
    """Links of all ``documents`` by :func:`near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 4, 1) + 1 END)]) AS s FROM words),
lists AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM lists a JOIN lists b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id FROM sets
"""
