"""Vectors, archives and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("veritrail.llm")

from veritrail.llm import ann, components, warc  # noqa: E402
from veritrail.llm.scratch import new_path  # noqa: E402


def exact(rows, every, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            scored = [(-float(v @ q / np.sqrt((v @ v) * (q @ q))), j) for j, v in ok if j != i and len(v) == len(q)]
            out[i] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(700, 16)))]
    rows += [(700 + i, rows[3][1]) for i in range(120)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] + [1.0] * 15), (1004, [None] + [1.0] * 15), (1005, [float("inf")] + [1.0] * 15), (None, rows[5][1]), (1050, [1.0, 2.0]), (1100, [2.0, 1.0])]
    df = spark.createDataFrame(rows + rows[:2], "vec_id long, embedding array<double>").withColumnRenamed("x", "x")
    got = {}
    for r in ann.nearest(df, every=50, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = exact(rows, 50, 5)
    assert set(got) == set(want) and got[1050] == [(1100, pytest.approx(0.8))]
    hits = sum(len({j for j, _ in want[q]} & {j for j, _ in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert [j for j, _ in got[700]] == [3, 701, 702, 703, 704] and got[700][0][1] == pytest.approx(1.0)
    scores = {i: np.array(v, float) for i, v in rows if i is not None and v and len(v) == 16 and i < 1000}
    assert all(s == pytest.approx(float(scores[q] @ scores[j] / np.linalg.norm(scores[q]) / np.linalg.norm(scores[j])), abs=1e-12) for q in got if q < 1000 for j, s in got[q])
    assert ann.nearest(df.limit(0)).count() == 0


def near_to(x, cosine, rng):
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return cosine * x + np.sqrt(1 - cosine**2) * z


def test_regions_and_buckets_cover():
    """Visited regions hold neighbours as often as estimated, and visited buckets of two tables nearly all of them."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hasher, cosine = ann.new_hasher(32), np.full(400, 0.6)
    near = near_to(x, 0.6, rng)
    for lead in (0, 1, 3):
        visited = hasher.regions(x, cosine, lead)
        held = np.take_along_axis(visited, (hasher.codes(near) >> hasher.shift(lead))[..., None], -1)[..., 0]
        assert held.mean() > ann.REGION_SUCCESS - 0.03 and (lead < 3 or visited.mean() < 0.9)
    pairs = [(x, near), (x, rng.permutation(x))]
    found = []
    for asked, other in pairs:
        hit = np.zeros(400, bool)
        for t in range(ann.TABLES):
            for i in range(400):
                part = ann.Part(hasher, t, np.arange(2), np.repeat(hasher.codes(other[i : i + 1])[:, t], 2), np.repeat(other[i : i + 1], 2, 0))
                gains, least = hasher.scores(asked[i : i + 1], cosine[:1], t, ann.DEVIATIONS)
                hit[i] |= sum(gains[0, g][part.groups[g]] for g in range(len(part.groups)))[0] >= least[0]
        found.append(hit.mean())
    assert found[0] > 0.75 and found[1] < 0.1


def share_and_recall(spark, x, every=50, k=5):
    tally = spark.sparkContext.accumulator(0)
    n = len(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in ann.nearest(df, every, k, tally=tally).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    recall = {}
    for q in range(0, n, every):
        near = unit @ unit[q]
        near[q] = -2
        recall[q] = len(set(np.argpartition(-near, k)[:k].tolist()) & got[q]) / k
    return tally.value / len(recall) / n, recall


@pytest.mark.parametrize("n", [2000, 10_000, 100_000])
def test_few_rows_compared(spark, n):
    """On vectors without structure below a fifth of the rows is compared, and 0.9 of the neighbours are found."""
    every = 50 if n < 100_000 else 500
    share, recall = share_and_recall(spark, np.random.default_rng(n).normal(size=(n, 64)), every)
    print(f"{n} vectors: {share:.3f} of the rows compared, recall {np.mean(list(recall.values())):.3f}")
    assert share < 0.2 and np.mean(list(recall.values())) >= 0.9


@pytest.mark.parametrize("grouped", [0.6, 0.8])
def test_nearest_of_clusters(spark, grouped):
    """Scattered vectors find their neighbours although most rows lie in tight groups."""
    rng = np.random.default_rng(6)
    n, size = 8000, 200
    groups = int(n * grouped) // size
    x = np.concatenate([np.repeat(rng.normal(size=(groups, 64)), size, 0) + 0.2 * rng.normal(size=(groups * size, 64)), rng.normal(size=(n - groups * size, 64))])
    share, recall = share_and_recall(spark, x)
    inside = np.array([q < groups * size for q in recall])
    values = np.array(list(recall.values()))
    print(f"{share:.3f} of the rows compared, recall {values[inside].mean():.3f} in groups, {values[~inside].mean():.3f} elsewhere")
    assert values[inside].mean() >= 0.9 and values[~inside].mean() >= 0.9 and share < 0.25


def test_nearest_of_odd_vectors(spark, monkeypatch):
    """Magnitudes whose squares overflow or vanish, an id with two vectors, parts of a region, clashing columns, few dimensions."""
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 2e-200]), (2, [1e-310, 0.0]), (3, [3.0, 3.0]), (3, [0.0, 1.0]), (50, [2.0, 0.1]), (4, [-1e300, 1.0])]
    names = "vec_id long, embedding array<double>, size int, entry string, cosine int, vector string, query int"
    df = spark.createDataFrame([(*r, 1, "e", 1, "v", 1) for r in rows], names)
    got = {}
    for r in ann.nearest(df, 50, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert [j for j, _ in got[0]] == [3, 1, 50, 2, 3] and got[0][0][1] == pytest.approx(1.0)
    assert [j for j, _ in got[50]][::3] == [2, 1] and {j for j, _ in got[50][1:3]} == {0, 3} and got[50][0][1] == pytest.approx(2 / np.hypot(2, 0.1), abs=1e-15)
    monkeypatch.setattr(ann, "LEAST_PART", 40)
    monkeypatch.setattr(ann, "MOST_PART", 40)
    x = np.random.default_rng(8).normal(size=(3000, 24))
    _, recall = share_and_recall(spark, x)
    assert np.mean(list(recall.values())) >= 0.9
    for dimension in (1, 2, 3):
        _, recall = share_and_recall(spark, np.random.default_rng(9).normal(size=(600, dimension)) if dimension > 1 else np.array([[float(i - 300 or 1)] for i in range(600)]), 50, 2)
        assert dimension == 1 or np.mean(list(recall.values())) >= 0.9


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, small):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), small).collect()}
    assert got == {i: root(i) for i in parent}


PAGES = [(1, "http://a/ b", "<p>" + "x" * 200), (2, None, "<p>" + "x" * 200), (3, "http://c", "short"), (4, "http://d", "short"), (5, "http://e", None), (6, "http://f", ""), (7, "http://g", "é" * 60), (8, "http://h", "é" * 60), (9, "http://i", "WARC/1.1\r\n\r\n" * 20 + "\r\n\r\n"), (10, "http://j", "y" * 300_000), (11, "u", "line\nline\r\n" * 30)]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, compression):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int").repartition(3)
    path = new_path(spark, "warc-test")
    warc.write_warc(pages, path, compression)
    back = {r["record_id"]: r for r in warc.read_warc(spark, path, payloads=True).collect()}
    assert len(back) == len(PAGES) and not any(r["reason"] for r in back.values())
    assert all(bytes(back[f"<urn:page:{i}>"]["payload"]) == (h or "").encode() for i, _, h in PAGES if i not in (2, 8))
    got = {r["page_id"]: r for r in warc.archive_round_trip(pages, new_path(spark, "warc-test")).collect()}
    for i, _, h in PAGES:
        data = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", {2: 1, 8: 7}[i]) if i in (2, 8) else ("response", None))
    assert warc.archive_round_trip(pages.limit(0), new_path(spark, "warc-test")).count() == 0


def record(n, body=b"hello"):
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def ids(found):
    return [int(r.headers["warc-record-id"][10:-1]) for r in found.records]


def test_salvage_plain():
    good = [record(i, b"body %d" % i) for i in range(6)]
    broken = good[2].replace(b"Content-Length: 6", b"Content-Length: 90")
    flipped = good[4].replace(b"body 4", b"bodY 4")
    data = good[0] + b"noise\r\n" + good[1] + broken + good[3] + flipped + good[5][:-9]
    found = warc.salvage(data)
    assert ids(found) == [0, 1, 3] and len(found.gaps) == 3
    covered = sum(g.end - g.start for g in found.gaps) + sum(len(good[i]) for i in (0, 1, 3))
    assert covered == len(data) and found.gaps[0].start == len(good[0])
    assert warc.salvage(b"").records == [] and ids(warc.salvage(b"junk" + good[0])) == [0]


def test_salvage_members():
    import gzip

    members = [gzip.compress(record(i, b"body %d " % i * 50)) for i in range(5)]
    damaged = bytearray(members[2])
    damaged[len(damaged) // 2] ^= 0xFF
    data = members[0] + members[1] + bytes(damaged) + members[3] + b"\x00\x00" + members[4]
    found = warc.salvage(data)
    assert [i for i in ids(found) if i != 2] == [0, 1, 3, 4] and found.gaps
    whole = gzip.compress(b"".join(record(i) for i in range(4)))
    assert ids(warc.salvage(whole)) == [0, 1, 2, 3]
    cut = warc.salvage(gzip.compress(b"".join(record(i, bytes(random.Random(i).randbytes(400))) for i in range(40)))[:-2000])
    assert len(cut.records) >= 20 and cut.gaps[-1].reason == "the member is cut off"


def test_salvage_before_damage():
    """Of a member with many records, all those before the damage come back; with a bad CRC all."""
    import gzip

    records = [record(i, random.Random(i).randbytes(150)) for i in range(1000)]
    whole, next_one = gzip.compress(b"".join(records)), gzip.compress(record(5000))
    at = len(whole) * 9 // 10
    flipped = warc.salvage(whole[:at] + bytes([whole[at] ^ 0xFF]) + whole[at + 1 :] + next_one)
    assert ids(flipped)[:850] == list(range(850)) and ids(flipped)[-1] == 5000
    assert flipped.gaps and all(g.start > 0 for g in flipped.gaps)
    crc = warc.salvage(whole[:-8] + bytes([whole[-8] ^ 1]) + whole[-7:] + next_one)
    assert ids(crc) == [*range(1000), 5000]
    assert [g.end for g in crc.gaps] == [len(whole)] and crc.gaps[0].start >= len(whole) - 8


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip_can_resync(spark, compression):
    """A flipped byte anywhere in an archive of 2000 records costs one record at most."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = [(i, "u", f"page {i} " + " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)
    path = new_path(spark, "warc-test")
    warc.write_warc(pages, path, compression)
    files = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect()]
    assert sum(len(warc.salvage(data).records) for data in files) == 2000
    data = max(files, key=len)
    whole = len(warc.salvage(data).records)
    for at in [0, 1, 2, 3, 8, 9, len(data) - 1, len(data) - 5, *(rng.randrange(len(data)) for _ in range(50))]:
        found = warc.salvage(data[:at] + bytes([data[at] ^ rng.choice([1, 16, 255])]) + data[at + 1 :])
        assert len(found.records) >= whole - 1, at
        # No check covers the headers of a plain record.
        assert compression == "none" or set(ids(found)) <= set(range(2000)), at


def test_damage_ends_the_round_trip(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string")
    real = warc.read_warc
    monkeypatch.setattr(warc, "read_warc", lambda spark, path: real(spark, path).withColumn("reason", F.when(F.col("record_id") == "<urn:page:7>", "no version line")))
    with pytest.raises(Exception, match="damaged archive"):
        warc.archive_round_trip(pages, new_path(spark, "warc-test")).count()


def test_members_and_digests():
    import base64
    import gzip

    big = b"x" * (1 << 24)
    for body in (b"", b"abc", big):
        assert warc.member(body)[-1] == 0 and gzip.decompress(warc.member(body)) == body
    sha1 = hashlib.sha1(b"hello").digest()
    plain = record(1).replace(b"WARC/1.1", b"WARC/0.18")
    texts = [base64.b32encode(sha1).decode(), sha1.hex(), base64.b32encode(sha1).decode().lower()]
    for text in texts:
        for name in (b"WARC-Payload-Digest", b"WARC-Block-Digest"):
            line = name + b": sha1:" + text.encode()
            own = plain.replace(f"WARC-Payload-Digest: sha256:{hashlib.sha256(b'hello').hexdigest()}".encode(), line)
            assert ids(warc.salvage(own)) == [1] and not warc.salvage(own).gaps
            wrong = warc.salvage(own.replace(b"hello", b"hellO") + record(2))
            assert ids(wrong) == [2] and "another digest" in wrong.gaps[0].reason
    other = record(1).replace(b"sha256:", b"blake9:")
    assert ids(warc.salvage(other)) == [1]


def test_language_stage_without_labels(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(1, "some words", None), (2, "1 2 3", None), (3, None, None), (4, "Слово", None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in pipeline.language_stage(spark, docs, "").collect()) == [1, 4]


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from test_documents import TEXTS, components as group, sets_of

    more = ["call me at me@x.org", "3 4 5 !!!"]
    texts = [*TEXTS, *more]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [len(s) for s in pipeline.STAGES] == [2] * 5
    now, left = docs, {i: t for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")}
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        path = f"{tmp_path}/{k}"
        out.write.parquet(path)
        now = spark.read.parquet(path)
        if k == 1:
            left = {max(i for i, u in left.items() if u == t): t for t in set(left.values())}
        if k == 2:
            keys = sorted(left)
            left = {keys[c]: left[keys[c]] for c in set(group(sets_of([left[i] for i in keys])))}
        if k == 3:
            assert now.where(f"doc_id = {len(TEXTS)}").head()["text"] == "call me at [EMAIL]"
        if k < 4:
            assert now.columns == docs.columns and {r["doc_id"] for r in now.collect()} == set(left), k
    assert {r["doc_id"] for r in now.collect()} == set(left) and pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_stages_odd_rows(spark, tmp_path):
    """Null and repeated ids, null texts, clashing names and an empty table, in every stage."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(5, "alpha beta gamma"), (5, "shared text here"), (7, "shared text here"), (7, "shared text here"), (None, "shared text here"), (None, "no id, me@x.org"), (3, None), (4, ""), (6, "1 2 3")]
    names = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, lang_score int, gone_id int, gone_key int, personal_data int, shard int, piece_ int"
    docs = spark.createDataFrame([(*r, "en", "s", 0, *[None] * 7) for r in rows], names).repartition(2)
    now, none = docs, docs.limit(0)
    expected = [
        sorted(rows[:6], key=repr), sorted([rows[0], rows[2], rows[3], rows[5]], key=repr), sorted([rows[0], rows[2], rows[3], rows[5]], key=repr),
        sorted([rows[0], rows[2], rows[3], (None, "no id, [EMAIL]")], key=repr),
    ]
    for (_, stage), want in zip(pipeline.STAGES[:-1], expected):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns and sorted(((r["doc_id"], r["text"]) for r in now.collect()), key=repr) == want
        assert stage(spark, none, str(tmp_path)).count() == 0
    packed = pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert len(packed) == 4 and len({(r["sequence_id"], r["offset"]) for r in packed}) == 4
    assert pipeline.STAGES[-1][1](spark, none, str(tmp_path)).count() == 0
