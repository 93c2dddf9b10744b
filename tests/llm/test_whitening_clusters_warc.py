"""Operators 11 to 13 against plain computations on small tables, and their defined cases."""

import base64
import hashlib
import io
import math

import numpy as np
import pytest
import zstandard

from glyphforge.llm import clusters, queries, warc, whiten
from glyphforge.llm.common import shared_folder, table

VECTORS = "vec_id long, embedding array<float>, part string, state int, component int, cluster int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2, 3) for i, v in rows], VECTORS)


# ---------------------------------------------------------------- whitening


def check_whitening(rows, found, most=32):
    """rows: (id, vector) of one length, against the covariance formed outright."""
    x = np.floor(64 * np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(most, int((e > e[0] * 1e-12).sum()))
    assert len(found) == n * k
    by = {}
    for r in found:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    signs = None
    for (i, _), row in zip(rows, x, strict=True):
        got = by[i]
        assert sorted(got) == list(range(1, k + 1))
        w = np.array([got[c]["whitened"] for c in range(1, k + 1)])
        want = (row - s / n) @ v[:, :k] / np.sqrt(e[:k])
        if signs is None and np.abs(want).min() > 1e-6:
            signs = np.sign(w * want)
        assert {r["deviation"] for r in got.values()} == {sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True))}
        assert {r["n"] for r in got.values()} == {n}
        assert np.allclose(np.abs(w), np.abs(want), atol=1e-6)
        if signs is not None:
            assert np.allclose(w * signs, want, atol=1e-6)
        assert all(math.isclose(got[c]["explained"], e[c - 1] / e.sum(), rel_tol=1e-8) for c in got)
    assert max(r["identity_error"] for r in found) < 1e-9


def test_whitening_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf_dir, "embeddings").collect()]
    check_whitening(rows, queries.op11_embedding_whitening(spark, sf_dir).collect())


def test_whitening_over_many_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * [9, 5, 3, 2, 1, 0.5] + 40).tolist()) for i in range(700)]
    df = vectors(spark, rows).repartition(37)
    bases = whiten.fit(df, components=4)
    check_whitening(rows, whiten.whiten(df, bases).collect(), 4)


def test_whitening_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (None, [0.5, 4.0]), (2, [3.0, -1.0]), (5, [0.0, 0.0])]
    df = vectors(spark, [*good, (6, None), (7, [1.0, None]), (8, [nan, 1.0]), (9, [1.0, -inf]), (10, []), (11, [7.0]), (12, [1e30, 1.0]), (13, [1.0, 1.0, 1.0])])
    found = whiten.whiten(df, whiten.fit(df)).collect()
    assert sorted(r["vec_id"] for r in found if r["vec_id"] is not None) == [1, 1, 2, 2, 2, 2, 5, 5]  # lone vectors have no variance
    assert sum(r["vec_id"] is None for r in found) == 2 and {r["n"] for r in found} == {5}
    assert max(r["identity_error"] for r in found) < 1e-9
    none = df.limit(0)
    assert whiten.whiten(none, whiten.fit(none)).collect() == []


def test_whitening_deviation_beyond_longs(spark):
    df = vectors(spark, [(1, [1e10, 0.0]), (2, [-1e10, 1.0]), (3, [5.0, 2.0])])
    bases = whiten.fit(df)
    found = {r["vec_id"]: r["deviation"] for r in whiten.whiten(df, bases).collect()}
    assert found[1] is None and found[2] is None and found[3] is not None


# ---------------------------------------------------------------- clustering


def lloyd(rows, k=40, rounds=5):
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"2:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), [float(np.float32(c)) for c in rows[i][1]]))
    x, centroids = np.array(x, dtype=object), [list(x[i]) for i in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for v in x]
        for j in range(len(centroids)):
            mine = [v for v, o in zip(x, own, strict=True) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    final = [nearest(v) for v in x]
    total = {}
    for d, j in final:
        total[j] = total.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((rows[i][0], j, d, total[j], sum(total.values()), sha[j]) for i, (d, j) in enumerate(final)), key=str)


def clustered(df, **options):
    return sorted(map(tuple, clusters.cluster(df, **options).collect()), key=str)


@pytest.mark.parametrize("spread,parts", [(0.3, 3), (8.0, 41)])
def test_clusters_equal_full_search(spark, spread, parts):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 64)) * spread
    rows = [(i, (centres[i % 9] + rng.normal(size=64) * 0.2).tolist()) for i in range(400)]
    rows += [(i + 1000, rows[i][1]) for i in range(30)]  # copies
    log = []
    assert clustered(vectors(spark, rows).repartition(parts), log=log) == lloyd(rows)
    assert [r.vectors for r in log] == [430] * 5 and log[-1].listed <= log[0].listed == 10


def test_bounds_spare_scans(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 64))
    rows = [(i, (centres[i % 40] + rng.normal(size=64) * 0.1).tolist()) for i in range(600)]
    log = []
    assert clustered(vectors(spark, rows), rounds=9, log=log) == lloyd(rows, rounds=9)
    later = log[3:]
    assert sum(r.scanned for r in later) < sum(r.vectors for r in later) / 4


def test_clusters_break_ties_by_number(spark):
    """Few distinct whole vectors: distances tie all the time."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-1, 2, size=64).clip(-1, 1).astype(float).tolist()) for i in range(60)]
    rows += [(i + 100, [float(i % 2)] * 64) for i in range(50)]
    assert clustered(vectors(spark, rows).repartition(4), k=12) == lloyd(rows, 12)


def test_clusters_defined_cases(spark):
    nan = float("nan")
    good = [(1, [0.5] * 64), (None, [0.25] * 64), (2, [0.0] * 64), (2, [1.0] * 64), (2, [1.0] * 64), (3, [-3.7] * 64)]
    bad = [(4, None), (5, [1.0] * 63), (6, [None] * 64), (7, [nan] * 64), (8, []), (9, [1e9] * 64)]
    df = vectors(spark, good + bad)
    assert clustered(df) == lloyd(good)
    assert clustered(df, k=2, rounds=1) == lloyd(good, 2, 1)
    assert clustered(df.limit(0)) == []
    wide = [(i, [(-1.0) ** i * 90000.0 + i] * 64) for i in range(12)]  # beyond 16 bits, and beyond exact doubles
    assert clustered(vectors(spark, wide), k=3) == lloyd(wide, 3)


# ---------------------------------------------------------------- archives

PAGES = "page_id long, url string, html string, payload string, copies int, name string, part string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", 1, "n", "q") for i, u, h in rows], PAGES)


def b32(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows, least=0):
    out, groups = [], {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    for h, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        n = len(h.encode())
        for k, i in enumerate(ids):
            again = k > 0 and n >= least
            out.append((i, n, b32(h), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=str)


ROWS = [(3, "http://a/b c\r\nX: y", "<p>é</p>"), (1, None, "<p>é</p>"), (1, None, "<p>é</p>"), (7, "http://z", None), (8, "http://z", ""), (None, "u", "<p>é</p>"), (None, None, "lone"), (9, "v", "x" * 70_000), (10, "w", "\r\n\r\nWARC/1.1\r\n\r\n")]


@pytest.mark.parametrize("hot", [None, 1])
@pytest.mark.parametrize("least", [0, 1, 9, 100])
def test_archives_hold_every_page(spark, hot, least):
    df = pages(spark, ROWS)
    back = warc.read(warc.write(warc.plan(df, least, hot), shared_folder(spark, "w"), frame=300))
    rows = back.select(warc.page_of("record_id").alias("p"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("r"), "payload", "record_id").collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == expected(ROWS, least)
    assert len({r["record_id"] for r in rows}) == len(ROWS)
    for r in rows:
        assert (r["payload"] is None) == (r["record_type"] == "revisit")


def test_common_payloads_are_dealt_in_runs(spark, monkeypatch):
    monkeypatch.setattr(warc, "RUN", 50)
    rows = [(i // 3, f"http://h/{i % 3}", "same") for i in range(600)] + [(None, "n", "same")] * 500 + [(5, "n", "same")] * 300 + [(i, "o", f"own {i}") for i in range(20)]
    planned = warc.plan(pages(spark, rows), hot=100)
    assert max(r["copies"] for r in planned.collect()) == 50 and planned.filter("payload IS NOT NULL").count() == 21
    back = warc.read(warc.write(planned, shared_folder(spark, "w")))
    got = back.select(warc.page_of("record_id").alias("p"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("r"), "record_id").collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(rows)
    assert len({r["record_id"] for r in got}) == len(rows)


def test_bundles_are_plain_zstandard_and_seekable(spark, sf_dir):
    folder = shared_folder(spark, "w")
    manifest = warc.write(warc.plan(table(spark, sf_dir, "pages")), folder, frame=10_000, bundle=10_000)
    rows = manifest.collect()
    assert len(rows) > 2 and sum(r["records"] for r in rows) == table(spark, sf_dir, "pages").count()
    whole = {}
    for r in rows:
        data = open(r["path"].removeprefix("file://"), "rb").read()
        assert len(data) == r["bytes"] and data[-4:] == bytes.fromhex("b1ea928f")
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        assert len(plain) == r["plain_bytes"]
        whole |= {p.headers["warc-record-id"][1:-1]: p for p in warc.parse(plain)}
        reader = warc.Reader(io.BytesIO(data), len(data))
        for name, frame, offset, length in reader.index():  # each frame stands alone
            one = next(warc.parse(reader.frame(frame)[offset : offset + length]))
            assert one.headers["warc-record-id"] == f"<{name}>" and one == whole[name]
    some = spark.createDataFrame([(n,) for n in list(whole)[::7]] + [("urn:page:none",)], "record_id string")
    got = {r["record_id"]: bytes(r["record"]) for r in warc.fetch(manifest, some).collect()}
    assert got.keys() == set(list(whole)[::7]) and all(next(warc.parse(v)) == whole[k] for k, v in got.items())


def test_a_damaged_payload_is_an_error(spark):
    sha = hashlib.sha1(b"what it was").hexdigest()
    bad = spark.createDataFrame([("urn:page:1:x", None, sha, 11, b"what it is!", None, 1)], "name string, url string, sha1 string, n_bytes long, payload binary, refers_to string, copies long")
    with pytest.raises(Exception, match="not that of its digest"):
        warc.read(warc.write(bad, shared_folder(spark, "w"))).collect()


def test_no_pages_no_archive(spark):
    none = pages(spark, ROWS).limit(0)
    assert warc.write(warc.plan(none), shared_folder(spark, "w")).collect() == []
    assert warc.digests(none, shared_folder(spark, "w")).collect() == []


def test_page_ids_come_from_the_archive(spark):
    df = spark.createDataFrame([("urn:page:12:ab",), ("urn:page::cd",), (None,)], "record_id string")
    assert [r[0] for r in df.select(warc.page_of("record_id")).collect()] == [12, None, None]
