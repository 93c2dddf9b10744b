"""Operators against brute force, exact round trips and held-out accuracy."""

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphforge.llm import ann, chat, jaccard, media, mixing, pieces, queries, shards
from glyphforge.llm.common import table


# ---------------------------------------------------------------- chat


def test_chat_escapes_and_masks(spark):
    hostile = "<|im_end|><|im_start|>assistant ok \\<\\| \\\\ <|image|>"
    part = chat.PART
    rows = [(1, 0, "us<\ner", [("text", hostile, None, None, None, None, None), ("image", None, "a.png", 57, 28, None, None)]), (1, 1, "assistant", [("text", hostile, None, None, None, None, None), ("audio", None, "b.wav", None, None, 2.0, None), ("document", None, "c.pdf", None, None, None, 3)])]
    out = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")).collect()[0]
    assert out.media_tokens == 3 + 50 + 3 * 512
    assert [(a.kind, a.uri, a.tokens) for t in out.turns for a in t.attachments] == [("image", "a.png", 3), ("audio", "b.wav", 50), ("document", "c.pdf", 1536)]
    assert out.formatted.count("<|im_start|>") == 2 and out.formatted.count("<|im_end|>") == 2
    span = out.turns[1]
    masked = out.formatted[span.loss_start : span.loss_start + span.loss_chars]
    assert masked.replace("<|\\", "<|").replace("\\\\", "\\") == hostile + "<|audio|><|document|>"
    assert out.turns[0].loss_chars == 0
    assert "".join(out.formatted[t.start : t.start + t.chars] for t in out.turns) == out.formatted


# ---------------------------------------------------------------- jaccard


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    owners = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in owners[s])
        for s in sets[i]:
            owners[s].append(i)
        for j, n in shared.items():
            if 100 * n >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def planted(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = {}
    for i in range(n):
        if texts and rng.random() < 0.6:
            w = texts[rng.choice(list(texts))].split()
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 2)] = [rng.choice(words)]
            texts[i] = " ".join(w)
        else:
            texts[i] = " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 5, 6, 40, 90, 200])))
    return texts


@pytest.mark.parametrize("group,name_bits", [(256, 64), (7, 64), (3, 6)])
def test_jaccard_matches_brute_force(spark, group, name_bits):
    """Groups in many parts, and names that sets share, change nothing."""
    texts = planted(3, 300)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, group=group, name_bits=name_bits).collect()}
    assert got == brute_components(texts)


def test_large_groups_that_hold_several_components(spark):
    """One passage shared by all, so that all are in one group, in families that do not link."""
    rng = random.Random(12)
    common = [f"c{k}" for k in range(30)]
    texts = {}
    for family in range(12):
        own = [f"f{family}x{k}" for k in range(rng.choice([20, 60, 160]))]
        for _ in range(rng.choice([1, 3, 25])):
            w = common + own
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"r{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, group=8).collect()}
    assert got == brute_components(texts)


def test_hubs_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAST_HUB", 3)
    monkeypatch.setattr(jaccard, "HUBS", 4)
    edges = [(0, i) for i in range(1, 200)] + [(500, i) for i in range(300, 420)] + [(i, i + 1) for i in range(600, 640)] + [(10, 300)]
    got = {r.node: r.component for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(1, 200), *range(300, 420), 500]}, **{i: 600 for i in range(601, 641)}}


def test_jaccard_on_the_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_ngram_jaccard_join(spark, sf_dir).collect()}
    assert got == brute_components(texts)


def test_bound_never_prunes_a_link():
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 2**63, size=int(n), dtype=np.uint64) for n in rng.integers(1, 300, size=60)]
    sets = base + [np.concatenate((b[: int(len(b) * 0.95)], rng.integers(0, 2**63, size=2, dtype=np.uint64))) for b in base]
    sets = [np.unique(s) for s in sets]
    sizes, bits = [len(s) for s in sets], [jaccard.bitmap(s) for s in sets]
    flagged, linked = jaccard.Forest(sizes, bits), jaccard.Forest(sizes, bits, sets)
    every = np.arange(len(sets))
    flagged.within(every)
    linked.within(every)
    for i in every:
        for j in every[:i]:
            o = len(np.intersect1d(sets[i], sets[j]))
            if 9 * o >= 4 * (sizes[i] + sizes[j]):
                assert flagged.flag[i] and flagged.flag[j] and linked.find(i) == linked.find(j)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in jaccard.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


# ---------------------------------------------------------------- mixing


def test_mixing_reaches_targets(spark, sf_dir):
    rows = queries.op4_mixing(spark, sf_dir).collect()
    by = table(spark, sf_dir, "documents").select("doc_id", "source").collect()
    source = {r.doc_id: r.source for r in by}
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-6
    again = queries.op4_mixing(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mixing_prefers_quality(spark):
    rows = [(i, "abcde " * 20 if i % 2 else "abcdefghijklmnopqrstuvwxyz " * 20, "s") for i in range(400)] + [(i, "abcde " * 20, "t") for i in range(1000, 1400)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 3), share=0.6).collect()
    good = sum(r.taken for r in out if r.doc_id < 400 and r.doc_id % 2)
    poor = sum(r.taken for r in out if r.doc_id < 400 and not r.doc_id % 2)
    assert good > 2 * poor


def test_no_range_holds_much_of_a_source(spark):
    """Of texts of any kind, words of 3,000 characters among them."""
    for chars in (5, 12, 40, 3000):
        rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.repeat(F.lit("x"), chars).alias("text"))
        draw = -F.log(mixing.uniform(F.col("doc_id"))) / mixing.quality(F.col("text"), mixing.n_words(F.col("text")))
        most = rows.groupBy(F.floor(F.log2(draw) * mixing.STEPS)).count().agg(F.max("count")).first()[0]
        assert most < 20_000 * 0.0015


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Source to target, filling the least limits by weight one after another."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    out, left, free = {}, share * sum(sizes.values()), set(order)
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if most * sizes[s] <= w[s] * level}
        if not full:
            return out | {s: w[s] * level for s in free}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= full
    return out


def test_targets_of_many_sources(spark):
    rng = random.Random(3)
    sizes = {f"site{i}.example": rng.choice([0, 1, 5, 400, 10_000]) for i in range(700)} | {None: 77}
    rows = spark.createDataFrame([(("=" + s) if s else "", s, n) for s, n in sizes.items()], "key string, source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(plain_targets(sizes))


# ---------------------------------------------------------------- neighbours


def test_neighbours_are_exact_and_pruning_is_tunable():
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((1500, 6)), rng.standard_normal((40, 6))
    ids = np.arange(1500)
    want = np.argsort(ann.exact(q, x), axis=1)[:, :10]
    rows, _ = ann.Tree(x).search(q, np.full(40, -1), ids, 10, 1.0)
    assert (rows == want).all()
    rows, _ = ann.Tree(x).search(q, np.full(40, -1), ids, 10, 0.3)
    assert 0.3 < np.mean([len(set(a) & set(b)) / 10 for a, b in zip(rows, want, strict=True)]) < 1.0


def nearest(ids, x, asks, k):
    d = ann.exact(x[asks], x)
    out = {}
    for i, row in zip(np.flatnonzero(asks), d, strict=True):
        order = sorted((float(v), int(j)) for v, j in zip(row, ids, strict=True) if j != ids[i])[:k]
        out[int(ids[i])] = [(j, v) for v, j in order]
    return out


def found_by(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


@pytest.mark.parametrize("offset,spread", [(0.0, 1.0), (100.0, 1e-6), (1e5, 1.0)])
def test_search_over_shards_equals_brute_force(spark, offset, spread):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 8)) * 4
    x = (centres[rng.integers(0, 12, 1500)] + rng.standard_normal((1500, 8))) * spread + offset
    x[1000:1300] = x[7]  # a large group of copies, and small ones
    x[1300:1360] = x[:60]
    ids = rng.permutation(5000)[:1500].astype(np.int64)
    df = spark.createDataFrame([(int(i), v.tolist(), "e") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, part string").repartition(5)
    got = found_by(ann.search(df, F.col("vec_id") % 20 == 0, k=10, shard=100))
    assert got == nearest(ids, x, ids % 20 == 0, 10)


def test_relaxed_search_over_shards_keeps_most(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((40, 8))[rng.integers(0, 40, 3000)] * 3 + rng.standard_normal((3000, 8))
    ids = np.arange(3000, dtype=np.int64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = nearest(ids, x, ids % 50 == 0, 10)
    got = found_by(ann.search(df, F.col("vec_id") % 50 == 0, k=10, relax=0.8, shard=200))
    recall = np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in near}) / 10 for q, near in want.items()])
    assert recall >= 0.9


def test_a_shard_out_of_reach_is_not_asked():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((200, 4)), rng.standard_normal((200, 4)) + 1000])
    plan = numbered(x, 100)
    leaf = plan.router(4).leaf(x)
    home = int(plan.part(4, int(leaf[0]), x[:1], np.array([0]))[0])
    asked = {p for p, _ in plan.others(4, x[:1], np.array([3.0]), 1.0, home)}
    far = {int(p) for k in np.unique(leaf[200:]) for p in plan.part(4, int(k), x[200:][leaf[200:] == k], np.flatnonzero(leaf[200:] == k))}
    assert not asked & far


def numbered(x, shard):
    plan = ann.Plan(list(x), len(x), shard)
    router = plan.router(x.shape[1])
    leaf, rows = router.leaf(x), []
    for k in np.unique(leaf).tolist():
        rings = router.rings(k, x[leaf == k])
        rows.append((x.shape[1], k, int((leaf == k).sum()), list(zip(rings.min(axis=0), rings.max(axis=0), strict=True))))
    plan.number(rows)
    return plan


def test_rings_rule_out_most_leaves_of_clusters_and_no_true_neighbour():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((60, 64))[rng.integers(0, 60, 6000)] * 2 + rng.standard_normal((6000, 64)) * 0.3
    plan, q = numbered(x, 128), x[::100]
    d, leaf = ann.exact(q, x), plan.router(64).leaf(x)
    bound = np.sort(d, axis=1)[:, 10]
    reach = plan.reached(64, q, bound, 1.0)
    for i in range(len(q)):
        assert reach[i, leaf[d[i] <= bound[i]]].all()
    assert reach.mean() < 0.35  # measured: 0.29; balls about the leaves alone 0.58
    centre = plan.router(64).centre
    ball = ann.exact(q, centre) - np.array([ann.exact(x[leaf == k], centre[k : k + 1]).max() if (leaf == k).any() else -np.inf for k in range(len(centre))]) <= bound[:, None]
    assert reach.sum() < ball.sum()


def test_one_id_with_many_vectors_is_spread_and_repeats_meet():
    rng = np.random.default_rng(4)
    x = np.tile(rng.standard_normal((500, 8)), (2, 1))
    plan = ann.Plan([x[0]], 1000, 100)
    plan.number([(8, 0, 1000, [(0.0, 9.0)] * (1 + len(plan.router(8).pivots)))])
    part = plan.part(8, 0, x, np.full(1000, 7))
    assert (part[:500] == part[500:]).all() and np.bincount(part, minlength=10).max() < 160


# ---------------------------------------------------------------- media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1024, 1025, 8192, 8193, 40_000, 100_000])
def test_pcm_round_trip(n):
    payload = media.padded(os.urandom(n))
    stored = media.write_pcm(payload)
    back, parsed = media.read_pcm(stored)
    assert back == payload
    assert all(stored[c[2] : c[2] + 4] == media.CLUSTER.to_bytes(4, "big") for c in parsed.cues)
    assert [p[1] for p in parsed.packets] == [media.FRAME * i for i in range(len(parsed.packets))]


@pytest.mark.parametrize("kind,sizes", [(0, [300]), (1, [0, 254, 255, 256, 700, 3]), (2, [9, 9, 9]), (3, [5, 3000, 1, 1, 70_000]), (3, [4]), (1, [8])])
def test_lacings(kind, sizes):
    frames = [os.urandom(n) for n in sizes]
    block = media.laced_block(frames, -5, kind)
    ((_, start, end),) = media.elements(block, 0, len(block))
    out = media.Media()
    media._block(out, block, start, end, 0, 100, 0, True, False)
    assert [block[p[2] : p[2] + p[3]] for p in out.packets] == frames
    assert out.packets[0][1] == 95 and out.packets[0][7] == media.LACINGS[kind]


def test_unknown_sizes_and_groups():
    ebml = media._HEAD[0]
    group = media._element(media.BLOCK_GROUP, media._element(media.BLOCK, b"\x81\x00\x07\x00abc") + media._number(media.REFERENCE_BLOCK, 1))
    cluster = media.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + media._number(media.TIMESTAMP, 10) + group
    parsed = media.parse(ebml + media.SEGMENT.to_bytes(4, "big") + b"\xff" + cluster + cluster)
    assert [(p[1], p[4], p[5]) for p in parsed.packets] == [(17, False, 0), (17, False, 1)]


def test_malformed_media_is_reported(spark):
    good = media.write_pcm(b"x" * 64)
    rows = [(1, good), (2, good[:-3]), (3, b""), (4, None), (5, b"\x00\x01")]
    out = media.packets(spark.createDataFrame(rows, "id long, m binary"), "id", "m").collect()
    assert sorted((r.id, r.error is None) for r in out) == [(1, True), (2, False), (3, False), (5, False)]


# ---------------------------------------------------------------- pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(queries.tokenizer_file())


def test_pieces_equal_the_library(vocabulary, spark, sf_dir):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file())
    rng = random.Random(2)
    spelled = [p for p in vocabulary.pieces[259:]]
    texts = ["", " ", "   ", "a" * 300, "\n\n\t", "x\0y", "é ñ 漢字😀", "  two  spaces ", "ab" * 200]
    texts += ["".join(rng.choice(spelled).replace("▁", " ") if rng.random() < 0.7 else chr(rng.choice([32, 10, 9, 233, 0x4E2D, 0x1F600, 0x301])) for _ in range(rng.randint(0, 15))) for _ in range(400)]
    texts += [r.text for r in table(spark, sf_dir, "documents").collect()]
    tables = vocabulary.ready()
    coded = [np.frombuffer(c, dtype=np.int32).tolist() for c in tables.encode(texts)]
    assert coded == library.encode(texts)
    assert [tables.decode(np.array(c, dtype=np.int32)) for c in coded] == texts


def test_occurrence_ranges_equal_plain_search(vocabulary):
    tables = vocabulary.ready()
    words = ["▁the", "▁international", "▁▁▁▁x", "internationalization", "▁of", "ing"]
    text = "\0".join(words) + "\0"
    ranks = tables.edges(tables.code[pieces.code_points(text)].copy())
    found = {(p, tables.lengths[k - 1]) for p, k in zip(*np.nonzero(ranks != pieces.NONE), strict=True)}
    want = {(p, n) for p in range(len(text)) for n in range(2, 17) if text[p : p + n] in tables.ids and len(text[p : p + n]) == n}
    assert found == want


def test_pieces_of_any_length_are_found():
    rng = random.Random(8)
    spelled = sorted({"".join(rng.choice("ab") for _ in range(n)) for n in (1, 1, 2, 3, 5, 16, 17, 20, 31, 32, 33, 40, 65, 130) for _ in range(6)} | {"a", "b", "a" * 48})
    v = pieces.Vocabulary(["<unk>", *spelled], np.array([0.0] + [-float(i) for i in range(len(spelled))]), np.array([2] + [0] * len(spelled)))
    tables = v.ready()
    text = "\0".join(["".join(rng.choice(spelled) for _ in range(12)) for _ in range(30)] + ["a" * 60]) + "\0"
    ranks = tables.edges(tables.code[pieces.code_points(text)].copy())
    found = {(p, int(tables.lengths[k - 1])): ranks[p, k] for p, k in zip(*np.nonzero(ranks != pieces.NONE), strict=True)}
    want = {(p, len(s)): tables.rank[tables.ids[s]] for s in spelled if len(s) > 1 for p in range(len(text)) if text.startswith(s, p)}
    assert found == want


def test_text_without_spaces_takes_the_suffix_array(vocabulary, monkeypatch):
    """Unspaced scripts, encoded blobs and words beyond a batch, by the same edges as all else."""
    import base64

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file())
    rng = random.Random(4)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(3000)), "".join(rng.choice("カタナひらがな漢字日本語の") for _ in range(2000)), base64.b64encode(rng.randbytes(6000)).decode(), "https://example.org/" + "a-b_c/" * 500, "internationalization" * 300, "x" * 5000]
    monkeypatch.setattr(pieces, "BATCH", 1 << 10)
    tables = pieces.Tables(vocabulary)
    coded = [np.frombuffer(c, dtype=np.int32).tolist() for c in tables.encode(texts)]
    assert coded == library.encode(texts)
    assert [tables.decode(np.array(c, dtype=np.int32)) for c in coded] == texts


def test_unigram_relaxation_finds_the_best_path():
    v = pieces.Vocabulary(["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "▁ab", "aba"], np.array([0, -3, -2, -2, -2.5, -3.2, -2.4, -6, -4.0]), np.array([2, 0, 0, 0, 0, 0, 0, 0, 0]), "unigram")
    tables = v.ready()

    def best(s):
        if not s:
            return 0.0, []
        return max((v.scores[tables.ids[s[:n]]] + best(s[n:])[0], [tables.ids[s[:n]], *best(s[n:])[1]]) for n in range(1, len(s) + 1) if s[:n] in tables.ids)

    for s in ("ab", "aba", "abab", "bbaab"):
        got = np.frombuffer(tables.encode([s])[0], dtype=np.int32).tolist()
        assert sum(v.scores[got]) == pytest.approx(best("▁" + s)[0])


def test_encode_and_decode_columns(spark, vocabulary):
    df = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string")
    back = pieces.decode(pieces.encode(df, vocabulary, ["doc_id"]), vocabulary, ["doc_id"])
    assert sorted(map(tuple, back.collect())) == [(1, "hello world"), (2, "")]


# ---------------------------------------------------------------- shards


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000, 4096, 4097])
def test_permutation(n):
    slots = shards.permute(np.arange(n), n, 9)
    assert sorted(slots.tolist()) == list(range(n))
    assert n < 5 or (shards.permute(np.arange(n), n, 10) != slots).any()


def test_shards_read_back(spark, sf_dir, tmp_path):
    layout = shards.Layout(seq_len=256, per_shard=100)
    docs = table(spark, sf_dir, "documents")
    rows = shards.materialise(docs, layout)
    files = {r.shard: r for r in shards.write_shards(rows, str(tmp_path / "out")).collect()}
    parts = defaultdict(dict)
    for r in rows.select("slot", "shard", "byte_offset", "doc_id", "place").collect():
        data = open(files[r.shard].path, "rb").read()
        assert r.byte_offset == (r.slot - r.shard * 100) * layout.stride
        doc_id, place, ids = layout.read(data, r.shard * 100, r.slot)
        assert (doc_id, place) == (r.doc_id, r.place)
        parts[doc_id][place] = ids
    for d in docs.collect():
        ids = np.concatenate([parts[d.doc_id][k] for k in sorted(parts[d.doc_id])])
        assert ids[-1] == shards.END and bytes(ids[:-1].astype(np.uint8)).decode() == d.text


def test_layout_does_not_depend_on_partitions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    a = shards.materialise(docs).select("slot", "doc_id", "place").collect()
    b = shards.materialise(docs.repartition(7)).select("slot", "doc_id", "place").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


# ---------------------------------------------------------------- learned operators


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    lang = queries.op8_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert lang.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    good = queries.op6_quality_classifier(spark, sf).join(labels, "doc_id").filter("held_out")
    assert good.select(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.9
    toxic = queries.op3_toxicity(spark, sf).join(labels, "doc_id").filter("held_out")
    assert toxic.select(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0] > 0.9


def test_misspellings_share_character_grams():
    from glyphforge.llm.subword import Config, fit

    rng = random.Random(1)
    plain = ["stone", "river", "light", "green", "cloud", "paper"]
    texts = [" ".join(rng.choice(plain) for _ in range(30)) for _ in range(200)]
    y = np.array([i % 2 for i in range(200)])
    texts = [t + " horrible" if k else t for t, k in zip(texts, y, strict=True)]
    model = fit([t.encode() for t in texts], y, Config(window=4, steps=30))
    clean, seen, unseen = model.predict([b"stone river light", b"stone river horrible", b"stone river horriible"])
    assert clean < 0.5 < unseen < seen or clean < 0.5 < unseen
