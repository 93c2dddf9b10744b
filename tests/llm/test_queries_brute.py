"""Registered queries that SQL can't express, against plain readings of their tables."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphforge.llm import classify, langid, media, queries, shards
from glyphforge.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}


def in_fold(i, mod, rest):
    return zlib.crc32(str(i).encode()) % mod == rest


def test_media_query(spark, texts):
    rows = {r.doc_id: r for r in queries.op7_matroska_media(spark, SF).collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        b = (text or "").encode()
        payload = b + bytes(64 * max(1, -(-len(b) // 64)) - len(b))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.write_pcm(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        x = np.frombuffer(payload, dtype=np.uint8).astype(int) - 128
        assert f"sum={x.sum()};energy={(x * x).sum()};crossings={(np.diff(x >= 0) != 0).sum()}" in r.feature


def test_cues_point_at_clusters(spark):
    docs = spark.createDataFrame([(1, "x" * 100_000), (2, None)], "id long, text string")
    stored = media.encode(docs)
    cues, b = media.cues(stored, "id", "media").orderBy("id", "cue").collect(), {r.id: r.media for r in stored.collect()}
    assert len([c for c in cues if c.id == 1]) == 4 and len([c for c in cues if c.id == 2]) == 1
    assert all(b[c.id][c.cluster_offset : c.cluster_offset + 4] == media.CLUSTER.to_bytes(4, "big") and c.error is None for c in cues)


def test_pieces_query(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file())
    rows = {r.doc_id: r for r in queries.op9_sentencepiece(spark, SF).collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        ids = np.asarray(library.encode(text or ""), dtype="<i4")
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].round_trip) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), True)
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def slot_of(number, n, key):
    """The permutation in plain integers."""
    m64 = (1 << 64) - 1

    def mixed(x):
        for k in range(3):
            x ^= x >> 32
            x = x * 0xD6E8FEB86659FD93 & m64 if k < 2 else x
        return x

    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    while True:
        left, right = number >> half, number & (1 << half) - 1
        for r in range(shards.ROUNDS):
            salt = key + (r + 1) * 0x9E3779B97F4A7C15 & m64
            left, right = right, left ^ (mixed(right + salt & m64) & (1 << half) - 1)
        number = left << half | right
        if number < n:
            return number


def test_training_order_query(spark, texts):
    layout = shards.Layout()
    rows = queries.op10_training_order(spark, SF).collect()
    spread = table(spark, SF, "documents").select("doc_id", F.pmod(F.xxhash64("doc_id", F.encode("text", "UTF-8")), F.lit(shards.BUCKETS)).alias("b"), F.xxhash64(F.encode("text", "UTF-8")).alias("h")).collect()
    want, number = {}, 0
    counts = {i: len((t or "").encode()) // layout.seq_len + 1 for i, t in texts.items()}
    total = sum(counts.values())
    for r in sorted(spread, key=lambda r: (r.b, r.doc_id, r.h)):
        for place in range(counts[r.doc_id]):
            want[r.doc_id, place] = slot_of(number, total, layout.key)
            number += 1
    assert {(r.doc_id, r.place): r.slot for r in rows} == want
    parts = defaultdict(dict)
    for r in rows:
        assert (r.shard, r.byte_offset) == (r.slot // layout.per_shard, r.slot % layout.per_shard * layout.stride) and len(r.record) == layout.stride
        doc_id, place, ids = layout.read(bytes(r.record), 0, 0)
        assert (doc_id, place, len(ids)) == (r.doc_id, r.place, r.n_tokens)
        parts[doc_id][place] = ids
    for i, text in texts.items():
        ids = np.concatenate([parts[i][k] for k in sorted(parts[i])])
        assert ids[-1] == shards.END and bytes(ids[:-1].astype(np.uint8)).decode() == (text or "")


def test_token_ids_without_an_id_come_back(spark):
    layout = shards.Layout(seq_len=4, per_shard=5, width=4, end=2, pad=0)
    docs = spark.createDataFrame([(None, [70_000, 5, 6, 7, 8]), (-1, [9]), (3, None)], "doc_id long, ids array<int>")
    rows = shards.materialise(docs, layout, F.col("ids")).collect()
    read = sorted(((i is None, i or 0, p, t.tolist()) for i, p, t in (layout.read(bytes(r.record), 0, 0) for r in rows)))
    assert read == [(False, -1, 0, [9, 2]), (False, 3, 0, [2]), (True, 0, 0, [70_000, 5, 6, 7]), (True, 0, 1, [8, 2])]


def brute_language(model, text):
    """The model's closest centroid, by plain loops over n-grams."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    import unicodedata

    low = "".join(c if c.isascii() or c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in text.lower()).encode() + b"\n"
    low = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in low)
    tf = np.zeros(1 << langid.BITS)
    for size in langid.SIZES:
        for at in range(len(low) - size + 1):
            gram = low[at : at + size]
            if gram.strip(b" "):
                tf[(int.from_bytes(gram, "big") + (size << 56)) * langid.BASE % (1 << 64) >> 64 - langid.BITS] += 1
    v = np.sqrt(tf) * model.idf
    near = model.centroids @ (v / np.linalg.norm(v))
    return model.languages[int(near.argmax())], float(near.max())


def test_language_query(spark, texts):
    model = langid.train(table(spark, SF, "documents"), ~queries.held_out(5, 0))
    rows = {r.doc_id: r for r in queries.op8_language_id(spark, SF).collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        name, score = brute_language(model, text)
        assert rows[i].lang_pred == name and rows[i].score == pytest.approx(score, abs=1e-4)
        assert rows[i].held_out == in_fold(i, 5, 0)


def brute_score(model, text):
    """The model's score, by plain loops over words and their n-grams."""
    c = model.config
    words, low = [], text.translate({k: k + 32 for k in range(0x41, 0x5B)}) if c.lower else text
    b = b" " + low.encode() + b" "
    b = bytes(0x20 if x in b" \t\n\v\f\r" else x for x in b)
    starts = [k for k in range(1, len(b)) if b[k] != 0x20 and b[k - 1] == 0x20]
    hasher = model_features(model).words
    hashes = [int(hasher(np.frombuffer(b[s:].split(b" ")[0] + b"\n", dtype=np.uint8), False)[0][0]) for s in starts]
    place = lambda h: h >> 64 - c.bits
    for n, s in enumerate(starts):
        end = b.index(b" ", s)
        ids = []
        for size in (3, 4, 5):
            for at in range(s - 1, end):
                gram = b[at : at + size]
                if len(gram) == size and 0x20 not in gram[1:-1]:
                    ids.append(place((int.from_bytes(gram, "big") + (size << 56)) * 0x9E3779B97F4A7C15 % (1 << 64)))
        ids.append(place(hashes[n]))
        if c.pairs and n:
            from glyphforge.llm.common import mix

            both = np.uint64(1) if hashes[n] == hashes[n - 1] else np.uint64((hashes[n] * 3 + hashes[n - 1]) % (1 << 64))
            ids.append(place(int(mix(np.array([both]))[0])))
        ids = [k for k in ids if k]
        words.append((sum(float(model.scores[k]) for k in ids), len(ids)))
    if not words:
        return 0.0
    spans = [words[k : k + c.window] for k in range(len(words))] if c.window else [words]
    z = max(sum(w[0] for w in span) / max(1, sum(w[1] for w in span)) for span in spans)
    return 1 / (1 + np.exp(-(z + model.bias)))


def model_features(model):
    from glyphforge.llm.subword import Features

    return Features(model.config)


@pytest.mark.parametrize("name,label,config,mod,rest,least", [("op3_toxicity", "toxic", classify.TOXICITY, 5, 0, 0.5), ("op6_quality_classifier", "quality", classify.QUALITY, 4, 2, 0.7)])
def test_classifier_queries(spark, texts, name, label, config, mod, rest, least):
    model = classify.train(table(spark, SF, "documents"), table(spark, SF, "labels"), label, ~queries.held_out(mod, rest), config)
    rows = {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        assert rows[i].held_out == in_fold(i, mod, rest) and rows[i].predicted == int(rows[i].score >= least)
        if len(text or "") < 4000:
            assert rows[i].score == pytest.approx(brute_score(model, text or ""), abs=1e-4)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    norm = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    df = queries.QUERIES[name](spark, SF)
    got = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    result = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall())


def test_chat_ties_go_by_the_text(spark):
    from glyphforge.llm import chat

    said = ["<|a", "<a", "\\b", "\\", "]", "<|", "<", "<\\|", "a"]
    rows = spark.createDataFrame([(1, 0, "user", t) for t in said], "conv_id long, turn long, role string, text string")
    turns = rows.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    out = chat.read_back(chat.format_chat(turns)).collect()[0]
    assert out.turns_sha256 == hashlib.sha256("".join(f"user\n{t}\n" for t in sorted(said)).encode()).hexdigest()


def test_letters_are_letters():
    assert not any(map(langid.has_letter, ["", "²½", "Ⅷ", "12 !", "_", "\u0301"]))
    assert all(map(langid.has_letter, ["a", "é", "漢", "ʰ", "ß1"]))
    assert langid.lowered("“Ça” 😀 ½") == " ça     ".encode()


def test_a_dirty_language_column_does_not_stop_the_job(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.col("id") % 2500).alias("lang"), F.lit("some text of no matter").alias("text"))
    texts, names = langid.sample(rows, F.lit(True))
    assert len(set(names)) == langid.LANGUAGES and len(texts) <= langid.TEXTS


def test_training_texts_may_all_be_long(spark):
    rows = spark.createDataFrame([(i, ("good fine " if i % 2 else "bad poor ") * 9000) for i in range(8)], "doc_id long, text string")
    labels = rows.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    texts, y = classify.sample(rows, labels, "quality", F.lit(True))
    assert sorted(y) == [0] * 4 + [1] * 4 and {len(t) for t in texts} == {classify.LONGEST}
