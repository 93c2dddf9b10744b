"""Inputs beyond what used to be limits: more buckets than the least, model files of other kinds, folders of one machine."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from glyphforge.llm import pieces, queries, shards


def test_more_buckets_than_the_least_give_every_slot_once(spark, monkeypatch):
    rows = [(i if i % 3 else None, bytes(range(i % 40)) * (i % 7)) for i in range(400)] + [(5, b"same")] * 50
    df = spark.createDataFrame(rows, "doc_id long, t binary").withColumn("slot", F.lit(1)).withColumn("shard", F.lit("s")).withColumn("record", F.lit("r"))
    layout = shards.Layout(seq_len=16, per_shard=32)

    def run():
        return shards.materialise(df, layout, tokens=F.col("t")).collect()

    few = run()
    monkeypatch.setattr(shards, "BUCKETS", 4)
    monkeypatch.setattr(shards, "BUCKET_TOKENS", 64)
    many = run()
    want = sum(len(t) // 16 + 1 for _, t in rows)
    for got in (few, many):
        assert sorted(r.slot for r in got) == list(range(want))
    tokens = lambda got: sorted((r.doc_id is None, r.doc_id or 0, r.place, bytes(r.record)) for r in got)
    assert tokens(few) == tokens(many)


def test_a_plain_path_is_refused_on_a_cluster():
    far = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077")))
    with pytest.raises(ValueError, match="one machine"):
        shards.write_shards(far, "/tmp/out")


@pytest.fixture
def model(tmp_path):
    with open(queries.tokenizer_file(), "rb") as f:
        base = f.read()

    def write(more: bytes) -> str:
        """The public model with further settings: repeated messages of this format merge."""
        (tmp_path / "m.model").write_bytes(base + more)
        return str(tmp_path / "m.model")

    return write


def test_the_kind_of_a_model_is_read_from_its_file(model):
    assert pieces.Vocabulary.load(model(b"")).kind == "bpe"
    assert pieces.Vocabulary.load(model(b"\x12\x02\x18\x01")).kind == "unigram"
    with pytest.raises(ValueError, match="unigram"):
        pieces.Vocabulary.load(model(b"\x12\x02\x18\x01"), "bpe")
    with pytest.raises(ValueError, match="word"):
        pieces.Vocabulary.load(model(b"\x12\x02\x18\x03"))


@pytest.mark.parametrize("more,why", [(b"\x1a\x06\x12\x04abcd", "maps characters"), (b"\x1a\x02\x20\x01", "drops repeated spaces"), (b"\x1a\x02\x18\x00", "puts no space")])
def test_models_that_rewrite_text_are_refused(model, more, why):
    with pytest.raises(ValueError, match=why):
        pieces.Vocabulary.load(model(more))
