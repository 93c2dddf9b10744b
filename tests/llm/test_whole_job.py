"""Cases in which an operator once did less than its whole job."""

import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphforge.llm import ann, classify, langid, queries
from glyphforge.llm.common import table
from glyphforge.llm.subword import fit


def test_unlearned_languages_and_encoded_junk_are_rejected(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train(docs, ~queries.held_out(5, 0))
    rng = random.Random(3)
    planted = [
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
        "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri.",
        base64.b64encode(rng.randbytes(300)).decode(),
        rng.randbytes(300).hex(),
        "def f(x):\n    return [i for i in range(x) if i % 2]\nclass A(object):\n    def __init__(self): self.x = None\n",
    ]
    assert model.predict([t.encode() for t in planted])[2].all()
    clean = docs.filter(queries.held_out(5, 0) & F.col("text").rlike("[a-z]")).select("lang", "text").collect()
    assert model.predict([r.text.encode() for r in clean])[2].mean() < 0.01
    short = [" ".join(r.text.split()[:4]).encode() for r in clean]
    assert model.predict(short)[2].mean() < 0.02


def test_a_language_left_out_of_training_is_rejected(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").filter("lang IS NOT NULL AND text IS NOT NULL")
    for language in ("es", "en"):
        model = langid.train(docs, F.col("lang") != language)
        rows = docs.select("lang", "text").collect()
        rejected = {own: model.predict([r.text.encode() for r in rows if (r.lang == language) == own])[2].mean() for own in (True, False)}
        assert rejected[True] > 0.95 and rejected[False] < 0.02


@pytest.mark.parametrize("config", [classify.TOXICITY, classify.QUALITY])
def test_scores_do_not_depend_on_neighbours(config):
    rng = random.Random(5)
    words = ["river", "stone", "fool", "green", "idiot", "cloud"]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 1, 2, 3, 40]))).encode() for _ in range(300)]
    model = fit(texts, np.array([b"fool" in t for t in texts], dtype=int), config)
    alone = np.array([model.predict([t])[0] for t in texts])
    assert (model.predict(texts) == alone).all()
    assert (model.predict(texts[::-1])[::-1] == alone).all()
    long = b" ".join(texts * 80)
    assert len(long) > 2 << 17
    assert model._long(long) == pytest.approx(model._chunk([long])[0], abs=1e-9)


def test_gram_counts_do_not_depend_on_neighbours():
    texts = [b"ein haus", b"abc", b"x", b"the end"]
    assert (langid.counts(texts) == np.concatenate([langid.counts([t]) for t in texts])).all()


@pytest.mark.parametrize("norm", [1, 100, 1000, 100_000])
def test_copies_of_any_norm_are_found_by_id(norm):
    rng = np.random.default_rng(2)
    for _ in range(20):
        one = rng.standard_normal(64)
        x = np.tile(one * norm / np.linalg.norm(one), (600, 1))
        ids = rng.permutation(1000)[:600]
        tree = ann.Tree(x)
        tree.root = (0, 0.0, np.arange(1, 300), np.arange(300, 600))  # copies in two leaves
        rows, d = tree.search(x[:1], np.array([-1]), ids, 10, 1.0)
        assert ids[rows[0]].tolist() == sorted(ids.tolist())[:10] and (d == 0).all()
