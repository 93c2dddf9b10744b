"""The unit relation against plain segmentation, and against its SQL table function."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from glyphforge.functions.text import normalize_str, tokenize_str
from glyphforge.operators.segment import Segmenter
from glyphforge.operators.units import unit_relation
from glyphforge.plans.charts import Spec
from glyphforge.sources.charts import bundled
from glyphforge.sql import register

TEXTS = ["Ng'ombe, é ẹ!  ña", "", None, "ɔ̃a n̈gn ́x", "  --  ", "ÃÃ kpaẹ́ 한글 ṩ", "a" * 5000 + " é" * 2000, "½ x' ʼy", "Ng'ombe, é ẹ!  ña"]


@pytest.mark.parametrize("code", ["swh", "kus", "dyu"])
def test_units_of_texts(spark, code):
    spec = Spec(bundled().load(code))
    df = spark.createDataFrame([(i, t, "k", 1, "b") for i, t in enumerate(TEXTS)], "id int, text string, key_ string, u int, parts string")
    rows = unit_relation(df, "text", spec, ["id", "u", "parts"]).collect()
    reader, got = Segmenter(spec), {}
    for r in rows:
        got.setdefault((r["id"], r["tok"]), []).append(r)
    want = {(i, k): (w, is_word) for i, t in enumerate(TEXTS) if t for k, (w, is_word) in enumerate(tokenize_str(normalize_str(t)))}
    for place, (w, is_word) in want.items():
        units = sorted(got.pop(place, []), key=lambda r: r["pos"])
        if not is_word:
            assert [(r["pos"], r["unit"], r["is_word"], r["base"], r["marks"], r["known"]) for r in units] == [(0, w, False, None, None, False)]
            continue
        assert [r["unit"] for r in units] == [u for u in reader.units(w)]
        assert [r["pos"] for r in units] == list(range(len(units)))
        for r in units:
            assert unicodedata.normalize("NFC", r["base"] + r["marks"]) == r["unit"] and r["known"] == (r["base"] in spec.keys)
    assert not got


def test_table_function_equals_the_relation(spark):
    register(spark)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    df.createOrReplaceTempView("units_of")
    want = unit_relation(df.withColumn("key", F.col("id").cast("string")), "text", Spec(bundled().load("kus")), ["key"]).collect()
    got = spark.sql("SELECT * FROM unit_rows(TABLE(SELECT id, text FROM units_of), 'kus')").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    with pytest.raises(Exception, match="no chart"):
        spark.sql("SELECT * FROM unit_rows(TABLE(SELECT id, text FROM units_of), 'zzz')").collect()


def test_sounds_are_no_written_units(spark):
    with pytest.raises(ValueError):
        unit_relation(spark.createDataFrame([("a",)], "t string"), "t", Spec(bundled().load("kus"), output="ipa"), [])


def test_units_of_a_batch_come_out_in_parts(spark):
    """What a worker makes at once is bounded, however many rows an Arrow batch has."""
    import pyarrow as pa

    from glyphforge.functions.text import over_slices, slices
    from glyphforge.operators import units as un

    batch = pa.RecordBatch.from_arrays([pa.array(["Ng'ombe na " * 100] * 10_000)], names=["text"])
    parts = list(slices(batch, un.PART))
    assert sum(len(p) for p in parts) == 10_000 and max(p.nbytes for p in parts) <= 2 * un.PART
    units = un.Units(Spec(bundled().load("swh")))
    row, columns = units.rows(parts[0].column(0))
    assert len(set(row.to_pylist())) == len(parts[0]) and all(len(c) == len(row) for c in columns)
    made = list(over_slices(str.upper, "string", batch.column(0)))
    assert len(made) > 1 and sum(map(len, made)) == 10_000
