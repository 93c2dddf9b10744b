"""SQL functions: g2p, phonemes, convert_lang, to_proxy, from_proxy, normalize_text, and the table functions
unit_rows (a table in Arrow batches) and segment_units (one text)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import normalize_str, plain_udf, tokenize_str, whole
from .operators.convert import Converter
from .operators.proxy import decode_str, encode_str
from .operators.segment import Segmenter
from .operators.units import units_function
from .plans.charts import Spec
from .sources.charts import Catalog, bundled


class Made:
    """What a function makes of its arguments, kept by each worker for itself."""

    def __init__(self, make) -> None:
        self.make, self.kept = make, {}

    def __call__(self, *key):
        if key not in self.kept:
            self.kept[key] = self.make(*key)
        return self.kept[key]

    def __reduce__(self):
        return Made, (self.make,)


def register(spark: SparkSession, catalog: Catalog | None = None) -> None:
    catalog = catalog or bundled()

    reader = Made(lambda lang, output: Segmenter(Spec(catalog.load(lang), output=output)))
    converter = Made(lambda source, target: Converter(source, target, catalog=catalog))

    @F.arrow_udf("string")
    def g2p(text: pa.Array, lang: pa.Array, output: pa.Array) -> pa.Array:
        return whole(lambda t, c, o: reader(c, o).convert(t), "string", text, lang, output)

    @F.arrow_udf("array<string>")
    def phonemes(text: pa.Array, lang: pa.Array) -> pa.Array:
        return whole(lambda t, c: reader(c, "ipa").phonemes(t), "array<string>", text, lang)

    @F.arrow_udf("string")
    def convert_lang(text: pa.Array, source: pa.Array, target: pa.Array) -> pa.Array:
        return whole(lambda t, a, b: converter(a, b).convert(t), "string", text, source, target)

    to_proxy, from_proxy, normalize_text = plain_udf(encode_str), plain_udf(decode_str), plain_udf(normalize_str)

    for f, name in ((g2p, "g2p"), (phonemes, "phonemes"), (convert_lang, "convert_lang"), (to_proxy, "to_proxy"), (from_proxy, "from_proxy"), (normalize_text, "normalize_text")):
        spark.udf.register(name, f)

    class SegmentUnits:
        def eval(self, text: str, lang: str):
            if text is None or lang is None:
                return
            written, spoken = reader(lang, "grapheme"), reader(lang, "ipa")
            for tok, (word, is_word) in enumerate(tokenize_str(normalize_str(text))):
                if is_word:
                    sounds = spoken.units(word)
                    for pos, unit in enumerate(written.units(word)):
                        yield tok, pos, unit, sounds[pos] if pos < len(sounds) else None

    spark.udtf.register("unit_rows", units_function(catalog))
    spark.udtf.register("segment_units", F.udtf(SegmentUnits, returnType="tok int, pos int, unit string, ipa string"))
