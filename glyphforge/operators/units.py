"""The unit relation: a row for every written unit of every word, and for what stands between words."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import REMEMBERED, Memo, nfd_str, normalize_str, piece_pattern, slices, word_pattern
from ..plans.charts import Spec
from ..sources.charts import Catalog, bundled
from .words import free

COLUMNS, KINDS = "tok pos is_word unit base marks known", "integer integer boolean string string string boolean"
ROWS = "key string, tok int, pos int, is_word boolean, unit string, base string, marks string, known boolean"


TYPES = (pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.bool_())
PART = 1 << 18  # bytes of text whose units are made at once


class Units:
    """The unit relation of batches of texts in Arrow columns; a worker cuts a distinct word once."""

    def __init__(self, spec: Spec) -> None:
        self.spec = spec
        self._begin()

    def _begin(self) -> None:
        self.number: dict[tuple, int] = {}  # (is_word, unit, base, marks, known)
        self.pieces, self.columns = Memo(self._cut), []

    def _cut(self, piece: str) -> np.ndarray:
        """Numbers of the units of a word, or of what stands between two."""
        found = [(False, piece, None, None, False)]
        if word_pattern().match(piece):
            found = []
            for key, marks, other in self.spec.pattern.findall(nfd_str(piece)):
                if key:
                    base = self.spec.latin.get(key, key)
                    found.append((True, unicodedata.normalize("NFC", base + marks), base, marks, True))
                elif not unicodedata.combining(other):
                    found.append((True, other, other, "", False))
        return np.array([self.number.setdefault(u, len(self.number)) for u in found], np.int32)

    def rows(self, texts: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
        """For each unit the place of its text, and the columns of the relation."""
        if len(self.number) > REMEMBERED:
            self._begin()
        split = [[] if x is None else piece_pattern().findall(normalize_str(x)) for x in texts.to_pylist()]
        counts = np.array([len(s) for s in split], np.int64)
        cut = [self.pieces[p] for s in split for p in s]
        sizes = np.array([len(c) for c in cut], np.int64)
        ids = np.concatenate([np.empty(0, np.int32), *cut])
        row = np.repeat(np.repeat(np.arange(len(split)), counts), sizes)
        tok = np.repeat(np.arange(len(cut)) - np.repeat(counts.cumsum() - counts, counts), sizes)
        pos = np.arange(len(ids)) - np.repeat(sizes.cumsum() - sizes, sizes)
        if not self.columns or len(self.columns[0]) < len(self.number):
            self.columns = [pa.array([u[k] for u in self.number], kind) for k, kind in enumerate(TYPES[2:])]
        at = pa.array(ids)
        return pa.array(row), [pa.array(tok.astype(np.int32)), pa.array(pos.astype(np.int32)), *[c.take(at) for c in self.columns]]


def unit_relation(docs: DataFrame, text: str, spec: Spec, keep: list[str]) -> DataFrame:
    """keep, tok, pos, is_word, unit, base, marks, known: Arrow batches go in, parts of bounded size come out.

    `base` is the key that a unit was matched by (its latin form in that output), decomposed
    as `marks` are, `unit` both composed.  A character that is no key is a unit of its own,
    not known; what stands between words is one row with neither.  Null and empty texts have
    no rows, nor do words of marks alone.
    """
    if spec.output == "ipa":
        raise ValueError("written units need output grapheme or latin; `respell.word_sounds` gives sounds")
    given = docs.select(*keep, F.col(text).alias(free(docs.columns, "text_")))
    schema = StructType(given.schema.fields[:-1])
    for name, kind in zip(COLUMNS.split(" "), KINDS.split(" "), strict=True):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(spec)
        for batch in batches:
            for part in slices(batch, PART):
                row, columns = units.rows(part.column(len(keep)))
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(row) for k in range(len(keep))], *columns], names=schema.names)

    return given.mapInArrow(run, schema)


def units_function(catalog: Catalog | None = None):
    """The SQL table function `unit_rows(TABLE(SELECT key, text FROM t), 'swh')`: key as a string, and the columns of the unit relation.

    The table's first column is the key, its second the text.  Arrow batches go in, parts of
    bounded size come out; each worker cuts a distinct word once.  (Arrow table functions have a fixed schema.)
    """
    charts = (catalog or bundled()).charts

    class UnitRows:
        def __init__(self) -> None:
            self.made: dict[str, Units] = {}

        def eval(self, table: pa.RecordBatch, lang: pa.Array) -> Iterator[pa.Table]:
            code = lang[0].as_py()
            if code not in charts:
                raise ValueError(f"no chart for {code!r}")
            if code not in self.made:
                self.made[code] = Units(Spec(charts[code]))
            for part in slices(table, PART):
                row, columns = self.made[code].rows(part.column(1))
                yield pa.Table.from_arrays([part.column(0).cast(pa.string()).take(row), *columns], names=["key", *COLUMNS.split(" ")])

    return F.arrow_udtf(UnitRows, returnType=ROWS)
