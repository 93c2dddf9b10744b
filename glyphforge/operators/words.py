"""Running text by way of its distinct words: each is converted once, however often it occurs.

Text falls into cores and what separates them: ASCII blanks and punctuation that no mark
composes with, no word holds, and no case rule looks through (so not the apostrophe, and
full stops and colons only where a separator or the end follows).  What is done to a text is
then what is done to its cores one by one; separators stay as they are.

Texts meet their dictionary in two ways.  The HOT most frequent entries, of bounded length,
are broadcast.  Of what is left none has more than 1 / HOT of all occurrences, since HOT
others have as many, so the rest joins by a plain shuffle without a hot key: each text asks
for its distinct other words once (`asked`), and gets them as a dictionary of its own.  Texts
stay whole; no row is made for an occurrence that is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import over_slices, per_row
from ..session import settle

_SEPARATOR = r"\x09-\x0D\x20!\"#$%&()*+,\-/;?@\[\\\]{|}~"
_CORE = f"(?:[^{_SEPARATOR}.:]++|[.:]++(?![{_SEPARATOR}]|\\z))++"
_BETWEEN = f"[.:]*+[{_SEPARATOR}]*+"
#: A core and what follows it; what comes before the first core stands alone.
_PAIR = f"{_CORE}{_BETWEEN}|[.:]*+[{_SEPARATOR}]++|[.:]++"
#: Entries broadcast at most, and their characters: some 50 MB if all were as long as can be.
HOT, HOT_CHARS = 200_000, 64


def free(columns: list[str], name: str) -> str:
    """`name`, or what no column is called."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def pairs(text: Column) -> Column:
    """The cores of a text in order, each with what separates it from the next."""
    return F.regexp_extract_all(text, F.lit(_PAIR), F.lit(0))


def core(pair: Column) -> Column:
    """The core of a pair; null where there is none."""
    return F.nullif(F.regexp_extract(pair, f"^{_CORE}", 0), F.lit(""))


def numbered(docs: DataFrame, row: str = "row") -> DataFrame:
    """docs with a number for each row: its place among the rows as they are read.

    Stable as long as the rows come in the same order when they are read again, as they do
    from files and checkpoints; settle what has been shuffled before.
    """
    return docs.withColumn(row, F.monotonically_increasing_id())


def met(occurrences: DataFrame, entries: DataFrame, key: str, hot: int = HOT, outer: bool = True) -> DataFrame:
    """occurrences joined to entries by `key`; entries (key, times_, ...) are distinct, times_ tells how often each occurs.

    Null keys meet nothing; they stay if `outer`.
    """
    values = [c for c in entries.columns if c not in (key, "times_")]
    sizes = [F.length(F.col(c).cast("string")) for c in (key, *values)]
    short = F.coalesce(sum(sizes[1:], sizes[0]) <= HOT_CHARS, F.lit(False))
    often = entries.withColumn("short", short).filter("short").orderBy(F.col("times_").desc(), key).limit(hot)
    often = often.select(key, *values, F.lit(True).alias("is_hot"))
    first = occurrences.join(F.broadcast(often), key, "left")
    found = first.filter("is_hot" if not outer else f"is_hot OR {key} IS NULL").drop("is_hot")
    if entries.count() <= hot and entries.filter(~short).isEmpty():  # all of them are broadcast
        return (first if outer else found).drop("is_hot")
    rest = first.filter(f"is_hot IS NULL AND {key} IS NOT NULL").drop("is_hot", *values)
    return found.unionByName(rest.join(entries.drop("times_"), key, "left" if outer else "inner"))


def dictionary(occurrences: DataFrame, key: str, values: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """key, times_ and the values of every distinct key, computed once."""
    counted = occurrences.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("times_"))
    return settle(counted.select(key, "times_", *[f(F.col(key)).alias(name) for name, f in values.items()]))


def no_entries() -> Column:
    return F.create_map().cast("map<string,string>")


def known(entries: DataFrame, key: str, value: str, hot: int = HOT, longest: int = HOT_CHARS) -> tuple[Broadcast, bool]:
    """Entries (key, times_, value) as a dictionary that workers share: all of them, or the most frequent; and whether it holds all."""
    size = F.length(key) + F.coalesce(F.length(value), F.lit(0))
    n, total = entries.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    whole = n <= hot and total <= hot * longest
    often = entries if whole else entries.filter(size <= longest).orderBy(F.col("times_").desc(), key).limit(hot)
    return entries.sparkSession.sparkContext.broadcast(dict(map(tuple, often.select(key, value).collect()))), whole


def asked(rows: DataFrame, text: str, keys: Callable[[], Callable[[str], Iterable[str]]], key: str, often: Broadcast | None = None) -> DataFrame:
    """row_ and key: what the function that `keys` makes finds in a text, each once, unless `often` holds it."""

    def method():
        find, held = keys(), often.value if often else ()
        return lambda x: [k for k in dict.fromkeys(find(x)) if k not in held]

    return rows.select("row_", F.explode(per_row(method, "array<string>")(F.col(text))).alias(key))


def own(rows: DataFrame, wanted: DataFrame, entries: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows with `name`: a map of the entries that each row_ asked for."""
    found = wanted.join(entries.select(key, value), key).groupBy("row_").agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))
    return rows.join(found, "row_", "left").withColumn(name, F.coalesce(name, no_entries()))


def by_dictionaries(make: Callable[..., Callable], *often: Broadcast, kind: str = "string"):
    """An Arrow UDF of a text (or an array) and, for each of `often`, a map of the row's own further entries.

    `make` gets the shared dictionaries once a worker and gives a function of a text and its own ones.
    """

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        f = make(*[b.value for b in often])
        for batch in batches:
            yield from over_slices(lambda x, *more: f(x, *map(dict, more)), kind, *batch)

    return run


_CORES = re.compile(_CORE.replace("\\z", "\\Z"))


def _replacer(shared: dict[str, str | None]) -> Callable[[str, dict], str]:
    def run(x: str, more: dict[str, str | None]) -> str:
        return _CORES.sub(lambda m: (shared[w] if (w := m.group()) in shared else more[w]) or "", x)

    return run


def through_words(docs: DataFrame, text: str, convert: Callable[[Column], Column], keep: list[str], out: str = "converted", hot: int = HOT) -> DataFrame:
    """`keep` and `out`: the texts with every core as `convert` (a column function) makes it.

    Rows are told apart by their number (see `numbered`).  A null text stays null, an empty one
    empty.
    """
    rows = numbered(docs.select(*keep, F.col(text).alias("text_")), "row_").withColumn("own_", no_entries())
    cores = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(_CORE), F.lit(0))).alias("core_"))
    entries = dictionary(cores, "core_", {"out_": convert})
    often, whole = known(entries, "core_", "out_", hot)
    if not whole:
        rows = own(rows.drop("own_"), asked(rows, "text_", lambda: _CORES.findall, "core_", often), entries, "core_", "out_", "own_")
    return rows.select(*keep, by_dictionaries(_replacer, often)(F.col("text_"), F.col("own_")).alias(out))


def _occurrences(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    rows = numbered(docs.select(*keep, F.col(text).alias("text_")), "row_")
    rows = rows.select("row_", *keep, F.col("text_").isNull().alias("none_"), F.posexplode_outer(pairs(F.col("text_"))).alias("pos_", "pair_"))
    return rows.withColumn("core_", core(F.col("pair_")))


def word_sums(docs: DataFrame, text: str, measures: dict[str, Callable[[Column], Column]], keep: list[str], hot: int = HOT) -> DataFrame:
    """`keep` and for each measure (a column function that counts something in a core) its sum over the text; null texts sum to 0."""
    parts = _occurrences(docs, text, keep)
    joined = met(parts, dictionary(parts, "core_", measures), "core_", hot)
    whole = joined.groupBy("row_", *keep).agg(*[F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in measures])
    return whole.select(*keep, *measures)
