"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a word budget.  A source whose budget exceeds its size gives complete
epochs first; the rest is chosen by exponential keys -ln(u) / quality, smallest first,
prefix-summed to the budget.  The document on which the budget ends gives only its first
words, so the words taken equal the budget.

No task ever holds a source.  Keys fall into ranges on a logarithmic scale, STEPS to each
doubling.  Whatever the qualities of a source's documents, a range holds at most a share of
ln(2) / (e * STEPS) of them on average (0.025 %), for that is the largest density of the
logarithm of an exponential number.  Sums per (source, range) place the budget, and only
rows of one (source, range) are ordered together.  Sources are ranked, and budgets reshared,
over partitions by range with the partitions' own totals added, so any number of sources
will do.

Keys hash the id, the text and a copy's number, so rows without an id and exact repeats draw
each for itself.

Defined cases: a null text has no words; null sources are one source, ranked last; rows
that tie in key are ordered by id, text digest and copy; documents without words take
nothing; a very long text is a document like any other; repeated rows are documents of
their own; an empty table gives no rows; further columns are ignored by `mix` and kept by
`emit`, whatever their names and types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh

STEPS = 1024
RUN = 4096  # copies of one row in a task
HOT_SHARE = 1024
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """1 where words have six characters on average with their spaces, less the further they are from it."""
    chars = F.length(F.coalesce(text, F.lit(""))).cast("double")
    return F.when(size > 0, 1.0 / (1.0 + F.abs(chars / size - 6.0))).otherwise(F.lit(1.0))


def uniform(*parts: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on the parts alone."""
    text = F.concat_ws("/", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0**52)


def ranged(rows: DataFrame, by: list[Column], sums: dict[str, str], order: list[str]) -> DataFrame:
    """rows with running sums from the first row on, in the order of `by` (ties by `order`); no task holds all rows.

    `sums` names each new column and the column that it adds up; a row's own value is left out.
    """
    spark, part = rows.sparkSession, fresh(rows.columns, "part")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written, so that a partition's number stays what it was when the rows are read again
    dealt = cut(rows.repartitionByRange(partitions, *by).withColumn(part, F.spark_partition_id()))
    totals = dealt.groupBy(part).agg(*[F.sum(c).alias(f"{name}_all") for name, c in sums.items()])
    lower = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = totals.select(F.col(part).alias(f"{part}_of"), *[F.coalesce(F.sum(f"{name}_all").over(lower), F.lit(0)).alias(f"{name}_off") for name in sums])
    within = Window.partitionBy(part).orderBy(*by, *order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"{name}_in") for name, c in sums.items()])
    out = local.join(F.broadcast(offsets), F.col(part) == F.col(f"{part}_of"))
    return out.select(*rows.columns, *[(F.col(f"{name}_in") + F.col(f"{name}_off")).alias(name) for name in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """key, source, source_size -> with `target`: budgets by weight, none above `most` times its source.

    Raising a common level fills all sources in step with their weights; the sources that
    reach their limit first are those with the least limit by weight, so sorted by that
    ratio the full ones are a prefix and the level is one division.
    """
    ranked = ranged(sizes.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], {"rank": "one"}, ["key"])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("w", weight).withColumn("most", (F.col("source_size") * most).cast("double"))
    filled = ranged(ranked.withColumn("ratio", F.col("most") / F.col("w")), [F.col("ratio")], {"spent": "most", "weight_spent": "w"}, ["rank"])
    total, weight = filled.agg(F.sum("source_size") * F.lit(share), F.sum("w")).first()
    level = filled.withColumn("level", (F.lit(total) - F.col("spent")) / (F.lit(weight) - F.col("weight_spent")))
    level = level.withColumn("full", F.col("most") <= F.col("w") * F.col("level"))
    (final,) = level.agg(F.max(F.when(~F.col("full"), F.col("level")))).first()
    return level.select("key", "source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("w") * F.lit(final).cast("double")).alias("target"))


def mix(docs: DataFrame, seed: str = SEED, steps: int = STEPS, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of `docs`; with columns `more` of docs also these and the number of each among rows alike."""
    size = n_words(F.col("text"))
    rows = docs.select("doc_id", "source", *more, size.alias("size"), quality(F.col("text"), size).alias("quality"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    # rows alike in all of these are counted and numbered again in runs, so that each copy draws for itself and no task holds them all
    rows = cut(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")))
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {RUN}")))
    nth = F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("copies"), (F.col("run") + 1) * RUN) - 1))
    many = rows.filter("copies > 1").withColumn("run", run).repartition("doc_id", "digest", "run").withColumn("nth", nth).drop("run")
    rows = rows.filter("copies = 1").withColumn("nth", F.lit(0).cast("long")).unionByName(many).drop("copies")
    draw = uniform(F.col("doc_id"), F.col("digest"), F.col("nth"), *[F.col(c) for c in more], seed=seed)
    rows = rows.withColumn("draw", -F.log(draw) / F.col("quality")).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    rows = cut(rows.withColumn("bucket", F.floor(F.log2("draw") * steps).cast("int")))
    sums = rows.groupBy("key", "source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(sums.groupBy("key", "source").agg(F.sum("bucket_size").alias("source_size")), weights, share, most)
    whole = F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("source_size") * most)
    budgets = targets.withColumn("budget", whole).withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0).cast("long")))
    budgets = budgets.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")).drop("source")
    lower = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.drop("source").withColumn("below", F.coalesce(F.sum("bucket_size").over(lower), F.lit(0).cast("long"))).join(budgets, "key").drop("bucket_size")
    within = Window.partitionBy("key", "bucket").orderBy("draw", "doc_id", "digest", "nth", *more).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(placed, ["key", "bucket"]).withColumn("ahead", F.col("below") + F.coalesce(F.sum("size").over(within), F.lit(0).cast("long")))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("ahead")))
    return out.select("doc_id", *more, *(["nth"] if more else []), "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("epochs") * F.col("size") + part).alias("taken"))


def _identity(docs: DataFrame) -> list[Column]:
    """Two hashes of a whole row, nulls told from values; columns that hold maps go in as JSON."""
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    nulls = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in plain])
    return [F.xxhash64(nulls, *plain), F.xxhash64(F.lit(SEED), *plain, nulls)]


def emit(docs: DataFrame, seed: str = SEED, hot: int | None = None) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, the last copy cut to the words left.

    The columns are those of `docs`.  Rows are known by two hashes of all their columns; rows
    that are alike in every column are numbered on both sides, so that each takes its own share.
    Rows with more copies than `hot` (a 1,024th of all, so at most 1,024 such rows) meet their
    shares in runs of RUN instead, a copy of the row for each run.
    """
    columns = docs.columns
    one, two, one_of, two_of, size, taken, nth, share, copy, run, copies = fresh(columns, "one", "two", "one_of", "two_of", "size", "taken", "nth", "share", "copy", "run", "copies")
    first, second = _identity(docs)
    tagged = docs.withColumns({one: first, two: second})
    shares = mix(tagged, seed, more=(one, two)).select(F.col(one).alias(one_of), F.col(two).alias(two_of), F.col("nth").alias(share), F.col("size").alias(size), F.col("taken").alias(taken))
    shares = shares.filter(F.col(taken) > 0)
    if hot is None:
        hot = max(RUN, docs.count() // HOT_SHARE)
    often = [r[0] for r in tagged.groupBy(one, two).count().filter(F.col("count") > hot).select(one).collect()]
    is_hot = lambda c: F.col(c).isin(*often) if often else F.lit(False)
    same = (F.col(one) == F.col(one_of)) & (F.col(two) == F.col(two_of))
    numbered = tagged.filter(~is_hot(one)).withColumn(nth, F.row_number().over(Window.partitionBy(one, two).orderBy(one)) - 1)
    both = numbered.join(shares.filter(~is_hot(one_of)), same & (F.col(nth) == F.col(share))).select(*[F.col(f"`{c}`") for c in columns], size, taken)
    if often:
        row = F.struct(*[F.col(f"`{c}`") for c in columns])
        classes = tagged.filter(is_hot(one)).groupBy(one, two).agg(F.first(row).alias("row"), F.count(F.lit(1)).alias(copies))
        classes = classes.withColumn(run, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{copies}` - 1) div {RUN}"))))
        met = classes.join(shares.filter(is_hot(one_of)), same & (F.col(run) == F.expr(f"`{share}` div {RUN}")))
        both = both.unionAll(met.select(*[F.col("row")[c].alias(c) for c in columns], size, taken))
    both = both.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col(taken) / F.col(size)))))
    left = F.col(taken) - (F.col(copy) - 1) * F.col(size)
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    text = F.when(left >= F.col(size), F.col("text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), left.cast("int")), ""))
    return both.withColumn("text", text).select(*[F.col(f"`{c}`") for c in columns])
