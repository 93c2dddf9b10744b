"""Chat formatting: typed content parts, flattened by a visitor into one templated string.

Input: one row per turn with `conv_id`, `turn`, `role` and `parts`, an array of structs
(type, text, uri, width, height, seconds, pages).  Everything is built from DataFrame
expressions; one shuffle by conversation carries each text once.

Defined cases: a null text, role or parts array is empty; turns are ordered by (turn,
role, text), nulls first, so ties and repeated rows have one order; a null conv_id is a
conversation of its own; a very long text is a turn like any other, and a conversation may
have very many turns (work grows with its length); an empty table gives no rows; further
columns are ignored.

Template, per turn:  <|im_start|>ROLE\\nCONTENT<|im_end|>\\n
Text may hold any of these control strings.  A backslash is doubled and `<|` becomes
`<|\\`, so no text can spell a control string; a newline in a role becomes `<\\n>`.
Both are undone exactly by `unescape` and `unescape_role`.  Escaped texts sort as the texts
do, since an escape begins with what it stands for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"


@dataclass(frozen=True)
class Budget:
    """Tokens that a placeholder stands for."""

    patch: int = 28  # pixels on a side of one image token
    audio_rate: float = 25.0  # tokens a second
    page_tokens: int = 512  # tokens of a document page


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<|\\"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<|\\"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


class Visitor:
    """One method per part type: the text it leaves in the turn, and the tokens it expands to."""

    kinds = ("image", "audio", "document")

    def __init__(self, budget: Budget = Budget()) -> None:
        self.budget = budget

    def text(self, part: Column) -> Column:
        return escape(F.coalesce(part["text"], F.lit("")))

    def image(self, part: Column) -> Column:
        side = lambda n: F.ceil(F.greatest(F.coalesce(part[n], F.lit(1)), F.lit(1)) / F.lit(self.budget.patch))
        return side("width") * side("height")

    def audio(self, part: Column) -> Column:
        return F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * F.lit(self.budget.audio_rate))

    def document(self, part: Column) -> Column:
        return F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)).cast("long") * F.lit(self.budget.page_tokens)

    def placeholder(self, part: Column) -> Column:
        """What the part leaves in the text; a part of an unknown type counts as text."""
        out = self.text(part)
        for kind in self.kinds:
            out = F.when(part["type"] == kind, F.lit(f"<|{kind}|>")).otherwise(out)
        return out

    def tokens(self, part: Column) -> Column:
        out = F.lit(0).cast("long")
        for kind in self.kinds:
            out = F.when(part["type"] == kind, getattr(self, kind)(part).cast("long")).otherwise(out)
        return out

    def flatten(self, parts: Column) -> Column:
        return F.array_join(F.transform(parts, self.placeholder), "")

    def attachments(self, parts: Column) -> Column:
        """References in the order of their placeholders; text parts leave none."""
        numbered = F.transform(parts, lambda p, i: F.struct(i.alias("part"), p["type"].alias("kind"), p["uri"].alias("uri"), self.tokens(p).alias("tokens")))
        return F.filter(numbered, lambda a: a["kind"].isin(*self.kinds))


def text_parts(text: Column) -> Column:
    """The parts array of a plain text turn."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.array(
        F.struct(F.lit("text").alias("type"), text.alias("text"), null("string").alias("uri"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages"))
    )


def format_chat(turns: DataFrame, visitor: Visitor = Visitor(), trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, turns: array of (turn_no, start, chars, loss_start, loss_chars, attachments), media_tokens.

    Offsets count code points of `formatted`. The loss mask of a turn is its content if the
    turn's role is `trained_role`, and has no characters otherwise.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    role = F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), visitor.flatten(parts).alias("content"), visitor.attachments(parts).alias("attachments"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "content")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = (
        rows.withColumn("segment", F.concat(head, F.col("content"), F.lit(f"{END}\n")))
        .withColumn("chars", F.length("segment").cast("long"))
        .withColumn("head", F.length(head).cast("long"))
        .withColumn("body", F.length("content").cast("long"))
        .withColumn("turn_no", F.row_number().over(order))
        .withColumn("start", F.coalesce(F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    )
    turn = F.struct(
        "turn_no",
        "segment",
        "start",
        "chars",
        (F.col("start") + F.col("head")).alias("loss_start"),
        F.when(F.col("role") == trained_role, F.col("body")).otherwise(F.lit(0).cast("long")).alias("loss_chars"),
        "attachments",
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return grouped.select(
        "conv_id",
        F.array_join(F.col("t.segment"), "").alias("formatted"),
        F.transform("t", lambda t: t.dropFields("segment")).alias("turns"),
        F.aggregate(F.flatten(F.col("t.attachments")), F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("media_tokens"),
    )


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted text, as array of (role, content, segment), texts still escaped."""
    segments = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda s: s != "")
    body = lambda s: F.substring_index(F.split(s, "\n", 2)[1], END, 1)
    return F.transform(segments, lambda s: F.struct(F.split(s, "\n", 2)[0].alias("role"), body(s).alias("content"), F.concat(F.lit(START), s).alias("segment")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests computed from the formatted text and its loss mask alone."""
    parsed = formatted.withColumn("p", parse_chat(F.col("formatted")))
    said = F.transform("p", lambda t: F.concat(unescape_role(t["role"]), F.lit("\n"), unescape(t["content"]), F.lit("\n")))
    # the mask's offsets count from the start of `formatted`: each turn must begin where the segments read back before it end
    ends = F.zip_with("turns", "p", lambda t, p: t["start"] + F.length(p["segment"]))
    nexts = F.concat(F.slice(F.col("turns.start"), F.lit(2), F.size("turns")), F.array(F.length("formatted").cast("long")))
    fits = (F.col("turns")[0]["start"] == 0) & F.forall(F.zip_with(ends, nexts, lambda e, n: F.coalesce(e == n, F.lit(False))), lambda x: x)
    masked = F.zip_with("p", "turns", lambda p, t: F.when(t["loss_chars"] > 0, unescape(F.substr(p["segment"], (t["loss_start"] - t["start"] + 1).cast("int"), t["loss_chars"].cast("int")))).otherwise(F.lit("")))
    masked = F.when(fits, masked)
    return parsed.select("conv_id", "formatted", "media_tokens", F.size("p").cast("long").alias("n_turns"), F.array_join(said, "").alias("said"), F.array_join(masked, "").alias("loss")).select(
        "conv_id",
        "n_turns",
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "media_tokens",
    )
