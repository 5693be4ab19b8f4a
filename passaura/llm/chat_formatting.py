"""Conversations as training text, in DataFrame and SQL functions only.

A message's content is a list of typed parts. A visitor has one method for each type: it says what stands for a part in
the text, what attachment it refers to and how many tokens the model puts in the place of its placeholder. So text,
image, audio and document parts become one text with placeholders in order, and a list of attachments beside it.

The template marks turns with control strings. Texts and roles may hold such strings (or those of other templates, which
a tokenizer might know): a backslash after the first character takes their meaning, one more where there are some
already, and reading back takes one off. Control strings begin with one of a few characters that they hold nowhere
else, so no two overlap and this is exact both ways.

The loss mask is a list of runs: so many code points without loss, then so many with. There is a run for each control
string and the text up to the next, so that a reader cuts the output at control strings and takes each run's part.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, prepare

#: A part: its type, the text of a text part, else where the attachment is and what its size is.
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,millis:long,pages:int>>"
#: Control strings of other public templates, which texts should not be able to say either: fixed values.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>")


@dataclass(frozen=True)
class Template:
    """Control strings before a role, before and after a message; roles with loss; further strings to be escaped."""

    start: str = "<|start|>"
    message: str = "<|message|>"
    end: str = "<|end|>"
    placeholders: dict[str, str] = field(default_factory=lambda: {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"})
    trained: tuple[str, ...] = ("assistant",)
    foreign: tuple[str, ...] = FOREIGN

    def __post_init__(self):
        own = self.own
        if len(set(own)) < len(own):
            raise ValueError("control strings must differ")
        first = {x[:1] for x in self.controls}
        if any(len(x) < 2 or set(x[1:]) & (first | {"\\"}) for x in self.controls):
            raise ValueError("a control string needs two characters, none after the first a backslash or the first of any")

    @property
    def own(self) -> tuple[str, ...]:
        return (self.start, self.message, self.end, *self.placeholders.values())

    @property
    def controls(self) -> tuple[str, ...]:
        return (*self.own, *self.foreign)

    @property
    def bounds(self) -> str:
        """A pattern of the places before the template's own control strings."""
        return f"(?={'|'.join(map(re.escape, self.own))})"

    def _pattern(self, least: str) -> str:
        by: dict[str, list[str]] = {}
        for x in dict.fromkeys(self.controls):
            by.setdefault(x[0], []).append(re.escape(x[1:]))
        return "|".join(rf"(?<={re.escape(c)}){least}(?=\\*(?:{'|'.join(rest)}))" for c, rest in by.items())

    def escaped(self, text: Column) -> Column:
        """One backslash more after the first character of each control string and each escaped one."""
        return F.regexp_replace(text, self._pattern(""), r"\\")

    def read(self, text: Column) -> Column:
        """What escaped() was given."""
        return F.regexp_replace(text, self._pattern(r"\\"), "")


class Visitor:
    """What each type of part becomes; for other models, override a method or its parameters.

    A method takes the part and returns struct(text, attachment, n_tokens): the text to stand in the message, the kind of attachment (null:
    none) and the tokens of its placeholder when expanded (of text: null, its tokenizer says). A null size counts as nothing.
    """

    def __init__(self, template: Template, tile: int = 448, tile_tokens: int = 256, audio_rate: int = 25, page_tokens: int = 1024):
        self.template, self.tile, self.tile_tokens, self.audio_rate, self.page_tokens = template, tile, tile_tokens, audio_rate, page_tokens

    def _held(self, kind: str, n: Column) -> Column:
        return F.struct(F.lit(self.template.placeholders[kind]).alias("text"), F.lit(kind).alias("kind"), F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"))

    def text(self, part: Column) -> Column:
        written = self.template.escaped(F.coalesce(part["text"], F.lit("")))
        return F.struct(written.alias("text"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("n_tokens"))

    def image(self, part: Column) -> Column:
        tiles = F.ceil(part["width"] / self.tile) * F.ceil(part["height"] / self.tile)
        return self._held("image", tiles * self.tile_tokens)

    def audio(self, part: Column) -> Column:
        return self._held("audio", F.ceil(part["millis"] * self.audio_rate / 1000))

    def document(self, part: Column) -> Column:
        return self._held("document", part["pages"] * self.page_tokens)

    def visit(self, part: Column) -> Column:
        """By the part's type; null is text, a type that is not known an error."""
        kind = F.coalesce(part["type"], F.lit("text"))
        of: dict[str, Callable[[Column], Column]] = {"text": self.text, "image": self.image, "audio": self.audio, "document": self.document}
        out = None
        for name, method in of.items():
            out = F.when(kind == name, method(part)) if out is None else out.when(kind == name, method(part))
        return out.otherwise(F.raise_error(F.concat(F.lit("no such type of part: "), kind)).cast("struct<text:string,kind:string,n_tokens:long>"))


def text_parts(text: Column) -> Column:
    """A plain text as content: one text part."""
    empty = lambda kind: F.lit(None).cast(kind)
    part = F.struct(F.lit("text").alias("type"), text.alias("text"), empty("string").alias("ref"), empty("int").alias("width"), empty("int").alias("height"), empty("long").alias("millis"), empty("int").alias("pages"))
    return F.array(part)


def _runs(message: Column, trained: Column, template: Template) -> Column:
    """array<struct<skip, take>> of a formatted message."""

    def run(cut: Column) -> Column:
        n = F.length(cut)
        head = F.lit(None).cast("int")
        for x in (template.message, *template.placeholders.values()):
            head = F.when(cut.startswith(x), len(x)).otherwise(head)
        skip = F.when(trained, F.coalesce(head, n)).otherwise(n)
        return F.struct(skip.alias("skip"), (n - skip).alias("take"))

    return F.transform(F.split(message, template.bounds), run)


def formatted(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content: Column | None = None, template: Template | None = None, visitor: Visitor | None = None) -> DataFrame:
    """(id_col, n_turns, formatted, loss, attachments, n_expanded_tokens) of each conversation of rows.

    content is a column of PARTS; by default the column `text`, as one text part. Turns are in order of turn_col, nulls
    first; those of equal number by role and content, so repeated rows come out as often as they go in. Null roles,
    texts, contents and parts are empty; null ids are one conversation; other columns of rows are ignored, whatever their
    names; an empty table gives no rows. loss: array<struct<skip, take>> over formatted's code points, for each control string and
    the text up to the next. attachments: array<struct<turn, at, kind, ref, n_tokens>>, turn and at counting from 0 (turns of the
    conversation, attachments of the turn) in the order of their placeholders; n_expanded_tokens is their sum.
    A conversation is one value of the result, so it must fit in one (2 GB); raw rows are shuffled once, by conversation.
    """
    prepare(rows.sparkSession)
    template = template or Template()
    visitor = visitor or Visitor(template)
    content = text_parts(F.col("text")) if content is None else content
    role = F.coalesce(named(role_col), F.lit(""))
    turn = F.struct(named(turn_col).alias("turn"), role.alias("role"), F.coalesce(content, F.array().cast(PARTS)).cast(PARTS).alias("content"))
    held = rows.select(named(id_col).alias("id"), turn.alias("row")).groupBy("id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def visited(row: Column) -> Column:
        seen = F.transform(F.filter(row["content"], lambda p: p.isNotNull()), lambda p: F.struct(visitor.visit(p).alias("out"), p["ref"].alias("ref")))
        return F.struct(row["role"].alias("role"), seen.alias("seen"))

    def message(row: Column, k: Column) -> Column:
        text = F.concat(F.lit(template.start), template.escaped(row["role"]), F.lit(template.message), F.array_join(F.transform(row["seen"], lambda p: p["out"]["text"]), ""), F.lit(template.end))
        found = F.filter(row["seen"], lambda p: p["out"]["kind"].isNotNull())
        of = lambda p, i: F.struct(k.alias("turn"), i.alias("at"), p["out"]["kind"].alias("kind"), p["ref"].alias("ref"), p["out"]["n_tokens"].alias("n_tokens"))
        return F.struct(text.alias("text"), row["role"].isin(*template.trained).alias("trained"), F.transform(found, of).alias("attachments"))

    held = held.select("id", F.transform("rows", visited).alias("rows")).select("id", F.transform("rows", message).alias("turns"))
    out = held.select(
        "id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"),
        F.flatten(F.transform("turns", lambda t: _runs(t["text"], t["trained"], template))).alias("loss"), F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
    )
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"])
    return out.select(F.col("id").alias(id_col), "n_turns", "formatted", "loss", "attachments", tokens.alias("n_expanded_tokens"))


def turns_of(text: Column, template: Template | None = None) -> Column:
    """array<struct<role, text>> read back from a formatted conversation; placeholders stay in the text as they are."""
    template = template or Template()
    turns = F.slice(F.split(text, re.escape(template.start)), 2, 1 << 30)

    def of(turn: Column) -> Column:
        both = F.split(turn, re.escape(template.message), 2)
        body = both[1]
        return F.struct(template.read(both[0]).alias("role"), template.read(F.substring(body, F.lit(1), F.length(body) - len(template.end))).alias("text"))

    return F.transform(turns, of)


def text_under_loss(text: Column, loss: Column, template: Template | None = None) -> Column:
    """The text that the mask's runs take from a formatted conversation, read back, nothing between; an error if they do not fit it."""
    template = template or Template()
    cuts = F.split(text, template.bounds)
    parts = F.zip_with(cuts, loss, lambda cut, run: F.when(F.length(cut) == run["skip"] + run["take"], F.substring(cut, run["skip"] + 1, run["take"])).otherwise(F.raise_error(F.lit("the mask is of another text")).cast("string")))
    return F.array_join(F.transform(parts, template.read), "")
