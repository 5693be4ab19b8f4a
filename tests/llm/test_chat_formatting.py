"""Conversations formatted and read back: control strings in texts, parts, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from passaura.llm import chat_formatting as chat

ROWS = "conv_id long, turn int, role string, text string"


def read_back(spark, rows, **how):
    out = chat.formatted(spark.createDataFrame(rows, ROWS), **how)
    return {r.conv_id: r for r in out.select("*", chat.turns_of(F.col("formatted")).alias("turns"), chat.text_under_loss(F.col("formatted"), F.col("loss")).alias("trained")).collect()}


def test_control_strings_are_escaped_and_read_back(spark):
    """Texts of control strings, parts of these and backslashes come back; the output holds no control string but its own."""
    r, t = random.Random(3), chat.Template()
    bits = [*t.controls, "\\", "\\\\", "<", "|", "[", ">", "/s>", "INST]", "|end|>", "é", "😀", "\n", "$1", "a"]
    rows = [(k, turn, r.choice(["user", "assistant", "system", "<|end|>"]), "".join(r.choice(bits) for _ in range(r.randint(0, 9)))) for k in range(200) for turn in range(r.randint(1, 4))]
    got = read_back(spark, rows)
    for k in range(200):
        own = [(x[2], x[3]) for x in rows if x[0] == k]
        assert [tuple(x) for x in got[k].turns] == own and got[k].n_turns == len(own)
        assert got[k].trained == "".join(text for role, text in own if role == "assistant")
        text = got[k].formatted
        assert [text.count(x) for x in (t.start, t.message, t.end)] == [len(own)] * 3 and not any(x in text for x in t.foreign)
        assert sum(x.skip + x.take for x in got[k].loss) == len(text)


def test_parts(spark):
    """Parts become placeholders in order, with references and token counts; loss is on the texts alone."""
    part = "struct<type:string,text:string,ref:string,width:int,height:int,millis:long,pages:int>"
    rows = [
        (1, 1, "assistant", [("text", "see <|image|>", None, None, None, None, None), ("image", None, "a.png", 449, 100, None, None), ("text", "é!", None, None, None, None, None), None, (None, "?", None, None, None, None, None)]),
        (1, 0, "user", [("document", None, "d.pdf", None, None, None, 3), ("audio", "x", "s.wav", None, None, 1001, None), ("image", None, None, None, None, None, None)]),
        (1, 2, "user", None), (2, 0, None, []),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, content array<{part}>")
    out = chat.formatted(df, content=F.col("content"))
    got = {r.conv_id: r for r in out.select("*", chat.turns_of(F.col("formatted")).alias("turns"), chat.text_under_loss(F.col("formatted"), F.col("loss")).alias("trained")).collect()}
    assert [tuple(x) for x in got[1].attachments] == [(0, 0, "document", "d.pdf", 3072), (0, 1, "audio", "s.wav", 26), (0, 2, "image", None, 0), (1, 0, "image", "a.png", 512)]
    assert got[1].n_expanded_tokens == 3072 + 26 + 512 and got[2].n_expanded_tokens == 0 and got[2].attachments == []
    assert [tuple(x) for x in got[1].turns] == [("user", "<|document|><|audio|><|image|>"), ("assistant", "see <|image|><|image|>é!?"), ("user", "")]
    assert "see <\\|image|><|image|>é!?" in got[1].formatted and got[1].trained == "see <|image|>é!?" and [tuple(x) for x in got[2].turns] == [("", "")]
    with pytest.raises(Exception, match="no such type of part: video"):
        chat.formatted(spark.createDataFrame([(1, 0, "user", [("video", *[None] * 6)])], df.schema), content=F.col("content")).collect()


def test_a_visitor_of_ones_own(spark):
    class Flat(chat.Visitor):
        def image(self, part):
            return self._held("image", F.lit(64))

    t = chat.Template(placeholders={"image": "<|pic|>", "audio": "<|snd|>", "document": "<|doc|>"}, trained=("assistant", "tool"))
    content = F.array(F.struct(*(F.lit("image" if x == "type" else None).alias(x) for x in ("type", "text", "ref", "width", "height", "millis", "pages")))).cast(chat.PARTS)
    got = chat.formatted(spark.createDataFrame([(1, 0, "tool", "x")], ROWS), content=content, template=t, visitor=Flat(t)).first()
    assert got.n_expanded_tokens == 64 and got.formatted == "<|start|>tool<|message|><|pic|><|end|>"


def test_odd_rows(spark):
    """Nulls are empty and first; repeated rows stay; a null id is a conversation; long texts and many turns; clashing names; empty tables."""
    long = "ab<|end|>" * 200_000
    rows = [(None, 1, "user", "n"), (1, None, "assistant", None), (1, 0, None, "b"), (1, 0, None, "b"), (2, 0, "assistant", long), *((3, k, "assistant", f"{k}") for k in range(3000))]
    got = read_back(spark, rows)
    assert [tuple(x) for x in got[1].turns] == [("assistant", ""), ("", "b"), ("", "b")] and [tuple(x) for x in got[None].turns] == [("user", "n")]
    assert got[2].trained == long and got[3].trained == "".join(map(str, range(3000))) and got[3].n_turns == 3000
    clash = spark.createDataFrame([(1, 0, "user", "t", 5, 6)], ROWS + ", formatted int, `a.b` int")
    assert chat.formatted(clash).first().formatted == "<|start|>user<|message|>t<|end|>"
    assert chat.formatted(clash.limit(0)).count() == 0


def test_a_mask_of_another_text_is_an_error(spark):
    df = chat.formatted(spark.createDataFrame([(1, 0, "assistant", "abc")], ROWS))
    with pytest.raises(Exception, match="the mask is of another text"):
        df.select(chat.text_under_loss(F.concat(F.lit("x"), "formatted"), F.col("loss"))).collect()


@pytest.mark.parametrize("strings", [{"start": "<<s>"}, {"start": "<"}, {"end": "<|start|>"}, {"message": "<\\m>"}])
def test_templates_that_cannot_be_read_back(strings):
    with pytest.raises(ValueError):
        chat.Template(**strings)
