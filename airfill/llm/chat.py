"""Chat formatting (operator 3): turns collected per conversation, sorted, adjacent turns of one
role merged into a block, and the blocks concatenated - Spark expressions only.

The template, with its control strings:

    system      <<SYS>>text<</SYS>>
    user        [INST]text[/INST]
    assistant   <s>text</s>                      (its texts are under the loss mask)
    any other   <<ROLE>>role<sep>text<</ROLE>>

Turns merged into one block are separated by ``<sep>``. In texts and role names a backslash is
doubled and a control string gets a backslash after its first character, so a control string
in the output is always the template's, and every text can be read back as it was.

Defined results: null text and null role are empty strings; turns are ordered by turn number
(null first), then role, then text, so ties and repeated rows have one order and all stay; rows
with a null conversation id form one conversation; an empty table gives no rows. A conversation
is one output row, so it has to fit one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
CONTROLS = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<sep>"]
FRAMES = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("<<ROLE>>", "<</ROLE>>")
SEPARATOR, LOSS_ROLE = "<sep>", "assistant"


def _tails(first: str) -> str:
    return "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == first)


_ESCAPE = rf"<(?={_tails('<')})|\[(?={_tails('[')})"
_ANY = "|".join(re.escape(c) for c in CONTROLS)
#: After or before a control string; the single characters first, which most places fail.
_BOUNDARY = rf"(?<=[>\]])(?<={_ANY})|(?=[<\[])(?={_ANY})"
_BLOCK = r"(?s)(\[INST\]|<s>|<<SYS>>|<<ROLE>>)(.*?)(\[/INST\]|</s>|<</SYS>>|<</ROLE>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _ESCAPE, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _frame(role: Column, side: int) -> Column:
    out = F.lit(OTHER[side])
    for name, ends in FRAMES.items():
        out = F.when(role == name, F.lit(ends[side])).otherwise(out)
    return out


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, and loss_mask, the runs of the formatted
    text in order with their length in code points and whether they are under the loss."""
    one = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    collected = one.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    n = F.size("turns")
    at = lambda i: F.element_at("turns", (i + 1).cast("int"))
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (at(i)["role"] != at(
        F.greatest(i - 1, F.lit(0)))["role"]))
    merged = collected.withColumn("starts", starts).withColumn("blocks", F.transform(
        "starts", lambda s, k: F.struct(
            at(s)["role"].alias("role"),
            F.transform(F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), n) - s),
                        lambda t: escape(t["text"])).alias("texts"))))

    def run(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def runs(block: Column) -> Column:
        """The block's text as runs: frame, texts with separators between, frame."""
        name, texts, no = block["role"], block["texts"], F.lit(False)
        known = name.isin(list(FRAMES))
        head = F.when(known, F.array(run(_frame(name, 0), no))).otherwise(
            F.array(run(_frame(name, 0), no), run(escape(name), no), run(F.lit(SEPARATOR), no)))
        body = F.flatten(F.transform(texts, lambda t, i: F.when(i == 0, F.array(run(t, name == LOSS_ROLE))).otherwise(
            F.array(run(F.lit(SEPARATOR), no), run(t, name == LOSS_ROLE)))))
        return F.concat(head, body, F.array(run(_frame(name, 1), no)))

    return (merged.withColumn("runs", F.flatten(F.transform("blocks", runs)))
                  .select("conv_id", F.array_join(F.transform("runs", lambda r: r["text"]), "").alias("formatted"),
                          F.transform("runs", lambda r: F.struct(
                              F.length(r["text"]).alias("chars"), r["loss"].alias("loss"))).alias("loss_mask")))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    blocks = F.regexp_extract_all(formatted, F.lit(_BLOCK), F.lit(0))

    def turns(block: Column) -> Column:
        head = F.regexp_extract(block, _BLOCK, 1)
        parts = F.split(F.regexp_extract(block, _BLOCK, 2), re.escape(SEPARATOR), -1)
        known = F.lit("")
        for name, ends in FRAMES.items():
            known = F.when(head == ends[0], F.lit(name)).otherwise(known)
        other = head == OTHER[0]
        name = F.when(other, unescape(F.element_at(parts, 1))).otherwise(known)
        texts = F.when(other, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
        return F.transform(texts, lambda t: F.struct(name.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, loss_mask: Column) -> Column:
    """The texts under the loss mask, unescaped, in order (array of strings). Runs and pieces
    between control strings line up once the empty ones are left out."""
    pieces = F.filter(F.split(formatted, _BOUNDARY, -1), lambda p: p != "")
    runs = F.filter(loss_mask, lambda r: r["chars"] > 0)
    under = F.filter(F.zip_with(pieces, runs, lambda p, r: F.struct(p.alias("piece"), r["loss"].alias("loss"))),
                     lambda z: z["loss"])
    return F.transform(under, lambda z: unescape(z["piece"]))


def digests(formatted: DataFrame) -> DataFrame:
    """Read back from the output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars."""
    loss = F.array_join("loss", "")
    return (formatted.withColumn("turns", read_turns(F.col("formatted")))
            .withColumn("loss", read_loss(F.col("formatted"), F.col("loss_mask")))
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                    F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(
                        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
                    F.length(loss).cast("long").alias("loss_chars"),
                    F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars")))
