"""Chat formatting of typed content parts, with Column functions only.

A turn holds an array of parts ``struct<kind, text, ref, units>``. One visitor per kind turns a part into text: a text part is
escaped, an image, audio or document part becomes an ordered placeholder (``<|image:0|>``) whose reference is recorded and which
stands for ``units`` times the kind's tokens. Turns are then joined as ``<|turn role|>\\n`` + parts + ``<|end|>\\n``.

Escaping: ``\\`` becomes ``\\\\``, ``<`` becomes ``\\l`` and ``>`` becomes ``\\g`` inside roles and texts, so ``<`` and ``>`` occur in
marks alone and both directions are exact.
The loss mask is one span (turn, start, length) an assistant turn, in code points from the start of the turn; ``read_back`` takes turns,
texts and the text under the mask from the formatted string alone and the mask.

Rows: a null text is an empty one, a null role an empty one; null parts are left out and unknown kinds treated as text; turns of equal number are
ordered by role and text; repeated rows stay; rows with a null conv_id form one conversation; an empty table gives no rows. A conversation
is one string and so one row, as in any chat format.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens that one unit of a kind expands to: an image tile, a second of audio, a page of a document.
TOKENS = {"image": 256, "audio": 25, "document": 512}
PART = "struct<kind:string,text:string,ref:string,units:bigint>"
_HEAD, _MIDDLE, _END = "<|turn ", "|>\n", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    """Inverse of ``escape``: what lies between doubled backslashes has none but those of ``\\l``."""
    pieces = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))), "\\")


def text_part(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))


def _placeholder(kind: str) -> Callable[[Column, Column], Column]:
    return lambda part, number: F.concat(F.lit(f"<|{kind}:"), number.cast("string"), F.lit("|>"))


#: What each kind of part becomes; any other kind is visited as text.
VISITORS: dict[str, Callable[[Column, Column], Column]] = {kind: _placeholder(kind) for kind in TOKENS}


def flatten(parts: Column) -> Column:
    """struct(text, attachments): parts in order; attachments are numbered within the turn and carry reference and tokens."""
    held = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    foreign = F.filter(held, lambda p: F.coalesce(p["kind"], F.lit("text")).isin(*TOKENS))

    def visit(state: Column, part: Column) -> Column:
        kind, number = part["kind"], state["n"]
        shown = escape(F.coalesce(part["text"], F.lit("")))
        for name, visitor in VISITORS.items():
            shown = F.when(kind == name, visitor(part, number)).otherwise(shown)
        return F.struct(F.concat(state["text"], shown).alias("text"), (number + F.coalesce(kind, F.lit("text")).isin(*TOKENS).cast("int")).alias("n"))

    text = F.aggregate(held, F.struct(F.lit("").alias("text"), F.lit(0).alias("n")), visit)["text"]
    tokens = F.lit(0).cast("long")
    attachments = F.transform(foreign, lambda p, i: F.struct(
        i.cast("int").alias("number"), p["kind"].alias("kind"), p["ref"].alias("ref"),
        (F.coalesce(p["units"], F.lit(1)) * _tokens_of(p["kind"])).cast("long").alias("tokens")))
    return F.struct(text.alias("text"), attachments.alias("attachments"), F.aggregate(attachments, tokens, lambda a, x: a + x["tokens"]).alias("tokens"))


def _tokens_of(kind: Column) -> Column:
    out = F.lit(0)
    for name, n in TOKENS.items():
        out = F.when(kind == name, F.lit(n)).otherwise(out)
    return out


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, mask, attachments, tokens from rows (conv_id, turn, role, parts)."""
    role = F.coalesce(F.col("role"), F.lit(""))
    flat = turns.select("conv_id", "turn", role.alias("role"), flatten(F.col("parts")).alias("flat"))
    head = F.concat(F.lit(_HEAD), escape(F.col("role")), F.lit(_MIDDLE))
    span = F.when(F.col("role") == "assistant", F.struct(F.char_length(head).alias("start"), F.char_length("flat.text").alias("length")))
    rows = flat.select("conv_id", F.struct(
        "turn", "role", F.concat(head, F.col("flat.text"), F.lit(_END)).alias("shown"), span.alias("span"), "flat.attachments", "flat.tokens").alias("t"))
    joined = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    spans = F.transform("t", lambda t, i: F.when(t["span"].isNotNull(), F.struct(i.cast("int").alias("turn"), t["span"]["start"].alias("start"), t["span"]["length"].alias("length"))))
    files = F.flatten(F.transform("t", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(
        i.cast("int").alias("turn"), a["number"].alias("number"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return joined.select(
        "conv_id", F.array_join(F.transform("t", lambda t: t["shown"]), "").alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("mask"),
        files.alias("attachments"), F.aggregate("t", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("tokens"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text with placeholders), the text under the mask, formatted."""
    segments = F.slice(F.split("formatted", r"<\|turn ", -1), 2, 1_000_000_000)
    cut = chats.select("conv_id", "formatted", "mask", F.transform(segments, lambda s: F.concat(F.lit(_HEAD), s)).alias("segments"))

    def turn(s: Column) -> Column:
        head = F.locate("|>", s)
        role = F.substring(s, F.lit(len(_HEAD) + 1), head - 1 - len(_HEAD))
        text = F.substring(s, head + len(_MIDDLE), F.char_length(s) - len(_END) - len(_MIDDLE) - head + 1)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    def under(m: Column) -> Column:
        return unescape(F.substring(F.get(F.col("segments"), m["turn"]), m["start"] + 1, m["length"]))

    return cut.select("conv_id", F.transform("segments", turn).alias("turns"), F.array_join(F.transform("mask", under), "").alias("loss"), "formatted")


def digests(read: DataFrame) -> DataFrame:
    """Counts and digests of what ``read_back`` gives."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
