import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpus_kb.llm import chat

HOSTILE = ["\\", "\\\\", "<", ">", "\\l", "\\\\l", "\\g<", "<|end|>\n", "<|turn user|>\n", "|>", "<|image:0|>", "\\### Assistant: </turn> ok", "", " \n ", "é\\<|", "\n"]


def test_escape_is_reversible_and_hides_marks(spark):
    texts = HOSTILE + [a + b for a in HOSTILE for b in HOSTILE]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r.u == r.t and "<" not in r.e and ">" not in r.e


def conversation(rows):
    """n_turns and the digests by plain Python."""
    rows = sorted(rows, key=lambda r: r[0])
    said = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in rows)
    loss = "".join(text or "" for _, role, text in rows if role == "assistant")
    return len(rows), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_digests_of_hostile_conversations(spark):
    rows = [(c, t, role, HOSTILE[(c * 5 + t * 3) % len(HOSTILE)] if (c + t) % 7 else None) for c in range(40) for t, role in enumerate(["system", "user", "assistant", None, "a|>b", "assistant"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", chat.text_part(F.col("text")).alias("parts"))
    for r in chat.digests(chat.read_back(chat.format_chats(df))).collect():
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == conversation([x[1:] for x in rows if x[0] == r.conv_id])


def test_mask_spans_lie_on_assistant_texts(spark):
    rows = [(1, 0, "user", "a<b"), (1, 1, "assistant", "c\\d"), (1, 2, "assistant", ""), (1, 3, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", chat.text_part(F.col("text")).alias("parts"))
    r = chat.format_chats(df).first()
    turns = [chat._HEAD + x for x in r.formatted.split(chat._HEAD)[1:]]
    assert [turns[m.turn][m.start : m.start + m.length] for m in r["mask"]] == ["c\\\\d", ""]
    assert r.formatted == "<|turn user|>\na\\lb<|end|>\n<|turn assistant|>\nc\\\\d<|end|>\n<|turn assistant|>\n<|end|>\n<|turn user|>\n<|end|>\n"


def test_parts_become_ordered_placeholders(spark):
    parts = [("text", "see ", None, None), ("image", None, "s3://a.png", 3), ("audio", "ignored", "b.wav", 4), ("text", " and <c>", None, None), None, ("document", None, "c.pdf", None), ("other", "plain", None, None), ("image", None, None, 1)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", []), (1, 2, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chats(df).first()
    assert r.formatted.startswith("<|turn user|>\nsee <|image:0|><|audio:1|> and \\lc\\g<|document:2|>plain<|image:3|><|end|>\n")
    assert [(a.turn, a.number, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, 0, "image", "s3://a.png", 768), (0, 1, "audio", "b.wav", 100), (0, 2, "document", "c.pdf", 512), (0, 3, "image", None, 256)]
    assert r.tokens == 1636
    assert chat.read_back(chat.format_chats(df)).first().turns[0].text == "see <|image:0|><|audio:1|> and <c><|document:2|>plain<|image:3|>"


def test_edges(spark):
    df = spark.createDataFrame([(None, None, None, None, "z"), (None, 1, "user", "x", "z"), (2, 0, "user", "same", "z"), (2, 0, "user", "same", "z"), (3, 5, "assistant", "y" * 200_000, "z")], "conv_id long, turn long, role string, text string, formatted string").select("*", chat.text_part(F.col("text")).alias("parts"))
    got = {r.conv_id: r for r in chat.digests(chat.read_back(chat.format_chats(df))).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {None: (2, 0), 2: (2, 0), 3: (1, 200_000)}
    assert chat.digests(chat.read_back(chat.format_chats(df.limit(0)))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="\\<>|lg\nab", max_size=12), st.text(alphabet="\\<>|lg\nab", max_size=12))
def test_escaped_texts_cannot_run_together(a, b):
    def escape(t):
        return t.replace("\\", "\\\\").replace("<", "\\l").replace(">", "\\g")

    assert (escape(a) == escape(b)) == (a == b)
