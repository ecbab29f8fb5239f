import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import chat

TRICKY = st.lists(st.sampled_from(["<", "|", ">", "\\", "<|", "|>", "</s>", "[INST]", "[/INST]", "<|end|>\n", "a", "\n", "<|image:0|>", "é"]), max_size=12).map("".join)
PARTS = st.lists(st.one_of(TRICKY.map(lambda t: {"type": "text", "text": t}), st.sampled_from(["image", "audio", "document", "video"]).map(lambda k: {"type": k, "ref": f"{k}.bin", "pages": 2})), max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TRICKY, TRICKY), max_size=4))
def test_round_trip(turns):
    got = chat.render([(role, [{"type": "text", "text": text}]) for role, text in turns])
    assert chat.parse(got["formatted"]) == turns
    for _, text in turns:
        assert not any(c in chat.escape(text) for c in chat.CONTROL)


def slow_content(parts, number):
    """Texts joined where they meet, attachments by number."""
    out = []
    for p in parts:
        if p["type"] == "text":
            if out and isinstance(out[-1], str):
                out[-1] += p["text"] or ""
            else:
                out.append(p["text"] or "")
        else:
            out.append(number[0])
            number[0] += 1
    return [x for x in out if x != ""]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|says|>"]), PARTS), max_size=4))
def test_round_trip_of_many_parts(turns):
    got, number = chat.render(turns), [0]
    assert chat.parse_parts(got["formatted"]) == [(role, slow_content(parts, number)) for role, parts in turns]
    assert len(got["attachments"]) == number[0] and len(got["errors"]) == sum(p["type"] == "video" for _, parts in turns for p in parts)
    loss = [got["formatted"][a:b] for a, b in got["loss"]]
    assert "".join(map(chat.unescape, loss)) == "".join(p["text"] for role, parts in turns if role == "assistant" for p in parts if p["type"] == "text")
    assert not any(c in x for x in loss for c in chat.CONTROL)


def test_no_placeholder_from_pieces():
    got = chat.render([("user", [{"type": "text", "text": t} for t in ("<", "|image:7|", ">keep")])])
    assert chat.parse(got["formatted"]) == [("user", "<|image:7|>keep")] and not got["attachments"] and "<|image" not in got["formatted"]


def test_parts_and_mask():
    parts = [{"type": "text", "text": "see "}, {"type": "image", "ref": "a.png", "width": 1024, "height": 512}, {"type": "text", "text": " and "}, {"type": "audio", "ref": "b.wav", "seconds": 2.0}, {"type": "document", "ref": "c.pdf", "pages": 3}]
    got = chat.render([("user", parts), ("assistant", [{"type": "text", "text": "<|no"}, {"type": "image", "ref": "d.png"}, {"type": "text", "text": "tail"}])])
    assert [(a["type"], a["ref"], a["tokens"]) for a in got["attachments"]] == [("image", "a.png", 85 + 340), ("audio", "b.wav", 50), ("document", "c.pdf", 1800), ("image", "d.png", 255)]
    assert "see <|image:0|> and <|audio:1|><|document:2|>" in got["formatted"]
    assert "".join(chat.unescape(got["formatted"][a:b]) for a, b in got["loss"]) == "<|notail"
    assert got["expanded_tokens"] == 425 + 50 + 1800 + 255 + 1 + 1 + 1 + 1


DDL = f"conv_id long, turn int, role string, parts array<{chat.PART}>, formatted string, errors int"


def test_conversations(spark):
    text = lambda t: [("text", t, None, None, None, None, None)]
    rows = [(1, 1, "assistant", text("b")), (1, 0, "user", text("a")), (1, 1, "assistant", text("b")), (2, None, None, None), (None, 0, "assistant", text(None)), (3, 0, "assistant", text("x " * 200_000))]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], DDL)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[1]["loss_chars"] == 2 and got[1]["loss_sha256"] == hashlib.sha256(b"bb").hexdigest()
    assert got[2]["n_turns"] == 1 and got[None]["loss_chars"] == 0 and got[3]["loss_chars"] == 400_000
    assert chat.format_conversations(spark.createDataFrame([], DDL)).count() == 0


def test_many_turns_of_many_parts(spark):
    rng = random.Random(5)
    bits = ["<", "|", ">", "<|", "|>", "</s>", "[INST]", "\\", "word ", "<|image:0|>", "é\n"]
    rows, want = [], {}
    for conv in range(250):
        turns, number, tokens = [], [0], 0
        for turn in range(4):
            parts = []
            for _ in range(rng.randrange(6)):
                kind = rng.choice(["text", "text", "image", "audio", "document"])
                part = {"type": kind, "text": "".join(rng.choices(bits, k=rng.randrange(5))) if kind == "text" else None, "ref": None if kind == "text" else f"{conv}/{turn}", "width": 700, "height": 300, "seconds": 1.5, "pages": 2}
                parts.append(part)
                tokens += {"text": 0, "image": 85 + 2 * 170, "audio": 38, "document": 1200}[kind]
            turns.append(("user" if turn % 2 == 0 else "assistant", parts))
            rows.append((conv, turn, turns[-1][0], [tuple(p[k] for k in ("type", "text", "ref", "width", "height", "seconds", "pages")) for p in parts], "", 0))
        content = [(role, slow_content(parts, number)) for role, parts in turns]
        words = sum(len(x.split()) for _, parts in content for x in parts if isinstance(x, str))
        want[conv] = content, number[0], tokens + words
    got = chat.format_conversations(spark.createDataFrame(rows, DDL)).collect()
    assert {r["conv_id"]: (chat.parse_parts(r["formatted"]), len(r["attachments"]), r["expanded_tokens"]) for r in got} == want
    assert all(a["position"] == i and a["ref"].startswith(f"{r['conv_id']}/") for r in got for i, a in enumerate(r["attachments"]))
