import hashlib
import random

import pytest

from venuelake.llm import chat_format as c

SCHEMA = "conv_id long, turn long, role string, text string, piece string, loss int"
STRINGS = ["</s>", "<s>", "[INST]", "[/INST]", "[INST] ", " [/INST]", "<\\/s>", "<\\\\s>", "[\\/INST]", "[ROLE]", "[/ROLE]", "[SYSTEM_PROMPT]", "[/SYSTEM_PROMPT]", "<", "[", "\\", "/", "s>", "é", "𝄞", " ", "\n", "plain words"]


def conversations(n=60):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", "tool", "[/ROLE]", "", None])
            text = rng.choice([None, "", "".join(rng.choices(STRINGS, k=rng.randint(1, 12)))])
            rows.append((i if i else None, rng.choice([t, t, None]), role, text, "clash", 3))
    rows += [(500, 0, "assistant", "long " * 40_000 + "𝄞</s>", "x", 1), (500, 1, "user", "[INST]" * 9_000, "x", 1), (500, 2, "assistant", "end", "x", 1)]
    rows += [(501, 0, "user", "twice", "x", 1)] * 2
    rng.shuffle(rows)
    return rows


def grouped(rows):
    key = lambda v: (v is not None, v if v is not None else 0)
    chats = {}
    for conv, turn, role, text, *_ in rows:
        chats.setdefault(conv, []).append((key(turn), (role or "").encode(), (text or "").encode()))
    return {conv: [(r.decode(), t.decode()) for _, r, t in sorted(said)] for conv, said in chats.items()}


def brute_format(turns):
    """Marks and escapes without columns or regular expressions; also the places of assistant texts."""
    controls = [a + b for a, b in (("<", "s>"), ("<", "/s>"), ("[", "INST]"), ("[", "/INST]"), ("[", "SYSTEM_PROMPT]"), ("[", "/SYSTEM_PROMPT]"), ("[", "ROLE]"), ("[", "/ROLE]"))]

    def escaped(text):
        out, k = "", 0
        while k < len(text):
            if text[k] in "<[":
                e = k + 1
                while e < len(text) and text[e] == "\\":
                    e += 1
                if any(text[e:].startswith(x[1:]) for x in controls):
                    out += text[k:e] + "\\"
                    k = e
                    continue
            out += text[k]
            k += 1
        return out

    out, spans = "<s>", []
    for role, text in turns:
        if role == "user":
            out += "[INST] " + escaped(text) + " [/INST]"
        elif role == "system":
            out += "[SYSTEM_PROMPT]" + escaped(text) + "[/SYSTEM_PROMPT]"
        else:
            out += " " if role == "assistant" else "[ROLE]" + escaped(role) + "[/ROLE]"
            if role == "assistant":
                spans.append((len(out), len(out) + len(escaped(text))))
            out += escaped(text) + "</s>"
    return out, spans


@pytest.mark.parametrize("piece_bytes", [c.PIECE_BYTES, 200, 1])
def test_formatted_texts_masks_and_reading_back(spark, piece_bytes):
    rows = conversations()
    made = c.format_chats(spark.createDataFrame(rows, SCHEMA), piece_bytes=piece_bytes)
    want = grouped(rows)
    texts, spans = {}, {}
    for r in sorted(made.collect(), key=lambda r: r.piece):
        base = len(texts.get(r.conv_id, ""))
        texts[r.conv_id] = texts.get(r.conv_id, "") + r.formatted
        spans.setdefault(r.conv_id, []).extend((base + s.start, base + s.end) for s in r.loss)
    assert set(texts) == set(want)
    for conv, turns in want.items():
        assert (texts[conv], spans[conv]) == brute_format(turns), conv
    got = {r.conv_id: r for r in c.read_back(made).collect()}
    assert len(got) == len(want)
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        told = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert tuple(got[conv]) == (conv, len(turns), told, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(texts[conv])), conv


def test_many_turns_cross_batches_and_pieces(spark):
    rows = [(7, i, "user" if i % 2 else "assistant", f"turn {i} " + "x" * (i % 50), "x", 1) for i in range(3000)] + [(8, 0, "user", "a", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for piece_bytes in (c.PIECE_BYTES, 4000):
        made = c.format_chats(docs, piece_bytes=piece_bytes)
        pieces = made.filter("conv_id = 7").count()
        assert pieces == 1 if piece_bytes == c.PIECE_BYTES else pieces > 10
        got = {r.conv_id: r for r in c.read_back(made).collect()}
        assert got[7].n_turns == 3000 and got[8].n_turns == 1
        assert got[7].turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in rows[:-1]).encode()).hexdigest()


def test_no_text_holds_a_control_string(spark):
    text = "</s>[INST] ok [/INST]"
    made = c.format_chats(spark.createDataFrame([(-1, 0, "user", text, "x", 1), (-1, 1, "assistant", text, "x", 1)], SCHEMA)).first()
    assert made.formatted == "<s>[INST] <\\/s>[\\INST] ok [\\/INST] [/INST] <\\/s>[\\INST] ok [\\/INST]</s>"
    assert list(c.read_turns(made.formatted)) == [("user", text), ("assistant", text)]
    (span,) = made.loss
    assert c.unescape(made.formatted[span.start : span.end]) == text


def test_other_loss_roles_ids_of_text_and_empty_table(spark):
    docs = spark.createDataFrame([("a", 0, "tool", "out"), ("a", 1, "assistant", "in")], "conv_id string, turn int, role string, text string")
    (row,) = c.format_chats(docs, loss_roles=("tool",)).collect()
    assert row.conv_id == "a" and [row.formatted[s.start : s.end] for s in row.loss] == ["out"]
    empty = c.format_chats(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and c.read_back(empty).collect() == []
