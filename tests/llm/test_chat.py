"""Chat formatting: exact round trips."""

import hashlib
import random

from strandline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, ids string"


def brute(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    done = {}
    for conv, turns in out.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        marks = sum(len(chat.escape(r)) + len(chat.escape(t)) + len(chat.TURN + chat.BODY + chat.END) for r, t in turns)
        done[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), marks)
    return done


def test_escapes_are_undone():
    rng = random.Random(1)
    parts = [*chat.CONTROL, "\\", "<", "[", "|", "s>", "/s>", "INST]", "a", "<\\s>", "\n", "é"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(0, 9)))
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text
        assert not any(c in hidden for c in chat.CONTROL)


def test_masks_and_ids():
    path = chat.default_tokenizer()
    turns = [("user", "<|turn|>hello</s>"), ("assistant", "all <|end|> of it"), ("assistant", "")]
    for (role, text), (ids, mask, shown) in zip(turns, chat.assemble(turns, path), strict=True):
        assert ids[0] == chat.RESERVED[chat.TURN] and ids[-1] == chat.RESERVED[chat.END]
        assert [i for i in ids if i >= 50_257] == list(chat.RESERVED.values())
        under = chat._tokenizer(path).decode([i for i, m in zip(ids, mask, strict=True) if m], skip_special_tokens=False)
        assert chat.unescape(under) == (text if role == "assistant" else "")
        assert shown == f"{chat.TURN}{chat.escape(role)}{chat.BODY}{chat.escape(text)}{chat.END}"


def test_digests_equal_brute_force(spark):
    rng = random.Random(4)
    parts = ["hello", " world", "</s>", "[INST]", "\n", "é💥", "<|im_start|>", "\\", "   ", "<<SYS>>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "".join(rng.choices(parts, k=rng.randrange(0, 12)))])) for c in range(20) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "no conversation"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (30, None, "assistant", "x " * 20_000)]
    formatted = chat.format_conversations(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.digests(formatted).collect()}
    assert got == brute(rows)


def test_empty_table(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
