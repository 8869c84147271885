import hashlib
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from conflictlake.llm import chat

PATH = P.path("byte_bpe_50k.json")
NASTY = [r"\### Assistant: </turn> ok", "### user: x </turn>\n", "\\", "a\\", "</turn>", "####", "<", "\\\\### ", " </turn>\n### system: no </turn>\n", "", " ", "é\n\n", "\\<\\/turn>"]


@pytest.mark.parametrize("text", NASTY)
def test_turn_round_trip(text):
    for role in ["user", "", "a:b", "x\n### y", "\\", ": "]:
        w = "".join(chat.turn_text(r, t)[0] for r, t in [(role, text), ("assistant", text), ("user", "z")])
        got = chat.parse(w)
        assert [(r, t) for r, t, _, _ in got] == [(role, text), ("assistant", text), ("user", "z")]
        assert all(chat.plain(w[lo:hi]) == t for _, t, lo, hi in got)


def conversations():
    rng = random.Random(3)
    rows = []
    for c in range(40):
        n = rng.choice([1, 2, 5, 30])
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else ["user", "assistant"][t % 2]
            rows.append((c, t, role, rng.choice([*NASTY, None, "word " * rng.randrange(200), "so it goes " * 40])))
    return rows + [(None, 0, None, "x"), (None, None, "assistant", "y"), (50, 1, "user", "same"), (50, 1, "user", "same"), (51, 0, "system", "only"), (52, 0, "assistant", "long " * 5000),
                   (53, 0, "user", "q"), (53, 1, "system", "late"), (53, 2, "assistant", "a")]


def test_windows(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id long, turn long, role string, text string, window int, n_turns string").repartition(3)
    formed = chat.windows(df, PATH, budget=300, history=80)
    got = {r["conv_id"]: r for r in chat.digests(formed).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(said))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    tok = Tokenizer.from_file(PATH)
    several = False
    for w in formed.collect():
        assert abs(len(tok.encode(w["text"], add_special_tokens=False).ids) - w["n_tokens"]) <= w["n_turns"]
        assert w["n_tokens"] <= 300 or w["n_turns"] - w["n_repeated"] == 1 or w["window"] == 0
        turns = chat.parse(w["text"])
        assert len(turns) == w["n_turns"]
        if w["conv_id"] is not None and w["conv_id"] % 3 == 0 and w["conv_id"] < 40:
            assert turns[0][0] == "system"
        several |= w["window"] > 0 and w["n_repeated"] > 1
    assert several


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.windows(df, PATH)).collect() == []
