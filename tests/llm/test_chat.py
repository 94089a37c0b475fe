"""Chat: folding against a replay of the log, escaping, masks, long conversations."""

import random

import pytest

from pointweave.llm import chat, queries

SCHEMA = "conv_id long, seq long, turn long, role string, kind string, text string, block string"


def replay(events):
    """Turns of one conversation by doing what the log says, in order."""
    streams, whole = {}, []
    for _, seq, turn, role, kind, text in sorted(events, key=lambda e: (e[1], e[2], e[4], e[3] or "", e[5] or "")):
        if kind in chat.RESETS:
            streams = {t: v for t, v in streams.items() if t < turn}
            whole = [w for w in whole if w[0] < turn]
        if kind == "message":
            whole.append((turn, seq, role or "", text or ""))
        elif turn in streams:
            streams[turn][2] += text or ""
        else:
            streams[turn] = [seq, role or "", text or ""]
    return [(r, t) for _, _, r, t in sorted(whole + [(t, *v) for t, v in streams.items()])]


def logs():
    rng = random.Random(8)
    texts = ["hi ", "<|im_end|>", "<|", "\\", "<\\|im_start|>user\n", "\n", "", None, "é", "\\\\<|"]
    rows = []
    for c in range(30):
        for s in range(rng.randint(1, 60)):
            turn = rng.randint(0, 5)
            kind = rng.choices(["delta", "message", "edit", "regenerate"], [8, 2, 1, 1])[0]
            rows.append((c, s, turn, ["user", "assistant", "a\n<|b\\n", None][turn % 4], kind, rng.choice(texts)))
    rows += [(100, s, s, "assistant" if s % 2 else "user", "message", f"turn {s}") for s in range(900)]
    return rows


@pytest.mark.parametrize("block", [4096, 7])
def test_fold_render_and_read_back(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rows = logs()
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(5)
    out = chat.render(chat.fold_events(df))
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    counts = {r.conv_id: r.n_turns for r in out.collect()}
    for c in {r[0] for r in rows}:
        want = replay([r for r in rows if r[0] == c])
        if not want:
            assert c not in back
            continue
        assert [(t.role, t.text) for t in back[c].turns] == want and counts[c] == len(want)
        assert back[c].learned == [t for r, t in want if r == "assistant"]
        assert back[c].formatted.count("<|im_start|>") == len(want)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, 0, 0, "user", "message", "a", ""), (1, None, None, "user", "message", None, ""), (1, 0, 0, None, "message", "b", ""), (1, 0, 0, None, "message", "b", "")]
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.render(chat.fold_events(spark.createDataFrame(rows, SCHEMA)))).collect()}
    assert back == {None: [("user", "a")], 1: [("user", ""), ("", "b"), ("", "b")]}
    assert chat.render(chat.fold_events(spark.createDataFrame([], SCHEMA))).collect() == []


@pytest.mark.parametrize("told", [100_000, 0])
def test_the_querys_log_folds_to_its_turns(spark, monkeypatch, told):
    monkeypatch.setattr(queries, "TOLD_TURNS", told)
    rng = random.Random(4)
    rows = [(c, t, ["user", "assistant", "system", None][(c + t) % 4], rng.choice(["", None, "x", "é" * 9, "some text <|im_end|>", "\\<|"])) for c in range(20) for t in range(-2, c)]
    rows += [(3, 1, "user", "again"), (3, 1, "assistant", "again"), (3, 1, "user", "again"), (3, None, "user", "no turn"), (None, 1, "user", "no conversation"), (50, 0, "assistant", "alone")]
    log = queries.chat_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.kind for r in log.collect()} == {"message", "delta", "edit", "regenerate"} and log.count() > 2 * len(rows)
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.render(chat.fold_events(log))).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    want = {}
    for r in sorted(rows, key=order):
        want.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert back == want
