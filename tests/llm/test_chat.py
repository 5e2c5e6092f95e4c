import random

from wayline.llm import chat

SCHEMA = "conv_id long, seq long, kind string, msg string, role string, text string, at string, conv int"


def brute(rows):
    """Final messages of each conversation, event by event."""
    low = (0, "")
    key = lambda r: (r[1] is not None, r[1] or 0, chat.KINDS.index(r[2] or "message"), (1, r[3]) if r[3] is not None else low, r[4] or "", r[5] or "")
    out = {}
    for conv in {r[0] for r in rows}:
        messages, dropped = {}, set()
        for at, (_, _, kind, msg, role, text) in enumerate(sorted((r for r in rows if r[0] == conv), key=key)):
            kind, role, text = kind or "message", role or "", text or ""
            name = ("own", at) if kind == "message" else ("named", msg)
            if name not in messages:
                messages[name] = [at, role, ""]
            elif kind == "regenerate":
                dropped |= {n for n, m in messages.items() if m[0] > messages[name][0]}
            messages[name][2] = messages[name][2] + text if kind in ("message", "delta") else text
        out[conv] = [(m[1], m[2]) for n, m in sorted(messages.items(), key=lambda x: x[1][0]) if n not in dropped]
    return out


def test_matches_brute_force(spark):
    rng = random.Random(8)
    rows = [(-1, 0, "message", None, "user", "hi"), (-1, 0, "message", None, "user", "hi"), (None, None, None, None, None, None)]
    for conv in range(40):
        for seq in range(rng.randrange(1, 25)):
            kind = rng.choice(("delta", "delta", "delta", "message", "edit", "regenerate", None))
            rows.append((conv, seq // 2 if conv % 3 else seq, kind, rng.choice(("a", "b", "c", None)), rng.choice(("user", "assistant", "x<#\\", None)), rng.choice(("", "a", "\\l", "<turn>\n", "</turn>\n", "#\\s é", None))))
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        assert [tuple(t) for t in got[conv].turns] == turns
        assert got[conv].loss_text == "".join(t for role, t in turns if role == "assistant")
        assert got[conv].formatted.count("</turn>") == len(turns)


def test_empty_log(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_probe_and_no_python(spark, sf_dir):
    from wayline.llm.queries import QUERIES

    df = QUERIES["op4_chat_format"](spark, sf_dir)
    assert df.where("conv_id = -7").first().n_turns == 2
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning(conv") == 1


def test_derived_log_uses_every_kind_and_folds_to_its_rows(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", "é<#\\" * (t % 5) if t % 3 else None) for c in (1, 2) for t in range(30)] + [(1, 7, None, "twice"), (1, 7, None, "twice")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    log = chat.log_of(turns)
    assert {r.kind for r in log.select("kind").distinct().collect()} == set(chat.KINDS)
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.read_back(chat.format_chats(log.repartition(5))).collect()}
    key = lambda r: (r[1], r[2] or "", r[3] or "")
    assert got == {c: [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)] for c in (1, 2)}


def test_very_long_conversation_and_text(spark):
    rows = [(1, t, "assistant", f"text {t} <") for t in range(20_000)] + [(2, 0, "assistant", "#" * 2_000_000)]
    back = chat.read_back(chat.format_chats(chat.log_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    got = {r.conv_id: (len(r.turns), r.loss_text) for r in back.collect()}
    assert got == {1: (20_000, "".join(r[3] for r in rows[:-1])), 2: (1, "#" * 2_000_000)}
