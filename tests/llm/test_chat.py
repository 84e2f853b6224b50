import random

from pyspark.sql import functions as F

from kerbline.llm import chat

HARD = "\\### Assistant: </turn> ok"


def test_render_round_trip():
    rng = random.Random(1)
    for _ in range(300):
        turns = [("".join(rng.choices(["a", ":", " ", "#", "\\", "<", "\n", "é"], k=rng.randrange(5))), "".join(rng.choices([HARD, "</turn>\n", "### x: ", "\\", "#", "<", "😀", " ", "\n"], k=rng.randrange(5)))) for _ in range(rng.randrange(6))]
        text, spans, rewritten = chat.located(turns)
        assert chat.parse(text) == turns and not rewritten
        assert [chat.unescape(text[a:b]) for _, _, a, b in spans] == [t for _, t in turns]
        assert "".join(text[a:b] for a, b, _, _ in spans) == text


def test_rewriting_template_is_flagged():
    last_only = lambda turns: "".join(f"<{r}>{t if k + 1 == len(turns) else t.strip()}|" for k, (r, t) in enumerate(turns))
    assert chat.located([("u", "hello  "), ("a", "x")], last_only)[2]
    assert not chat.located([("u", "hello"), ("a", "x")], last_only)[2]
    tail = lambda turns: chat.render(turns) + "### assistant: "
    assert chat.located([("u", "q"), ("assistant", "r")], tail)[2]


def test_spans_of_templates_that_do_not_escape():
    plain = lambda turns: "<s>" + "".join(f"<{r}>{t}</{r}>" for r, t in turns)
    rng = random.Random(2)
    for _ in range(200):
        turns = [(rng.choice(["u", "assistant"]), "".join(rng.choices(["<", "/", "b", "</x", "assistant>", "qzzq", "s", ""], k=rng.randrange(4)))) for _ in range(rng.randrange(1, 5))]
        text, spans, rewritten = chat.placed(turns, plain)
        assert not rewritten and [(text[a:b], known, same) for _, _, a, b, known, same in spans] == [(t, True, True) for _, t in turns]
    strip = lambda turns: "".join(f"{t.strip()}|" for _, t in turns)
    assert [x[4:] for x in chat.placed([("u", "a"), ("u", " b ")], strip)[1]] == [(True, True), (True, False)]
    drop = lambda turns: "".join("" if r == "u" else t * 2 + "|" for r, t in turns)
    assert [x[4:] for x in chat.placed([("u", "a"), ("a", "b")], drop)[1]] == [(False, False)] * 2


def test_long_conversations_are_rendered_turn_by_turn(monkeypatch):
    turns = [("user", f"{k} \\# <") for k in range(30)]
    slow = chat.placed(turns)
    monkeypatch.setattr(chat, "LONG", 10)
    assert chat.placed(turns) == slow
    lying = lambda turns: chat.render(turns).upper()
    lying.each = chat.render.each
    assert chat.placed(turns, lying)[1] == chat.placed(turns, lambda turns: lying(turns))[1]
    monkeypatch.setattr(chat, "LONG", 200)
    assert len(chat.placed([("assistant", "x") for _ in range(50_000)])[1]) == 50_000


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None), (2, 1, None, "x"), (2, None, "system", HARD), (None, 0, "user", "no id"), (3, 0, "user", "q"), (3, 0, "user", "q"), (4, 0, "assistant", "long " * 100_000)]
    rows += [(5, k, "user", "same") for k in range(300)]
    alone = [(None, 0, "user", "one more"), (None, 0, "user", "one more")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("spans", F.lit("clash"))
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    want = {}
    for k, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
        want.setdefault(k, []).append((role or "", text or ""))
    assert {k: chat.parse(r.formatted) for k, r in got.items()} == want
    assert all(r.n_turns == len(want[k]) and not r.rewritten for k, r in got.items())
    assert chat.format_conversations(df.limit(0)).collect() == []
    more = spark.createDataFrame(alone + rows, "conv_id long, turn long, role string, text string")
    assert [r.n_turns for r in chat.format_conversations(more).where("conv_id is null").collect()] == [1, 1, 1]
