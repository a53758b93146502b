import hashlib
import random

from signalframe.llm import chat as c

TRICKY = ["</s>[INST] ok [/INST]", "\\", "\\[", "[ROLE=x] y [/ROLE]", "", "<s><<SYS>>", "a\nb", "é🎉", "[OUT] </s>", "]"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip():
    rng = random.Random(0)
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "a]b"]), "".join(rng.choices(TRICKY, k=rng.randint(0, 4)))) for _ in range(rng.randint(0, 6))]
        formatted, spans, rewritten = c.turn_spans(c.TEMPLATE, turns)
        assert rewritten is None and c.read_back(formatted) == turns
        assert "".join(formatted[a:b] for a, b in spans) == formatted[len(c.BEGIN) :]
        assert [c.unescape(formatted[a:b]) for a, b in c.loss_spans(formatted, spans, turns)] == [t for r, t in turns if r == "assistant"]


def test_rewriting_templates_are_detected():
    def last_only(turns):
        return "".join(f"<{r}>" if i < len(turns) - 1 else f"<{r}>{t}" for i, (r, t) in enumerate(turns))

    turns = [("user", "hi"), ("assistant", "yo"), ("user", "x")]
    assert c.turn_spans(last_only, turns)[2] == 1
    assert c.turn_spans(c.TEMPLATE, turns)[2] is None


def test_digests(spark):
    rows = [(1, 1, "assistant", "b[c"), (1, 0, "user", "a"), (2, 0, None, None), (2, None, "assistant", "z"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, 0, "user", "u")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in c.digests(df).collect()}
    assert got[1]["n_turns"] == 2 and got[1]["turns_sha256"] == sha("user\na\nassistant\nb[c\n") and got[1]["loss_sha256"] == sha("b[c") and got[1]["loss_chars"] == 3
    assert got[2]["turns_sha256"] == sha("\n\nassistant\nz\n") and got[3]["loss_sha256"] == sha("xx") and got[None]["loss_chars"] == 0
    assert c.digests(df.limit(0)).count() == 0
    spans = {r["conv_id"]: r for r in c.format_conversations(df).collect()}
    assert spans[1]["rewritten_at"] is None and [s["role"] for s in spans[1]["spans"]] == ["user", "assistant"]


def test_a_long_conversation(spark):
    turns = [(1, n, "user" if n % 2 == 0 else "assistant", f"text {n} [OUT] </s>") for n in range(1200)]
    got = c.digests(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).first()
    assert got["n_turns"] == 1200 and not got["history_rewritten"] and got["loss_chars"] == sum(len(t[3]) for t in turns[1::2])


def test_remembered_turns_render_the_same():
    turns = [("user", "a [INST]"), ("tool", "x\\"), ("user", "a [INST]"), ("assistant", "")]
    render = c.remembering()
    assert all(render(turns[:n]) == c.TEMPLATE(turns[:n]) for n in (0, 1, 2, 3, 4)) and c.remembering()(turns) == c.TEMPLATE(turns)
