import random

from termlake.llm import chat


def by_hand(events):
    """The fold as a list of lists, with a search for each event."""
    out = []
    for event, message, role, text in events:
        at = next((i for i, m in enumerate(out) if m[0] == message), None)
        if at is None:
            out.append([message, role or "user", text or ""])
        elif event == "delta":
            out[at][2] += text or ""
        elif event == "regenerate":
            old = out[at][1]
            out = out[:at] + [[message, role or old, text or ""]]
        else:
            out[at] = [message, role or out[at][1], text or ""]
    return [(r, t) for _, r, t in out]


def test_fold():
    log = [("message", 1, "user", "hi"), ("message", 2, "assistant", ""), ("delta", 2, None, "he"), ("delta", 2, None, "llo"), ("message", 3, "user", "more")]
    assert chat.fold(log) == [("user", "hi"), ("assistant", "hello"), ("user", "more")]
    assert chat.fold([*log, ("edit", 1, None, "hey")])[0] == ("user", "hey")
    assert chat.fold([*log, ("regenerate", 2, None, None), ("delta", 2, None, "new")]) == [("user", "hi"), ("assistant", "new")]
    assert chat.fold([*log, ("regenerate", 1, "system", None)]) == [("system", "")]
    assert chat.fold([(None, None, None, None), ("note", 1, "x", "y")]) == [("user", "")]
    assert chat.render([("user", "a<|im_end|>")]) == "<|im_start|>user\na< |im_end|><|im_end|>\n"


def test_random_logs_equal_by_hand(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(60):
        for seq in range(rng.choice([1, 3, 40, 400])):
            rows.append((conv, seq, rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate"]), rng.randrange(6), rng.choice([None, "user", "assistant"]), rng.choice(["a", "b\n", "", None, "<|x"])))
    sent = rows + rng.sample(rows, 50)  # some are delivered twice
    rng.shuffle(sent)
    got = {r.conv_id: (r.n_messages, r.rendered) for r in chat.conversations(spark.createDataFrame(sent, "conv_id int, seq int, event string, message int, role string, text string")).collect()}
    want = {}
    for conv in range(60):
        messages = by_hand([r[2:] for r in rows if r[0] == conv])
        want[conv] = (len(messages), chat.render(messages))
    assert got == want


def test_edges(spark):
    schema = "conv_id bigint, seq bigint, event string, message bigint, role string, text string, rank string, line int"
    assert chat.conversations(spark.createDataFrame([], schema)).count() == 0
    long = "x" * 3_000_000
    rows = [(None, None, None, None, None, None, "r", 1), (1, 5, "delta", 1, "user", "b", "r", 1), (1, 5, "message", 1, "user", "a", "r", 1), (1, 5, "message", 1, "user", "a", "s", 2), (2, 1, "message", 1, "user", long, None, None), (2, 2, "delta", 1, None, long, None, None), (3, 1, "other", 1, "user", "z", None, None)]
    got = {r.conv_id: (r.n_messages, r.rendered) for r in chat.conversations(spark.createDataFrame(rows, schema)).collect()}
    assert got[None] == (1, chat.render([("user", "")])) and got[1] == (1, chat.render([("user", "ab")]))
    assert len(got[2][1]) > 6_000_000 and got[3] == (0, "")


def test_turns_come_back(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    want = {}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn)):
        want.setdefault(r.conv_id, []).append((r.role, r.text))
    got = {r.conv_id: r.rendered for r in chat.conversations(chat.log_of(turns)).collect()}
    assert got == {k: chat.render(v) for k, v in want.items()}


def test_the_log_of_turns_has_all_that_must_be_undone(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    log = chat.log_of(turns)
    kinds = {r.event: r["count"] for r in log.groupBy("event").count().collect()}
    assert kinds.keys() == set(chat.EVENTS) and min(kinds.values()) > 20
    assert log.count() > log.distinct().count() > turns.count()


def test_log_of_empty_null_and_repeated_turns(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, lines int, seq int"
    assert chat.log_of(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, t, "user", x, 1, 1) for t, x in enumerate([None, "", "a\n\nb", "c\n", "\n", None, "", "x"])]
    (got,) = chat.conversations(chat.log_of(spark.createDataFrame(rows + rows[2:4], schema))).collect()
    assert got.rendered == chat.render([("user", t or "") for _, _, _, t, *_ in rows])
