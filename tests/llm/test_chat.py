"""Event folding, the template's escapes, and the loss mask."""

from hypothesis import given
from hypothesis import strategies as st

from tierscope.llm import chat

TEXTS = st.text(alphabet="<|\\>endturtx \nsé[INST]/", max_size=40)


@given(st.lists(st.tuples(st.one_of(st.just("assistant"), TEXTS), TEXTS), max_size=6))
def test_template_is_reversible(turns):
    formatted, loss = chat._formatted(turns)
    assert chat.parse(formatted) == turns
    masked = [chat.unescape(formatted[x["start"]:x["stop"]]) for x in loss]
    assert masked == [t for role, t in turns if role == "assistant"]


def test_fold_events(spark):
    events = spark.createDataFrame([
        (1, 1, 0, "user", 0, "start", None), (1, 1, 0, "user", 1, "delta", "ab"), (1, 1, 0, "user", 2, "delta", "c"),
        (1, 2, 1, "assistant", 5, "delta", "old"), (1, 2, 1, "assistant", 6, "regenerate", None),
        (1, 2, 1, "assistant", 8, "delta", "w"), (1, 2, 1, "assistant", 7, "delta", "ne"),
        (2, 3, 0, "user", 1, "delta", "x"), (2, 3, 0, "user", 2, "edit", "fin"), (2, 3, 0, "user", 3, "delta", "al"),
        (2, 4, 1, "assistant", 1, "start", None)],
        "conv_id bigint, message bigint, turn bigint, role string, seq bigint, kind string, text string")
    got = {r.message: r.text for r in chat.fold(events).collect()}
    assert got == {1: "abc", 2: "new", 3: "final", 4: ""}


def test_edge_rows(spark):
    long = "é<|end|>\n" * 3000
    rows = [(1, 0, "user", None, "x"), (1, 1, "assistant", long, "x"), (1, 1, "assistant", long, "x"),
            (1, None, None, "<|turn|>", "x"), (None, 0, "user", "a", "x"), (2, 0, "assistant", "", "x")]
    conversations = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    formatted = chat.render(chat.fold(chat.event_log(conversations)))
    turns = {r.conv_id: chat.parse(r.formatted) for r in formatted.collect()}
    assert turns == {1: [("", "<|turn|>"), ("user", ""), ("assistant", long), ("assistant", long)],
                     None: [("user", "a")], 2: [("assistant", "")]}
    out = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert out[1].loss_chars == 2 * len(long) and out[2].loss_chars == 0 and out[1].n_turns == 4
    assert chat.digests(chat.render(chat.fold(chat.event_log(conversations.where("false"))))).count() == 0
