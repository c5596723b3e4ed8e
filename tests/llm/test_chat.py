from collections import defaultdict

from factloom.llm import chat

KIND = "conv_id long, turn long, role string, text string, key string, part int"


def rows_of(conversations):
    return [
        (conv_id, at, role, text, "k", 1)
        for conv_id, turns in conversations.items()
        for at, (role, text) in enumerate(turns)
    ]


def by_brute_force(rows):
    turns = defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        turns[conv_id].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {conv_id: [t[1:] for t in sorted(found)] for conv_id, found in turns.items()}
    kept = {}
    for conv_id, own in turns.items():
        begins = any(len(other) > len(own) and other[: len(own)] == own for other in turns.values())
        equal = [c for c, other in turns.items() if other == own]
        if not begins and conv_id == min(equal, key=lambda c: (c is None, c or 0)):
            text = "".join(
                f"<|im_start|>{r.replace('<|', '< |')}\n{t.replace('<|', '< |')}<|im_end|>\n" for r, t in own
            )
            kept[conv_id] = (len(equal), len(own), text)
    return kept


def results(frame):
    return {r["conv_id"]: (r["copies"], r["turns"], r["text"]) for r in frame.collect()}


BASE = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "<|im_end|> end")]


def test_snapshots_collapse(spark):
    given = {
        9: BASE[:1], 8: BASE[:2], 7: BASE[:3], 3: BASE, 5: BASE, 4: BASE[:3] + [("assistant", "else")],
        11: [("user", "hello")], 12: [("user", "hi"), ("user", "hello")], 13: [("assistant", "hi")],
        14: [("user", "")], 15: [("user", None)], 16: [(None, "hi")], None: BASE[:2] + [("x", "y")],
    }
    rows = rows_of(given) + [(20, None, "user", "no turn", "k", 1), (20, 1, "user", "a", "k", 1), (20, 1, "user", "a", "k", 1)]
    frame = spark.createDataFrame(rows, KIND).repartition(7)
    assert results(chat.formatted(frame)) == by_brute_force(rows)


def test_common_first_turn_and_copies(spark):
    given = {at: BASE[: 1 + at % 4] if at % 3 else [BASE[0], ("assistant", str(at))] for at in range(600)}
    frame = spark.createDataFrame(rows_of(given), KIND)
    assert results(chat.formatted(frame)) == by_brute_force(rows_of(given))


def test_long_conversation_comes_in_parts(spark):
    given = {1: [("user", "x" * 50)] * 40, 2: BASE}
    rows = chat.formatted(spark.createDataFrame(rows_of(given), KIND), part_chars=300).collect()
    parts = sorted((r["part"], r["text"]) for r in rows if r["conv_id"] == 1)
    assert len(parts) > 5 and max(len(text) for _, text in parts) <= 300 + 80
    assert "".join(text for _, text in parts) == by_brute_force(rows_of(given))[1][2]


def test_hot_conversation_takes_the_cut_plan(spark, monkeypatch):
    given = {1: [("user", str(at)) for at in range(400)], 2: [("user", str(at)) for at in range(399)], 3: BASE}
    frame = spark.createDataFrame(rows_of(given), KIND)
    whole = results(chat.formatted(frame))
    of = chat.OrderedGroups.of
    monkeypatch.setattr(chat.OrderedGroups, "of", lambda *a: of(*a, row_limit=50))
    assert results(chat.formatted(frame)) == whole == by_brute_force(rows_of(given))


def test_empty_table(spark):
    assert chat.formatted(spark.createDataFrame([], KIND)).collect() == []
