from barquality.llm import preference as p

SCHEMA = "conv_id long, turn long, role string, text string, pair_id long"


def turn(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def test_common_prefix_is_rendered_once(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "good"), (0, 2, "user", "more"), (1, 0, "user", "hi"), (1, 1, "assistant", "bad"),
        (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "user", "alone"), (6, 0, None, None), (7, 0, "user", ""), (7, 1, "assistant", "x"),
        (8, 0, "system", "a"), (9, 0, "user", "a"), (0, 0, "user", "hi"), (None, 0, "user", "q"), (0, None, "user", "q"),
    ]
    turns = spark.createDataFrame([(*r, 5) for r in rows], SCHEMA)
    out = {r["pair_id"]: r for r in p.format_pairs(turns, p.neighbours(turns)).collect()}
    assert set(out) == {0, 1, 3, 4}
    a = out[0]
    assert (a["chosen_id"], a["rejected_id"], a["n_prompt_turns"], a["identical"]) == (0, 1, 1, False)
    assert a["prompt"] == turn("user", "hi")
    assert a["chosen"] == turn("assistant", "good") + turn("user", "more") and a["rejected"] == turn("assistant", "bad")
    spans = [tuple(s) for s in a["chosen_mask"]]
    first = len(turn("assistant", "good"))
    head, user = len("<|im_start|>assistant\n"), len("<|im_start|>user\n")
    assert spans == [(0, head, False), (head, first - head, True), (first, user, False), (first + user, len(turn("user", "more")) - user, False)]
    assert out[1]["identical"] and out[1]["chosen"] == out[1]["rejected"] == "" and out[1]["chosen_mask"] == []
    assert out[3]["n_prompt_turns"] == 1 and out[3]["rejected"] == turn("assistant", "x")
    assert out[4]["n_prompt_turns"] == 0 and out[4]["prompt"] == ""


def test_a_later_equal_turn_is_no_prefix(spark):
    rows = [(0, 0, "user", "a"), (0, 1, "user", "b"), (1, 0, "user", "x"), (1, 1, "user", "b")]
    out = p.format_pairs(t := spark.createDataFrame([(*r, 1) for r in rows], SCHEMA), p.neighbours(t)).first()
    assert out["n_prompt_turns"] == 0 and out["chosen"].endswith(turn("user", "b"))


def test_empty_table(spark):
    turns = spark.createDataFrame([], SCHEMA)
    assert p.digests(p.format_pairs(turns, p.neighbours(turns))).count() == 0


def test_large_ids_and_messages_of_one_turn(spark):
    """Integer pairs beyond 2^53; different messages of one turn all stay, in order."""
    big = 2**53 + 2
    rows = [(big, 0, "user", "q"), (big + 1, 0, "user", "q"), (big, 1, "assistant", "b"), (big, 1, "assistant", "a"), (big + 1, 1, "assistant", "a"), (big + 1, 1, "assistant", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pairs = p.format_pairs(turns, p.neighbours(turns)).collect()
    assert [(r["pair_id"], r["chosen_id"], r["rejected_id"], r["n_prompt_turns"]) for r in pairs] == [(big // 2, big, big + 1, 2)]
    assert pairs[0]["prompt"] == turn("user", "q") + turn("assistant", "a") and pairs[0]["chosen"] == turn("assistant", "b") and pairs[0]["rejected"] == ""


def test_masks_cover_completions_of_many_turns(spark):
    rows = [(0, i, "user" if i % 2 == 0 else "assistant", f"t{i}" * (i % 7)) for i in range(300)] + [(1, 0, "user", "other")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = p.format_pairs(turns, p.neighbours(turns)).first()
    at = 0
    for start, length, _ in r["chosen_mask"]:
        assert start == at
        at += length
    assert at == len(r["chosen"])
    assert "".join(r["chosen"][s : s + n] for s, n, t in r["chosen_mask"] if t) == "".join(f"{x[3]}<|im_end|>\n" for x in rows[:300] if x[2] == "assistant")


def test_borrowed_ends_share_all_turns_before_the_last_answer(spark):
    rows = [
        (-5, 0, "user", "q"), (-5, 1, "assistant", "a"), (-5, 2, "user", "r"), (-5, 3, "assistant", "b"), (-5, 4, "user", "bye"), (-4, 0, "user", "x"), (-4, 1, "assistant", "y"),
        (-3, 0, "user", "no answer"), (7, 0, "assistant", "same"), (8, 0, "assistant", "same"), (9, 0, "assistant", "z" * 300_000), (-(2**63), 0, "assistant", "least"),
    ]
    turns, pairs = p.borrowed_ends(spark.createDataFrame([(*r, 1) for r in rows + rows[:2]], SCHEMA))
    out = {r["pair_id"]: r for r in p.format_pairs(turns, pairs).collect()}
    assert set(out) == {-5, 7, 8}
    a = out[-5]
    assert a["n_prompt_turns"] == 3 and a["prompt"] == turn("user", "q") + turn("assistant", "a") + turn("user", "r")
    assert a["chosen"] == turn("assistant", "b") + turn("user", "bye") and a["rejected"] == turn("assistant", "y") + turn("user", "bye")
    assert out[7]["identical"] and out[8]["n_prompt_turns"] == 0 and out[8]["rejected"] == turn("assistant", "z" * 300_000)
    assert out[8]["rejected_mask"][1]["length"] == 300_000 + len("<|im_end|>\n")
    empty = spark.createDataFrame([], SCHEMA)
    assert p.format_pairs(*p.borrowed_ends(empty)).count() == 0
