import zlib

from dataward.llm import chat


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows],
                                 "pair_id bigint, side string, turn int, role string, text string, n int, prompt string")


def test_common_prefix_and_masks(spark):
    rows = []
    for side, last in (("chosen", "good"), ("rejected", "bad answer")):
        rows += [(1, side, 0, "system", "s"), (1, side, 1, "user", "<|end|> q"), (1, side, 2, "assistant", last),
                 (1, side, 3, "user", "more"), (1, side, 4, "assistant", last + "é")]
    rows += [(2, "chosen", 0, "user", "same"), (2, "rejected", 0, "user", "same")]      # equal: no preference
    rows += [(3, "chosen", 0, "user", "q"), (3, "chosen", 1, "assistant", "a"), (3, "rejected", 0, "user", "q")]
    rows += [(4, "chosen", 0, "user", "alone"), (None, "chosen", 0, "user", "x"), (5, "other", 0, "user", "x")]
    rows += [(6, "chosen", 0, None, None), (6, "rejected", 0, "user", "x"), (6, "rejected", 0, "user", "x")]
    got = {r["pair_id"]: r for r in chat.preference_pairs(turns(spark, rows).repartition(4)).collect()}
    assert set(got) == {1, 3, 6}
    one = got[1]
    assert one["n_prompt_turns"] == 2
    assert one["prompt"] == "<|system|>\ns<|end|>\n<|user|>\n< |end|> q<|end|>\n"
    for side, last in (("chosen", "good"), ("rejected", "bad answer")):
        assert one[side] == (f"<|assistant|>\n{last}<|end|>\n<|user|>\nmore<|end|>\n<|assistant|>\n{last}é<|end|>\n")
        spans = [one[side][m["start"]:m["end"]] for m in one[f"{side}_mask"]]
        assert spans == [f"{last}<|end|>\n", f"{last}é<|end|>\n"]
    assert got[3]["rejected"] == "" and got[3]["rejected_mask"] == [] and got[3]["n_prompt_turns"] == 1
    assert got[6]["n_prompt_turns"] == 0 and got[6]["prompt"] == "" and got[6]["chosen"] == "<|unknown|>\n<|end|>\n"
    assert got[6]["chosen_mask"] == []


def test_pairs_from_conversations(spark):
    rows = [(c, t, role, f"{role} {c} {t}") for c in range(1, 40) for t, role in
            enumerate(["system", "user", "assistant", "user", "assistant", "assistant", "user"])]
    rows += [(50, 0, "user", "q"), (50, 1, "assistant", "a"), (51, 0, "user", "no answer"), (52, 0, "assistant", "first"),
             (53, 0, "user", "a"), (53, 1, "assistant", "a"), (None, 0, "assistant", "a"), (50, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").repartition(3)
    made = chat.made_pairs(df)
    assert made.columns == ["pair_id", "side", "turn", "role", "text"]
    got = {r["pair_id"]: r for r in chat.preference_pairs(made).collect()}
    assert set(got) == {*range(1, 40), 50, 52}              # 51 has no answer, 53 repeats itself
    assert {got[c]["n_prompt_turns"] for c in range(1, 40)} == {2, 4, 5}
    for c in range(1, 40):
        n, answers = got[c]["n_prompt_turns"], (2, 4, 5)
        assert n == answers[zlib.crc32(str(c).encode()) % 3]
        spans = [got[c]["chosen"][m["start"]:m["end"]] for m in got[c]["chosen_mask"]]
        assert spans == [f"assistant {c} {t}<|end|>\n" for t in answers if t >= n]
        before = next(r[3] for r in rows if r[:2] == (c, n - 1))
        assert got[c]["rejected"] == got[c]["chosen"].replace(f"assistant {c} {n}<", f"{before}<")
        assert got[c]["chosen"].endswith(f"<|user|>\nuser {c} 6<|end|>\n")
    assert got[50]["rejected"] == "<|assistant|>\nq<|end|>\n" and got[52]["rejected"] == "<|assistant|>\n<|end|>\n"


def test_empty(spark):
    assert chat.preference_pairs(turns(spark, [])).count() == 0
    none = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    assert chat.preference_pairs(chat.made_pairs(none)).count() == 0
