"""Judge runs on questions with one turn, with references of one turn, and without the reference they need."""

import pytest
from pyspark.sql import functions as F

from coheral.operators import judge as J
from coheral.operators.external import stub_judge

PROMPTS = [(f"{kind}{ref}-v{2 if kind == 'pair' and not ref else 1}{multi}", "sys",
            ("ref {ref_answer_1}" + (" and {ref_answer_2}" if multi else "") + "\n" if ref else "")
            + {("pair", ""): "{question}|{answer_a}|{answer_b}", ("single", ""): "{question}|{answer}",
               ("pair", "-multi-turn"): "{question_1}{question_2}|{answer_a_1}{answer_a_2}|{answer_b_1}{answer_b_2}",
               ("single", "-multi-turn"): "{question_1}{question_2}|{answer_1}{answer_2} {unknown}"}[kind, multi])
           for kind in ("pair", "single") for ref in ("", "-math") for multi in ("", "-multi-turn")]

PAIRS = ("question_id bigint, category string, turns array<string>, model_1 string, model_2 string, answer_1 array<string>, "
         "answer_2 array<string>, reference_turns array<string>")
SINGLES = "question_id bigint, category string, turns array<string>, model_id string, answer array<string>, reference_turns array<string>"


@pytest.fixture(scope="module")
def prompts(spark):
    return spark.createDataFrame(PROMPTS, "name string, system_prompt string, prompt_template string")


def _pairs(spark, *rows):
    return spark.createDataFrame([(q, c, t, "m1", "m2", a, b, r) for q, c, t, a, b, r in rows], PAIRS)


def test_one_turn_question_with_a_one_turn_reference(spark, prompts):
    m = _pairs(spark, (1, "math", ["2+2?"], ["4"], ["5"], ["four {answer_a}"]), (2, "writing", ["hi"], ["a"], ["b"], None))
    got = {r.question_id: r for r in J.judge_pairs(m, prompts, stub_judge).collect()}
    assert got[1].g1_user_prompt == "sys\n\nref four {answer_a}\n2+2?|4|5" and got[1].g2_user_prompt == "sys\n\nref four {answer_a}\n2+2?|5|4"
    assert got[2].g1_user_prompt == "sys\n\nhi|a|b" and got[1].judge_prompt == "pair-math-v1" and got[2].judge_prompt == "pair-v2"
    single = spark.createDataFrame([(1, "math", ["2+2?"], "m1", ["4"], ["four"])], SINGLES)
    assert J.judge_singles(single, prompts, stub_judge).first().user_prompt == "sys\n\nref four\n2+2?|4"


def test_second_turns_are_used_in_multi_turn_only(spark, prompts):
    m = _pairs(spark, (1, "math", ["q1", "q2"], ["a1", "a2"], ["b1", "b2"], ["r1", "r2"]))
    assert J.judge_pairs(m, prompts, stub_judge).first().g1_user_prompt == "sys\n\nref r1\nq1|a1|b1"
    assert J.judge_pairs(m, prompts, stub_judge, multi_turn=True).first().g1_user_prompt == "sys\n\nref r1 and r2\nq1q2|a1a2|b1b2"


def test_missing_reference_fails_and_names_the_question(spark, prompts):
    m = _pairs(spark, (7, "math", ["q"], ["a"], ["b"], None), (8, "writing", ["q"], ["a"], ["b"], None))
    with pytest.raises(Exception, match="question 7: .*pair-math-v1"):
        J.judge_pairs(m, prompts, stub_judge).collect()
    with pytest.raises(ValueError):
        J.judge_pairs(m, prompts, stub_judge, missing="other")


def test_missing_reference_can_be_skipped(spark, prompts):
    asked = spark.sparkContext.accumulator(0)

    def judge(prompt):
        asked.add(1)
        assert "{ref" not in prompt
        return stub_judge(prompt)

    m = _pairs(spark, (7, "math", ["q"], ["a"], ["b"], None), (8, "writing", ["q"], ["a"], ["b"], None), (9, "math", ["q1", "q2"], ["a"], ["b"], ["r1"]))
    got = {r.question_id: r for r in J.judge_pairs(m, prompts, judge, missing="skip").collect()}
    assert asked.value == 4 and set(got) == {7, 8, 9}
    assert (got[7].g1_user_prompt, got[7].g2_judgment, got[7].g1_winner, got[7].g2_winner) == (None, None, "error", "error")
    assert got[9].g1_user_prompt == "sys\n\nref r1\nq1|a|b"
    two = J.judge_pairs(m.filter("question_id = 9"), prompts, judge, multi_turn=True, missing="skip").first()
    assert two.g1_user_prompt is None and two.g1_winner == "error"
    single = spark.createDataFrame([(1, "math", ["q"], "m1", ["4"], None), (2, "math", [], "m1", ["4"], ["r"])], SINGLES)
    assert {(r.question_id, r.user_prompt, r.score) for r in J.judge_singles(single, prompts, judge, missing="skip").collect()} == {
        (1, None, -1.0), (2, None, -1.0)}


def test_placeholders_in_values_are_not_filled_again(spark):
    df = spark.createDataFrame([("{a} {b} {c}", "{b}", "x")], "t string, a string, b string")
    assert df.select(J.render_prompt(F.col("t"), {"a": F.col("a"), "b": F.col("b")})).first()[0] == "{b} x {c}"
