"""Queries over all of their input, against loops: nothing that the operator can take may be left out."""

import math
import re
import string
from datetime import datetime

import pytest

from tracewright import plans


@pytest.fixture
def run(spark, tmp_path):
    def go(name, table, schema, rows):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{table}.parquet"))
        return plans.load()[0][name](spark, str(tmp_path)).collect()

    return go


def test_logits_of_the_whole_vector(run):
    v = [((7 * i) % 64) / 16 - 1 for i in range(64)]
    rows = run("logits_stats", "embeddings", "vec_id long, embedding array<float>, label int", [(1, v, 9), (2, v, 70), (3, [], 1), (4, None, 1)])
    z = sum(math.exp(x) for x in v)
    entropy = -sum(math.exp(x) / z * math.log(math.exp(x) / z) for x in v)
    got = {r.vec_id: r for r in rows}
    for k, label in ((1, 9), (2, 70 % 64)):
        assert got[k].entropy == pytest.approx(entropy, abs=2e-6) and got[k].logprob == pytest.approx(v[label] - math.log(z), abs=2e-6)
    assert got[3].logprob is None and got[4].entropy is None


def test_end_tokens_anywhere_in_the_sequence(run):
    late = [0.0] * 40 + [7 / 40 + 0.001] + [0.0] * 23
    rows = run("eos_masks", "embeddings", "vec_id long, embedding array<float>, label int", [(1, late, 0), (2, [0.0] * 64, 0), (3, [-9 / 40 - 0.001] + [0.0] * 63, 0)])
    assert {r.vec_id: r["mask"] for r in rows} == {1: [1] * 41 + [0] * 23, 2: [1] * 64, 3: [1] + [0] * 63}


def test_union_over_every_run(run):
    runs = ["r00-amber", "r01-birch", "r02-cedar", "r03-delta", "other"]
    rows = [(r, "q1", 1.0) for r in runs] + [(r, "q2", 1.0 if r == "r03-delta" else 0.0) for r in runs] + [("other", "q3", 0.9), ("r00-amber", "q3", 0.1), (None, "q4", 1.0), ("other", "q3", 0.9)]
    got = run("union_accuracy", "episodes", "run_id string, question_id string, total_reward double", rows)[0]
    assert (got.questions, got.correct_any, got.in_every, got.correct_every, got.inconsistent_rate) == (3, 3, 2, 1, 0.5)


def test_spans_of_every_form(run):
    good = {
        '[[1, 2.5], [4, 5]]': (2, 2.5), '[{"start": 1, "end": 3}, {"end": 9.5, "start": 9}]': (2, 2.5), "[3, 4.25]": (1, 1.25), " [ ] ": (0, 0.0),
        '[{"start": 1, "end": 2, "note": "a ] } b"}]': (1, 1.0), ' [[1, 2]]\n': (1, 1.0),
    }
    bad = ["B", "[b]", "", None, "[1, 2], [3, 4]", "[[1, 2]];", "[[1, 2]][[3, 4]]", "[[1, 2]] ], [", "[[1, 2]] }", '[{"start": 1, "end": 2}] x', "[{'start': 1, 'end': 2}]", '[{"start": 1}]', "[1, 2, 3]", "[[1, 2], [3]]", "[[1, 2]", "[[NaN, 2]]"]
    rows = run("span_parse", "example_train_rl", "row_id long, answer string", list(enumerate([*good, *bad])))
    assert {r.row_id: (r.n, r.seconds) for r in rows} == dict(enumerate(good.values()))


def test_step_report_counts_late_steps(run):
    info = lambda won, valid, error: (None, None, won, valid, error, None)
    rows = [("t1", i, info(None, True, None)) for i in range(1, 101)] + [("t1", 101, info(True, False, "BAD")), ("t2", 1, info(False, True, "STEP_LIMIT_REACHED"))]
    schema = (
        "traj_id string, step int, extra_info struct<video string, question_type string, won boolean, is_action_valid boolean, error_code string, duration_seconds double>, run_id string, question_id string, "
        "action_type string, output string, step_reward double, done boolean, episode_reward double, generation_seconds double, env_step_seconds double, step_wall_seconds double, started_at timestamp, ingested_at timestamp"
    )
    at = datetime(2026, 1, 1)
    got = run("step_report", "steps", schema, [(t, i, x, "r", "q", "answer", "", 0.0, False, 0.0, 0.0, 0.0, 0.0, at, at) for t, i, x in rows])[0]
    assert (got.n_steps, got.valid, got.invalid, got.won, got.failed_at_limit) == (102, 100, 2, 1, 1)


def test_questions_beyond_ascii(run):
    def normal(s):
        s = "".join(c for c in s.lower() if c not in string.punctuation)
        return " ".join(re.sub(r"\b(a|an|the)\b", " ", s).split())

    texts = ["The  cat, an Owl!", "“The” cat—an owl？", "The　cat", "a b", "which\r\n\tof the", "x\x1cy\x85the\x1f", "thé cat", "a² the", "①the a", "the‿", "中the国", "İ the", ""]
    rows = run("qa_normal", "example_eval", "eval_id long, question string", list(enumerate([*texts, None])))
    assert {r.eval_id: r.norm for r in rows} == {i: normal(t) for i, t in enumerate(texts)}


def test_long_numbers_in_file_names_keep_their_row(run):
    cases = {"run7/clip_12.jsonl": ("run7", 12), "run7/" + "9" * 17 + ".jsonl": ("run7", 10**17 - 1), "run7/9223372036854775807": ("run7", 2**63 - 1), "run7/9223372036854775808.x": ("run7", None), "a/" + "1" * 40: ("a", None), "x/none": ("x", None), "5": (None, 5)}
    rows = run("task_and_step", "example_train_rl", "row_id long, video string", list(enumerate([*cases, None])))
    assert {r.row_id: (r.task, r.step) for r in rows} == dict(enumerate(cases.values()))
