"""Best answers against all pairs."""

import numpy as np
import pytest

from tessera.operators.vectors import best_answers

DDL = "id long, scope string, vector array<float>"


@pytest.mark.parametrize("block", [512, 7])
def test_best_answers_are_those_of_all_pairs(spark, block):
    r = np.random.default_rng(2)
    centres = r.normal(size=(9, 6))
    row = lambda i, scope: (i, scope, [float(x) for x in centres[i % 9] + r.normal(size=6) * 0.25])
    scopes = ["hot"] * 6 + ["b", "c", None]
    questions = [row(i, scopes[i % 9]) for i in range(0, 60, 3)]
    answers = [row(i, scopes[(i * 5) % 9]) for i in range(1000, 1090)] + questions[:5] + [(2000, "hot", questions[0][2]), (1999, "hot", questions[0][2]), (3000, None, [0.0] * 6), (3001, None, [None] + [1.0] * 5), (3002, None, None), (3003, "b", [float("inf")] + [0.0] * 5)]
    questions += [(5000, "hot", [0.0] * 6), (5001, None, None)]
    want = {}
    for q, scope, v in questions[:20]:
        found = [(-round(float(np.dot(v, a) / np.linalg.norm(v) / np.linalg.norm(a)), 6), i) for i, s, a in answers if i != q and i < 2500 and (s is None or s == scope)]
        if found and -min(found)[0] >= 0.85:
            want[q] = (min(found)[1], -min(found)[0])
    got = {x.query_id: (x.id, x.cosine) for x in best_answers(spark.createDataFrame(questions, DDL), spark.createDataFrame(answers, DDL), 0.85, block).collect()}
    assert got.keys() == want.keys() and len(want) >= 5 and all(got[q][0] == want[q][0] and abs(got[q][1] - want[q][1]) < 2e-6 for q in want)
    assert best_answers(spark.createDataFrame([], DDL), spark.createDataFrame(answers, DDL), 0.85).count() == 0
