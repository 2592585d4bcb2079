"""Distributed descents against the list form and the one-task form, dense and sparse, several models at once."""

import random

import numpy as np
import pytest

from sieveline.operators import models

SPARSE = "split string, model string, ord long, label int, part string, features array<struct<i: int, v: double>>, doi string"


def made(seed=3):
    rng = random.Random(seed)
    rows = []
    for split, model, n, width in (("s", "a", 60, 5), ("s", "b", 40, 30), ("t", "a", 25, 3), ("u", "only train", 9, 2)):
        for k in range(n):
            cells = [(i, rng.random()) for i in range(width) if rng.random() < 0.4]
            part = "train" if k % 3 or split == "u" else "test"
            if part == "test" and k % 2:
                cells.append((width + 50, 1.0))  # a place that no training row has
            rows.append((split, model, k, int(rng.random() < 0.4), part, cells, f"d{k}"))
    return rows


def by_lists(rows, epochs):
    out, weights = {}, {}
    for key in {r[:2] for r in rows}:
        train, test = ([r for r in rows if r[:2] == key and r[4] == p] for p in ("train", "test"))
        width = max(i for r in train for i, _ in r[5]) + 1
        dense = lambda r, w=width: [dict(r[5]).get(i, 0.0) for i in range(w)]
        m = models.LogisticRegression(epochs=epochs).fit(np.array([dense(r) for r in train]), np.array([r[3] for r in train]))
        weights |= {(*key, i): w for i, w in enumerate(m.weights)}
        if test:
            out |= {(*key, r[2]): s for r, s in zip(test, m.predict(np.array([dense(r) for r in test])))}
    return out, weights


@pytest.mark.parametrize("task_cells", [10**6, 0, 100])
def test_scores_and_weights_are_those_of_the_list_form(spark, task_cells):
    rows = made()
    df = spark.createDataFrame(rows, SPARSE).repartition(4)
    want, weights = by_lists(rows, 12)
    got = {(r.split, r.model, r.ord): r.score for r in models.fit_groups(df, ["split", "model"], epochs=12, keep=["doi"], task_cells=task_cells).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    got = {(r.split, r.model, r.idx): r.weight for r in models.fit_weights(df, ["split", "model"], epochs=12, task_cells=task_cells).collect()}
    assert got.keys() == weights.keys() and all(abs(got[k] - weights[k]) < 1e-9 for k in weights)


def test_large_weights_are_joined(spark, monkeypatch):
    monkeypatch.setattr(models, "SENT_BYTES", 0)
    rows = made(4)
    want, _ = by_lists(rows, 3)
    got = {(r.split, r.model, r.ord): r.score for r in models.fit_groups(spark.createDataFrame(rows, SPARSE), ["split", "model"], epochs=3, task_cells=0).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
