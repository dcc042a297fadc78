"""Pairs of tasks and dates against the greedy choice over all sorted pairs."""

import random
import time

import pytest

from notemill.operators.reminders import NO_SPAN, nearest_pairs


def greedy(tasks, dates):
    pairs = sorted((NO_SPAN if tm is None or dm is None else abs(dm - tm) - bonus, a, b) for a, (_, tm) in enumerate(tasks) for b, (_, dm, bonus) in enumerate(dates))
    done, taken, out = set(), set(), []
    for _, a, b in pairs:
        if tasks[a][0] not in done and dates[b][0] not in taken:
            done.add(tasks[a][0])
            taken.add(dates[b][0])
            out.append((a, b))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_pairs_equal_the_greedy_choice(seed):
    r = random.Random(seed)
    span = r.choice([3, 10, 100, 30_000])
    place = lambda: None if r.random() < 0.1 else r.randint(0, span) / 2
    tasks = sorted(((f"t{r.randint(0, 20)}", place()) for _ in range(r.randint(0, 25))), key=str)
    dates = sorted((((r.randint(0, 9), f"d{r.randint(0, 3)}"), place(), r.choice([0.0, 40.0])) for _ in range(r.randint(0, 25))), key=str)
    assert nearest_pairs(tasks, dates) == greedy(tasks, dates)


@pytest.mark.parametrize("apart", [True, False])
def test_a_note_with_very_many_of_both(apart):
    n = 30_000
    r = random.Random(1)
    tasks = [(f"t{i}", float(i if apart else r.randint(0, n))) for i in range(n)]
    dates = [((i, "d"), float(n + i if apart else r.randint(0, n)), 40.0 * (i % 2)) for i in range(n)]
    began = time.time()
    assert len(nearest_pairs(tasks, dates)) == n and time.time() - began < 60
