"""Periodic stretches that begin at different phases still share a seed."""

import random

import numpy as np

from evispark.llm import spans


def seeds(text):
    _, places, values = spans.seed_places(np.array([ord(c) for c in text], np.uint32), np.array([0, len(text)]), 100, 101)
    return list(zip(places.tolist(), values.tolist()))


def longest(a, b):
    """The longest match through a common seed, as far as 100 characters on either side."""
    best = 0
    for i, v in seeds(a):
        for j, w in seeds(b):
            if v == w:
                left = next((x for x in range(min(i, j, 100)) if a[i - x - 1] != b[j - x - 1]), min(i, j, 100))
                room = min(len(a) - i, len(b) - j, 200)
                best = max(best, left + next((y for y in range(100, room) if a[i + y] != b[j + y]), room))
    return best


def test_no_shared_stretch_is_lost():
    rng = random.Random(3)
    tried = 0
    while tried < 400:
        period = rng.randint(20, 60)
        unit = "".join(rng.choices("abcdefgh", k=period)) * 20
        a, b = ("".join(rng.choices(edge, k=rng.choice([0, 5, 60]))) + unit[(at := rng.randrange(period)) : at + rng.choice([200, 210, 230, 260])] for edge in ("xyz", "uvw"))
        if any(a[i : i + 200] in b for i in range(len(a) - 199)):
            tried += 1
            assert longest(a, b) >= 200
