from __future__ import annotations

import random

WORDS = [f"{a}{b}" for a in "stun bral fev moth rik quas".split() for b in "ed ing or al um en ist".split()]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def edited(rng: random.Random, text: str, changes: int) -> str:
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = "x" + str(rng.randrange(10**6))
    return " ".join(words)


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]
