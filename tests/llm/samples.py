"""Texts and word helpers that the tests share."""

import re

import numpy as np

WORDS = "the of and to in is quiet river stones under bridge where old boats sleep while rain sings over roofs slow".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[rng.integers(len(WORDS))]}{rng.integers(40)}" for _ in range(n))


TEXTS = [prose(i, 60 + i) for i in range(20)]
NEAR = TEXTS[0].replace(TEXTS[0].split()[30], "CHANGED", 1)
ODD = [None, "", "  \n ", "one", "Two words", "é ÀB \U0001f600 x", TEXTS[0], TEXTS[0], NEAR, "x " * 30_000]
ROWS = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, 7) for i, t in enumerate([*TEXTS, *ODD])]
SCHEMA = "doc_id long, text string, lang string, source string, n_words long"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")
