"""Made-up texts for the tests."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnoprstuvé") for _ in range(r.randint(2, 9))) for _ in range(n)]


def prose(seed: int, n: int, per_line: int = 12) -> str:
    w = words(seed, n)
    return "\n".join(" ".join(w[i:i + per_line]) for i in range(0, n, per_line))


def colliding() -> tuple[str, str]:
    """Two strings of 2,048 letters with equal polynomial hashes modulo 2**64 for any base."""
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))
