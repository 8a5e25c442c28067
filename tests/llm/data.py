"""Small document tables with nulls, empties, ties, repeats, long texts and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, base string, fp long, size long"


def word(r: random.Random) -> str:
    return "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randrange(2, 8)))


def prose(r: random.Random, n: int, words: list[str]) -> str:
    return " ".join(r.choice(words) for _ in range(n))


def rows(seed: int = 3, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    words = [word(r) for _ in range(1500)]
    out = []
    for i in range(n):
        text = prose(r, r.randrange(1, 200), words)
        if i % 5 == 4:
            text = out[r.randrange(len(out))][1] or ""
        if i % 7 == 6 and out:
            parts = (out[r.randrange(len(out))][1] or "x").split()
            parts[r.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        out.append((i, text, "en", f"s{i % 3}", len(text), "x", "y", 1, 2))
    out.append((n, None, None, None, None, None, None, None, None))
    out.append((n + 1, "", "en", None, 0, "x", "y", 1, 2))
    out.append((n + 2, " \t\n ", "en", "s0", 4, "x", "y", 1, 2))
    out.append((n + 3, prose(r, 6000, words), "en", "s1", 1, "x", "y", 1, 2))
    out.append((n + 4, "same line\n" * 400, "en", "s1", 1, "x", "y", 1, 2))
    out.append((n + 5, "Ünïcode ÉCOLE 日本語 текст 😀 word", "fr", "é", 30, "x", "y", 1, 2))
    out.append(out[0])
    return out
