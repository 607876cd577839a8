"""Plain forms of what the operators compute."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text, n=5):
    w = WORD.findall(text or "")
    return {tuple(w[i: i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard_links(sets, least):
    out = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= least * len(a | b) - 1e-12 and a and b:
                out.append((j, i))
    return out


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, node int"


def odd_rows():
    """NULLs in every column, empty, blank and long texts, ties, repeated rows, clashing names."""
    long_text = " ".join(f"word{i % 977}" for i in range(40_000))
    rows = [
        (1, "Plain words in a row here.", "en", "a", 10, 1, 2),
        (1, "Plain words in a row here.", "en", "a", 10, 1, 2),
        (2, None, None, None, None, None, None),
        (3, "", "en", "b", 0, 1, 1),
        (4, " \n\t ", "en", "b", 3, 1, 1),
        (None, "No id at all for these words.", "fr", "b", 9, 1, 1),
        (5, long_text, "en", "a", len(long_text), 1, 1),
        (6, "1234 5678 ... !!!", "de", None, 4, 1, 1),
        (7, "Été À L’ÂGE ñandú İ K.", "es", "c", 5, 1, 1),
        (8, "Plain words in a row here.", "en", "c", 10, 1, 2),
    ]
    return rows
