"""Statistics of one text, as the quality operators use them."""

from __future__ import annotations

import numpy as np

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"

#: Names of `shape`, in order.
SHAPE = (
    "log_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_word_share", "upper_share", "digit_share",
    "bang_per_word", "bar_per_word", "distinct_share", "words_per_line", "stops_per_word", "long_word_share", "other_marks_per_word",
)


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows of `window` words that are found twice or more in the text, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    code = ids[:n]
    for k in range(1, window):
        # renumber, so that the product stays small whatever the text's length
        _, code = np.unique(code * len(names) + ids[k : n + k], return_inverse=True)
    twice = np.bincount(code)[code] > 1
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : n + k] |= twice
    return int(covered.sum())


def base(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def shape(text: str, words: list[bytes], counts: tuple[int, int, int, int, int]) -> list[float]:
    """Statistics that don't depend on the text's length, but for the first."""
    n, chars, symbols, dup_lines, repeats = counts
    n1, c1 = max(n, 1), max(chars, 1)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    seen = np.bincount(raw, minlength=256)
    lines = int(seen[10]) + 1
    upper, digits = int(seen[65:91].sum()), int(seen[48:58].sum())
    marks = int(seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum())
    bang, bar, stops = int(seen[33]), int(seen[124]), int(seen[46] + seen[44])
    return [
        float(np.log1p(n)), chars / n1, symbols / n1, dup_lines / lines, repeats / n1, upper / c1, digits / c1,
        bang / n1, bar / n1, len(set(words)) / n1, n / lines, stops / n1, sum(len(w) > 18 for w in words) / n1,
        (marks - bang - symbols - stops) / n1,
    ]


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()
