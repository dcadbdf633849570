"""Similarity of two short column names on a 0-100 scale."""


def common_subsequence(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a: str, b: str) -> float:
    """Share of characters kept when only insertions and deletions are allowed."""
    size = len(a) + len(b)
    return 100.0 * 2 * common_subsequence(a, b) / size if size else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter name against any window of the longer, shorter windows only at its ends."""
    short, long = sorted((a, b), key=len)
    m = len(short)
    if not m:
        return 100.0 if not long else 0.0
    windows = {long[i:i + m] for i in range(len(long) - m + 1)}
    windows |= {long[:k] for k in range(1, m)} | {long[-k:] for k in range(1, m)}
    return max(ratio(short, w) for w in windows)


def name_score(a: str, b: str) -> float:
    return 0.5 * ratio(a, b) + 0.5 * partial_ratio(a, b)
