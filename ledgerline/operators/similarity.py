"""String similarity by bit-parallel longest common subsequences.

The table of a longest common subsequence differs by 0 or 1 from cell to cell, so a column of it is a row
of bits, and a whole column comes from the one before by an addition and two masks. Many pairs take their
steps together: lanes of 64-bit words in numpy, with a carry from word to word. A string of n characters
against one of m costs n / 64 words for each of m steps.

The indel ratio is twice the common length over both lengths. The partial ratio is the best one between the
shorter string and all windows of its length over the longer one, shorter windows at both ends too. Counts
of characters that two strings share bound their common length, so windows (and pairs, where a least ratio
is asked for) that cannot be good enough are never compared.
"""

from __future__ import annotations

import numpy as np

#: 64-bit words of match masks that are held at a time; pairs of a size from which lanes are worth their calls.
HELD, LANES = 1 << 21, 512


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _padded(codes: list[np.ndarray], alphabet: np.ndarray) -> np.ndarray:
    """[strings, longest]: places in the alphabet; its length for what is not in it, and behind an end."""
    out = np.full((len(codes), max(map(len, codes), default=0)), len(alphabet), np.int64)
    for row, c in zip(out, codes):
        if len(alphabet):
            at = np.minimum(np.searchsorted(alphabet, c), len(alphabet) - 1)
            row[: len(c)] = np.where(alphabet[at] == c, at, len(alphabet))
    return out


def _masks(classes: np.ndarray, n: int, words: int) -> np.ndarray:
    """[strings, n + 1, words]: where each character of the alphabet is; nowhere for the last."""
    out = np.zeros((len(classes), n + 1, words), np.uint64)
    rows = np.arange(len(classes))
    for i in range(classes.shape[1]):
        out[rows, classes[:, i], i // 64] |= np.uint64(1 << i % 64)
    out[:, n] = 0
    return out


def _lanes(masks: np.ndarray, of: np.ndarray, steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Common lengths: lane k reads steps[k] against the masks of string of[k], which has sizes[k] characters."""
    words = masks.shape[2]
    state = np.full((len(of), words), ~np.uint64(0))
    for t in range(steps.shape[1]):
        met = state & masks[of, steps[:, t]]
        total, carry = np.empty_like(state), np.zeros(len(of), np.uint64)
        for w in range(words):
            first = state[:, w] + met[:, w]
            total[:, w] = first + carry
            carry = ((first < met[:, w]) | (total[:, w] < first)).astype(np.uint64)
        state = total | (state & ~met)
    bits = np.arange(words) * 64
    valid = np.clip(sizes[:, None] - bits, 0, 64)
    mask = np.where(valid == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(valid, 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~state & mask).sum(1).astype(np.int64)


def _common(short: str, long: str) -> int:
    """The same columns as whole numbers of any length, for a pair alone."""
    masks, state = {}, (1 << len(short)) - 1
    for i, c in enumerate(short):
        masks[c] = masks.get(c, 0) | 1 << i
    full = state
    for c in long:
        if met := state & masks.get(c, 0):
            state = (state + met | state - met) & full
    return len(short) - state.bit_count()


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """The length of the longest common subsequence of each pair."""
    out = np.zeros(len(a), np.int64)
    short = [_codes(min(x, y, key=len)) for x, y in zip(a, b)]
    long = [_codes(y if len(x) <= len(y) else x) for x, y in zip(a, b)]
    words = np.array([-(-len(s) // 64) for s in short], np.int64)
    order = np.lexsort(([len(x) for x in long], words))
    order = order[words[order] > 0]
    at = 0
    while at < len(order):
        # lanes of about one size: as many as their masks may hold
        width = int(words[order[at]])
        alphabet = max(len(np.unique(short[i])) for i in order[at : at + 64]) + 1
        take = order[at : at + max(1, HELD // (4 * alphabet * width))]
        take = take[words[take] == width]
        at += len(take)
        if len(take) < LANES:
            for i in take:
                out[i] = _common(*sorted((a[i], b[i]), key=len))
            continue
        known = np.unique(np.concatenate([short[i] for i in take]))
        while len(take) > 1 and len(take) * (len(known) + 1) * width > HELD:
            at -= len(take) - len(take) // 2
            take = take[: len(take) // 2]
            known = np.unique(np.concatenate([short[i] for i in take]))
        masks = _masks(_padded([short[i] for i in take], known), len(known), width)
        out[take] = _lanes(masks, np.arange(len(take)), _padded([long[i] for i in take], known), np.array([len(short[i]) for i in take]))
    return out


def shared_bound(a: str, b: str) -> int:
    """Characters that two strings have in common, whatever their order: the longest common subsequence is no longer."""
    x, y = _codes(a), _codes(b)
    known, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    return int(np.minimum(np.bincount(at[: len(x)], minlength=len(known)), np.bincount(at[len(x) :], minlength=len(known))).sum())


def ratios(a: list[str], b: list[str], least: float = 0.0) -> np.ndarray:
    """Indel ratios from 0 to 1 (two empty strings: 1); 0 for pairs whose shared characters keep them below `least`."""
    total = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64)
    out = np.where(total == 0, 1.0, 0.0)
    worth = [i for i, n in enumerate(total) if n and (not least or 2 * shared_bound(a[i], b[i]) >= least * n)]
    if worth:
        at = np.array(worth)
        out[at] = 2 * common_lengths([a[i] for i in worth], [b[i] for i in worth]) / total[at]
    return out


def partial_ratio(part: str, text: str) -> float:
    """The best indel ratio (0 to 100) of the shorter string with a window of its length over the longer one, or less at both ends.

    Two empty strings: 100; one empty string: 0.
    """
    short, long = (_codes(s) for s in sorted((part, text), key=len))
    if not len(short):
        return 0.0 if len(long) else 100.0
    best = _best_window(short, long)
    return 100 * (max(best, _best_window(long, short)) if len(short) == len(long) else best)


def _best_window(short: np.ndarray, long: np.ndarray) -> float:
    n = len(short)
    start, end = np.arange(1 - n, len(long)), np.arange(1, len(long) + n)
    start, end = np.maximum(start, 0), np.minimum(end, len(long))
    known = np.unique(short)
    classes, own = _padded([long], known)[0], np.bincount(_padded([short], known)[0], minlength=len(known) + 1)
    # shared characters of each window, from running counts
    bound = np.zeros(len(start), np.int64)
    for c in range(len(known)):
        upto = np.r_[0, np.cumsum(classes == c)]
        bound += np.minimum(upto[end] - upto[start], own[c])
    top = 2 * bound / (n + end - start)
    order = np.argsort(-top, kind="stable")
    masks = _masks(_padded([short], known), len(known), -(-n // 64))
    best, at, step = 0.0, 0, 16
    while at < len(order) and top[order[at]] > best:
        take = order[at : at + step]
        at, step = at + len(take), min(2 * step, 4096)
        reach = start[take][:, None] + np.arange(int((end - start)[take].max()))
        steps = np.where(reach < end[take][:, None], classes[np.minimum(reach, len(long) - 1)], len(known))
        found = _lanes(masks, np.zeros(len(take), np.int64), steps, np.full(len(take), n))
        best = max(best, float((2 * found / (n + (end - start)[take])).max()))
    return best
