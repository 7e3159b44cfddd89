"""Local alignment of two flanks and their quality-weighted consensus."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

# Scores, and the quality code above which an unpaired base is kept.
MATCH, MISMATCH, GAP, KEEP = 1, -1, -3, "5"


class Aligned(NamedTuple):
    """identity in percent (NaN if nothing was paired), gaps, consensus bases and qualities."""

    identity: float
    gaps: int
    seq: str
    qual: str


def _better(a: str, qa: str, b: str, qb: str) -> tuple[str, str]:
    """Base by base the one of higher quality; of equals the second."""
    pick = [(x, p) if p > q else (y, q) for x, p, y, q in zip(a, qa, b, qb, strict=True)]
    return "".join(x for x, _ in pick), "".join(q for _, q in pick)


def _scores(a: str, b: str) -> np.ndarray:
    """The matrix of local scores; gaps along a row are a running maximum."""
    x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b))
    out = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    slope = np.arange(len(y) + 1, dtype=np.int32) * GAP
    for i in range(1, len(x) + 1):
        base = np.zeros(len(y) + 1, np.int32)
        base[1:] = np.maximum(0, np.maximum(out[i - 1, :-1] + np.where(y == x[i - 1], MATCH, MISMATCH), out[i - 1, 1:] + GAP))
        out[i, 1:] = (np.maximum.accumulate(base - slope) + slope)[1:]
    return out


def align_flanks(block: str, block_qual: str, read: str, read_qual: str, right: bool) -> Aligned:
    """Aligns a block's flank with a read's.

    The best cell is the last of the best in reading order; a pair is preferred to skipping a base of the block, that to
    skipping one of the read. A skipped base counts as a gap and stays if its quality is above KEEP. On the right
    side the longer flank goes on beyond the last paired column of the read, and gaps are only the difference of
    the places where the pairs begin; on the left side bases of the read after the last pair
    are gaps, and the longer flank's bases before the first pair come in front.
    """
    n, m = len(block), len(read)
    k = min(n, m)
    # Where the shorter flank is simply part of the longer one there is no need for the matrix.
    if k and not right and block[n - k :] == read[m - k :]:
        seq, qual = _better(block[n - k :], block_qual[n - k :], read[m - k :], read_qual[m - k :])
        head, q = (block[: n - k], block_qual[: n - k]) if n > m else (read[: m - k], read_qual[: m - k])
        return Aligned(100.0, 0, head + seq, q + qual)
    if k and right and block[:k] == read[:k] and (block if n > m else read).rfind(block[:k]) == 0:
        seq, qual = _better(block[:k], block_qual[:k], read[:k], read_qual[:k])
        tail, q = (block[k:], block_qual[k:]) if n > m else (read[k:], read_qual[k:])
        return Aligned(100.0, 0, seq + tail, qual + q)
    score = _scores(block, read)
    inner = score[1:, 1:]
    i = j = 0
    if inner.size:
        at = inner.size - 1 - int(inner.ravel()[::-1].argmax())
        i, j = at // m + 1, at % m + 1
    longer, longer_qual = (block, block_qual) if n > m else (read, read_qual)
    tail = (longer[j:], longer_qual[j:]) if right else ("", "")
    gaps = 0 if right else m - j
    seq, qual, same, other = [], [], 0, 0
    while score[i, j] > 0 and i >= 1 and j >= 1:
        pair = score[i - 1, j - 1] + (MATCH if block[i - 1] == read[j - 1] else MISMATCH)
        if score[i, j] == pair:
            b, q = _better(block[i - 1], block_qual[i - 1], read[j - 1], read_qual[j - 1])
            seq.append(b)
            qual.append(q)
            same, other = (same + 1, other) if block[i - 1] == read[j - 1] else (same, other + 1)
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] + GAP:
            i, gaps = i - 1, gaps + 1
            if block_qual[i] > KEEP:
                seq.append(block[i])
                qual.append(block_qual[i])
        else:
            j, gaps = j - 1, gaps + 1
            if read_qual[j] > KEEP:
                seq.append(read[j])
                qual.append(read_qual[j])
    if right:
        gaps, head = abs(i - j), ("", "")
    else:
        first = i if n > m else j
        head = longer[:first], longer_qual[:first]
    identity = same * 100.0 / (same + other) if same + other else float("nan")
    return Aligned(identity, gaps, head[0] + "".join(reversed(seq)) + tail[0], head[1] + "".join(reversed(qual)) + tail[1])
