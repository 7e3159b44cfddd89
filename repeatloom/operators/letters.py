"""Whole batches of reads as arrays of letters: what has to look at every place of every read."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows taken at once.
ROWS = 4096

_COMPLEMENT = np.arange(0x110000, dtype=np.uint32)
for _a, _b in zip("ACGTN" + "acgtn", "TGCAN" + "tgcan", strict=True):
    _COMPLEMENT[ord(_a)] = ord(_b)


class Letters:
    """Texts one after another: code of each letter, which text it belongs to, and its place there."""

    def __init__(self, texts: list[str | None]):
        self.texts = [t or "" for t in texts]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.code = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.owner = np.repeat(np.arange(len(self.texts)), self.lengths)
        self.place = np.arange(len(self.code)) - self.starts[self.owner]

    def reverse_complements(self) -> Letters:
        mirrored = _COMPLEMENT[self.code][self.ends[self.owner] - 1 - self.place]
        whole = mirrored.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return Letters([whole[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)])


def best_matches(x: Letters, num_copies: int, flank: int, motif_lengths: tuple[int, ...], remove_homopolymers: bool, rank_before_filter: bool) -> list[tuple | None]:
    """The best repeat of each text as (len, copies, str, motif, start, end), or None.

    A place is good for k if the letter k further on is the same; a run of copies goes on to the next place that is not."""
    found = []
    size = len(x.code)
    unknown = np.concatenate([[0], np.cumsum(x.code == ord("N"))])
    same_as_next = np.zeros(size + 1, np.int64)
    if size > 1:
        same_as_next[1:size] = np.cumsum((x.code[1:] == x.code[:-1]) & (x.owner[1:] == x.owner[:-1]))
    for k in motif_lengths:
        if size <= k:
            continue
        at = np.arange(size)
        good = np.zeros(size, bool)
        good[:-k] = (x.code[:-k] == x.code[k:]) & (x.owner[:-k] == x.owner[k:])
        until = np.minimum.accumulate(np.where(good, size, at)[::-1])[::-1]
        copies = (until - at) // k + 1
        left = x.lengths[x.owner] - x.place
        keep = (copies >= num_copies) & (left >= k)
        if not rank_before_filter:
            keep &= (x.place >= flank) & (left - copies * k >= flank)
        at = at[keep]
        at = at[unknown[at + k] == unknown[at]]
        if remove_homopolymers and not rank_before_filter:
            at = at[same_as_next[at + k - 1] - same_as_next[at] != k - 1]
        found.append((at, copies[at], np.full(len(at), k)))
    out: list[tuple | None] = [None] * len(x.texts)
    if not found:
        return out
    at, copies, k = (np.concatenate(c) for c in zip(*found, strict=True))
    owner, length = x.owner[at], copies * k
    top = np.zeros(len(x.texts), np.int64)
    np.maximum.at(top, owner, length * (size + 1) + copies)  # longest, then most copies
    ties = np.flatnonzero(length * (size + 1) + copies == top[owner])
    for o, p, c, m in zip(owner[ties].tolist(), x.place[at[ties]].tolist(), copies[ties].tolist(), k[ties].tolist(), strict=True):
        s = x.texts[o]
        match = (c * m, c, s[p : p + c * m], s[p : p + m], p, p + c * m)
        if out[o] is None or match > out[o]:
            out[o] = match
    if rank_before_filter:
        fits = lambda m, n: m[4] >= flank and n - m[5] >= flank and not (remove_homopolymers and len(set(m[3])) == 1)
        out = [m if m and fits(m, n) else None for m, n in zip(out, x.lengths.tolist(), strict=True)]
    return out


_FIELDS = ("len", "copies", "str", "motif", "start", "end")
_TYPE = pa.struct([(f, pa.string() if f in ("str", "motif") else pa.int32()) for f in _FIELDS])


def _structs(matches: list[tuple]) -> pa.Array:
    return pa.array([dict(zip(_FIELDS, m, strict=True)) for m in matches], _TYPE)


def with_matches(batches: Iterator[pa.RecordBatch], strands: tuple[str, ...], args: tuple) -> Iterator[pa.RecordBatch]:
    """Batches with the best repeat of seq (fwd) and of its reverse complement (rc), without the rows that lack one asked for."""
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            part = batch.slice(first, ROWS)
            x = Letters(part["seq"].to_pylist())
            keep = np.arange(part.num_rows)
            columns = []
            if "fwd" in strands:
                fwd = best_matches(x, *args)
                keep = np.array([i for i in keep if fwd[i]], np.int64)
                columns.append(fwd)
            if "rc" in strands:
                rest = x if len(keep) == len(x.texts) else Letters([x.texts[i] for i in keep])
                back = dict(zip(keep.tolist(), best_matches(rest.reverse_complements(), *args), strict=True))
                keep = np.array([i for i in keep if back[i]], np.int64)
                columns.append(back)
            rows = part.take(pa.array(keep, pa.int64()))
            arrays = [*rows.columns, *[_structs([c[i] for i in keep.tolist()]) for c in columns]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rows.schema.names, *strands])


# K-mers as numbers

_BASE = np.full(256, 4, np.uint64)
for _i, _c in enumerate("ACGT"):
    _BASE[ord(_c)] = _BASE[ord(_c.lower())] = _i
_BASE[ord("N")] = _BASE[ord("n")] = 0


#: Letters of a minimizer at most, and of k-mers in a stretch.
MINIMIZER, STRETCH = 9, 255


def windows_of(code: np.ndarray, k: int) -> np.ndarray:
    """Codes of two bits a letter of all k letters in a row (k up to 32), by doubling."""
    n = max(0, len(code) - k + 1)
    piece, size, out, at = code.astype(np.uint64), 1, np.zeros(n, np.uint64), 0
    while at < k:
        if k & size:
            out = (out << np.uint64(2 * size)) | piece[at : at + n]
            at += size
        if at < k:
            piece = (piece[: max(0, len(piece) - size)] << np.uint64(2 * size)) | piece[size:]
            size *= 2
    return out


def reversed_codes(code: np.ndarray, k: int) -> np.ndarray:
    """Codes of the reverse complements."""
    c = ~code
    for bits, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        m, b = np.uint64(mask), np.uint64(bits)
        c = ((c >> b) & m) | ((c & m) << b)
    return c.byteswap() >> np.uint64(64 - 2 * k)


@lru_cache(4)
def _ranks(m: int) -> np.ndarray:
    """The rank of each m letters: a fixed scattered order, the same for a text and its reverse complement."""
    code = np.arange(4**m, dtype=np.uint64)
    h = (np.minimum(code, reversed_codes(code, m)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)


def _bin(rank: np.ndarray, bins: int) -> np.ndarray:
    return ((rank.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)).astype(np.int64) % bins


def bin_of(code: np.ndarray, k: int, bins: int) -> np.ndarray:
    """The bin of each text of k letters by its minimizer: texts that overlap by all but a letter mostly share it, and reverse complements do."""
    m = min(MINIMIZER, k)
    least, mask = np.full(len(code), 0xFFFFFFFF, np.uint32), np.uint64(4**m - 1)
    for i in range(k - m + 1):
        least = np.minimum(least, _ranks(m)[(code >> np.uint64(2 * i)) & mask])
    return _bin(least, bins)


def _lettered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the letters of texts without nulls, 4 for those that are none, and where each text begins and the last ends."""
    if not pc.all(pc.string_is_ascii(texts)).as_py():
        texts = pc.replace_substring_regex(texts, r"[^\x00-\x7f]", ".")
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return _BASE[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]], ends - ends[0]


def _good(code: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which k letters in a row are letters of one text, and the text of each letter."""
    n = len(code) - k + 1
    owner = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))
    bad = np.concatenate([[0], np.cumsum(code == 4)])
    return (bad[k:] == bad[:n]) & (owner[k - 1 :] == owner[:n]), owner


def placed_codes(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k-mers of texts without nulls: the text, the place in it, and the code of each, the smaller of it and its reverse complement."""
    code, ends = _lettered(texts) if len(texts) else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
    if len(code) < k:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    good, owner = _good(code, ends, k)
    at = np.flatnonzero(good)
    forth = windows_of(code & np.uint64(3), k)[at]
    return owner[at], at - ends[owner[at]], np.minimum(forth, reversed_codes(forth, k))


def _least_ranks(code: np.ndarray, k: int) -> np.ndarray:
    """The rank of the minimizer of all k letters in a row."""
    m = min(MINIMIZER, k)
    least, size, left = _ranks(m)[windows_of(code & np.uint64(3), m)], 1, k - m + 1
    while 2 * size <= left:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    n = len(code) - k + 1
    return np.minimum(least[:n], least[left - size : left - size + n])


def _cut_runs(new: np.ndarray, good: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of good k-mers begin and how long they are, cut where they are longer than `most`."""
    first = np.flatnonzero(new)
    if not len(first):
        return first, first
    new[good] |= (np.arange(len(new))[good] - first[(np.cumsum(new) - 1)[good]]) % most == 0
    first = np.flatnonzero(new)
    return first, np.bincount((np.cumsum(new) - 1)[good], minlength=len(first))


def _stretches(texts: pa.Array, k: int, bins: int, both: bool = False) -> Iterator[tuple[int, bytes, int]]:
    """The k-mers of some texts as stretches of letters whose k-mers share their minimizer, put together by its bin: bin, data, k-mers. Equal texts are one
    with their number. Data: how many stretches, of each its number of texts and of k-mers, and all letters, two bits each.
    both: a k-mer is in the bin of its first k-1 letters and in that of its last, once in each; a stretch is a letter longer for that."""
    counted = pc.value_counts(texts)
    texts, number = counted.field("values"), counted.field("counts").to_numpy(zero_copy_only=False)
    code, ends = _lettered(texts)
    n = len(code) - k + 1
    if n < 1:
        return
    good, owner = _good(code, ends, k)
    new = good.copy()
    if both:
        part = _bin(_least_ranks(code, k - 1), bins)
        new[1:] &= ~good[:-1] | (part[1:n] != part[: n - 1])
        first, sizes = _cut_runs(new, good, STRETCH - 1)
        at = part[first]
        longer = (first > 0) & good[first - 1] & (part[first - 1] != at)  # the k-mer before ends with letters of this part
        first, sizes = first - longer, sizes + longer
        last = np.flatnonzero(good & ~np.append(good[1:], False) & (part[1:] != part[:-1]))  # so do last ones of texts
        first, sizes, at = np.concatenate([first, last]), np.concatenate([sizes, np.ones(len(last), np.int64)]), np.concatenate([at, part[last + 1]])
    else:
        least = _least_ranks(code, k)
        new[1:] &= ~good[:-1] | (least[1:] != least[:-1]) | (owner[1:n] != owner[: n - 1])
        first, sizes = _cut_runs(new, good, STRETCH)
        at = _bin(least[first], bins)
    if not len(first):
        return
    order = np.argsort(at, kind="stable")
    at, first, sizes, times = at[order], first[order], sizes[order], number[owner[first[order]]]
    bounds = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    small = code.astype(np.uint8)
    for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(at)], strict=True):
        spans = sizes[a:b] + k - 1
        starts = np.concatenate([[0], np.cumsum(spans)])
        letters = small[np.arange(starts[-1]) + np.repeat(first[a:b] - starts[:-1], spans)]
        letters = np.concatenate([letters, np.zeros(-len(letters) % 4, np.uint8)]).reshape(-1, 4)
        packed = (letters << np.array([6, 4, 2, 0], np.uint8)).sum(axis=1, dtype=np.uint8)
        data = np.int64(b - a).tobytes() + times[a:b].astype(np.int64).tobytes() + sizes[a:b].astype(np.uint8).tobytes() + packed.tobytes()
        yield int(at[a]), data, int(sizes[a:b].sum())


def kmer_stretches(batches: Iterator[pa.RecordBatch], k: int, bins: int, letters: int = 8_000_000, both: bool = False) -> Iterator[pa.RecordBatch]:
    """The k-mers (k up to 31) of each few million letters by bins of their minimizers, as stretches of letters: a letter is sent some
    three times for a k-mer, not k times, and equal k-mers of either strand meet in one bin. both: in that of their first and in that of their last k-1 letters."""
    held, size = [], 0

    def told() -> pa.RecordBatch:
        rows = list(_stretches(pa.chunked_array(held).combine_chunks(), k, bins, both))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary()))], names=["bin", "data"])

    for b in batches:
        held.append(b["seq"])
        size += b["seq"].nbytes
        if size >= letters:
            yield told()
            held, size = [], 0
    if held:
        yield told()


def _windows_of_stretches(data: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the k-mers, the smaller of each and its reverse complement, and how many texts each stands for."""
    n = int(np.frombuffer(data, np.int64, 1)[0])
    times, sizes = np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.uint8, n, 8 + 8 * n).astype(np.int64)
    packed = np.frombuffer(data, np.uint8, offset=8 + 9 * n)
    letters = ((packed[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).reshape(-1)
    starts = np.concatenate([[0], np.cumsum(sizes + k - 1)[:-1]])
    before = np.cumsum(sizes) - sizes
    forth = windows_of(letters, k)[np.arange(sizes.sum()) + np.repeat(starts - before, sizes)]
    return np.minimum(forth, reversed_codes(forth, k)), np.repeat(times, sizes)


#: K-mers that are counted at once; with their numbers some 100 MB.
AT_ONCE = 4_000_000


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, times = (np.concatenate(x) for x in zip(*parts, strict=True))
    if (times == 1).all():
        return np.unique(code, return_counts=True)
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(times[order], first) if len(first) else np.zeros(0, np.int64)


def counted_codes(data: Iterable[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The different k-mers of some stretches as sorted codes, and their counts."""
    parts, size = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
    for x in data:
        parts.append(_windows_of_stretches(x, k))
        size += len(parts[-1][0])
        if size >= AT_ONCE:
            parts = [_summed(parts)]
            size = 0
    return _summed(parts)


def counted_stretches(t: pa.Table, k: int, least: int, most: int) -> pa.Table:
    """The different k-mers of one bin, and their counts up to `most`; those with at least `least`."""
    code, n = counted_codes((x.as_py() for x in t["data"]), k)
    keep = n >= least
    return pa.table({"kmer": spelled(code[keep], k), "cnt": pa.array(np.minimum(n[keep], most).astype(np.int64))})


def spelled(code: np.ndarray, k: int) -> pa.Array:
    """Codes as letters."""
    out = np.empty((len(code), k), np.uint8)
    for i in range(k):
        out[:, i] = np.frombuffer(b"ACGT", np.uint8)[((code >> np.uint64(2 * (k - 1 - i))) & np.uint64(3)).astype(np.int64)]
    return pa.StringArray.from_buffers(len(code), pa.py_buffer((np.arange(len(code) + 1, dtype=np.int32) * k).tobytes()), pa.py_buffer(out.tobytes()))


def kmer_codes(kmers: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of k-mers (k up to 31) and of their reverse complements, and which have k letters A, C, G, T; the others have code 0."""
    texts = [t if t is not None and len(t) == k else "" for t in kmers.to_pylist()]
    good = np.array([bool(t) for t in texts], bool)
    code = _BASE[np.frombuffer("".join(t or "A" * k for t in texts).encode("ascii", "replace"), np.uint8)].reshape(len(texts), k)
    good &= (code < 4).all(axis=1) if len(texts) else good
    code = np.where(code < 4, code, 0).astype(np.uint64)
    forth, back = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    for i in range(k):
        forth = (forth << np.uint64(2)) | code[:, i]
        back |= (np.uint64(3) - code[:, i]) << np.uint64(2 * i)
    return forth, back, good
