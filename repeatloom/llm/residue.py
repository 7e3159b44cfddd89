"""Template residue and error-page text: character n-gram models and likelihood-ratio windows."""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatloom.llm import residue_seeds as seeds
from repeatloom.shared import spread, written

#: Lengths of grams; a gram that a class has not seen backs off to the next shorter one.
LENGTHS = (2, 4, 6)
LONG = LENGTHS[-1]
#: Price of each step back (two fifths), greatest weight of a shorter gram, and weight of a letter that no gram ends with.
BACK_OFF, SHORT_CLIP, LOWEST = -0.92, 2.0, -4.0
#: Letters of prose that every corpus counts more, bounds of a gram's weight, share of the written examples in prose.
PRIOR, CLIP, TALK = 1_000_000, (-4.0, 4.0), 0.35
#: Least sum of a window; least share of its sentence that windows have to cover, and their least weight for each letter of it.
WINDOW_SUM, COVERAGE, MEAN = 10.0, 0.5, 0.55
#: Least sum of a window that covers less of its sentence, if the author does not quote it: anywhere, and at one of its ends with a capital letter.
WITHIN_SUM, EDGE_SUM = {"lorem": 60.0, "filler": 33.0, "notice": 60.0}, {"lorem": 45.0, "filler": 20.0, "notice": 45.0}
#: Least sum of a mark's window, and of the letters around it for a form against talk about the mark.
MARK_SUM, FORM_SUM = 6.0, 2.0
#: Least sum of a mark's window from which on its sentence is not counted as prose.
MARK_DOUBT = 4.0
#: Least sum of a part of a sentence that counts as covered, and letters between two parts that do too.
PART_SUM, BRIDGE = 2.5, 12
#: Least share and weight for each letter of a sentence that is not counted as prose in the first count.
LATIN = 0.6, 0.4
#: Letters of a gram around a mark, how far they go, and the greatest weight of one.
N_AROUND, AROUND, AROUND_CLIP = 4, 16, 3.0
#: Classes of residue told by their letters; marks are told by their shape.
KINDS = ("lorem", "filler", "notice")

# Own text

_TAG = re.compile(r"\[/?(?:quote|code)\b[^\]\n]*\]|</?(?:blockquote|pre)\b[^>\n]*>|```", re.I)
_MARKUP = re.compile(r"\[/?(?:b|i|u|s|img|url|size|color|font|list|quote|code)(?:=[^\]\n]*)?\]|</?(?:a|b|i|u|p|br|hr|h[1-6]|div|span|center|html|head|body|title|ul|li|em|strong|noscript|script|style|img|font|table|tr|td)\b[^>\n]*>", re.I)
_HIDDEN = re.compile("[​‌‍⁠﻿­\r]")
_SPACE = re.compile("[ \t ]+")
_BRACKET = re.compile(r"\[/?[^\W\d_]{1,5}[^\]\n]{0,60}\]")
_QUOTED_LINE = re.compile(r"^ *>.*$", re.M)
_INLINE = re.compile(r"`[^`\n]*`")


def _plain_tag(m: re.Match) -> str:
    """Tags whose letters have got accents by broken encoding."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", m[0]) if not unicodedata.combining(c))
    return plain if _TAG.fullmatch(plain) else m[0]


def own_text(text: str) -> str:
    """What the author wrote: without lines that start with >, quotes, code and markup. Quotes may be
    nested; what is opened and never closed goes on to the end; a closing tag alone is markup."""
    text = _HIDDEN.sub("", text)
    if ">" in text:
        text = _QUOTED_LINE.sub("\n", text)
    if "[" in text:
        text = _BRACKET.sub(_plain_tag, text)
    if "[" in text or "<" in text or "`" in text:
        out, depth, code, at = [], 0, "", 0
        for m in _TAG.finditer(text):
            tag = m[0].lower()
            kind = "```" if tag == "```" else re.sub(r"[^a-z].*", "", tag.lstrip("[</"))
            if code:
                if kind == code and (tag == "```" or tag[1] == "/"):
                    code, at = "", m.end()
                continue
            if not depth:
                out.append(text[at : m.start()])
            if kind in ("quote", "blockquote"):
                depth = max(0, depth - 1) if tag[1] == "/" else depth + 1
            elif kind == "```" or tag[1] != "/":
                code = kind
            out.append("\n")
            at = m.end()
        if not depth and not code:
            out.append(text[at:])
        text = _MARKUP.sub("\n", _INLINE.sub(" ", "".join(out)))
    if "&" in text:
        text = html.unescape(text)
    return _SPACE.sub(" ", text)


# Streams of letters


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code its plain letter (lower case, without accents, digits as 0) and its class in a shape: a, A, 0, c for
    letters without case, itself for others."""
    plain, kind = np.arange(0x110000, dtype=np.uint32), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x3000):
        c = chr(i)
        low = unicodedata.normalize("NFKD", c.lower())[:1] or c
        plain[i] = ord("0") if c.isdigit() else ord(low)
        kind[i] = ord("0") if c.isdigit() else ord("A") if c.isupper() else ord("a") if c.islower() else ord("c") if c.isalpha() else i
    for a, b in (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-")):
        plain[ord(a)] = ord(b)
    for first, last in ((0x3041, 0x3100), (0x3400, 0xA000), (0xAC00, 0xD7A4)):
        kind[first:last] = ord("c")
    return plain, kind


_PLAIN, _KIND = _tables()
_A, _LOW, _C, _NEWLINE, _UNDER, _BLANK = (ord(x) for x in "Aac\n_ ")


def shapes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shape of a text: its words as their case (Aa, A, a; c in scripts without), words of one case in a row as one, parts joined by
    underscores as two at most, numbers as 0, everything else as it is; and the place in the text that each letter of the shape comes from."""
    k = _KIND[codes]
    keep = np.ones(len(k), bool)
    keep[1:] = (k[1:] != k[:-1]) | ~((k[1:] == _A) | (k[1:] == _LOW) | (k[1:] == _C) | (k[1:] == ord("0")))
    at = np.flatnonzero(keep)
    k = k[at]
    # "a a a" is "a", "a_a_a" is "a_a".
    word = (k == _LOW) | (k == _A) | (k == _C)
    again = np.zeros(len(k), bool)
    again[2:] = (k[2:] == k[:-2]) & (k[1:-1] == _BLANK) & word[2:]
    again[4:] |= (k[4:] == k[2:-2]) & (k[2:-2] == k[:-4]) & (k[3:-1] == _UNDER) & (k[1:-3] == _UNDER) & word[4:]
    again[:-1] |= again[1:]
    return k[~again], at[~again]


def _hashes(codes: np.ndarray) -> dict[int, np.ndarray]:
    """A 64-bit number for the n letters that end at each place, for each length of a gram."""
    out, h = {}, np.zeros(len(codes), np.uint64)
    padded = np.concatenate([np.full(LONG, _NEWLINE, np.uint64), codes.astype(np.uint64)])
    for n in range(1, LONG + 1):
        # From the last letter back: the number of n letters is made of that of n - 1.
        h = (h ^ padded[LONG + 1 - n : LONG + 1 - n + len(codes)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in LENGTHS:
            out[n] = h
    return out


_SLOTS = 22


class Grams:
    """A fixed set of grams: place of each, found by one look into a table."""

    def __init__(self, h: np.ndarray):
        self.hash = np.unique(h)
        self.slot = np.full(1 << _SLOTS, -1, np.int32)
        self.slot[self._at(self.hash)] = np.arange(len(self.hash))

    @staticmethod
    def _at(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Place of each gram, -1 for others."""
        at = self.slot[self._at(h)]
        return np.where(self.hash[at] == h, at, -1)


def _counted(grams: Grams, h: np.ndarray) -> np.ndarray:
    at = grams.places(h)
    return np.bincount(at[at >= 0], minlength=len(grams.hash)).astype(float)


_AFTER = ("\n", " a", " Aa a", ", a", ". Aa a", ".\n", ",\n", "!\n", " c")
_BEFORE = ("\n", "a ", "Aa: ", "Aa ", "Aa a ", "c ", "a: ")


def _spell(mark: str, name: str) -> str:
    upper = re.sub("[ .]", "_" if "_" in mark or "%" in mark or "|" in mark else " ", name).upper()
    title = " ".join(w[:1].upper() + w[1:] for w in re.split("[ _.]", name))
    return re.sub("NAME|Name|name", lambda m: {"NAME": upper, "Name": title, "name": name}[m[0]], mark)


def _shape_text(text: str) -> str:
    return "".join(map(chr, shapes(_codes(text))[0]))


def _lorem() -> list[str]:
    """Sentences of filler words, each word before and after several others."""
    w = seeds.LOREM
    return [" ".join(w[(i * k + 7 * j) % len(w)] for j in range(12)).capitalize() + "." for k in range(1, 12) for i in range(0, len(w), 3)] + [" ".join(w) + "."] * 3


def _shuffled(lines: list[str]) -> list[str]:
    """The words of some lines in other orders."""
    w = [x.strip(".").lower() for t in lines for x in t.split()]
    return [" ".join(w[(i * k) % len(w)] for i in range(j, j + 10)).capitalize() + "." for k in (7, 31, 101) for j in range(0, len(w), 10)]


@lru_cache(1)
def _training() -> dict[str, str]:
    """Text of each class, a line for each example."""
    spelled = list(dict.fromkeys(_spell(m, f) for m in seeds.marks() for f in seeds.FIELDS))
    unclear = ["(your name)", "[your name]", "[Enter name]", "[名前]", "(insert 名前)"]  # these look like deletion notes
    marked = sorted(set(_shape_text("\n".join(spelled)).split("\n")) - {_shape_text(x) for x in unclear} - {"c", "a", "A", "Aa"})
    line = lambda x: "\n".join(x) + "\n"
    return {
        "lorem": line(_lorem() + seeds.LATIN * 2 + _shuffled(seeds.LATIN)),
        "filler": line(_lorem() + seeds.expanded(seeds.FILLER, 3) + seeds.expanded(seeds.UNFILLED, 3)),
        "notice": line(seeds.expanded(seeds.NOTICES, 3) + seeds.status_lines()),
        "mark": "\n" + "".join(b + m + a for m in marked for k, a in enumerate(_AFTER) for b in (_BEFORE[k % len(_BEFORE)], "\n")),
        "prose": line(seeds.expanded(seeds.PROSE, 2)),
    }


class Stream:
    """The grams of some classes in one stream (letters or shapes), their counts in the examples, and from counts in prose the weights."""

    def __init__(self, classes: dict[str, np.ndarray], prose: np.ndarray):
        hashed = {c: _hashes(x) for c, x in classes.items()}
        self.grams = {n: Grams(np.concatenate([h[n] for h in hashed.values()])) for n in LENGTHS}
        self.own = {c: {n: _counted(g, h[n]) for n, g in self.grams.items()} for c, h in hashed.items()}
        self.size = {c: len(x) for c, x in classes.items()}
        written = _hashes(prose)
        self.written, self.written_size = {n: _counted(g, written[n]) for n, g in self.grams.items()}, len(prose)

    def count(self, codes: np.ndarray) -> list[np.ndarray]:
        """How often each gram of the classes occurs, by length; and the number of letters."""
        h = _hashes(codes)
        return [*(_counted(g, h[n]) for n, g in self.grams.items()), np.array([len(codes)], float)]

    def weights(self, counts: list[np.ndarray]) -> dict[str, dict[int, np.ndarray]]:
        """Of each class and gram the logarithm of its share in the class to that in prose: TALK of it are the written
        examples of people who write about such things, the rest is the corpus with PRIOR letters more and half an occurrence of every gram. A gram that the class has not seen backs off to the shorter one, at the price of BACK_OFF."""
        total = counts[-1][0] + PRIOR
        out = {}
        for c, own in self.own.items():
            w = {}
            for n, m in zip(self.grams, counts, strict=False):
                prose = (1 - TALK) * (m + 0.5) / total + TALK * self.written[n] / self.written_size
                seen = own[n] > 0
                x = np.where(seen, np.clip(np.log(np.where(seen, own[n], 1) / self.size[c] / prose), *CLIP), np.nan)
                w[n] = np.append(x, np.nan).astype(np.float32)
            out[c] = w
        return out

    def score(self, codes: np.ndarray, weights: dict[str, dict[int, np.ndarray]]) -> dict[str, np.ndarray]:
        """The weight of every letter for each class: that of the longest gram ending there that the class has seen."""
        h = _hashes(codes)
        out = {c: np.full(len(codes), np.nan, np.float32) for c in weights}
        rest = None
        for step, (n, g) in enumerate(reversed(self.grams.items())):
            at = g.places(h[n] if rest is None else h[n][rest])
            left = np.zeros(len(at), bool)
            for c, x in out.items():
                if rest is None:
                    x[:] = weights[c][n][at]
                    left |= np.isnan(x)
                else:
                    old = x[rest]
                    x[rest] = np.where(np.isnan(old), np.minimum(weights[c][n][at], SHORT_CLIP) + BACK_OFF * step, old)
                    left |= np.isnan(x[rest])
            rest = np.flatnonzero(left) if rest is None else rest[left]
        for x in out.values():
            np.nan_to_num(x, copy=False, nan=LOWEST)
        return out


class Vocabulary:
    """The streams of letters and of shapes; the same for every corpus."""

    def __init__(self) -> None:
        t = _training()
        raw = {c: _PLAIN[_codes(t[c])] for c in KINDS}
        self.letters = Stream(raw, _PLAIN[_codes(t["prose"])])
        self.shapes = Stream({"mark": _codes(t["mark"])}, shapes(_codes(t["prose"]))[0])

    def streams(self) -> tuple[Stream, Stream]:
        return self.letters, self.shapes


@lru_cache(1)
def vocabulary() -> Vocabulary:
    return Vocabulary()


class Model:
    """Weights of both streams."""

    def __init__(self, counts: list[list[np.ndarray]] | None = None):
        v = vocabulary()
        counts = counts or [s.count(np.zeros(0, np.uint32)) for s in v.streams()]
        self.letters, self.shapes = (s.weights(c) for s, c in zip(v.streams(), counts, strict=True))


# Prose


def _joined(texts: list[str]) -> np.ndarray:
    return _codes("\n\n".join(["", *texts, ""]))


_SENTENCES = re.compile(r"[^\n]+?(?:[.!?…]+(?= )|[。！？]|$)", re.M)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 1000):
            found: dict[str, None] = {}
            for x in b["text"].slice(k, 1000).to_pylist():
                found.update(dict.fromkeys(s.strip() for s in _SENTENCES.findall(own_text(x))))
            found.pop("", None)
            yield pa.RecordBatch.from_pydict({"sentence": pa.array(list(found), pa.string())})


def _packed(counts: list[list[np.ndarray]]) -> bytes:
    return zlib.compress(np.concatenate([x for c in counts for x in c]).astype(np.int64).tobytes(), 1)


def _unpacked(flat: np.ndarray) -> list[list[np.ndarray]]:
    out, at = [], 0
    for s in vocabulary().streams():
        sizes = [*(len(g.hash) for g in s.grams.values()), 1]
        own = []
        for n in sizes:
            own.append(flat[at : at + n].astype(float))
            at += n
        out.append(own)
    return out


def _count(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    """Counts of the vocabulary's grams in the sentences of a partition; with a model, in those without residue by it."""
    from pyspark import TaskContext

    v, total = vocabulary(), None
    for b in batches:
        for k in range(0, b.num_rows, 4000):
            texts = b["sentence"].slice(k, 4000).to_pylist()
            texts = [s for s, keep in zip(texts, natural(texts, model) if model else ~latin_like(texts), strict=True) if keep]
            if texts:
                codes = _joined(texts)
                own = [v.letters.count(_PLAIN[codes]), v.shapes.count(shapes(codes)[0])]
                total = own if total is None else [[x + y for x, y in zip(a, c, strict=True)] for a, c in zip(total, own, strict=True)]
    if total is not None:
        yield pa.RecordBatch.from_pydict({"node": pa.array([TaskContext.get().partitionId()], pa.int32()), "counts": pa.array([_packed(total)], pa.binary())})


@lru_cache(1)
def _seed_model() -> Model:
    return Model()


def latin_like(sentences: list[str]) -> np.ndarray:
    """Whether the written examples alone, without any corpus, take each sentence for filler in a language like that of the printers' words. Such
    filler has a small vocabulary, so that its grams would soon be prose if they were counted."""
    codes, out = _joined(sentences), []
    x = vocabulary().letters.score(_PLAIN[codes], {"lorem": _seed_model().letters["lorem"]})["lorem"]
    start = 2
    # The weights above zero are at least the sum of all windows: most sentences have too little.
    bound = np.add.reduceat(np.maximum(x, 0), np.cumsum([2, *[len(t) + 2 for t in sentences]])[:-1], dtype=np.float64) if sentences else []
    for t, most in zip(sentences, bound, strict=True):
        if most + 1e-3 < LATIN[1] * len(t):
            out.append(False)
            start += len(t) + 2
            continue
        parts = _parts(x[start : start + len(t)])
        out.append(_letters_of(parts) >= LATIN[0] * len(t) and sum(p[2] for p in parts) >= LATIN[1] * len(t))
        start += len(t) + 2
    return np.array(out, bool)


def natural(sentences: list[str], model: Model) -> np.ndarray:
    """Whether each sentence has no residue and no mark, not even one that someone writes about."""
    return np.array([not f for f in windows(sentences, model, MARK_DOUBT, -np.inf)], bool)


#: Counts merged by one task of the tree.
FAN_IN = 64


def _sum(key: tuple, t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.int64) for x in t["counts"])
    return pa.table({"node": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _fitted(sentences: DataFrame, model: Model | None) -> Model:
    """The model from counts in sentences, merged in a tree; only one row of fixed size comes to the driver."""
    sent = sentences.sparkSession.sparkContext.broadcast(model)
    out = sentences.mapInArrow(lambda it: _count(it, sent.value), "node int, counts binary")
    nodes = sentences.rdd.getNumPartitions()
    while True:
        nodes = -(-nodes // FAN_IN)
        out = out.groupBy(F.floor(F.col("node") / FAN_IN).cast("int").alias("up")).applyInArrow(_sum, "node int, counts binary")
        if nodes <= 1:
            break
    rows = [np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in out.collect()]
    return Model(_unpacked(sum(rows)) if rows else None)


def fit(documents: DataFrame, posts: int | None = None) -> Model:
    """The models. Residue comes from the written examples. Prose comes from the own texts of all posts; each different sentence
    counts once, but for those that look like printers' filler by the examples alone, and in a second count for those that the first model finds residue
    in: being frequent makes nothing prose. Only the counts of the vocabulary's grams are kept, so what is merged, and what comes to the driver, has a fixed size.
    No query asks for fewer: with `posts` a caller takes at most about so many, chosen by the hash of the text, so that copies are in or not alike."""
    texts = documents.select(F.col("text").cast("string").alias("text")).where("text != ''")
    if posts is not None and (n := texts.count()) > posts:
        texts = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * posts / n))
    sentences = written(spread(texts).mapInArrow(_split, "sentence string").distinct(), "sentences")
    return _fitted(sentences, _fitted(sentences, None))


# Windows

_QUOTED = re.compile("\"[^\"]+\"|“[^“”]+”|„[^„“”]+[“”]|«[^«»]+»|»[^«»]+«|「[^「」]+」|『[^『』]+』|‘[^‘’]+’|(?<!\\w)'[^']+'(?!\\w)")
#: A word of telling, and up to three short ones between it and a window, which may begin within a word.
_TOLD = re.compile(r"(?:^|\W)(?:" + "|".join(seeds.TELLING) + r")(?:\W+\w{1,5}){0,3}\W*\w{0,8}$", re.I)
_CAPITAL = re.compile(r"(?<!\w)[A-ZÀ-ÞА-Я0-9]")
_WORDS_BEFORE, _WORDS_AFTER = re.compile(r"(?:\s*[^\W_]*[.,:;!?]*(?=\s))*\s*"), re.compile(r"(?:\s+[^\W_]*[.,:;!?]*)*[.,:;!?\s]*$")
#: What makes a mark of a name: neither letters and digits nor the usual signs of sentences (but question marks, that some double).
_SIGN = ~np.isin(np.arange(0x110000), [ord(c) for c in "Aa0c \n.,:;!…'\"-–—。、！"])
_ENDS = np.isin(np.arange(0x110000), [ord(c) for c in ".!?…"])
_FULL = np.isin(np.arange(0x110000), [ord(c) for c in "。！？"])


def _bounds(codes: np.ndarray) -> np.ndarray:
    """First place of each sentence: after a line's end, after a full stop and a blank."""
    new = np.zeros(len(codes), bool)
    new[0] = True
    line = codes == _NEWLINE
    new[1:] |= line[:-1] != line[1:]
    new[1:] |= _FULL[codes[:-1]]
    new[2:] |= _ENDS[codes[:-2]] & (codes[1:-1] == _BLANK)
    return np.flatnonzero(new)


def _best(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each stretch the greatest sum of a window, and that window's end."""
    c = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
    last = np.append(first[1:], len(x))
    owner = np.repeat(np.arange(len(first)), last - first)
    # Lower for every next stretch: the running minimum begins anew there.
    far = (c.max() - c.min() + 1.0) * owner
    gain = c[1:] - np.minimum.accumulate(c[:-1] - far) - far
    top = np.maximum.reduceat(gain, first)
    hit = np.flatnonzero(gain >= top[owner] - 1e-6)
    end = np.zeros(len(first), np.int64)
    end[owner[hit][::-1]] = hit[::-1] + 1
    return top, end


def _is_told(body: str, start: int, end: int, n: int) -> tuple[bool, bool]:
    """Whether the author of a sentence quotes this window of it, as less than all of the sentence; and whether words before it tell about it."""
    quoted = any(m.start() <= start + LONG and end - LONG <= m.end() and len(m[0]) < 0.9 * n for m in _QUOTED.finditer(body))
    return quoted, _TOLD.search(body[max(0, start - 60) : start]) is not None


def _around(left: str, right: str) -> list[str]:
    """Grams of the letters around a mark, which is one letter there, as the sentence's start and end are; without case and accents."""
    fold = lambda t: "".join(map(chr, _PLAIN[_codes(t)]))
    t = "\2" + fold(left) if len(left) < AROUND else fold(left[-AROUND:])
    t += "\1" + (fold(right) + "\3" if len(right) < AROUND else fold(right[:AROUND]))
    grams = [t[k : k + N_AROUND] for k in range(len(t) - N_AROUND + 1)]
    if not left.strip():
        # What begins a sentence has a sentence, a small letter or something else after it.
        after = right.lstrip()[:1]
        grams.append("\2" + ("A" if after.isupper() else "a" if after.islower() else "."))
    return list(dict.fromkeys(grams))


@lru_cache(1)
def _around_weights() -> dict[str, float]:
    """Logarithm of each gram's share around fields of forms to that around marks that someone writes about."""
    counts = []
    for texts in (seeds.FILLED, seeds.NAMED):
        c: dict[str, int] = {}
        for t in seeds.expanded(texts, 3):
            for m in re.finditer("@", t):
                for g in _around(t[: m.start()].replace("@", "\1"), t[m.end() :].replace("@", "\1")):
                    c[g] = c.get(g, 0) + 1
        counts.append(c)
    known = counts[0].keys() | counts[1].keys()
    total = [sum(c.values()) + len(known) / 2 for c in counts]
    most = AROUND_CLIP
    return {g: float(np.clip(np.log((counts[0].get(g, 0) + 0.5) / total[0]) - np.log((counts[1].get(g, 0) + 0.5) / total[1]), -most, most)) * (5.0 if g.startswith("\2") and len(g) == 2 else 1.0) for g in known}


def form_sum(left: str, right: str) -> float:
    """Weight of the letters around a mark for a form that was not filled in, against talk about the mark."""
    w = _around_weights()
    return sum(w.get(g, 0.0) for g in _around(left, right))


def _parts(x: np.ndarray) -> list[tuple[int, int, float]]:
    """Disjoint windows of PART_SUM or more: first place, end and sum, from left to right; each is the best of what the ones before it left."""
    parts, found, c = [(0, len(x))], [], np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
    while parts:
        a, b = parts.pop()
        low = np.minimum.accumulate(c[a : b + 1])
        k = int((c[a : b + 1] - low).argmax())
        if c[a + k] - low[k] < PART_SUM:
            continue
        s = a + int(c[a : a + k + 1].argmin())
        found.append((s, a + k, float(c[a + k] - c[s])))
        parts += [(a, s), (a + k, b)]
    return sorted(found)


def _letters_of(found: list[tuple[int, int, float]]) -> int:
    """Letters of the windows, with what lies between two that are at most BRIDGE letters apart."""
    between = (a - b for (_, b, _), (a, _, _) in zip(found, found[1:], strict=False))
    return sum(b - a for a, b, _ in found) + sum(g for g in between if g <= BRIDGE)


def windows(texts: list[str], model: Model, mark_sum: float = MARK_SUM, least_form: float = FORM_SUM) -> list[list[tuple[int, int, str, float]]]:
    """Of each own text the windows of residue: first place, end, kind and the share of the sentence that it covers.

    Of every sentence and class the window with the greatest sum of weights is taken. It is residue if the sum reaches WINDOW_SUM and it
    covers COVERAGE of the sentence or more, or if the sum reaches WITHIN_SUM and the author does not quote it. A mark is a window on the shape of the
    sentence that reaches MARK_SUM; it is residue, and its whole sentence with it, if nothing else stands there or if the letters around it weigh FORM_SUM for a form."""
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    if not any(texts):
        return out
    v, codes = vocabulary(), _joined(texts)
    starts = np.cumsum([2, *[len(t) + 2 for t in texts]])[:-1]
    first = _bounds(codes)
    last = np.append(first[1:], len(codes))
    text_of = lambda place: int(np.searchsorted(starts, place, side="right")) - 1

    def sentence(k: int) -> tuple[int, int, int, str]:
        t = text_of(first[k])
        a, b = int(first[k] - starts[t]), min(len(texts[t]), int(last[k] - starts[t]))
        return t, a, b, texts[t][a:b]

    likely: dict[int, tuple[float, str]] = {}
    scores = v.letters.score(_PLAIN[codes], model.letters)
    for kind, x in scores.items():
        top, _ = _best(x, first)
        for k in np.flatnonzero(top >= WINDOW_SUM).tolist():
            likely[k] = max(likely.get(k, (0.0, "")), (float(top[k]), kind))
    for k, (_, kind) in likely.items():
        t, a, b, body = sentence(k)
        n = len(body.strip())
        if t < 0 or not n:
            continue
        parts = _parts(scores[kind][first[k] : first[k] + b - a])
        share = min(1.0, _letters_of(parts) / n)
        told = [_is_told(body, x, e, n) for x, e, _ in parts]
        if share >= COVERAGE and sum(total for *_, total in parts) >= MEAN * n and not told[max(range(len(parts)), key=lambda i: parts[i][2])][0]:
            out[t].append((a + parts[0][0], a + parts[-1][1], kind, share))
            continue
        for (x, e, total), (quoted, words) in zip(parts, told, strict=True):
            # Glued without a full stop: the window, or what follows it, begins with a capital letter.
            glued = (x <= LONG and body[e:].lstrip()[:1].isupper()) or (len(body.rstrip()) - e <= LONG and _CAPITAL.search(body[max(0, x - LONG) : x + 3]))
            if total >= (EDGE_SUM if glued else WITHIN_SUM)[kind] and not quoted and not words:
                out[t].append((a + x, a + e, kind, (e - x) / n))
                break
    shape, place = shapes(codes)
    x = v.shapes.score(shape, model.shapes)["mark"]
    inner = np.searchsorted(place, first)
    inner = inner[np.append(True, inner[1:] != inner[:-1])]
    inner = inner[inner < len(place)]
    top, end = _best(x, inner)
    signs = np.add.reduceat(_SIGN[shape].astype(np.int64), inner) if len(inner) else inner
    for k in np.flatnonzero((top >= mark_sum) & (signs > 0)).tolist():
        e = int(end[k])
        c = np.cumsum(x[inner[k] : e][::-1], dtype=np.float64)[::-1]
        s = int(place[int(inner[k]) + int(c.argmax())])
        e = int(place[e]) if e < len(place) else len(codes)
        t, a, b, body = sentence(int(np.searchsorted(first, s, side="right")) - 1)
        if t < 0:
            continue
        a0, b0 = max(a, s - int(starts[t])), min(b, e - int(starts[t]))
        if not texts[t][a0:b0].strip():
            continue
        # The window may hold words around the mark that often stand there.
        lead, trail = _WORDS_BEFORE.match(texts[t], a0, b0), _WORDS_AFTER.search(texts[t][a0:b0])
        a0, b0 = lead.end(), a0 + trail.start()
        if not any(x.isalpha() for x in texts[t][a0:b0]):  # a mark has a name
            continue
        left, right = texts[t][a:a0].lstrip(), texts[t][b0:b].rstrip()
        if not (left + right).strip(".,;:!? ") or (form_sum(left, right) >= least_form and not any(m.start() <= a0 - a and b0 - a <= m.end() for m in _QUOTED.finditer(body))):
            out[t].append((a, b, "placeholder", 1.0))
    return out


def residue(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, covered and n_own (letters of the windows and of the own text), coverage and kinds, of every post that has residue: the
    coverage is the greatest share of one of its sentences that a window covers, and a window counts from COVERAGE on (see windows). Null
    and empty texts, and posts without own text, are none. Every post is judged for itself, so copies are judged alike. No shuffle
    beyond those of fit."""
    model = model or fit(documents)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.string()))
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                texts = [own_text(x) for x in part["text"].to_pylist()]
                rows = [
                    (d, sum(x[1] - x[0] for x in w), len(t), max(x[3] for x in w), sorted({x[2] for x in w}))
                    for d, t, w in zip(part["doc_id"].to_pylist(), texts, windows(texts, sent.value), strict=True)
                    if w
                ]
                cols = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "covered", "n_own", "coverage", "kinds"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text != ''").mapInArrow(run, "doc_id long, covered int, n_own int, coverage double, kinds array<string>")
