"""Evaluation texts leaking into training text.

Edit distance is mapped to Hamming distance by a random walk over the characters (the CGK embedding), and the embedded
windows are hashed at sampled places, anew in each repetition. Windows are half a run of an item, less the edits: taken from
the corpus one after the other and from the items at every character, so that any run holds a whole window of the corpus. The number of
repetitions is set so that a window with `max_edits` random edits is hit with the wanted recall; equal windows have equal
embeddings, so runs without edits are always hit. Hits are verified by edit distance: of the window, then of a whole
run around it. Exact runs are told apart last.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawmill.llm.grams import code_points
from lawmill.session import spread

RUN = 40
#: Item characters of one broadcast block; an index takes some 16 bytes a character and repetition. Larger sets are searched in
#: blocks of this size. Characters of texts that are searched in one go.
ITEM_CHARS, TEXT_AT_ONCE = 1_000_000, 1_000_000
SAMPLES = 8
MAX_EDITS, RECALL = 2, 0.95
#: Hits that are verified in one go.
HITS_AT_ONCE = 200_000


@cache
def _compared() -> np.ndarray:
    """Which code points are letters or digits."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)


def compared_chars(text: str | None) -> np.ndarray:
    """Letters and digits of the text with width and case evened out (NFKC, lower case), as code points."""
    if not text:
        return np.empty(0, dtype=np.uint32)
    c = code_points(unicodedata.normalize("NFKC", text).lower())
    return c[_compared()[c]]


def walk_codes(windows: np.ndarray, seed: int, samples: int = SAMPLES) -> np.ndarray:
    """Hashes of sampled places of the embedded windows; one row of code points each.

    The walk has three steps a character: each step puts out the character it stands at and moves on or not, as a
    random function of step and character says; past the end it puts out 0. Only the sampled steps enter the hash.
    """
    m, n = windows.shape
    rng = np.random.default_rng(seed)
    steps = 3 * n
    mult = rng.integers(1, 2**63, steps, dtype=np.uint64) | np.uint64(1)
    taken = np.zeros(steps, dtype=bool)
    taken[rng.choice(steps, min(samples, steps), replace=False)] = True
    out = np.empty(m, dtype=np.uint64)
    for lo in range(0, m, 1 << 15):
        part = windows[lo : lo + (1 << 15)]
        rows = len(part)
        flat = np.zeros((rows, n + 1), dtype=np.uint64)
        flat[:, :n] = part
        flat = flat.ravel()
        base = np.arange(rows) * (n + 1)
        last, at, h = base + n, base.copy(), np.full(rows, seed + 1, dtype=np.uint64)
        for j in range(steps):
            c = flat[at]
            turned = (c + np.uint64(1)) * mult[j]
            if taken[j]:
                h = (h ^ turned) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            at += ((turned >> np.uint64(61)) & np.uint64(1)).astype(np.int64)
            np.minimum(at, last, out=at)
        out[lo : lo + rows] = h
    return out


@cache
def repetitions(window: int, max_edits: int, recall: float, trials: int = 2000) -> int:
    """How many repetitions find a window with max_edits random edits with the wanted probability, by simulation."""
    if max_edits == 0:
        return 1
    rng = np.random.default_rng(7)
    a = rng.integers(1, 3000, (trials, window + max_edits)).astype(np.uint32)
    b = a.copy()
    for row in b:
        for p in rng.integers(0, window, max_edits):
            kind = rng.integers(3)
            if kind == 0:
                row[p] = rng.integers(1, 3000)
            elif kind == 1:
                row[p:-1] = row[p + 1 :]
            else:
                row[p + 1 :] = row[p:-1]
    hit, s = np.zeros(trials, dtype=bool), 0
    while hit.mean() < recall:  # pairs differ in how easily they are hit, so each is followed through all repetitions
        hit |= walk_codes(a[:, :window], s) == walk_codes(b[:, :window], s)
        s += 1
    return s


def common_run(a: np.ndarray, i: int, b: np.ndarray, j: int) -> tuple[int, int, int]:
    """The longest run of equal characters through a[i] = b[j]: its start in a, in b, and its length (0 if unequal)."""
    back, fore = min(i, j), min(len(a) - i, len(b) - j)
    left = a[i - back : i][::-1] != b[j - back : j][::-1]
    right = a[i : i + fore] != b[j : j + fore]
    x = int(left.argmax()) if left.any() else back
    y = int(right.argmax()) if right.any() else fore
    return (i - x, j - x, x + y) if y else (i, j, 0)


def least_edits(needle: np.ndarray, hay: np.ndarray) -> int:
    """The smallest edit distance of needle to any stretch of hay."""
    row = np.zeros(len(hay) + 1, dtype=np.int64)
    ramp = np.arange(len(hay) + 1)
    for i, c in enumerate(needle):
        nxt = np.minimum(row + 1, np.concatenate([[i + 1], row[:-1] + (hay != c)]))
        row = np.minimum.accumulate(nxt - ramp) + ramp
    return int(row.min())


def banded_reach(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of code points a (0 past the end of an item) and b (0 past the end of a text, `most` characters longer): how
    far into a one gets with 0, 1 .. `most` edits (rows by most + 1), and the edit distance of all of a to the best prefix
    of b, where larger than most reads most + 1."""
    rows, n = a.shape
    width, far = 2 * most + 1, most + 1
    reach = np.zeros((rows, most + 1), dtype=np.int64)
    d = np.full((width + 2, rows), far, dtype=np.int64)  # d[k + 1]: a prefix of b longer by k - most; a border on both sides
    for k in range(most, width):
        d[k + 1] = k - most
    for i in range(n):
        alive = a[:, i] != 0
        new = np.full_like(d, far)
        for k in range(width):
            j = i + k - most
            step = d[k + 2] + 1  # a character of a that b lacks
            if 0 <= j < b.shape[1]:
                step = np.minimum(step, d[k + 1] + ((a[:, i] != b[:, j]) | (b[:, j] == 0)))
            if j >= 0:
                step = np.minimum(step, new[k] + 1)
            new[k + 1] = np.minimum(step, far)
        new[:, ~alive] = far
        d = new
        low = d[1:-1].min(axis=0)
        for e in range(most + 1):
            reach[low <= e, e] = i + 1
    return reach, d[1:-1].min(axis=0)


def _around(chars: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n characters from each place on; places outside are 0."""
    i = at[:, None] + np.arange(n)
    return np.where((i >= 0) & (i < len(chars)), chars[np.clip(i, 0, max(0, len(chars) - 1))], 0) if len(chars) else np.zeros(i.shape, np.uint32)


class _Index:
    """Windows of the items at every character, each distinct window hashed once per repetition and sorted."""

    def __init__(self, ids: list, texts: list[str | None], run: int, window: int, repeats: int) -> None:
        self.ids, self.run, self.window = ids, run, window
        self.chars = [compared_chars(t) for t in texts]
        # items one after the other, parted by as many zeros as are ever looked at beyond an end
        self.pad = 2 * run
        self.begins = np.cumsum([self.pad, *(len(c) + self.pad for c in self.chars[:-1])]) if self.chars else np.empty(0, np.int64)
        self.flat = np.zeros(self.pad + sum(len(c) + self.pad for c in self.chars), dtype=np.uint32)
        for c, lo in zip(self.chars, self.begins, strict=True):
            self.flat[lo : lo + len(c)] = c
        places = [lo + np.arange(len(c) - window + 1) for c, lo in zip(self.chars, self.begins, strict=True) if len(c) >= run]
        place = np.concatenate(places) if places else np.empty(0, np.int64)
        windows = _around(self.flat, place, window)
        kinds, which = np.unique(windows, axis=0, return_inverse=True) if len(place) else (np.zeros((0, window), np.uint32), np.empty(0, np.int64))
        order = np.argsort(which, kind="stable")
        self.place, self.kind_at = place[order], np.searchsorted(which[order], np.arange(len(kinds) + 1))
        self.kinds, self.tables = kinds, []
        for s in range(repeats):
            codes = walk_codes(kinds, s)
            order = np.argsort(codes, kind="stable")
            self.tables.append((codes[order], order))

    def hits(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, kind of item window) that agree in the sampled places of some repetition, each once."""
        pairs = [np.empty(0, np.int64)]
        for s, (codes, kinds) in enumerate(self.tables):
            got = walk_codes(windows, s)
            lo, hi = np.searchsorted(codes, got), np.searchsorted(codes, got, "right")
            n = hi - lo
            w = np.repeat(np.arange(len(got)), n)
            k = kinds[np.repeat(lo, n) + np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)]
            pairs.append(w * max(1, len(self.kinds)) + k)
        both = np.unique(np.concatenate(pairs))
        return both // max(1, len(self.kinds)), both % max(1, len(self.kinds))

    def search(self, texts: list[str | None], max_edits: int) -> list[tuple[int, int, int, int]]:
        """(text number, item number, length of the longest exact run found, least edits of a run of `run` characters)."""
        chars = [compared_chars(t) for t in texts]
        n, run = self.window, self.run
        counts = np.array([len(c) // n for c in chars], dtype=np.int64)
        if not counts.sum() or not len(self.kinds):
            return []
        starts = np.cumsum([self.pad, *(len(c) + self.pad for c in chars[:-1])])
        flat = np.zeros(self.pad + sum(len(c) + self.pad for c in chars), dtype=np.uint32)
        for c, lo in zip(chars, starts, strict=True):
            flat[lo : lo + len(c)] = c
        owner = np.repeat(np.arange(len(chars)), counts)
        place = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * n
        windows = _around(flat, place, n)
        w, k = self.hits(windows)
        dist = np.concatenate([np.empty(0, np.int64), *(banded_reach(self.kinds[k[i : i + HITS_AT_ONCE]], _around(flat, place[w[i : i + HITS_AT_ONCE]], n + max_edits), max_edits)[1] for i in range(0, len(w), HITS_AT_ONCE))])
        w, k = w[dist <= max_edits], k[dist <= max_edits]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        size = self.kind_at[k + 1] - self.kind_at[k]
        cut = np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + HITS_AT_ONCE, HITS_AT_ONCE))  # a window of many items is verified part by part
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            part = np.arange(lo, hi)
            if not len(part):
                continue
            h = np.repeat(part, size[part])
            at = self.place[self.kind_at[k[h]] + np.arange(len(h)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])]
            self._verify(chars, starts, flat, place[w[h]], at, owner[w[h]], max_edits, best)
        return [(t, i, r, e) for (t, i), (r, e) in best.items()]

    def _verify(self, chars: list[np.ndarray], starts: np.ndarray, flat: np.ndarray, p: np.ndarray, q: np.ndarray, owner: np.ndarray, most: int, best: dict) -> None:
        """Runs through the places p of the texts and q of the items: so far to the right of it and so far to the left."""
        run = self.run
        item = np.searchsorted(self.begins, q, "right") - 1
        right, _ = banded_reach(_around(self.flat, q, run), _around(flat, p, run + most), most)
        left, _ = banded_reach(_around(self.flat, q - run, run)[:, ::-1], _around(flat, p - run - most, run + most)[:, ::-1], most)
        edits = np.full(len(p), most + 1)
        for e in range(most, -1, -1):
            for x in range(e + 1):
                edits[left[:, x] + right[:, e - x] >= run] = e
        seen: dict[tuple[int, int, int], int] = {}  # where the last exact run on a diagonal ended; another may follow
        for j in np.lexsort((p, item, owner)):
            if edits[j] > most:
                continue
            t, i = int(owner[j]), int(item[j])
            length, least = best.get((t, i), (0, most + 1))
            if not edits[j] and p[j] >= seen.get((t, i, int(p[j] - q[j])), 0):
                _, begin, got = common_run(self.chars[i], int(q[j] - self.begins[i]), chars[t], int(p[j] - starts[t]))
                seen[t, i, int(p[j] - q[j])] = int(starts[t]) + begin + got
                length = max(length, got)
            best[t, i] = length, min(least, int(edits[j]))


_INDEXES: dict[int, _Index] = {}


def _index(shared, run: int, window: int, repeats: int) -> _Index:
    """The index of a broadcast block of items, built once in each worker."""
    if shared.value[0] not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[shared.value[0]] = _Index(shared.value[1], shared.value[2], run, window, repeats)
    return _INDEXES[shared.value[0]]


def leaked_items(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, parts: list[str], run: int = RUN, max_edits: int = MAX_EDITS, recall: float = RECALL) -> DataFrame:
    """One row per item and document that share a run of `run` compared characters of one of the item's parts but for at most `max_edits`
    edits: item_id, doc_id, run (the longest exact run found if at least `run`, else 0), edits (the fewest of a run).

    Exact runs are all found; runs with edits with the wanted recall. Compared characters are letters and digits after NFKC
    and lower case; all else is skipped on both sides. Defined cases: null, empty and shorter texts match nothing;
    repeated rows of an id count as one; null ids are ignored; texts are searched whole. Items are broadcast in blocks of at
    most ITEM_CHARS characters and indexed in the workers; there are as many passes over the documents as blocks.
    """
    window = (run - max_edits) // 2  # a run that lost max_edits characters still holds a whole window of the corpus
    repeats = repetitions(window, max_edits, recall)
    flat = items.select(F.col(item).alias("item"), F.explode(F.array(*[F.col(p) for p in parts])).alias("text")).filter("item is not null and text is not null").distinct()
    total = flat.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // ITEM_CHARS))
    schema = "item_id long, doc_id long, run int, edits int"
    source = spread(docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).filter("doc is not null and text is not null"))

    def searcher(shared):
        def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                index = _index(shared, run, window, repeats)
                ids, found = b.column("doc").to_pylist(), []
                texts = b.column("text").to_pylist()
                sizes = np.cumsum([len(t) for t in texts])
                for lo, hi in parts_of(sizes, TEXT_AT_ONCE):
                    found += [(index.ids[i], ids[lo + t], r, e) for t, i, r, e in index.search(texts[lo:hi], max_edits)]
                cols = list(zip(*found, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["item_id", "doc_id", "run", "edits"])

        return run_batches

    out = None
    for k in range(blocks):
        block: pd.DataFrame = flat.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).toPandas()
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().int, [int(x) for x in block["item"]], list(block["text"])))
        part = source.mapInArrow(searcher(shared), schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("item_id", "doc_id").agg(F.max(F.when(F.col("run") >= run, F.col("run")).otherwise(0)).alias("run"), F.min("edits").alias("edits"))


def parts_of(ends: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ranges of neighbouring texts of about `size` characters in all, from the running sum of their lengths."""
    if not len(ends):
        return []
    cut = np.unique(np.append(np.searchsorted(ends, np.arange(size, ends[-1], size)) + 1, len(ends)))
    return [(int(a), int(b)) for a, b in zip([0, *cut[:-1]], cut, strict=True)]
