"""Grouping of spelling variants by a trie of letter-group counts.

Words are counted over all texts in numpy. The vocabulary is then arranged as
a trie: the first levels are a word's length and its numbers of the letters of
three groups, the further levels its numbers of the other groups. One edit
adds at most one letter (a surplus) and takes away at most one (a deficit), so
a search follows at each level the branch of its own count, or that of one
more or one less while it has that budget. Each subtree of the first levels is
a task's work, large ones in parts; a word's search goes to the few subtrees
that the budget allows. What meets at a leaf is compared letter by letter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import LOWER, drop_dir, lut, small, spans_of, text_slices, work_dir, written
from brindle.llm.packed_terms import PackedTerms

#: Words have at least so many letters and occurrences.
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: One distinct run of letters of a document in so many loses a letter.
LOSS = 97
#: A word's form has at least so many times its occurrences.
FORM_RATIO = 2
#: Occurrences that a task holds before it counts them.
FLUSH_WORDS = 3_000_000
#: Runs of up to this many bytes get their checksum in numpy.
SHORT = 48
#: Bytes of words of a subtree that one task holds.
PART_BYTES = 1 << 20
#: Search states that are followed at once, and bytes of letters compared at once.
BLOCK, COMPARED = 1 << 16, 4 << 20

#: Groups of letters; those of the trie's first levels come first, all others are one group at the end.
GROUPS = ["en", "ai", "rt", "s", "o", "l", "u", "d", "c", "h", "m", "g", "p", "b", "f", "k", "v", "w", "z", "y", "qxj", "é", "áàâä", "íìîïóòôö", "úùûüßñç"]
FIRST_LEVELS = 3
#: Letter group by code point (all letters are below 256).
GROUP = np.full(256, len(GROUPS), np.int64)
for _i, _letters in enumerate(GROUPS):
    GROUP[[ord(c) for c in _letters]] = _i

ASCII_LETTER = lut((0x41, 0x5A), (0x61, 0x7A))
LEAD = 0xC3  # the first of the two bytes of U+00C0 to U+00FF
TAIL_BYTE = lut((0x80, 0xBF))
KEYS = ["size", *(f"c{i}" for i in range(FIRST_LEVELS))]


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The crc32 of each span, going on from the crc32 ``before`` of what precedes it."""
    size = ends - starts
    order = np.argsort(np.minimum(size, SHORT + 1), kind="stable")[::-1]
    sized, first = size[order], starts[order]
    state = ~before[order].astype(np.uint32)
    long = int((sized > SHORT).sum())
    for j in range(int(sized[long]) if long < len(sized) else 0):
        n = int(np.searchsorted(-sized[long:], -j, "left"))  # spans of over j bytes
        at = slice(long, long + n)
        state[at] = CRC[(state[at] ^ data[first[at] + j]) & np.uint32(0xFF)] ^ (state[at] >> np.uint32(8))
    state = ~state
    for k in range(long):
        state[k] = zlib.crc32(data[first[k] : first[k] + sized[k]].tobytes(), int(before[order[k]]))
    out = np.empty(len(size), np.uint32)
    out[order] = state
    return out


def runs_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, letters) of every run of letters of at least LEAST_LETTERS."""
    lead = data == LEAD
    inside = ASCII_LETTER[data] | lead
    inside[1:] |= lead[:-1]
    starts, ends, row = spans_of(inside, offsets)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~TAIL_BYTE[data], out=points[1:])
    letters = points[ends] - points[starts]
    keep = letters >= LEAST_LETTERS
    return starts[keep], ends[keep], row[keep], letters[keep]


def word_counts(docs: DataFrame, flush: int = FLUSH_WORDS) -> DataFrame:
    """(word, n) of words of at least LEAST_LETTERS letters, partly summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            for word, _, n, _ in words.runs():
                yield pa.RecordBatch.from_arrays([word, pa.array(n)], names=["word", "n"])

        words = PackedTerms()
        for batch in batches:
            ids = [b"" if i is None else str(i).encode() for i in batch.column(0).to_pylist()]
            for a, b, data, offsets in text_slices(batch):
                data = LOWER[data]
                starts, ends, row, letters = runs_of(data, offsets)
                before = np.array([zlib.crc32(i + b":") for i in ids[a:b]], np.uint32)
                h = checksums(data, starts, ends, before[row])
                lose = h % LOSS == 0
                words.add(data, starts[~lose], ends[~lose], row[~lose])
                lost = []
                for k in np.flatnonzero(lose & (letters > LEAST_LETTERS)).tolist():
                    run_of = data[starts[k] : ends[k]].tobytes().decode()
                    at = int(h[k]) % len(run_of)
                    lost.append((run_of[:at] + run_of[at + 1 :]).encode())
                edge = np.cumsum([0, *map(len, lost)])
                words.add(np.frombuffer(b"".join(lost), np.uint8), edge[:-1], edge[1:], edge[:-1])
                if words.size >= flush:
                    yield from out()
                    words = PackedTerms()
        yield from out()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long")


def matrix_slices(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of words whose matrix of letters, as wide as their longest, has about COMPARED bytes at most."""
    a = 0
    while a < len(size):
        area = np.maximum.accumulate(size[a:]) * np.arange(1, len(size) - a + 1)
        b = a + max(1, int(np.searchsorted(area, COMPARED, "right")))
        yield a, b
        a = b


def letters_of(words: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of code points, zero beyond a word's end; counts of the letter groups) of words of letters below U+0100."""
    width = int(size.max(initial=1))
    text = np.array([w.encode("latin-1") for w in words], f"S{width}").view(np.uint8).reshape(len(words), width)
    counts = np.zeros((len(words), len(GROUPS) + 1), np.int64)
    row, at = np.nonzero(text)
    np.add.at(counts, (row, GROUP[text[row, at]]), 1)
    return text, counts


def placed_words(words: DataFrame) -> DataFrame:
    """Words with their place in the first levels of the trie: ``size`` letters, of which ``c0``, ``c1``, ... in the first groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = batch.column(0).to_pylist()
            size = np.array([len(w) for w in word], np.int64)
            first = np.zeros((len(word), FIRST_LEVELS), np.int32)
            for a, b in matrix_slices(size):
                first[a:b] = letters_of(word[a:b], size[a:b])[1][:, :FIRST_LEVELS]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int32()), *(pa.array(c) for c in first.T.copy())], names=["word", "n", *KEYS])

    return words.mapInArrow(run, "word string, n long, " + ", ".join(f"{k} int" for k in KEYS))


def searches(placed: DataFrame) -> DataFrame:
    """Each word once for every subtree in which its search goes on, with the budget that is left there.

    A pair of near words needs one of them to find the other: the shorter one
    searches longer words, and of words of one length that with the smaller
    counts in the first levels; where these are equal both search.
    """
    step = lambda size, surplus, deficit, **more: F.struct((F.col("size") + size).alias("size"), *((F.col(f"c{i}") + more.get(f"c{i}", 0)).alias(f"c{i}") for i in range(FIRST_LEVELS)), F.lit(surplus).cast("byte").alias("surplus"), F.lit(deficit).cast("byte").alias("deficit"))
    to = [step(0, 1, 1), step(1, 1, 0)]
    for i in range(FIRST_LEVELS):
        to += [step(1, 0, 0, **{f"c{i}": 1}), step(0, 0, 1, **{f"c{i}": 1})]
        to += [step(0, 0, 0, **{f"c{i}": 1, f"c{j}": -1}) for j in range(i + 1, FIRST_LEVELS)]
    return placed.select("word", "n", F.explode(F.array(*to)).alias("to")).select("word", "n", "to.*")


class Trie:
    """The lower levels of one subtree, over words of one length."""

    def __init__(self, words: list[str], n: np.ndarray):
        size = np.array([len(w) for w in words], np.int64)
        text, counts = letters_of(words, size)
        counts = counts[:, FIRST_LEVELS:]
        order = np.lexsort(counts.T[::-1])
        self.text, self.n, self.words = text[order], n[order], pa.array(words, pa.string()).take(pa.array(order))
        counts, self.scale = counts[order], int(size.max()) + 3
        node = np.zeros(len(words), np.int64)
        self.branches = []  # by level: parent and count of each node in one number, rising
        for level in range(counts.shape[1]):
            branch = node * self.scale + counts[:, level] + 1  # + 1: one less than a count of 0 is no other node's branch
            new = np.ones(len(branch), bool)
            new[1:] = branch[1:] != branch[:-1]
            self.branches.append(branch[new])
            node = np.cumsum(new) - 1
        self.first = np.append(np.searchsorted(node, np.arange(int(node[-1]) + 1)), len(words))

    def leaves(self, counts: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(search, leaf) pairs, by depth-first search of blocks of searches."""
        every = np.arange(len(counts))
        stack = [(0, every[a : a + BLOCK], np.zeros(len(every[a : a + BLOCK]), np.int64), surplus[a : a + BLOCK], deficit[a : a + BLOCK]) for a in range(0, len(every), BLOCK)]
        while stack:
            level, who, node, more, less = stack.pop()
            if level == len(self.branches):
                yield who, node
                continue
            branches, found = self.branches[level], []
            for change, may in ((0, None), (1, more > 0), (-1, less > 0)):
                s = np.arange(len(who)) if may is None else np.flatnonzero(may)
                branch = node[s] * self.scale + counts[who[s], level] + 1 + change
                at = np.minimum(np.searchsorted(branches, branch), len(branches) - 1)
                hit = branches[at] == branch
                s = s[hit]
                found.append((who[s], at[hit], more[s] - (change > 0), less[s] - (change < 0)))
            states = [np.concatenate(x) for x in zip(*found, strict=True)]
            for a in range(0, len(states[0]), BLOCK):
                stack.append((level + 1, *(x[a : a + BLOCK] for x in states)))

    def near(self, words: list[str], surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(search, word of the trie) of words that differ by exactly one edit; of two words of equal counts on all first levels the smaller one finds the larger."""
        size = np.array([len(w) for w in words], np.int64)
        text, counts = letters_of(words, size)
        width = self.text.shape[1]
        padded = np.zeros((len(words), width), np.uint8)
        padded[:, : text.shape[1]] = text
        step = max(1, COMPARED // width)
        for who, leaf in self.leaves(counts[:, FIRST_LEVELS:], surplus, deficit):
            n = self.first[leaf + 1] - self.first[leaf]
            total, edge = int(n.sum()), np.cumsum(n) - n
            for a in range(0, total, step):
                pair = np.arange(a, min(total, a + step))
                k = np.searchsorted(edge, pair, "right") - 1
                q, x = who[k], self.first[leaf[k]] + pair - edge[k]
                one, two = padded[q], self.text[x]
                differ = one != two
                at = differ.argmax(axis=1)
                same = size[q] == width
                ok = differ.sum(axis=1) == 1
                # equal letters on from the first different one, shifted by the one that is more
                tail = np.zeros_like(differ)
                tail[:, 1:] = one[:, :-1] != two[:, 1:]
                ok = np.where(same, ok, ~(tail & (np.arange(width) > at[:, None])).any(axis=1))
                rows = np.arange(len(q))
                both = same & (surplus[q] > 0) & (deficit[q] > 0)
                ok &= ~both | (one[rows, at] < two[rows, at])
                yield q[ok], x[ok]


def near_words(words: DataFrame, base: str) -> DataFrame:
    """(word, near, near_n) of all pairs of ``words`` (word, n) that differ by exactly one edit, in both directions."""
    spark = words.sparkSession
    placed = written(placed_words(words), f"{base}/placed")
    trees = placed.groupBy(*KEYS).agg((F.floor(F.count("*") * F.max("size") / PART_BYTES) + 1).cast("int").alias("parts"))
    trees = small(written(trees, f"{base}/trees"))
    own = placed.join(trees, KEYS).select(*KEYS, F.pmod(F.xxhash64("word"), "parts").cast("int").alias("part"), F.lit(False).alias("search"), "word", "n", F.lit(0).cast("byte").alias("surplus"), F.lit(0).cast("byte").alias("deficit"))
    sent = searches(placed).join(trees, KEYS).select(*KEYS, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("search"), "word", "n", "surplus", "deficit")
    task = [*KEYS, "part"]
    rows = own.unionByName(sent).repartition(*task).sortWithinPartitions(*task, "search")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, trie = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            edge = np.ones(batch.num_rows, bool)
            edge[1:] = np.any([pc.not_equal(batch.column(k)[1:], batch.column(k)[:-1]).to_numpy(zero_copy_only=False) for k in range(len(task) + 1)], axis=0)
            cuts = [*np.flatnonzero(edge).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(batch.column(k)[a].as_py() for k in range(len(task)))
                part = batch.slice(a, b - a)
                if key != now:
                    now, held, trie = key, [], None
                if not part.column("search")[0].as_py():
                    held.append(part)
                    continue
                if trie is None:
                    if not held:  # a part of a subtree that got no word
                        continue
                    whole = pa.Table.from_batches(held)
                    trie = Trie(whole.column("word").to_pylist(), whole.column("n").to_numpy())
                for lo in range(0, part.num_rows, max(1, COMPARED // key[0])):
                    some = part.slice(lo, max(1, COMPARED // key[0]))
                    yield from met(trie, some)

    def met(trie: Trie, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        word, n = part.column("word"), part.column("n").to_numpy()
        surplus, deficit = (part.column(c).to_numpy().astype(np.int64) for c in ("surplus", "deficit"))
        for q, x in trie.near(word.to_pylist(), surplus, deficit):
            one, two = word.take(pa.array(q)), trie.words.take(pa.array(x))
            yield pa.RecordBatch.from_arrays([one, two, pa.array(trie.n[x])], names=["word", "near", "near_n"])
            yield pa.RecordBatch.from_arrays([two, one, pa.array(n[q])], names=["word", "near", "near_n"])

    return rows.mapInArrow(run, "word string, near string, near_n long")


def roots(links: DataFrame, base: str) -> DataFrame:
    """(word, root) of every word of ``links`` (word, up): where following ``up`` ends. Each round doubles the steps; no links make a ring."""
    spark, step = links.sparkSession, 0
    links = written(links, f"{base}/up0")
    while True:
        further = links.select(F.col("word").alias("up"), F.col("up").alias("next"))
        step += 1
        moved = written(links.join(further, "up", "left").select("word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), f"{base}/up{step}")
        drop_dir(spark, f"{base}/up{step - 1}")
        links = moved.select("word", "up")
        if moved.where("moved").isEmpty():
            return links.select("word", F.col("up").alias("root"))


def spelling_variants(docs: DataFrame, least_count: int = LEAST_COUNT, form_ratio: int = FORM_RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word with at least ``least_count`` occurrences.

    Words are runs of ASCII letters and U+00C0 to U+00FF, only A-Z lower-cased,
    of at least LEAST_LETTERS letters. Where LOSS divides h, the crc32 of
    ``<doc_id>:<run>``, the run's letter at h % length is left out first. Two
    words are near if one inserted, deleted or replaced letter makes one the
    other. A word's form is its near word of most occurrences (of equals the
    first in code-point order) if these are at least ``form_ratio`` (2 or more)
    times its own; its root is where following forms ends.

    A null text has no words; a null doc_id is written as nothing before the
    colon. Every row counts, repeated ones as often as they occur. Texts and
    words are read whole, however long. Other columns are not read; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    base = work_dir(spark)
    words = word_counts(docs).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    words = written(words, f"{base}/words")
    best = near_words(words, base).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    forms = words.join(best, "word", "left").withColumn("ok", -F.col("best.less") >= form_ratio * F.col("n"))
    forms = written(forms.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("ok"), F.col("best.near")).alias("form"), F.when(F.col("ok"), -F.col("best.less")).alias("form_n")), f"{base}/forms")
    ends = roots(forms.where("form is not null").select("word", F.col("form").alias("up")), base)
    out = forms.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    for name in ("placed", "trees", "words"):
        drop_dir(spark, f"{base}/{name}")
    return out
