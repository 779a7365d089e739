"""Token counts of whole texts by rank-synchronous merging over ragged arrays.

Every task keeps the counts of pre-tokens it has met. New pre-tokens of a
slice of rows are laid out as one flat symbol array plus a word number for
each symbol; in each round all words apply their own lowest-ranked pair at
all its places at once, until no word has a pair left. What survives is the
count. Rows never move: the operator is one scan without a shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brindle.llm.common import MUL, code_hashes, text_slices

#: Pre-tokens whose counts a task keeps; at more, it starts anew.
KEPT = 400_000
#: Bits of a slot number in the pair tables.
SLOT_BITS = 20
NO_RANK = np.iinfo(np.int64).max


class MergeTable:
    """Merge ranks of a word-end BPE file as sorted numpy arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model, vocab = spec["model"], spec["model"]["vocab"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain BPE files with a word-end suffix are supported")
        special = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in special):
            raise ValueError("added tokens with options are not supported")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(special, key=lambda t: -len(t["content"])))) if special else None
        self.special_ids = {t["content"]: t["id"] for t in special}
        tokenizer = Tokenizer.from_file(path)
        self.normalizer = tokenizer.normalizer
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if not (split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"] and split["pattern"]["Regex"] == PLAIN_SPLIT):
            raise ValueError("the first pre-tokenizer must keep the matches of the known pattern")
        if [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("the normalizer must be NFC, white space and lower case")
        chars = byte_characters()
        end = model["end_of_word_suffix"] or ""
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.code = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.slots = self._slots()
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.kind = np.full(0x110000, UNSEEN, np.uint8)

    def classes(self, code: np.ndarray) -> np.ndarray:
        """The class of each code point; the library's own splitter tells those not met before."""
        for c in np.unique(code[self.kind[code] == UNSEEN]).tolist():
            self.kind[c] = SHAPES[tuple(span for _, span in self.split(f"a{chr(c)}!"))]
        return self.kind[code]

    def _slots(self) -> list[tuple[np.uint64, np.ndarray]]:
        """Hash tables from pair to rank; what finds its slot taken goes to the next table."""
        left, out, mul = np.arange(len(self.code)), [], MUL
        while len(left):
            at = self._slot(self.code[left], mul)
            slots = np.full(1 << SLOT_BITS, -1, np.int32)
            slots[at[::-1]] = left[::-1]
            out.append((mul, slots))
            left = left[slots[at] != left]
            mul = np.uint64(int(mul) * 0xBF58476D1CE4E5B9 % (1 << 64) | 1)
        return out

    @staticmethod
    def _slot(code: np.ndarray, mul: np.uint64) -> np.ndarray:
        return (code.view(np.uint64) * mul >> np.uint64(64 - SLOT_BITS)).view(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left << 32 | right
        out = np.full(len(code), NO_RANK)
        for mul, slots in self.slots:
            rank = slots[self._slot(code, mul)]
            hit = (rank >= 0) & (self.code[rank] == code)
            out[hit] = rank[hit]
        return out

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word when no pair can be merged."""
        return self.merge(words)[1]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each word)."""
        size = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(size)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        full = size > 0
        sym[ends[full] - 1] = self.last[raw[ends[full] - 1]]
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = [], []
        while len(sym):
            same = word[1:] == word[:-1]
            rank = np.append(np.where(same, self.ranks(sym[:-1], sym[1:]), NO_RANK), NO_RANK)
            heads = np.flatnonzero(np.append(True, ~same))
            sizes = np.diff(np.append(heads, len(sym)))
            least = np.repeat(np.minimum.reduceat(rank, heads), sizes)
            live = least < NO_RANK
            done_sym.append(sym[~live])
            done_word.append(word[~live])
            at = np.flatnonzero(every_other((rank == least) & live))
            sym[at] = self.merged[least[at]]
            live[at + 1] = False
            sym, word = sym[live], word[live]
        if not done_word:
            return np.zeros(0, np.int64), size
        word = np.concatenate(done_word)
        return np.concatenate(done_sym)[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


def every_other(hit: np.ndarray) -> np.ndarray:
    """Of each run of neighbouring hits keep the first, third and so on: merges go from the left and don't overlap."""
    at = np.flatnonzero(hit)
    if not len(at):
        return hit
    new = np.append(True, np.diff(at) != 1)
    start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    out = np.zeros_like(hit)
    out[at[(np.arange(len(at)) - start) % 2 == 0]] = True
    return out


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


@lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


#: The split pattern that ``spans`` follows.
PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Classes of code points: letters, numbers, white space, all else.
LETTER, NUMBER, BLANK, OTHER, UNSEEN = 0, 1, 2, 3, 4
#: How "a", a character and "!" are split, by the character's class.
SHAPES = {((0, 2), (2, 3)): LETTER, ((0, 1), (1, 2), (2, 3)): NUMBER, ((0, 1), (2, 3)): BLANK, ((0, 1), (1, 3)): OTHER}
#: What may follow an apostrophe that begins a pre-token.
TAILS = ("s", "t", "re", "ve", "m", "ll", "d")


def spans(code: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the pre-tokens in an array of code points and their classes, by PLAIN_SPLIT."""
    if not len(code):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(code), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    # an apostrophe where no run of others is under way takes a known tail with it
    quote = np.flatnonzero((code == 39) & new)
    padded = np.append(code, np.zeros(2, code.dtype))
    for tail in TAILS:
        if not len(quote):
            break
        hit = np.ones(len(quote), bool)
        for i, c in enumerate(tail):
            hit &= padded[quote + 1 + i] == ord(c)
        at = quote[hit]
        new[at + 1] = False
        after = at + 1 + len(tail)
        new[after[after < len(code)]] = True
        # what follows the tail may be an apostrophe or a run of its own, found by its class
        quote = quote[~hit]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(code))
    keep = kind[starts] != BLANK
    return starts[keep], ends[keep]


@dataclass
class Met:
    """Distinct pre-tokens of some texts: where each occurs, and its key in a task's store."""

    special: list[list[tuple[int, int]]]
    row: np.ndarray
    which: np.ndarray
    keys: list[int]
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    joined: str

    def words(self, picked: list[int]) -> list[bytes]:
        at = self.first[picked]
        return [self.joined[a:b].encode() for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


def met(texts: list[str], table: MergeTable) -> Met:
    """Split texts; ``special`` has, by text, (pre-tokens of that text before it, id) of special strings."""
    parts, owner, special = [], [], []
    for i, text in enumerate(texts):
        if table.special is not None and "<" in text and (hits := table.special.findall(text)):
            pieces = table.special.split(text)
            special.append([(len(parts) + k + 1, table.special_ids[h]) for k, h in enumerate(hits)])
        else:
            pieces = [text]
            special.append([])
        parts += [p.lower() if p.isascii() else table.normalizer.normalize_str(p) for p in pieces]
        owner += [i] * len(pieces)
    joined = "\n".join(parts)
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    starts, ends = spans(code, table.classes(code))
    edges = np.cumsum([len(x) + 1 for x in parts])
    part = np.searchsorted(edges, starts, "right")
    uniq, first, which = np.unique(code_hashes(code, starts, ends), return_index=True, return_inverse=True)
    # the place of a special string: how many pre-tokens of its text come before it
    row = np.array(owner, np.int64)[part]
    for i, found in enumerate(special):
        if found:
            base = int(np.searchsorted(row, i))
            special[i] = [(int(np.searchsorted(part, k)) - base, token) for k, token in found]
    return Met(special, row, which, uniq.tolist(), first, starts, ends, joined)


def counted(texts: list[str], table: MergeTable, known: dict[int, int]) -> np.ndarray:
    """Tokens of each text; ``known`` is the task's store of counts by pre-token hash."""
    m = met(texts, table)
    if len(known) + len(m.keys) > KEPT:
        known.clear()
    fresh = [k for k, key in enumerate(m.keys) if key not in known]
    if fresh:
        known.update(zip([m.keys[k] for k in fresh], table.count(m.words(fresh)).tolist(), strict=True))
    sizes = np.array([known[k] for k in m.keys], np.int64)
    return np.bincount(m.row, sizes[m.which], minlength=len(texts)).astype(np.int64) + [len(x) for x in m.special]


class TokenIds:
    """Token ids of texts; keeps those of the pre-tokens that a task has met."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids, self.start = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        m = met(texts, self.table)
        if len(self.known) + len(m.keys) > KEPT:
            self.clear()
        fresh = [k for k, key in enumerate(m.keys) if key not in self.known]
        if fresh:
            ids, n = self.table.merge(m.words(fresh))
            self.known.update(zip([m.keys[k] for k in fresh], range(len(self.known), len(self.known) + len(fresh)), strict=True))
            self.start = np.append(self.start, self.start[-1] + np.cumsum(n))
            self.ids = np.append(self.ids, ids)
        word = np.array([self.known[k] for k in m.keys], np.int64)[m.which]
        n = self.start[word + 1] - self.start[word]
        ends = np.cumsum(n)
        flat = self.ids[np.arange(n.sum()) - np.repeat(ends - n, n) + np.repeat(self.start[word], n)].astype(np.uint32)
        edge = np.searchsorted(m.row, np.arange(len(texts) + 1))
        at = np.append(0, ends)
        out = []
        for i, special in enumerate(m.special):
            one = flat[at[edge[i]] : at[edge[i + 1]]]
            if special:
                one = np.insert(one, [at[edge[i] + k] - at[edge[i]] for k, _ in special], [t for _, t in special])
            out.append(one)
        return out


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    Counts are those of the tokenizers library for ``tokenizer_path`` without
    begin, end or added special tokens; special strings that a text holds count
    one each, as is its default. A null text counts as empty (0 bytes, 0
    tokens). Rows are kept one for one, repeated ids and texts included; other
    columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = merge_table(tokenizer_path), {}
        for batch in batches:
            column = batch.column(1)
            for a, b, _, offsets in text_slices(batch, text_col):
                n = counted([x or "" for x in column.slice(a, b - a).to_pylist()], bpe, known)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
