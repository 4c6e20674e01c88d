"""Byte-level BPE by speculation: greedy longest matches are proposed, adjacent pairs verified, failing words merged."""

from __future__ import annotations

import heapq
import json
import string
import struct
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, small_batches

#: Fixed value: white space as Unicode has it; regex's own \s has four control characters more.
SPACE = r"\t-\r\x20\x85\xa0  -     　"

#: Fixed value: the byte-level pattern of the tokenizer files.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: None of it lies beyond U+3000.
SPACES = frozenset(chr(c) for c in range(0x3001) if regex.match(f"[{SPACE}]", chr(c)))

#: ASCII signs other than letters, digits and white space.
MARKS = frozenset(string.punctuation)

#: Words, and stretches from space to space, whose encoding a worker remembers at least, and their bytes at most. Twice as many
#: are there at the end of a generation.
MEMORY, MEMORY_BYTES = 150_000, 30_000_000

#: Pairs of tokens that a worker remembers whether they can stand side by side.
MEMORY_PAIRS = 250_000

#: Bytes of a word up to which it's cut and merged side by side with others, a step of all of them at a time.
SHORT = 32

#: Words merged side by side at most; their arrays stay in a processor's cache.
MERGED = 4_000

#: Behind a word's last byte, in arrays of bytes.
END = 256

NEVER = np.iinfo(np.int64).max


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the files: itself where printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Lookup:
    """Distinct non-negative 64-bit keys to values, for arrays of keys: open addressing, at most a quarter full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int64)
        todo, at = np.arange(len(keys)), self._place(keys)
        while len(todo):
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = keys[todo[put]], values[todo[put]]
            left = np.ones(len(todo), dtype=bool)
            left[put] = False
            todo, at = todo[left], at[left] + 1 & len(self.keys) - 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        # Fibonacci hashing: 2^64 by the golden ratio.
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        at = self._place(keys)
        held = self.keys[at]
        found = np.where(held == keys, self.values[at], default)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            at[left] = at[left] + 1 & len(self.keys) - 1
            held = self.keys[at[left]]
            same = held == keys[left]
            found[left[same]] = self.values[at[left[same]]]
            left = left[~same & (held >= 0)]
        return found


class Memory:
    """What has been met, in two generations: what the last one didn't meet again is forgotten, little by little."""

    def __init__(self) -> None:
        self.now: dict = {}
        self.before: dict = {}
        self.bytes = 0

    def lacks(self, keys: set) -> list:
        """Those of the keys that neither generation has; now has the others after that."""
        new = keys.difference(self.now)
        again = new.intersection(self.before)
        self.learn(list(again), map(self.before.__getitem__, again))
        return list(new.difference(again))

    def learn(self, keys: list, values: Iterable) -> None:
        self.now.update(zip(keys, values, strict=True))
        self.bytes += sum(map(len, keys))

    def age(self) -> None:
        """A new generation, where this one has become full."""
        if len(self.now) > MEMORY or self.bytes > MEMORY_BYTES:
            self.before, self.now, self.bytes = self.now, {}, 0


class Tokenizer:
    """A byte-level BPE tokenizer file; encode_words and decode are exact."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = {"normalizer": None, "truncation": None, "padding": None}
        if any(spec.get(k) != v for k, v in plain.items()) or model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError(f"{path} isn't a plain byte-level BPE file")
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True):
            raise ValueError(f"{path} splits words in another way")
        letters = {c: b for b, c in byte_letters().items()}
        self.token = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        added = {a["content"]: a for a in spec["added_tokens"]}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added.values()):
            raise ValueError(f"{path} has special tokens that take in neighbours")
        self.special = {t: a["id"] for t, a in added.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.words = regex.compile(PATTERN)
        self.byte = {t[0]: i for i, t in self.token.items() if len(t) == 1}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [(model["vocab"][a], model["vocab"][b], model["vocab"][a + b]) for a, b in pairs]
        self.rank = {(a, b): (r, c) for r, (a, b, c) in reversed([*enumerate(ids)])}
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self._tables(ids)
        self.known, self.stretches = Memory(), Memory()
        self.pairs: dict[int, bool] = {}
        parts = [self.token.get(i, b"") for i in range(max(self.token) + 1)]
        self.flat = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.size = np.array([len(x) for x in parts])
        self.start = np.cumsum(self.size) - self.size

    def _tables(self, ids: list[tuple[int, int, int]]) -> None:
        """For each token its outer parts: the last (first) token of what it was made from, step by step, and the
        rank of the merge that used that part up. Of each pair of tokens its merge's rank."""
        n = max(self.token) + 1
        right, left = ([[] for _ in range(n)] for _ in range(2))
        for i in self.byte.values():
            right[i], left[i] = [(i, NEVER)], [(i, NEVER)]
        for r, (a, b, c) in enumerate(ids):
            right[c] = [*right[b][:-1], (b, r), (c, NEVER)]
            left[c] = [*left[a][:-1], (a, r), (c, NEVER)]

        def table(outer: list[list[tuple[int, int]]], k: int) -> np.ndarray:
            """One row a step; shorter ones end with parts that are used up from the start."""
            steps = range(max(map(len, outer)))
            return np.array([[x[d][k] if len(x) > d else (0, -1)[k] for x in outer] for d in steps], dtype=np.int64)

        self.right, self.right_end = table(right, 0), table(right, 1)
        self.left, self.left_end = table(left, 0), table(left, 1)
        keys = np.array([a << 32 | b for a, b, _ in ids], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        first = np.unique(keys, return_index=True)[1]
        self.ranks, self.made = Lookup(keys[first], first), np.array([c for _, _, c in ids], dtype=np.int64)
        # A token that merging its own bytes doesn't give back can never come out, so it's never proposed.
        whole = np.array([(a, b) for a, b, _ in ids], dtype=np.int64).reshape(-1, 2)
        alone = self._apart(whole[:, 0], whole[:, 1], final=True)
        good = {*self.byte.values()}
        for (a, b, c), ok in zip(ids, alone, strict=True):  # parts come before what is made of them
            if ok and a in good and b in good:
                good.add(c)
        self.propose = {self.token[i]: i for i in good}
        self.reach: dict[bytes, int] = {}
        for t in self.propose:
            self.reach[t[:3]] = max(len(t), self.reach.get(t[:3], 0))
        # A tree of the proposed tokens' beginnings: from a node (0 the root), by a byte, to the next; of each node the token that it is, or -1.
        tree: dict[int, int] = {}
        ends: dict[int, int] = {}
        for t, i in self.propose.items():
            node = 0
            for byte in t:
                node = tree.setdefault(node << 9 | byte, len(tree) + 1)
            ends[node] = i
        self.next = Lookup(np.fromiter(tree, dtype=np.int64), np.fromiter(tree.values(), dtype=np.int64))
        self.at_node = np.full(len(tree) + 1, -1, dtype=np.int64)
        self.at_node[list(ends)] = list(ends.values())

    def _apart(self, a: np.ndarray, b: np.ndarray, final: bool = False) -> np.ndarray:
        """Whether merging the bytes of tokens a and b leaves just those two. final: before they merge themselves.

        Merges run by rank, and a part of a token exists until its own merge uses it up. Something merges across the
        border if a part at a's end and one at b's start have a merge that comes before either is used up; where the
        part of b is used up by an equal merge, the one across is further left and comes first.
        """
        apart = np.ones(len(a), dtype=bool)
        for i in range(len(self.right)):
            x, x_end = self.right[i][a], self.right_end[i][a]
            for j in range(len(self.left)):
                y, y_end = self.left[j][b], self.left_end[j][b]
                keys = x << 32 | y
                at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
                rank = np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)
                across = (rank < x_end) & (rank <= y_end) & (rank != NEVER)
                if final:
                    across &= ~((x == a) & (y == b))
                apart &= ~across
        return apart

    def greedy(self, word: bytes) -> list[int]:
        """The longest token at each place; what three bytes begin tells how long it can be."""
        out, i, n, propose, reach = [], 0, len(word), self.propose.get, self.reach.get
        while i < n:
            j = min(n, i + reach(word[i : i + 3], 2))
            while (found := propose(word[i:j])) is None:
                j -= 1
            out.append(found)
            i = j
        return out

    def greedy_all(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of short words, none empty: the tokens that greedy gives, one word's after the other's, and how many each has."""
        ends = np.cumsum([len(w) + 1 for w in raw]) - 1
        text = np.frombuffer(b"\0".join([*raw, b""]), dtype=np.uint8).astype(np.int64)
        text[ends] = END
        word, at = np.arange(len(raw)), np.concatenate([[0], ends[:-1] + 1])
        node, best, upto = np.zeros(len(raw), dtype=np.int64), np.zeros(len(raw), dtype=np.int64), at.copy()
        words, tokens = [], []
        while len(word):
            to = self.next.get(node << 9 | text[at], -1)
            on = to >= 0
            at, node = at + on, np.where(on, to, 0)
            token = self.at_node[node]  # none at the root
            whole = token >= 0
            best, upto = np.where(whole, token, best), np.where(whole, at, upto)
            stuck = np.flatnonzero(~on)
            if len(stuck):
                words.append(word[stuck])
                tokens.append(best[stuck])
                at[stuck] = upto[stuck]
                more = np.ones(len(word), dtype=bool)
                more[stuck] = text[at[stuck]] != END
                word, at, node, best, upto = (x[more] for x in (word, at, node, best, upto))
        word = np.concatenate(words)
        return np.concatenate(tokens)[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(raw))

    def merge_all(self, raw: list[bytes]) -> list[bytes]:
        """What merge gives for short words, packed; a step merges one pair of each word that still has one."""
        size = np.array([len(w) for w in raw])
        wide = int(size.max())
        ids = np.array([self.byte[b] for b in range(256)])[np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in raw), dtype=np.uint8).reshape(len(raw), wide)]
        rank = self.ranks.get((ids[:, :-1] << 32 | ids[:, 1:]).ravel(), NEVER).reshape(len(raw), wide - 1)
        rank[np.arange(1, wide) >= size[:, None]] = NEVER
        # A column of its own ends the ranks, so that there's always one to shift in.
        rank = np.concatenate([rank, np.full((len(raw), 1), NEVER)], axis=1)
        out: list[bytes] = [b""] * len(raw)
        word, places = np.arange(len(raw)), np.arange(wide)
        while len(word):
            row, col = np.arange(len(word)), rank.argmin(axis=1)
            low = rank[row, col]
            done = low == NEVER
            for k, n, x in zip(word[done].tolist(), size[done].tolist(), ids[done].astype("<u4"), strict=True):
                out[k] = x[:n].tobytes()
            go = ~done
            word, size, col, low = word[go], size[go] - 1, col[go], low[go]
            row = np.arange(len(word))
            take = np.minimum(places + (places > col[:, None]), wide - 1)
            ids = np.take_along_axis(ids[go], take, axis=1)
            ids[row, col] = self.made[low]
            rank = np.take_along_axis(rank[go], np.minimum(places + (places >= col[:, None]), wide - 1), axis=1)
            for here, can in ((col - 1, col > 0), (col, col < size - 1)):
                k, c = row[can], here[can]
                rank[k, c] = self.ranks.get(ids[k, c] << 32 | ids[k, c + 1], NEVER)
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact: always the merge of lowest rank, the leftmost of equal ones."""
        ids = [self.byte[b] for b in word]
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(self.rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or (found := self.rank.get((ids[i], ids[j]))) is None or found[0] != r:
                continue
            ids[i], ids[j], after[i] = found[1], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (new := self.rank.get((ids[k], ids[after[k]]))):
                    heapq.heappush(heap, (new[0], k))
        return [i for i in ids if i >= 0]

    def learn(self, new: list[str]) -> None:
        """Encodes words into self.known, as packed unsigned 32-bit integers."""
        raw = sorted((w.encode() for w in new), key=len)  # words of a length are merged side by side
        at = bisect_right(raw, SHORT, key=len)
        short, long = raw[:at], raw[at:]
        parts, counts = self.greedy_all(short) if short else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        rest = [self.greedy(w) for w in long]
        flat = np.concatenate([parts, np.fromiter(chain.from_iterable(rest), dtype=np.int64)])
        ends = np.cumsum([*counts.tolist(), *map(len, rest)])
        if not len(flat):
            return
        data, cuts = flat.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
        found = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        if len(flat) > 1:
            keys = flat[:-1] << 32 | flat[1:]
            distinct, place = np.unique(keys, return_inverse=True)
            new_pairs = np.array([k for k in distinct.tolist() if k not in self.pairs], dtype=np.int64)
            if len(self.pairs) > MEMORY_PAIRS:
                self.pairs.clear()
                new_pairs = distinct
            self.pairs.update(zip(new_pairs.tolist(), self._apart(new_pairs >> 32, new_pairs & 0xFFFFFFFF).tolist(), strict=True))
            fails = ~np.array([self.pairs[k] for k in distinct.tolist()])[place]
            fails[ends[:-1] - 1] = False  # the pair across two words
            again = np.unique(np.searchsorted(ends, np.flatnonzero(fails), side="right")).tolist()
            side_by_side = [k for k in again if k < len(short)]
            for at in range(0, len(side_by_side), MERGED):
                some = side_by_side[at : at + MERGED]
                for k, ids in zip(some, self.merge_all([raw[k] for k in some]), strict=True):
                    found[k] = ids
            for k in again[len(side_by_side) :]:
                ids = self.merge(raw[k])
                found[k] = struct.pack(f"<{len(ids)}I", *ids)
        self.known.learn([w.decode() for w in raw], found)

    def pieces(self, text: str) -> Iterator[str | int]:
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                yield self.special[part]
            elif part:
                yield part

    def _cut(self, text: str) -> list[str]:
        """Its words. ASCII letters alone, behind a space or not, are a word, and so is a mark that they end with."""
        letters = text[1:] if text[:1] == " " else text
        if letters.isascii():
            if letters.isalpha():
                return [text]
            if letters[-1:] in MARKS and letters[:-1].isalpha():
                return [text[:-1], text[-1]]
        return self.words.findall(text)

    def _words(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, packed; the texts hold no special tokens."""
        cut = list(map(self._cut, texts))
        self.learn(self.known.lacks(set(chain.from_iterable(cut))))
        known = self.known.now
        return [known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws]) for ws in cut]

    def _stretches(self, new: list[str]) -> None:
        """A space between two others than white space always starts a word, so what's from there to the next can be
        encoded by itself. None: it starts or ends with white space, or is empty."""
        sound = [x for x in new if x and x[0] not in SPACES and x[-1] not in SPACES]
        found = dict.fromkeys(new) | dict(zip(sound, self._words([f" {x}" for x in sound]), strict=True))
        self.stretches.learn(list(found), found.values())

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        self.known.age()
        self.stretches.age()
        cut: list[list] = []  # of each text its parts: a special token's id, or what's before the first space, and the stretches
        met: set[str] = set()
        for text in texts:
            parts: list = []
            for p in self.pieces(text):
                if isinstance(p, str):
                    head, space, tail = p.partition(" ")
                    p = (head, tail.split(" ") if space else [])
                    met.update(p[1])
                parts.append(p)
            cut.append(parts)
        self._stretches(self.stretches.lacks(met))
        held, rest = self.stretches.now.__getitem__, []
        for parts in cut:
            for k, p in enumerate(parts):
                if isinstance(p, int):
                    continue
                head, tail = p
                # The first space has to stand between two others than white space as well.
                whole = bool(tail) and (not head or head[-1] in SPACES)
                if not whole:
                    try:
                        parts[k] = b"".join(map(held, tail))
                    except TypeError:  # a None: white space is more than single spaces
                        whole = True
                if whole:
                    parts[k] = b""
                rest.append(" ".join([head, *tail]) if whole else head)
        by_words = iter(self._words(rest))
        return [b"".join([p.to_bytes(4, "little") if isinstance(p, int) else next(by_words) + p for p in parts]) for parts in cut]

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, dtype="<u4")
        size = self.size[ids]
        ends = np.cumsum(size)
        place = np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1] if len(ids) else 0)
        return self.flat[place].tobytes().decode("utf-8", "replace")


@lru_cache(1)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit integers), a row for each row.

    path: a byte-level BPE file that every executor can open, as part of the installed tokenizers. Special tokens in a
    text are encoded as such and none are added. Null and empty texts have no ids; repeated rows stay repeated; other
    columns aren't read. decoded: adds text as decode does, by the same worker, which so has the tables only once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            packed = own.encode_batch(batch.column(1).to_pylist())
            sizes = pa.array([len(x) // 4 for x in packed], pa.int64())
            cols = {"doc_id": batch.column(0), "n_tokens": sizes, "ids": pa.array(packed, pa.binary())}
            if decoded:
                cols["text"] = pa.array(map(own.decode, packed), pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return small_batches(rows).mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", text string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds text to doc_id, n_tokens, ids: the tokens' bytes as UTF-8, invalid ones replaced. No ids: an empty text."""

    def make() -> Callable[..., tuple]:
        own = tokenizer(path)
        return lambda i, n, ids: (i, n, ids, own.decode(ids or b""))

    return map_rows(encoded.select("doc_id", "n_tokens", "ids"), make, "doc_id long, n_tokens long, ids binary, text string")


