"""Byte-pair encoding by speculation and verification, and its inverse.

A word's greedy longest-match tokens are only a guess. Two facts make the guess checkable: a sequence of
tokens is what the merges give if and only if each token alone and each adjacent pair of tokens is what the
merges give for their own characters (a first merge across a border would also happen in that pair alone).
So one vectorised look-up per batch tests all adjacent pairs of all new words at once; a verdict on a pair is
computed once per worker. Only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import ready, text_of

_END = "</w>"
#: Words kept with their tokens per worker, a memo only; beyond it the memo starts anew.
MEMO_WORDS = 400_000
#: Characters on which all Unicode versions agree; texts with others are split by the vocabulary's own rules.
_SETTLED = re.compile("[^\\x00-\u024f\u2010-\u2027\u20ac]").search
#: Characters of text that are tokenised at once.
CHUNK_CHARS = 1_000_000


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_named: dict[str, np.ndarray] = {}


def token_names(path: str) -> np.ndarray:
    """The name of each id; all that decoding needs of a vocabulary."""
    if path not in _named:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        out = np.array([""] * (max(ids.values()) + 1), dtype=object)
        out[list(ids.values())] = list(ids)
        _named[path] = out
    return _named[path]


class WordBpe:
    """A vocabulary with word ends (end_of_word_suffix), lower case and a split pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        assert model["type"] == "BPE" and model["end_of_word_suffix"] == _END and not model["unk_token"], "a BPE with word ends is expected"
        self.vocab: dict[str, int] = model["vocab"]
        self.names = token_names(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank: dict[tuple[str, str], int] = {}
        for i, m in enumerate(model["merges"]):
            self.rank.setdefault(tuple(m) if isinstance(m, list) else tuple(m.split(" ")), i)
        self.longest = max(len(k.removesuffix(_END)) for k in self.vocab)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.as_chars = {b: c for b, c in _byte_chars().items()}
        self.rules = Tokenizer.from_file(path)
        self.as_bytes = {c: b for b, c in self.as_chars.items()}
        self.alone = np.zeros(len(self.names), dtype=np.int8)  # 1: the merges give this token for its own characters; 2: they don't
        self.pairs: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.start, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(8192, np.int32), 0

    # -- words -------------------------------------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        """Normalised words; an added token stands for itself, marked by a leading NUL."""
        parts = self.special_split(text) if self.special_split and "<|" in text else [text]
        out: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append("\0" + part)
            elif _SETTLED(part):
                part = self.rules.normalizer.normalize_str(part)
                out += [bytes(self.as_bytes[c] for c in w).decode() for w, _ in self.rules.pre_tokenizer.pre_tokenize_str(part)]
            elif part:
                part = unicodedata.normalize("NFC", part)
                out += self.words(part.lower())
        return out

    def symbols(self, word: str) -> list[str]:
        s = word.encode("utf-8").decode("latin-1").translate(self.as_chars)
        return [*s[:-1], s[-1] + _END]

    def guess(self, s: list[str]) -> list[int]:
        """Greedy longest match from the left."""
        text, n, at, out = "".join(s)[: -len(_END)], len(s), 0, []
        while at < n:
            for to in range(min(n, at + self.longest), at, -1):
                t = self.vocab.get(text[at:to] + _END if to == n else text[at:to])
                if t is not None:
                    out.append(t)
                    at = to
                    break
            else:
                return []
        return out

    def merge(self, symbols: list[str]) -> list[int]:
        """The merges themselves, lowest rank first, leftmost first."""
        s, none, rank = list(symbols), 1 << 60, self.rank.get
        if len(s) > 200:
            return self.merge_long(s)
        r = [rank(p, none) for p in zip(s, s[1:])]
        while r:
            best = min(r)
            if best == none:
                break
            i = r.index(best)
            s[i] += s.pop(i + 1)
            del r[i]
            if i:
                r[i - 1] = rank((s[i - 1], s[i]), none)
            if i < len(r):
                r[i] = rank((s[i], s[i + 1]), none)
        return [self.vocab[x] for x in s if x in self.vocab]

    def merge_long(self, s: list[str]) -> list[int]:
        """The same with a heap: n log n for a word of any length."""
        n, rank = len(s), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(x, i, s[i], s[i + 1]) for i in range(n - 1) if (x := rank((s[i], s[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if s[i] else n
            if j >= n or s[i] != a or s[j] != b:
                continue
            s[i], s[j] = a + b, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := rank((s[i], s[after[i]]))) is not None:
                    heapq.heappush(heap, (x, i, s[i], s[after[i]]))
            if (h := before[i]) >= 0 and (x := rank((s[h], s[i]))) is not None:
                heapq.heappush(heap, (x, h, s[h], s[i]))
        return [self.vocab[x] for x in s if x in self.vocab]

    def _chars(self, token: int) -> list[str]:
        name = self.names[token]
        return [*name[: -len(_END) - 1], name[-len(_END) - 1 :]] if name.endswith(_END) and len(name) > len(_END) else list(name)

    def learn(self, words: list[str]) -> None:
        """Put the tokens of new words in the memo."""
        symbols = [self.symbols(w) for w in words]
        guesses = [self.guess(s) for s in symbols]
        n = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(n.sum()))
        owner = np.repeat(np.arange(len(words)), n)
        for t in np.unique(flat[self.alone[flat] == 0]):
            self.alone[t] = 1 if self.merge(self._chars(t)) == [t] else 2
        good = n > 0
        np.logical_and.at(good, owner, self.alone[flat] == 1)
        inner = owner[1:] == owner[:-1]
        keys, where = np.unique((flat[:-1] << 32 | flat[1:])[inner], return_inverse=True)
        verdict = np.empty(len(keys), dtype=bool)
        for i, k in enumerate(keys.tolist()):
            v = self.pairs.get(k)
            if v is None:
                a, b = k >> 32, k & 0xFFFFFFFF
                v = self.pairs[k] = self.merge(self._chars(a) + self._chars(b)) == [a, b]
            verdict[i] = v
        np.logical_and.at(good, owner[1:][inner], verdict[where])
        for i in np.flatnonzero(~good).tolist():
            guesses[i] = self.merge(symbols[i])
        for w, g in zip(words, guesses):
            self.put(w, g)
        if len(self.pairs) > 2 * MEMO_WORDS:
            self.pairs.clear()

    def put(self, word: str, tokens: list[int]) -> None:
        k = len(self.index)
        if k == len(self.start):
            self.start, self.count = np.resize(self.start, 2 * k), np.resize(self.count, 2 * k)
        while self.used + len(tokens) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.index[word], self.start[k], self.count[k] = k, self.used, len(tokens)
        self.flat[self.used : self.used + len(tokens)] = tokens
        self.used += len(tokens)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the texts one after the other, and the number of tokens of each text."""
        if len(self.index) > MEMO_WORDS:
            self.forget()
        per = [self.split(t) for t in texts]
        words = [w for p in per for w in p]
        if new := [w for w in dict.fromkeys(words) if w not in self.index]:
            for w in [w for w in new if w[0] == "\0"]:
                self.put(w, [self.special[w[1:]]])
            if new := [w for w in new if w[0] != "\0"]:
                self.learn(new)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        count = self.count[at]
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(self.start[at] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(p) for p in per])])]
        return ids, np.diff(bounds)


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One vocabulary per worker process."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the token ids of each whole text in array<int> column `out` (a column of that name is replaced).

    A null or empty text has no tokens. Rows are independent: repeated rows and ties give equal results,
    extra columns pass through, an empty table stays empty. `path` is the vocabulary file, readable on
    every executor."""
    ready(df.sparkSession)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(a: pa.Array) -> pa.Array:
        model, parts, sizes, chunk, chars = load(path), [], [], [], 0
        for i in range(len(a)):
            t = a[i].as_py() or ""
            chunk.append(t)
            chars += len(t)
            if chars >= CHUNK_CHARS or i == len(a) - 1:
                x, n = model.encode(chunk)
                parts.append(x)
                sizes.append(n)
                chunk, chars = [], 0
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))

    return df.withColumn(out, ids(text_of(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of the token ids in `out`: the tokens' names joined by one space, special ones
    included, as a vocabulary without a decoder gives them. Null or no ids give the empty text; unknown ids
    are left out."""
    ready(df.sparkSession)

    @F.arrow_udf(T.StringType())
    def joined(a: pa.Array) -> pa.Array:
        names = token_names(path)
        flat, ends = a.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        if len(flat) and (flat.min() < 0 or flat.max() >= len(names)):
            known = (flat >= 0) & (flat < len(names))
            flat = np.where(known, flat, -1)
            rows = [[names[t] for t in flat[ends[i] : ends[i + 1]] if t >= 0] for i in range(len(a))]
            return pa.array([" ".join(r) for r in rows], pa.string())
        return pa.array([" ".join(names[flat[ends[i] : ends[i + 1]]]) for i in range(len(a))], pa.string())

    return df.withColumn(out, joined(F.coalesce(F.col(ids), F.array().cast("array<int>"))))
