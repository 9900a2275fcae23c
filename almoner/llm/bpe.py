"""Byte-level BPE by an index of pair occurrences, and back.

A partition's texts are cut into chunks as the tokenizer's own rule says. The distinct chunks of a block of texts that the
worker has not met yet are laid out as one array of byte symbols, linked to their neighbours. The index maps each pair
that has a rank to all its positions. Active ranks are applied in ascending order, each at all its positions at a time;
the pairs that this makes left and right of each merge are entered into the lists of their ranks, and an entry whose pair
is gone is passed over when its rank comes up. A merge's product is never part of a pair of a lower rank, which is
checked when the file is read, so a rank that has been applied never comes back, and the ids are those of merging each
chunk by itself, lowest rank first, leftmost first.

The file has to be a byte-level BPE in the format of the tokenizers library without normalizer, prefix space, dropout,
unknown token or affixes; others are refused. Truncation and padding in it are not applied. Strings of added tokens in a
text become those tokens, as the library does by default.

Defined results: a null text is empty and has no ids; a null list of ids is empty; null ids and ids that the vocabulary
lacks are decoded as nothing, as the library does; repeated rows are coded each; bytes that are no UTF-8 become U+FFFD;
an empty table has no rows; a kept column of a new column's name gives way to it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import _common as c

#: Fixed by the format: how byte-level files cut texts.
CHUNK = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Texts of these characters alone are cut by CHUNK; others by the library, as letters of late Unicode versions differ.
SETTLED = regex.compile(r"[\x00-ԯ -⁯　-鿿가-힣]*")
#: Characters of texts whose chunks are taken at a time.
BLOCK = 2 << 20
#: Chunks that a worker remembers, and the length of the longest.
KNOWN = 200_000
KNOWN_LENGTH = 64


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class PairIndex:
    """The merges of a file, applied to many chunks at a time."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.of_byte = np.array([vocab[x] for x in byte_alphabet()], np.int64)
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.base = max(vocab.values()) + 3
        self.gone, self.border = self.base - 2, self.base - 1  # no token's
        since = np.full(self.base, -1, np.int64)  # the rank that makes a token
        since[self.made[::-1]] = np.arange(len(merges))[::-1]
        if len(np.unique(self.made)) < len(merges) or (np.maximum(since[self.left], since[self.right]) >= np.arange(len(merges))).any():
            raise ValueError("merges must make each token once, from bytes and tokens of lower ranks")
        keys = self.left * self.base + self.right
        order = np.argsort(keys)
        self.keys, self.rank_of = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, -1)

    def enter(self, lists: dict[int, list[np.ndarray]], symbols: np.ndarray, after: np.ndarray, positions: np.ndarray) -> list[int]:
        """Adds positions to the lists of the ranks of the pairs that begin there; the ranks that had no list."""
        key = symbols[positions] * self.base + symbols[after[positions]]
        at = self.keys.searchsorted(key)
        here = (self.keys[at] == key).nonzero()[0]
        if not len(here):
            return []
        ranks, positions = self.rank_of[at[here]], positions[here]
        order = ranks.argsort(kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = [0, *((ranks[1:] != ranks[:-1]).nonzero()[0] + 1).tolist(), len(ranks)]
        new = []
        for a, b, r in zip(cuts[:-1], cuts[1:], ranks[cuts[:-1]].tolist(), strict=True):
            if r in lists:
                lists[r].append(positions[a:b])
            else:
                lists[r] = [positions[a:b]]
                new.append(r)
        return new

    def encode(self, chunks: list[bytes]) -> list[np.ndarray]:
        """The ids of each chunk."""
        if not chunks:
            return []
        symbols = np.concatenate([[self.border], self.of_byte[np.frombuffer(b"\0".join([*chunks, b""]), np.uint8)]])
        symbols[np.cumsum([len(x) + 1 for x in chunks])] = self.border  # behind each chunk
        after, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        after[-1] = before[0] = 0
        lists: dict[int, list[np.ndarray]] = {}
        active = self.enter(lists, symbols, after, np.arange(len(symbols)))
        heapq.heapify(active)
        left, right, made = self.left.tolist(), self.right.tolist(), self.made.tolist()
        while active:
            r = heapq.heappop(active)
            p = np.concatenate(lists.pop(r))
            p.sort()
            p = p[(symbols[p] == left[r]) & (symbols[after[p]] == right[r])]
            if len(p) > 1:
                p = p[np.append(True, p[1:] != p[:-1])]
                if left[r] == right[r]:  # of overlapping places the first, third, ... of each run
                    number = np.arange(len(p))
                    first = np.append(True, after[p[:-1]] != p[1:])
                    p = p[(number - np.maximum.accumulate(np.where(first, number, 0))) % 2 == 0]
            elif not len(p):
                continue
            merged = after[p]
            symbols[p], symbols[merged] = made[r], self.gone
            after[p] = behind = after[merged]
            before[behind] = p
            for new in self.enter(lists, symbols, after, np.concatenate([before[p], p])):
                heapq.heappush(active, new)
        ids = symbols[symbols != self.gone]
        borders = (ids == self.border).nonzero()[0].tolist()
        ids = ids.astype(np.int32)
        return [ids[a + 1 : b] for a, b in zip(borders[:-1], borders[1:], strict=True)]


class ByteBPE:
    """A file's rules: texts to ids and back."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, cut = told["model"], told.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or told.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or (told.get("decoder") or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path} is no plain byte-level BPE")
        added = told.get("added_tokens") or []
        if any(a.get(k) for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens that look at their neighbours")
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.index = PairIndex(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.added = {a["content"]: a["id"] for a in added}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        byte_of = {x: b for b, x in enumerate(byte_alphabet())}
        tokens = model["vocab"] | self.added
        self.bytes_of = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.bytes_of[i] = bytes(map(byte_of.__getitem__, token)) if all(x in byte_of for x in token) else token.encode()
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.known: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        if SETTLED.fullmatch(text):
            return CHUNK.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def parts(self, text: str) -> list[str | int]:
        """The chunks of a text, and the ids of added tokens among them."""
        if self.cut is None or not self.cut.search(text):
            return self.chunks(text)
        out: list[str | int] = []
        for k, x in enumerate(self.cut.split(text)):
            out += [self.added[x]] if k % 2 else self.chunks(x)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        known, cut = self.known, [self.parts(x) for x in texts]
        new = list({x for parts in cut for x in parts}.difference(known))
        for x, ids in zip([x for x in new if isinstance(x, str)], self.index.encode([x.encode() for x in new if isinstance(x, str)]), strict=True):
            known[x] = ids.tobytes()
        known.update((x, np.int32(x).tobytes()) for x in new if isinstance(x, int))
        out = [np.frombuffer(b"".join(map(known.__getitem__, parts)), np.int32) for parts in cut]
        for x in new:
            if isinstance(x, str) and len(x) > KNOWN_LENGTH:
                del known[x]
        if len(known) > KNOWN:
            known.clear()
        return out

    def decode(self, ids: list[int | None]) -> str:
        table, n = self.bytes_of, len(self.bytes_of)
        try:
            raw = b"".join(map(table.__getitem__, ids)) if min(ids, default=0) >= 0 else None
        except (IndexError, TypeError):
            raw = None
        if raw is None:
            raw = b"".join(table[i] for i in ids if i is not None and 0 <= i < n)
        return raw.decode("utf-8", "replace")

    def listed_sha256(self, ids: np.ndarray) -> str:
        """Of the ids as decimal numbers with commas, taken in parts."""
        sha = hashlib.sha256()
        for k in range(0, len(ids), 1 << 16):
            sha.update((("," if k else "") + ",".join(map(self.decimal.__getitem__, ids[k : k + (1 << 16)].tolist()))).encode())
        return sha.hexdigest()


RULES: dict[str, ByteBPE] = {}


def rules(path: str) -> ByteBPE:
    """Those of a file, read once for each worker process."""
    if path not in RULES:
        RULES[path] = ByteBPE(path)
    return RULES[path]


def _blocks(array: pa.Array) -> Iterator[list[str]]:
    """Texts of a batch, so many at a time as hold BLOCK characters; null counts as empty."""
    held, size = [], 0
    for x in array:
        held.append(x.as_py() or "")
        size += len(held[-1])
        if size >= BLOCK:
            yield held
            held, size = [], 0
    yield held


#: What `encode` can tell of a text: its ids, what they are decoded to, their number, and digests of both.
OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType()),
    "decoded": T.StringType(),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", outputs: tuple[str, ...] = ("ids",), keep: list[str] | None = None) -> DataFrame:
    """docs with columns of OUTPUTS. Decoded texts come from the ids; only what is asked for is held longer than a block of texts."""

    def told(bpe: ByteBPE, ids: np.ndarray) -> dict:
        decoded = bpe.decode(ids.tolist()) if "decoded" in outputs or "decoded_sha256" in outputs else None
        tell = {
            "ids": lambda: ids, "decoded": lambda: decoded, "n_tokens": lambda: len(ids), "ids_sha256": lambda: bpe.listed_sha256(ids),
            "decoded_sha256": lambda: hashlib.sha256(decoded.encode()).hexdigest(),
        }
        return {x: tell[x]() for x in outputs}

    def fn(batches):
        bpe = rules(tokenizer)
        for (texts,) in batches:
            made = [told(bpe, ids) for block in _blocks(texts) for ids in bpe.encode(block)]
            columns = []
            for x in outputs:
                values = [m[x] for m in made]
                if x == "ids":
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate(values), pa.int32())))
                else:
                    columns.append(pa.array(values, pa.int64() if x == "n_tokens" else pa.string()))
            yield columns

    return c.map_batches(docs, [text_col], fn, [T.StructField(x, OUTPUTS[x]) for x in outputs], keep)


def decode(coded: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """coded with the text of each list of ids."""

    def fn(batches):
        bpe = rules(tokenizer)
        for (ids,) in batches:
            yield [pa.array([bpe.decode(x.as_py() or []) for x in ids], pa.string())]

    return c.map_batches(coded, [ids_col], fn, [T.StructField(text_col, T.StringType())], keep)
