"""Byte-level BPE by rank-synchronous merging of ragged numpy arrays.

Pre-tokens are held as one flat array of symbol ids with the start of each sequence. In each round every
sequence looks up the ranks of its neighbouring pairs and merges all occurrences of its lowest one at once; a
sequence without a mergeable pair leaves with its surviving symbols. Since a symbol made at some rank only
takes part in later ranks, merging all occurrences together gives the same as one by one from the left.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np

#: Distinct chunks that a worker remembers before it starts anew.
REMEMBER = 250_000
#: Fixed value: the pre-token rule of this kind of tokenizer.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of the pre-token rule (Unicode), other than the plain space, before one.
_SPACE_BEFORE = [chr(c) + " " for c in (*range(9, 14), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by the rule they share."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Pairs:
    """Pair of symbols -> rank and merged symbol, by two probes of a table of a power of two."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> None:
        key = left.astype(np.int64) << 20 | right
        self.made = np.append(made.astype(np.int64), -1)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        todo = np.arange(len(key))
        self.bits = max(8, int(len(key)).bit_length() + 2)
        while len(todo):  # those that find their place taken go to the next level
            k = len(self.levels)
            at = self._hash(key[todo], k)
            _, first = np.unique(at, return_index=True)
            keys, ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, len(key), np.int64)
            keys[at[first]], ranks[at[first]] = key[todo[first]], todo[first]
            self.levels.append((keys, ranks))
            todo = np.delete(todo, first)
        self.none = len(key)

    def _hash(self, key: np.ndarray, level: int) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * level * 0x632BE59BD9B4E019 & (1 << 64) - 1 | 1)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        out = np.full(len(key), self.none, np.int64)
        for k, (keys, ranks) in enumerate(self.levels):
            at = self._hash(key, k)
            hit = keys[at] == key
            out[hit] = ranks[at[hit]]
        return out


class ByteBPE:
    """A tokenizer file of the `tokenizers` library of kind byte-level BPE, read for encoding only."""

    def __init__(self, path: str, native: bool = False) -> None:
        """native: whole texts go through a compiled encoder over the same ranks, not through merge()."""
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        vocab, of = model["vocab"], byte_symbols()
        self.first = np.zeros(256, np.int64)  # byte -> symbol
        for c, b in of.items():
            self.first[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        self.compiled = None
        if native and (np.diff(pairs[:, 2]) > 0).all():  # merges are in the order of their ids: ids are ranks
            import tiktoken

            ranks = {bytes(of[c] for c in t): k for t, k in vocab.items() if all(c in of for c in t) and t not in {a["content"] for a in spec["added_tokens"]}}
            self.compiled = tiktoken.Encoding("own", pat_str=RULE, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pairs = _Pairs(pairs[:, 0], pairs[:, 1], pairs[:, 2])
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError(f"{path}: added token {t['content']!r} isn't matched plainly")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.short = max([*vocab.values(), *self.special.values()]) < 1 << 16  # ids fit two bytes
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # Contractions, then runs of letters, digits or others with one space before.
        self.rule = regex.compile(RULE)
        self.known: dict[str, bytes] = {}  # of chunks after a space
        self.first_known: dict[str, bytes] = {}  # of others

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, starts) of the pieces after all merges, piece by piece; starts has one more for the end."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), size)  # which piece a symbol belongs to
        done_symbols, done_owner = [], []
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            inner = np.append(owner[1:] == owner[:-1], False)  # has a right neighbour
            rank = np.full(len(symbols), self.pairs.none, np.int64)
            at = np.flatnonzero(inner)
            rank[at] = self.pairs.rank(symbols[at], symbols[at + 1])
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            low = np.repeat(lowest, lengths)
            live = low < self.pairs.none
            if not live.all():
                done_symbols.append(symbols[~live])
                done_owner.append(owner[~live])
            hit = live & (rank == low)
            # Of overlapping occurrences (a a a) every other one counts, from the left of their run.
            run = np.flatnonzero(hit[1:] & hit[:-1]) + 1
            if len(run):
                begin = np.flatnonzero(hit & ~np.append(False, hit[:-1]))
                where = np.flatnonzero(hit)
                since = where - begin[np.searchsorted(begin, where, side="right") - 1]
                hit[where[since % 2 == 1]] = False
            symbols = np.where(hit, self.pairs.made[np.where(hit, low, -1)], symbols)
            keep = live & ~np.append(False, hit[:-1])
            symbols, owner = symbols[keep], owner[keep]
        if done_symbols:
            symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
            order = np.argsort(owner, kind="stable")
            symbols, owner = symbols[order], owner[order]
        return symbols, np.searchsorted(owner, np.arange(len(pieces) + 1))

    def _learn(self, known: dict[str, bytes], chunks: list[str], before: str) -> None:
        """Remembers the ids of chunks, each a stretch of text that the rule never joins with its neighbours.

        before: what stands before each chunk, the space or nothing. A chunk of letters is one token as it is.
        """
        pieces: list[bytes] = []
        ends = [0]
        find = self.rule.findall
        for c in chunks:
            if c.isalpha():
                pieces.append((before + c).encode())
            else:
                pieces += [m.encode() for m in find(before + c)]
            ends.append(len(pieces))
        symbols, starts = self.merge(pieces)
        raw = symbols.astype("<u4").tobytes()
        at = (starts[np.array(ends)] * 4).tolist()
        known.update((c, raw[a:b]) for c, a, b in zip(chunks, at, at[1:], strict=False))

    def _parts(self, text: str) -> list[str]:
        """The text cut at special strings, which stay as parts of their own."""
        return self.at_special.split(text) if self.at_special and any(s in text for s in self.special) else [text]

    def _whole(self, text: str) -> bytes:
        """The ids of one text by the compiled encoder."""
        encode, special = self.compiled, self.special
        return b"".join(special[p].to_bytes(4, "little") if p in special else array("I", encode(p)).tobytes() for p in self._parts(text) if p)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text as little-endian unsigned 32-bit numbers, special strings as their own ids.

        A text is cut at plain spaces between non-spaces, where the rule always begins a token with the space. If
        the text has runs of white space, cuts are made only where no other white space is near.
        """
        if self.compiled:
            return [self._whole(t or "") for t in texts]
        cut: list[list[tuple[int, str, list[str]]]] = []  # special id or -1, first chunk, chunks after a space
        firsts, afters = set(), set()
        for t in texts:
            t, rows = t or "", []
            for p in self._parts(t):
                if p in self.special:
                    rows.append((self.special[p], "", []))
                elif p:
                    odd = "  " in p or any(c in p for c in _SPACE_BEFORE)
                    parts = [x[k > 0 :] for k, x in enumerate(_at_single_space.split(p))] if odd else p.split(" ")
                    rows.append((-1, parts[0], parts[1:]))
                    firsts.add(parts[0])
                    afters.update(rows[-1][2])
            cut.append(rows)
        for known, now, before in ((self.first_known, firsts, ""), (self.known, afters, " ")):
            new = list(now - known.keys())
            if len(known) + len(new) > REMEMBER:
                for c in known.keys() - now:
                    del known[c]
            self._learn(known, new, before)
        of, head, out = self.known.__getitem__, self.first_known.__getitem__, []
        for rows in cut:
            out.append(b"".join(head(a) + b"".join(map(of, p)) if k < 0 else k.to_bytes(4, "little") for k, a, p in rows))
        return out


#: Cuts before a plain space that has a non-space on either side; white space in runs stays together with what follows.
_at_single_space = re.compile(r"(?<=\S)(?= \S)")


@lru_cache(maxsize=4)
def load(path: str, native: bool = False) -> ByteBPE:
    """One tokenizer for each file and worker process."""
    return ByteBPE(path, native)
