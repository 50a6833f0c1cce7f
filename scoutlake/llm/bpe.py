"""Byte-pair encoding by forced-boundary splitting, and decoding.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can never end up within one token, so the
place between them is a certain token boundary. Text is cut at such places, every fragment is encoded on its own, and
the results are concatenated. Fragments repeat (words, mostly), so a worker keeps the ids of those it has seen in a
bounded table. Where the pre-tokeniser looks across a cut (white space before a word, an apostrophe after a sign) the
place is left uncut; the fragment is merely longer.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex

#: Fragments whose ids a worker keeps; memory only, never results.
CACHE_FRAGMENTS = 400_000
#: Words that are sooner merged one by one than in a table.
FEW = 100
#: Characters of text that are cut and looked up at a time.
WINDOW = 1 << 20
NEVER = (1 << 31) - 1

# The white space of the tokenisers' regular expressions, and their two split patterns.
SPACE = "\t-\r \x85\xa0  -     　"
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^%s\p{L}\p{N}]+|[%s]+(?![^%s])|[%s]+" % ((SPACE,) * 4)
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^%s\p{L}\p{N}]+" % SPACE

_WIDE_SPACE = re.compile("[\x85\xa0  -     　]")
_GAP = re.compile(r"\S(?=\s)")
_WIDE_BYTES = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Bpe:
    """The tokeniser a `tokenizers` JSON file describes: `byte_bpe` files (byte level, white space kept) and `word_bpe`
    files (lower case, white space dropped, word ends marked)."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        letters = byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.words = bool(self.suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile(WORD_LEVEL if self.words else BYTE_LEVEL)
        self.first = [vocab[c] for c in letters]
        self.last = [vocab[c + self.suffix] for c in letters] if self.words else self.first
        self.rank, self.merged = {}, []
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a], vocab[b]] = k
            self.merged.append(vocab[a + b])
        back = {c: b for b, c in enumerate(letters)}
        self.token_bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            core = token[: -len(self.suffix)] if self.words and token.endswith(self.suffix) else token
            self.token_bytes[i] = bytes(back[c] for c in core) + b" " * (core != token) if all(c in back for c in core) else token.encode()
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.keep = CACHE_FRAGMENTS
        self._cuts()
        self._rank_table()
        self._forget()

    def _cuts(self) -> None:
        """cut[a, b]: between the bytes a and b a fragment ends. True only for pairs inside no token, and not where the
        pre-tokeniser's choice depends on both sides."""
        inside = np.zeros((256, 256), bool)
        special = {*self.special.values()}
        for i, token in enumerate(self.token_bytes):
            if i not in special and len(token) > 1:
                t = np.frombuffer(token, np.uint8)
                inside[t[:-1], t[1:]] = True
        self.forced = ~inside
        cut = self.forced.copy()
        cut[[*range(9, 14), 32, *range(0x1C, 0x20)]] = False  # after white space: it may belong to the next word
        cut[:, 0x27] = False  # an apostrophe may begin a contraction
        cut[:, 0x80:0xC0] = False  # within a code point
        self.cut = cut
        self.cut_ascii = cut.copy()
        self.cut_ascii[0x80:] = False

    def _rank_table(self) -> None:
        """The ranks in an open table for whole columns of pairs: a slot for each pair, the next slots on a clash."""
        pairs = np.array(list(self.rank), np.int64).reshape(-1, 2)
        keys = pairs[:, 0] << 20 | pairs[:, 1]
        self.bits = max(4, int(np.ceil(np.log2(8 * len(keys) + 16))))
        self.slot_key = np.full((1 << self.bits) + 64, -1, np.int64)
        self.slot_rank = np.full(len(self.slot_key), NEVER, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.slot_key[at[left]] < 0]
            self.slot_key[at[free]] = keys[free]  # of several for one slot the last stays
            self.slot_rank[at[free]] = np.fromiter(self.rank.values(), np.int32, len(keys))[free]
            left = left[self.slot_key[at[left]] != keys[left]]
            at[left] += 1
        self.joined = np.array(self.merged, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 20 | right).ravel()
        at, out = self._slot(keys), np.full(len(keys), NEVER, np.int32)
        found = self.slot_key[at]
        hit = np.flatnonzero(found == keys)
        out[hit] = self.slot_rank[at[hit]]
        clash = np.flatnonzero((found != keys) & (found >= 0))
        while len(clash):
            at[clash] += 1
            found = self.slot_key[at[clash]]
            same = found == keys[clash]
            out[clash[same]] = self.slot_rank[at[clash[same]]]
            clash = clash[~same & (found >= 0)]
        return out.reshape(left.shape)

    def _forget(self) -> None:
        """Start the tables of seen fragments and of seen words anew; special tokens stand in the first."""
        key = (lambda x: x) if self.words else str.encode
        self.seen = {key(x): np.uint32(i).tobytes() for x, i in self.special.items()}
        self.parts: dict[str, bytes] = {}

    def fragments(self, text: str) -> list[bytes]:
        """The pieces of a text between certain boundaries."""
        raw = text.encode()
        if not raw:
            return []
        wide = any(x in raw for x in _WIDE_BYTES) and _WIDE_SPACE.search(text)
        table = self.cut_ascii if wide else self.cut  # a wide space ends in bytes that letters end in too
        codes = np.frombuffer(raw, np.uint8)
        places = [0, *(np.flatnonzero(table[codes[:-1], codes[1:]]) + 1).tolist(), len(raw)]
        return [raw[i:j] for i, j in zip(places, places[1:])]

    def _chunks(self, text: str) -> list[str]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python only
            return [x for x in re.split(f"[{SPACE}]+", text) if x]
        return text.split()

    def _run(self, text: str) -> list:
        cut = self._chunks if self.words else self.fragments
        if self.special_split is None or "<|" not in text:
            return cut(text)
        return [y for x in self.special_split.split(text) for y in (cut(x) if x not in self.special else [x if self.words else x.encode()])]

    def _slices(self, text: str) -> Iterator[str]:
        """A long text in slices that end before white space (after anything else), a boundary to every pre-tokeniser."""
        begin = 0
        while len(text) - begin > 2 * WINDOW and (m := _GAP.search(text, begin + WINDOW)):
            yield text[begin : m.start() + 1]
            begin = m.start() + 1
        yield text[begin:]

    def encode_many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers, special tokens' strings as their ids."""
        waiting: list[list] = []
        size = 0
        for text in texts:
            if len(text) > 2 * WINDOW:
                yield from self._look_up(waiting)
                waiting, size = [], 0
                yield b"".join(x for part in self._slices(text) for x in self._look_up([self._run(part)]))
                continue
            waiting.append(self._run(text))
            size += len(text)
            if size > WINDOW:
                yield from self._look_up(waiting)
                waiting, size = [], 0
        yield from self._look_up(waiting)

    def _look_up(self, runs: list[list]) -> list[bytes]:
        if len(self.seen) > self.keep:
            self._forget()
        look = self.seen.get
        found = [[*map(look, run)] for run in runs]
        holes = [[i for i, x in enumerate(ids) if x is None] if None in ids else () for ids in found]
        if missing := {run[i] for run, at in zip(runs, holes) for i in at}:
            self._fill([*missing])
            for run, ids, at in zip(runs, found, holes):
                for i in at:
                    ids[i] = self.seen[run[i]]
        return [b"".join(ids) for ids in found]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(next(iter(self.encode_many([text]))), "<u4")

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")

    def _fill(self, fragments: list) -> None:
        """Encode new fragments together: split each as the pre-tokeniser does, merge the new words of all at once."""
        find, parts = self.split.findall, self.parts
        if self.words:
            words = [find(self._normal(x)) for x in fragments]
        else:
            words = [find(x.decode()) for x in fragments]
        if new := [*{w for ws in words for w in ws if w not in parts}]:
            parts.update(zip(new, self._merge_many(new)))
        for fragment, ws in zip(fragments, words):
            self.seen[fragment] = parts[ws[0]] if len(ws) == 1 else b"".join(map(parts.__getitem__, ws))

    @staticmethod
    def _normal(chunk: str) -> str:
        if not chunk.isascii() and not unicodedata.is_normalized("NFC", chunk):
            chunk = unicodedata.normalize("NFC", chunk)
        return chunk.lower() if "Σ" not in chunk else "".join(c.lower() for c in chunk)

    def _merge_many(self, words: list[str]) -> list[bytes]:
        """Each word's ids. In every round each row of a table of words joins its pair of lowest rank, the leftmost of
        equals; rows without a ranked pair are done. Long words, and few, go one by one."""
        raws = [w.encode() for w in words]
        out: list[bytes] = [b""] * len(raws)
        by_width: dict[int, list[int]] = {}
        for i, raw in enumerate(raws):
            if len(raw) > 64 or len(raws) < FEW:
                ids = self._merge([*map(self.first.__getitem__, raw[:-1]), self.last[raw[-1]]])
                out[i] = np.array(ids, "<u4").tobytes()
            else:
                by_width.setdefault(-(-len(raw) // 4) * 4, []).append(i)
        first, last = np.array(self.first, np.int32), np.array(self.last, np.int32)
        for width, rows in by_width.items():
            codes = np.frombuffer(b"".join(raws[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(-1, width)
            size = np.array([len(raws[i]) for i in rows])
            ids = np.where(np.arange(width) < size[:, None], first[codes], -1)
            ids[np.arange(len(rows)), size - 1] = last[codes[np.arange(len(rows)), size - 1]]
            rows = np.array(rows)
            ranks = self._ranks_of(ids[:, :-1], ids[:, 1:])
            ranks[ids[:, 1:] < 0] = NEVER
            while True:
                at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
                low = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NEVER)
                more = low < NEVER
                done = np.flatnonzero(~more)
                ended = ids[done]
                flat, step = ended.astype("<u4").tobytes(), 4 * ended.shape[1]
                for k, (i, n) in enumerate(zip(rows[done].tolist(), (4 * (ended >= 0).sum(1)).tolist())):
                    out[i] = flat[k * step : k * step + n]
                if not more.any():
                    break
                rows, ids, ranks, at, low = rows[more], ids[more], ranks[more], at[more], low[more]
                k = np.arange(len(rows))
                ids[k, at] = self.joined[low]
                past = np.arange(ids.shape[1] - 1)
                ids = np.take_along_axis(ids, past + (past > at[:, None]), 1)
                past = past[:-1]
                ranks = np.take_along_axis(ranks, past + (past >= at[:, None]), 1)
                if ranks.shape[1]:
                    for where in (at - 1, at):
                        ok = (where >= 0) & (where < ranks.shape[1])
                        right = ids[k[ok], where[ok] + 1]
                        ranks[k[ok], where[ok]] = np.where(right < 0, NEVER, self._ranks_of(ids[k[ok], where[ok]], right))
        return out

    def _merge(self, ids: list[int]) -> list[int]:
        """Join the neighbours with the lowest rank, the leftmost first, until no pair has a rank."""
        if len(ids) > 200:
            return self._merge_long(ids)
        rank = self.rank.get
        ranks = [rank(pair, NEVER) for pair in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < NEVER:
            i = ranks.index(low)
            ids[i : i + 2] = [self.merged[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and linked neighbours, for runs where searching the list again would be quadratic."""
        n, rank = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.merged[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := rank((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]


_LOADED: dict[str, Bpe] = {}


def load(name: str, spec) -> Bpe:
    """The worker's own tokeniser, built once from the broadcast vocabulary file."""
    if name not in _LOADED:
        _LOADED[name] = Bpe(spec.value if hasattr(spec, "value") else spec)
    return _LOADED[name]


def broadcast_vocabulary(spark, path: str):
    """The vocabulary file's text for the workers: a few MB, the same whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x if x is not None else "" for x in batch.column(column).to_pylist()]
