"""Token counts of byte-level merge vocabularies: a heap of adjacent pairs over a linked list, no ids emitted."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrescope.llm.common import small_batches, span_hash, text_slices

TEXT_SLICE = 2 << 20
PART = 1 << 20  # bytes after which a long text is cut before the next white space
STORE = 1_000_000  # spans a worker remembers
_SPACE, _LETTER, _NUMBER, _OTHER, _OPEN = range(5)
_CUT = re.compile(rb"[!-~](?=[ \t\n])")


class CountModel:
    """Merge table of a vocabulary file and the counts of spans met lately.

    Supported: byte-level merges with the usual split into contractions, letters,
    numbers, other signs and white space, no text normalisation, and added tokens
    that match as they stand. Anything else in the file is a ValueError.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
        if model["type"] != "BPE" or any(odd) or spec["normalizer"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError(f"{path} is not a plain byte-level merge vocabulary")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        self.library = Tokenizer.from_file(path)
        self.added = sorted((t["content"].encode() for t in spec["added_tokens"]), key=len, reverse=True)
        self.added_at = re.compile(b"|".join(map(re.escape, self.added))) if self.added else None
        vocab = model["vocab"]
        # printable bytes stand for themselves, the others for the characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.symbol = [vocab[sign[b]] for b in range(256)]
        self.base = max(vocab.values()) + 1
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[a] * self.base + vocab[b]] = (rank, vocab[a + b])
        self.kind = np.full(0x110000, _OPEN, np.uint8)
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.count, self.seen, self.clock = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    # --- one span ---------------------------------------------------------------
    def merges(self, span: bytes) -> int:
        """How often two neighbours become one symbol: the pair of lowest rank first, the leftmost of equals."""
        sym: list = [self.symbol[b] for b in span]
        n, base, pairs = len(sym), self.base, self.pairs
        heap = []
        for i in range(n - 1):
            found = pairs.get(sym[i] * base + sym[i + 1])
            if found:
                heap.append((found[0], i, found[1]))
        if not heap:
            return 0
        heapq.heapify(heap)
        after, before, done = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            rank, i, merged = heapq.heappop(heap)
            j = after[i]
            if sym[i] < 0 or j >= n or pairs.get(sym[i] * base + sym[j], (-1,))[0] != rank:
                continue  # one of the two is part of another symbol by now
            sym[i], sym[j], after[i] = merged, -1, after[j]
            done += 1
            if after[j] < n:
                before[after[j]] = i
                found = pairs.get(merged * base + sym[after[j]])
                if found:
                    heapq.heappush(heap, (found[0], i, found[1]))
            if before[i] >= 0:
                found = pairs.get(sym[before[i]] * base + merged)
                if found:
                    heapq.heappush(heap, (found[0], before[i], found[1]))
        return done

    # --- spans of a slice ---------------------------------------------------------
    def _kinds(self, chars: np.ndarray) -> np.ndarray:
        """Kind of each character; new characters are classed by the library's own split."""
        kinds = self.kind[chars]
        if (kinds == _OPEN).any():
            for c in np.unique(chars[kinds == _OPEN]).tolist():
                one = [k for k, head in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!"))
                       if len(self.library.pre_tokenizer.pre_tokenize_str(head + chr(c))) == 1]
                self.kind[c] = one[0] if one else _SPACE
            kinds = self.kind[chars]
        return kinds

    def _starts(self, chars: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """Whether a span starts at each character; ``opens`` are the positions where a part starts."""
        kinds, n = self._kinds(chars), len(chars)
        border = np.zeros(n + 1, bool)
        border[opens] = border[n] = True
        start = border[:n].copy()
        start[1:] |= kinds[1:] != kinds[:-1]
        # the last sign of white space before anything else stands apart; a blank belongs to what follows
        last = np.flatnonzero((kinds[:-1] == _SPACE) & (kinds[1:] != _SPACE) & ~border[1:n])
        start[last] = True
        start[last[chars[last] == 32] + 1] = False
        # 's 't 'm 'd 're 've 'll are spans of their own where no blank belongs to them
        at = np.flatnonzero(start[:-1] & (chars[:-1] == 39) & (kinds[1:] == _LETTER) & ~border[1:n])
        one, two = chars[at + 1], np.where(border[np.minimum(at + 2, n)], 0, chars[np.minimum(at + 2, n - 1)])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[at[short | long] + 1] = False
        end = np.concatenate([at[short] + 2, at[long & ~short] + 3])
        start[end[end < n]] = True
        return start

    def _parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions where parts start, those that are added tokens): texts, cut at added tokens and, if long, before white space."""
        raw, cuts, whole = data.tobytes(), [], []
        if self.added_at and any(t in raw for t in self.added):
            rows = offsets.tolist()
            for a, b in zip(rows[:-1], rows[1:]):
                for m in self.added_at.finditer(raw, a, b):
                    cuts += [m.start(), m.end()]
                    whole.append(m.start())
        for row in np.flatnonzero(np.diff(offsets) > 2 * PART).tolist():
            at = int(offsets[row]) + PART
            while (m := _CUT.search(raw, at, int(offsets[row + 1]))) is not None:
                cuts.append(m.end())
                at = m.end() + PART
        if whole and len(cuts) > 2 * len(whole):  # no cut inside an added token
            held = np.array(whole)
            at = np.maximum(np.searchsorted(held, cuts, "right") - 1, 0)
            cuts = [c for c, w in zip(cuts, held[at]) if not w < c < self.added_at.match(raw, w).end()]
        parts = np.unique(np.concatenate([offsets[:-1], np.array(cuts, np.int64)]))
        return parts[parts < len(data)], np.array(whole, np.int64)

    def count_slice(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row of a slice."""
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64)
        parts, whole = self._parts(data, offsets)
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each character
        chars = data if len(lead) == len(data) else np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        starts = lead[self._starts(chars, np.searchsorted(lead, parts))]
        ends = np.append(starts[1:], len(data))
        tokens = np.zeros(len(starts), np.int64)
        special = np.zeros(len(starts), bool)
        if len(whole):  # an added token is one token, whatever spans it would hold
            stop = np.array([self.added_at.match(data.tobytes(), w).end() for w in whole.tolist()])
            inside = np.searchsorted(whole, starts, "right") - 1
            special = (inside >= 0) & (starts < stop[inside])
            tokens[np.searchsorted(starts, whole)] = 1
        tokens[~special] = self._span_counts(data, starts[~special], ends[~special])
        total = np.concatenate([[0], np.cumsum(tokens)])
        return np.diff(total[np.searchsorted(starts, offsets)])

    def _span_counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each span; equal spans, known by two 64-bit hashes, are merged once."""
        if not len(starts):
            return np.zeros(0, np.int64)
        raw = data.tobytes()
        fresh_count = lambda k: int(ends[k] - starts[k]) - self.merges(raw[starts[k]:ends[k]])
        one, two = span_hash(data, starts, ends, 0), span_hash(data, starts, ends, 1)
        key, first, inverse = np.unique(one, return_index=True, return_inverse=True)
        check = two[first]
        if (check[inverse] != two).any():  # two spans share a hash: this slice goes without the store
            return np.array([fresh_count(k) for k in range(len(starts))], np.int64)
        self.clock += 1
        counts = np.zeros(len(key), np.int64)
        place = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        known = (self.key[place] == key) & (self.check[place] == check) if len(self.key) else np.zeros(len(key), bool)
        counts[known] = self.count[place[known]]
        self.seen[place[known]] = self.clock
        fresh = np.flatnonzero(~known)
        counts[fresh] = [fresh_count(k) for k in first[fresh].tolist()]
        place = np.searchsorted(self.key, key[fresh])
        for name, new in (("key", key[fresh]), ("check", check[fresh]), ("count", counts[fresh]), ("seen", np.full(len(fresh), self.clock))):
            setattr(self, name, np.insert(getattr(self, name), place, new))
        if len(self.key) > STORE:  # the half not met for longest leaves
            stay = np.sort(np.argsort(-self.seen, kind="stable")[:STORE // 2])
            self.key, self.check, self.count, self.seen = self.key[stay], self.check[stay], self.count[stay], self.seen[stay]
        return counts[inverse]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each whole text; null reads as empty."""
        found = [self.count_slice(data, offsets) for _, _, data, offsets in text_slices(texts, TEXT_SLICE)]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


_models: dict[str, CountModel] = {}


def load_model(path: str) -> CountModel:
    """A model, loaded once per Python worker."""
    if path not in _models:
        _models[path] = CountModel(path)
    return _models[path]


def count_tokens(docs: DataFrame, model: str, limit: int, *, text: str = "text", n_bytes: str = "n_bytes", n_tokens: str = "n_tokens",
                 over: str = "over_limit") -> DataFrame:
    """The rows without their text, with its bytes in UTF-8, its tokens and whether these are more than ``limit``.

    A null text counts as empty: no bytes, no tokens. Strings of added tokens in a
    text count as one token each, as the library takes them. Every row stays, also
    repeated ones and those with null ids; other columns stay, but columns named
    like the three new ones give way to them. An empty table gives an empty one.
    Texts are counted whole, long ones in parts that no span crosses.
    """
    keep = [c for c in docs.columns if c not in (text, n_bytes, n_tokens, over)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load_model(model)
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counter.counts(batch.columns[-1]), pa.int64())], names=[*keep, n_bytes, n_tokens])

    given = docs.select(*keep, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias(n_bytes), F.col(text))
    schema = docs.select(*keep, F.lit(0).cast("long").alias(n_bytes), F.lit(0).cast("long").alias(n_tokens)).schema
    return given.mapInArrow(run, schema).withColumn(over, F.col(n_tokens) > limit)
