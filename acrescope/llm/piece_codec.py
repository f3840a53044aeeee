"""SentencePiece encoding and decoding for merge-type vocabularies: agendas of adjacent symbol pairs, best score first."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrescope.llm.common import SpanIds, small_batches, text_slices

TEXT_SLICE = 2 << 20
LONG_SPAN = 128  # characters above which a span has a heap of its own
_MARK = "▁"


class PieceModel:
    """Vocabulary and merge table of a model file, with a store of recent spans.

    Supported: merge-type models with byte fallback, no text normalisation, a
    space put before each text, and pieces that hold a space only at their
    start. Then no merge crosses the start of a run of spaces, so the spans
    between such places are encoded apart.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(open(path, "rb").read())
        rules, trained = spec.normalizer_spec, spec.trainer_spec
        plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces and not trained.treat_whitespace_as_suffix
        if trained.model_type != 2 or not trained.byte_fallback or not plain:
            raise ValueError(f"{path} is not a merge-type model with byte fallback and plain text rules")
        normal = {p.piece: k for k, p in enumerate(spec.pieces) if p.type == 1}
        if any(_MARK in p.lstrip(_MARK) for p in normal) or any(p.type in (4, 5) for p in spec.pieces):
            raise ValueError(f"{path} has pieces that cross spaces, or user-defined or unused ones")
        self.n = len(spec.pieces)
        self.unknown, self.end = self.library.unk_id(), self.library.eos_id()
        self.byte = np.array([self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        # symbols: pieces by id, then single characters that are none
        self.symbol = dict(normal)
        for piece in normal:
            for c in piece:
                self.symbol.setdefault(c, self.n + len(self.symbol))
        self.of_char = np.full(0x110000, -1, np.int64)
        for text, k in self.symbol.items():
            if len(text) == 1:
                self.of_char[ord(text)] = k
        self.of_char[ord(" ")] = self.of_char[ord(_MARK)]
        self.base = max(self.symbol.values()) + 2
        order = {s: r for r, s in enumerate(sorted({spec.pieces[k].score for k in normal.values()}))}
        pairs = {}
        for piece, k in normal.items():
            for cut in range(1, len(piece)):
                a, b = self.symbol.get(piece[:cut]), self.symbol.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = (order[spec.pieces[k].score], k)
        self.pair = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[int(k)][0] for k in self.pair], np.int64)
        self.merged = np.array([pairs[int(k)][1] for k in self.pair], np.int64)
        self.pairs = pairs
        self.surface = [self._bytes(p, k) for k, p in enumerate(spec.pieces)]
        self.decimal = [str(k).encode() for k in range(self.n)]
        self.store = SpanIds(self.encode_spans)

    def _bytes(self, piece, k: int) -> bytes:
        if piece.type == 6:
            return bytes([int(piece.piece[3:5], 16)])
        if piece.type == 2:
            return self.library.decode([k]).encode()
        return b"" if piece.type == 3 else piece.piece.replace(_MARK, " ").encode()

    # --- encoding -----------------------------------------------------------
    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or -1, merged symbol) of neighbours."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], -1), self.merged[at]

    def _agendas(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final (symbols, span) of many short spans: in each round every span merges its best pair, the leftmost of equals."""
        done_sym, done_word = [], []
        rank, merged = np.full(len(sym), -1), np.zeros(len(sym), np.int64)
        pair = np.flatnonzero(word[1:] == word[:-1])
        rank[pair], merged[pair] = self._look(sym[pair], sym[pair + 1])
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            value = (rank << 32) + (0xFFFFFFFF - np.arange(len(sym)))
            best = np.maximum.reduceat(value, first)
            active = best >= 0
            size = np.diff(np.append(first, len(sym)))
            go = np.repeat(active, size)
            done_sym.append(sym[~go])
            done_word.append(word[~go])
            at = 0xFFFFFFFF - (best[active] & 0xFFFFFFFF)
            sym[at] = merged[at]
            go[at + 1] = False  # its right neighbour is part of it now
            moved = (np.cumsum(go) - 1)[at]
            sym, word, rank, merged = sym[go], word[go], rank[go], merged[go]
            for k in (moved, moved[moved > 0] - 1):
                inside = np.zeros(len(k), bool)
                near = k + 1 < len(sym)
                inside[near] = word[k[near]] == word[k[near] + 1]
                rank[k[~inside]] = -1
                k = k[inside]
                rank[k], merged[k] = self._look(sym[k], sym[k + 1])
        return np.concatenate(done_sym or [sym]), np.concatenate(done_word or [word])

    def _agenda(self, symbols: list[int]) -> list[int]:
        """One long span: a heap of pairs, entries of gone symbols skipped."""
        sym: list = list(symbols)
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap = []

        def push(i):
            j = after[i]
            if j < len(sym) and sym[i] >= 0 and sym[j] >= 0:
                found = self.pairs.get(sym[i] * self.base + sym[j])
                if found:
                    heapq.heappush(heap, (-found[0], i, sym[i], sym[j], found[1]))

        for i in range(len(sym) - 1):
            push(i)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i] if sym[i] is not None else len(sym)
            if sym[i] != a or j >= len(sym) or sym[j] != b:
                continue
            sym[i], sym[j] = merged, None
            after[i] = after[j]
            if after[j] < len(sym):
                before[after[j]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return [s for s in sym if s is not None]

    def encode_spans(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each span), each compared with the library's."""
        if not spans:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        texts = [s.decode() for s in spans]
        size = np.array([len(t) for t in texts])
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(texts)), size)
        # a character that is no symbol stands as -2 - code point until the end
        sym = self.of_char[chars]
        sym = np.where(sym < 0, -2 - chars, sym)
        short = (size <= LONG_SPAN)[word]
        ids, owner = self._agendas(sym[short], word[short])
        parts, owners = [ids], [owner]
        begin = np.cumsum(size) - size
        for k in np.flatnonzero(size > LONG_SPAN):
            found = self._agenda(sym[begin[k]:begin[k] + size[k]].tolist())
            parts.append(np.array(found, np.int64))
            owners.append(np.full(len(found), k))
        ids, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        ids, owner = ids[order], owner[order]
        ids, owner = self._bytes_for_unknown(ids, owner)
        count = np.bincount(owner, minlength=len(spans))
        self._check(texts, ids, count)
        return ids.astype(np.int32), count

    def _bytes_for_unknown(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odd = (ids < 0) | (ids >= self.n)
        if not odd.any():
            return ids, owner
        back = {k: ord(t) for t, k in self.symbol.items() if k >= self.n}
        out, who = [], []
        for i, o in zip(ids.tolist(), owner.tolist()):
            new = [i] if 0 <= i < self.n else self.byte[list(chr(-2 - i if i < 0 else back[i]).encode())].tolist()
            out += new
            who += [o] * len(new)
        return np.array(out, np.int64), np.array(who, np.int64)

    def _check(self, texts: list[str], ids: np.ndarray, count: np.ndarray) -> None:
        """Every span opens with the space that the library puts before a text."""
        cuts = np.concatenate([[0], np.cumsum(count)])
        flat = ids.tolist()
        for k, want in enumerate(self.library.encode([t[1:] for t in texts], num_threads=1)):
            if flat[cuts[k]:cuts[k + 1]] != want and len(texts[k]) > 1:
                raise ValueError(f"span {texts[k]!r}: ids {flat[cuts[k]:cuts[k + 1]]}, the library has {want}")

    def encode(self, texts: pa.Array) -> Iterator[list[int]]:
        """Ids of each whole text with the end id; null reads as empty."""
        for _, _, data, offsets in text_slices(texts, TEXT_SLICE):
            raw = data.tobytes()
            rows = [raw[a:b].replace(_MARK.encode(), b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            rows = [b" " + r if r else r for r in rows]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            data = np.frombuffer(b"".join(rows), np.uint8)
            space = data == 32
            open_ = space.copy()
            open_[1:] &= ~space[:-1]
            open_[offsets[:-1][offsets[:-1] < len(data)]] = True
            starts = np.flatnonzero(open_)
            ids, count = self.store.ids(data, starts, np.append(starts[1:], len(data)) if len(starts) else starts)
            cuts, flat = count[np.searchsorted(starts, offsets)], ids.tolist()
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield [*flat[a:b], self.end]

    # --- decoding -----------------------------------------------------------
    def decode(self, ids: list[int]) -> bytes:
        """The text of ids in UTF-8: control ids vanish and the first piece loses one leading space."""
        begin = next((k for k, i in enumerate(ids) if self.surface[i]), None)
        if begin is None:
            return b""
        parts = list(map(self.surface.__getitem__, ids))
        if parts[begin].startswith(b" ") and ids[begin] != self.unknown and not 0 <= ids[begin] - int(self.byte[0]) < 256:
            parts[begin] = parts[begin][1:]
        out = b"".join(parts)
        try:
            out.decode()
        except UnicodeDecodeError:  # byte pieces that make no character
            return self.library.decode(ids).encode()
        return out


_models: dict[str, PieceModel] = {}


def load_model(path: str) -> PieceModel:
    """A model, loaded once per Python worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_pieces(docs: DataFrame, model: str, *, text: str = "text", into: str = "ids", count: str = "n_tokens") -> DataFrame:
    """The documents without their text, with its ids (array<int>, end id last) and their number.

    Null and empty texts have the end id alone. Other columns stay; rows stay.
    """
    keep = [c for c in docs.columns if c not in (text, into, count)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load_model(model)
        for batch in small_batches(batches):
            ids = [np.array(i, np.int32) for i in coder.encode(batch.column(text))]
            size = np.array([len(i) for i in ids], np.int64)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists, pa.array(size)], names=[*keep, into, count])

    schema = docs.select(*[c for c in docs.columns if c in keep], F.lit(None).cast("array<int>").alias(into), F.lit(None).cast("long").alias(count)).schema
    return docs.mapInArrow(run, schema)


def decode_pieces(rows: DataFrame, model: str, *, ids: str = "ids", into: str = "text") -> DataFrame:
    """The rows with ``into``, the text of their ids; null ids give a null text."""
    keep = [c for c in rows.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load_model(model)
        for batch in small_batches(batches):
            texts = [None if i is None else coder.decode(i).decode() for i in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, into])

    return rows.mapInArrow(run, rows.select(*keep, F.lit(None).cast("string").alias(into)).schema)


def round_trip_digests(docs: DataFrame, model: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256, without moving the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load_model(model)
        for batch in batches:
            n, one, two = [], [], []
            for ids in coder.encode(batch.column("text")):
                n.append(len(ids))
                one.append(hashlib.sha256(b" ".join(map(coder.decimal.__getitem__, ids))).hexdigest())
                two.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
