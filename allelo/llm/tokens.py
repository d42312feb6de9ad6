"""Token counts by a compiled finite-state transducer for byte-pair-encoding vocabularies (SentencePiece models).

The encoding of a text by merges is unique, and a sequence of pieces is that encoding exactly if every two neighbours are:
merging the joined text of the two gives the two back. So the last piece of each prefix follows from the last pieces of
shorter prefixes, at most one piece length back. A state is what that needs: the longest end of the text that begins a
piece and, for each start from which a piece may still be completed, the last piece there and how many tokens the prefix
to that start has less than the whole. Reading a character leads to one state and emits the change of the token count.
Where no piece holds two neighbouring characters next to each other, nothing merges across and the state is reset.

States and transitions are compiled when first reached and kept in one dense table per task process, which is cleared
when it holds MAX_STATES states. A batch of texts is cut into chunks of CHUNK characters that run side by side. Each chunk is
a map from the state that enters it to the state that leaves it. A chunk with a reset maps every state to one; of others the
map is computed for the start state and then for all states that a chunk before it can leave, which soon are no new ones as
paths meet; equal chunks share a map. A parallel prefix scan composes the maps, each step over twice as many chunks, and gives
the state that enters each chunk. Counts of documents are differences of the running sum of emissions.

Characters outside the vocabulary count as their UTF-8 bytes. Defined cases: null and empty texts have 0 tokens; repeated
rows count alike; very long texts, also without any break, are many chunks; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

LIMIT = 4096
CHUNK = 512
MAX_STATES = 300_000
_SPACE = "▁"


class Transducer:
    """Counts tokens as the SentencePiece BPE model at ``path`` gives them (dummy prefix, no other normalisation)."""

    def __init__(self, path: str, max_states: int = MAX_STATES):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in usable}
        self.max_states = max_states
        inside = {c for p in self.score if len(p) > 1 for c in p}
        self.bigrams = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        # Character classes: those within longer pieces one each; other pieces; else by number of UTF-8 bytes.
        self.chars = sorted(inside)
        self.width = len(self.chars)
        self.class_of = np.empty(0x110000, np.int32)
        for n, (a, b) in enumerate(((0, 0x80), (0x80, 0x800), (0x800, 0x10000), (0x10000, 0x110000))):
            self.class_of[a:b] = -1 - (n + 1)
        for c in self.score:
            if len(c) == 1:
                self.class_of[ord(c)] = -1 - 1
        for i, c in enumerate(self.chars):
            self.class_of[ord(c)] = i
        self.class_of[ord(" ")] = self.class_of[ord(_SPACE)]
        self.joined = np.zeros((self.width, self.width), bool)
        at = {c: i for i, c in enumerate(self.chars)}
        for a, b in self.bigrams:
            self.joined[at[a], at[b]] = True
        self.prefixes = {p[:i] for p in self.score for i in range(len(p) + 1)}
        self._pair: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        self._clear()

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text by merging the best pair, leftmost first."""
        s = list(text)
        while len(s) > 1:
            best = max(((self.score.get(s[i] + s[i + 1], -np.inf), -i) for i in range(len(s) - 1)), default=None)
            if best is None or best[0] == -np.inf:
                break
            i = -best[1]
            s[i : i + 2] = [s[i] + s[i + 1]]
        return s

    def _fits(self, last: str | None, piece: str) -> bool:
        if last is None:
            if (ok := self._whole.get(piece)) is None:
                ok = self._whole[piece] = len(piece) == 1 or self.merged(piece) == [piece]
            return ok
        if (ok := self._pair.get((last, piece))) is None:
            ok = self._pair[last, piece] = self._fits(None, piece) and self.merged(last + piece) == [last, piece]
        return ok

    def _clear(self) -> None:
        self.columns = np.full(self.width, -1, np.int32)  # of the table, for the characters seen so far
        self.shown: list[str] = []
        start = ("", ((None, 0),))
        self.states, self.number = [start], {start: 0}
        self.next = np.full((1024, 64), -1, np.int32)
        self.emit = np.zeros((1024, 64), np.int8)

    def _step(self, state: tuple, char: str) -> tuple[tuple, int]:
        """A state is (text back to the earliest useful start, and for each position in it the last piece and count back)."""
        text, marks = state
        text += char
        best = None
        for k in range(len(text)):
            piece = text[k:]
            if marks[k] is not None and (piece in self.score or len(piece) == 1) and self._fits(marks[k][0], piece):
                best = piece, marks[k][1] + 1
                break
        piece, count = best
        moved = [m and (m[0], m[1] - count) for m in marks] + [(piece, 0)]
        keep = next((k for k in range(len(text)) if text[k:] in self.prefixes), len(text))
        text, moved = text[keep:], moved[keep:]
        # a start whose rest cannot grow to a piece is of no use any more; nor is what a cut hides
        marks = tuple(m if k == len(text) or text[k:] in self.prefixes else None for k, m in enumerate(moved))
        return (text, marks), count

    def _compile(self, cells: np.ndarray) -> None:
        """Fill (state, column) cells, given as unique state * width + column."""
        for cell in cells.tolist():
            s, c = divmod(cell, self.next.shape[1])
            state, emitted = self._step(self.states[s], self.shown[c])
            n = self.number.get(state)
            if n is None:
                n = self.number[state] = len(self.states)
                self.states.append(state)
                if n >= len(self.next):
                    more = len(self.next) // 2
                    self.next = np.concatenate([self.next, np.full_like(self.next[:more], -1)])
                    self.emit = np.concatenate([self.emit, np.zeros_like(self.emit[:more])])
            self.next[s, c] = n
            self.emit[s, c] = emitted

    def _show(self, classes: np.ndarray) -> None:
        for c in np.unique(classes[classes >= 0]).tolist():
            if self.columns[c] < 0:
                self.columns[c] = len(self.shown)
                self.shown.append(self.chars[c])
        while len(self.shown) > self.next.shape[1]:
            self.next = np.hstack([self.next, np.full_like(self.next[:, :16], -1)])
            self.emit = np.hstack([self.emit, np.zeros_like(self.emit[:, :16])])

    def _run(self, column: np.ndarray, reset: np.ndarray, start: np.ndarray, stop: np.ndarray, state: np.ndarray, emitted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Run lanes [start, stop) side by side from their states: their end states, and their emissions in all; puts the
        emissions per position in ``emitted``."""
        order = np.argsort(start - stop, kind="stable")  # longest first: the lanes that still run are a prefix
        at, end, s = start[order].copy(), stop[order], state[order].copy()
        length = end - at
        sums = np.zeros(len(at), np.int64)
        live = len(at)
        for step in range(int(length[0]) if len(length) else 0):
            while live and length[live - 1] <= step:
                live -= 1
            p = at[:live] + step
            here = s[:live]
            here[reset[p]] = 0
            c = column[p]
            inner = c >= 0
            cell = here * self.next.shape[1] + np.where(inner, c, 0)
            new = self.next.ravel()[cell]
            if (missing := inner & (new < 0)).any():
                self._compile(np.unique(cell[missing]))
                new = self.next.ravel()[cell]
            count = np.where(inner, self.emit.ravel()[cell], -1 - c)
            sums[:live] += count
            if emitted is not None:
                emitted[p] = count
            s[:live] = np.where(inner, new, 0)
        out, total = np.empty_like(state), np.empty_like(sums)
        out[order], total[order] = s, sums
        return out, total

    def _enter(self, column: np.ndarray, reset: np.ndarray, begin: np.ndarray, stop: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state that enters each chunk, and the emissions of those without a reset. ``ends``: the state that leaves a
        chunk with a reset, -1 for others."""
        open_ = np.flatnonzero(ends < 0).tolist()
        content: dict[bytes, int] = {}
        same = {j: content.setdefault(column[begin[j] : stop[j]].tobytes(), len(content)) for j in open_}
        maps: dict[tuple[int, int], tuple[int, int]] = {}  # (content, entering state): leaving state, emissions
        sets = {j: [0] for j in open_}
        grown = True
        while grown:
            wanted = {(same[j], s): j for j in open_ for s in sets[j] if (same[j], s) not in maps}
            lanes = np.array(list(wanted.values()), np.int64)
            left, count = self._run(column, reset, begin[lanes], stop[lanes], np.array([s for _, s in wanted], np.int64))
            maps.update(zip(wanted, zip(left.tolist(), count.tolist(), strict=True), strict=True))
            grown = False
            for j in open_:
                for s in [int(ends[j - 1])] if ends[j - 1] >= 0 else [maps[same[j - 1], x][0] for x in sets[j - 1] if (same[j - 1], x) in maps]:
                    if s not in sets[j]:
                        sets[j].append(s)
                        grown = True
        # maps between the numbers of states in the sets of neighbouring chunks (a chunk with a reset: one number for all)
        width = max(map(len, sets.values()), default=1)
        number = {j: {s: i for i, s in enumerate(x)} for j, x in sets.items()}
        scan = np.zeros((len(begin), width), np.int64)
        for j in range(len(begin) - 1):
            to = number.get(j + 1)
            if to is not None:
                scan[j, :] = to[int(ends[j])] if ends[j] >= 0 else 0
                if ends[j] < 0:
                    scan[j, : len(sets[j])] = [to[maps[same[j], s][0]] for s in sets[j]]
        step = 1
        while step < len(scan):
            scan[step:] = np.take_along_axis(scan[step:], scan[:-step], 1)
            step *= 2
        into, emissions = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        for j in open_:
            s = sets[j][scan[j - 1, 0]]
            emissions[j] = maps[same[j], s][1]
            if j + 1 < len(begin):
                into[j + 1] = maps[same[j], s][0]
        after = np.flatnonzero(ends[:-1] >= 0) + 1
        into[after] = ends[after - 1]
        return into, emissions

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        if len(self.states) > self.max_states:
            self._clear()
        parts = [" " + t if t else "" for t in texts]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        if not len(code):
            return np.zeros(len(texts), np.int64)
        cls = self.class_of[code]
        self._show(cls)
        column = np.where(cls >= 0, self.columns[np.maximum(cls, 0)], cls + 0)
        reset = np.ones(len(code), bool)
        inner = (cls[1:] >= 0) & (cls[:-1] >= 0)
        reset[1:] = ~(inner & self.joined[np.maximum(cls[:-1], 0), np.maximum(cls[1:], 0)])
        reset[bounds[:-1][lengths > 0]] = True
        # chunks, and in each the first reset
        begin = np.arange(0, len(code), CHUNK)
        stop = np.minimum(begin + CHUNK, len(code))
        resets = np.flatnonzero(reset)
        first = np.searchsorted(resets, begin)
        first = np.where(first < len(resets), resets[np.minimum(first, len(resets) - 1)], len(code))
        lanes = np.flatnonzero(first < stop)
        emitted = np.zeros(len(code), np.int64)
        ends = np.full(len(begin), -1, np.int64)
        ends[lanes], _ = self._run(column, reset, first[lanes], stop[lanes], np.zeros(len(lanes), np.int64), emitted)
        into, whole = self._enter(column, reset, begin, stop, ends)
        self._run(column, reset, begin[lanes], first[lanes], into[lanes], emitted)
        emitted[begin] += whole
        total = np.concatenate([[0], np.cumsum(emitted)])
        return total[bounds[1:]] - total[bounds[:-1]]


_built: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One per process, with what it has compiled so far."""
    if path not in _built:
        _built[path] = Transducer(path)
    return _built[path]


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit. The model file must be at the same path on every worker."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        n = transducer(model_path).count(texts)
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).cast(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_slices(docs.select("doc_id", F.col("text")), run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
