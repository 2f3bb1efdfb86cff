"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model is compiled into arrays:
- the normaliser, as the model file states it (a leading space, space to U+2581);
- the pieces as a trie, one state per prefix; a final state writes its piece at weight -score;
- byte fallback: a character that is no piece writes its UTF-8 bytes at BYTE_WEIGHT each;
- for a BPE model, an acceptor of neighbouring pieces: a pair weighs nothing where merging the two
  texts together gives just these two pieces, and infinitely much elsewhere. A sequence of pieces is
  the model's own encoding exactly if every neighbouring pair is such, so of all paths into a prefix
  one at most has finite weight. A unigram model has no such acceptor and the scores alone decide.
  Which of the two it is, the model file states.
Composed with a text that is a lattice whose states are (characters read, last piece); the encoding
is the path of least total weight (tropical semiring).

No piece crosses the start of a word, nor certain punctuation (found from the pieces themselves), so
the lattice falls apart into short segments. A worker composes all new segments of a batch at once
(`paths`): the trie is walked from every character in step, and the least weights are relaxed one
column of all lattices at a time. Longer segments, and those with byte fallback, go one by one
(`path`). Paths of short segments are remembered.

Defined results: a null or empty text has no pieces; any other text decodes to itself (U+2581 in it
becomes a space, as in SentencePiece itself); rows that repeat a doc_id are encoded each for itself;
an empty table gives an empty result; other columns are dropped. A model whose normaliser maps
characters, removes white space or writes none is refused with an error.
"""

from __future__ import annotations

import re
import string
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnspark.llm.common import sliced, table

SPACE = "▁"
#: Segments, and pairs of pieces, that a worker remembers; longer segments are not kept.
CACHE, LONGEST = 700_000, 48
#: Weight of a byte of a character that only its bytes can spell: above any path of pieces.
BYTE_WEIGHT = 1e6
#: Segments composed at once, and slots for the admissibility of pairs of pieces.
AT_ONCE, SLOTS = 1 << 14, 1 << 21


def proto_fields(raw: bytes):
    """(number, value) of each field of a protocol buffer message; bytes for nested and fixed-size ones."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, raw[at : at + size]
            at += size


def check_model(raw: bytes) -> bool:
    """Whether a model file is BPE (else unigram); an error where its normaliser is not of the plain kind.

    Field numbers are those of SentencePiece's public model format: trainer 2 (model type 3),
    normaliser 3 (character map 2, leading space 3, white space removed 4, spaces escaped 5).
    """
    top = dict(proto_fields(raw))
    trainer, normaliser = (dict(proto_fields(top.get(n, b""))) for n in (2, 3))
    if normaliser.get(2) or not normaliser.get(3, 1) or normaliser.get(4, 1) or not normaliser.get(5, 1) or trainer.get(24, 0):
        raise ValueError("a model whose normaliser is not 'leading space, spaces escaped' cannot be compiled")
    if trainer.get(3, 1) not in (1, 2):
        raise ValueError("only unigram and BPE models can be compiled")
    return trainer.get(3, 1) == 2


class Transducer:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id_of = {model.id_to_piece(i): i for i in normal}
        self.weight = {i: -model.get_score(i) for i in normal}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.text_of = {i: p for p, i in self.id_of.items()}
        self.bytes_of = {i: p.replace(SPACE, " ").encode() for p, i in self.id_of.items()} | {i: bytes([b]) for b, i in self.byte.items()}
        #: Lengths of pieces by their last one and two characters, longest first: the arcs that can end there.
        ends: dict[str, set[int]] = {}
        for p in self.id_of:
            ends.setdefault(p[-2:], set()).add(len(p))
        for p, n in ends.items():
            n.update({1} & ends.get(p[-1], set()))
        self.lengths = {c: sorted(n, reverse=True) for c, n in ends.items()}
        self.merges = check_model(model.serialized_model_proto())
        self.known: dict[str, bytes] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.segment = re.compile(self._segments())
        size = model.vocab_size()
        #: By id: weight, and the bytes it stands for.
        self.weights = np.array([self.weight.get(i, BYTE_WEIGHT) for i in range(size)])
        spelt = [self.bytes_of.get(i, b"") for i in range(size)]
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.spelt_len = np.array([len(x) for x in spelt])
        self.spelt_at = np.cumsum(self.spelt_len) - self.spelt_len
        self._compile()
        self.pair_key, self.pair_ok = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)

    def _compile(self) -> None:
        """The trie: moves (state, symbol) -> state, the piece each state writes, symbols of characters."""
        letters = sorted({c for p in self.id_of for c in p})
        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.symbols = len(letters) + 1
        self.alone = np.zeros(0x110000, bool)
        self.alone[[ord(p) for p in self.id_of if len(p) == 1]] = True
        number, writes, moves = {"": 0}, [-1], []
        for p in sorted(self.id_of):
            for k in range(1, len(p) + 1):
                if p[:k] not in number:
                    number[p[:k]] = len(number)
                    writes.append(-1)
                    moves.append(number[p[: k - 1]] * self.symbols + int(self.symbol[ord(p[k - 1])]))
            writes[number[p]] = self.id_of[p]
        self.writes, self.moves = np.array(writes, np.int32), pd.Index(np.array(moves, np.int64))
        self.deepest = max(map(len, self.id_of))

    def _segments(self) -> str:
        apart = set(string.punctuation)
        while True:  # punctuation that no piece joins to anything but U+2581 and its like
            bad = {c for p in self.id_of for a, b in zip(p, p[1:]) if SPACE not in (a, b) and (a in apart) != (b in apart) for c in (a, b) if c in apart}
            if not bad:
                break
            apart -= bad
        inside = any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        if inside:
            return r"(?s).+"
        marks = "".join(map(re.escape, sorted(apart)))
        newline = "" if any("\n" in p for p in self.id_of) else r"\n"
        one = rf"{SPACE}*[{marks}]+|" if marks else ""
        return rf"{one}{SPACE}*[^{SPACE}{newline}{marks}]+|{SPACE}+" + (rf"|{newline}+" if newline else "")

    def _merged(self, parts: list[str]) -> list[str]:
        """The model's merges over neighbouring parts: the best-scored first, the leftmost of equals."""
        while len(parts) > 1:
            best = min(((self.weight[self.id_of[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.id_of), default=None)
            if best is None:
                return parts
            k = best[1]
            parts = [*parts[:k], parts[k] + parts[k + 1], *parts[k + 2 :]]
        return parts

    def _may_follow(self, last: int, piece: int) -> bool:
        """last: -1 at a start or after bytes."""
        if (ok := self.follows.get((last, piece))) is None:
            a, b = self.text_of[last] if last >= 0 else "", self.text_of[piece]
            ok = not self.merges or self._merged(list(a + b)) == ([a, b] if a else [b])
            if len(self.follows) > 2 * CACHE:
                self.follows.clear()
            self.follows[last, piece] = ok
        return ok

    def path(self, s: str) -> tuple[list[int], float]:
        """Piece ids of the least-weight path over the normalised segment s, and its weight."""
        n, id_of, weight, follows, lengths = len(s), self.id_of, self.weight, self.follows, self.lengths
        cost, last, back = [0.0] + [float("inf")] * n, [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            c = s[i - 1]
            for length in lengths.get(s[i - 2 : i] if i > 1 else c) or lengths.get(c, ()):
                if length > i or (piece := id_of.get(s[i - length : i])) is None:
                    continue
                j = i - length
                ok = follows.get((last[j], piece))
                if ok or (ok is None and self._may_follow(last[j], piece)):
                    total = cost[j] + weight[piece]
                    if total < cost[i]:
                        cost[i], last[i], back[i] = total, piece, j
                    if self.merges:
                        break  # the only arc into this prefix
            if c not in id_of and (total := cost[i - 1] + BYTE_WEIGHT * len(c.encode())) < cost[i]:
                cost[i], last[i], back[i] = total, -1, i - 1
        out, i = [], n
        while i:
            out.append([last[i]] if last[i] >= 0 else [self.byte[b] for b in s[back[i] : i].encode()])
            i = back[i]
        return [x for part in reversed(out) for x in part], cost[n]

    def _admissible(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """_may_follow of many pairs, through a table that a later pair in the same slot overwrites."""
        key = (last.astype(np.int64) + 1) * len(self.weights) + piece
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS.bit_length() + 1)).view(np.int64)
        lacking = np.flatnonzero(self.pair_key[slot] != key)
        ok = self.pair_ok[slot]
        if len(lacking):
            new, back = np.unique(key[lacking], return_inverse=True)
            told = np.fromiter((self._may_follow(k // len(self.weights) - 1, k % len(self.weights)) for k in new.tolist()), bool, len(new))
            ok[lacking] = told[back]
            self.pair_key[slot[lacking]], self.pair_ok[slot[lacking]] = key[lacking], ok[lacking]
        return ok

    def paths(self, segments: list[str]) -> dict[str, bytes]:
        """Piece ids (int32) of the least-weight path over each segment; every character must be a piece."""
        segments = sorted(segments, key=len, reverse=True)
        code = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        size = np.array(list(map(len, segments)))
        first = np.cumsum(size) - size
        stop = np.repeat(first + size, size)
        # the lattice's arcs: writes[d][p] is the piece of length d + 1 that starts at character p
        sym, at, state = self.symbol[code], np.arange(len(code)), np.zeros(len(code), np.int64)
        writes = np.full((self.deepest, len(code)), -1, np.int32)
        for d in range(self.deepest):
            state = self.moves.get_indexer(state * self.symbols + sym[at + d]) + 1
            on = state > 0
            at, state = at[on], state[on]
            writes[d, at] = self.writes[state]
            on = at + d + 1 < stop[at]
            at, state = at[on], state[on]
            if not len(at):
                break
        # columns: after i characters of every segment that has so many; row s of segment s starts at node[s]
        node = first + np.arange(len(segments))
        total = len(code) + len(segments)
        cost, last, back = np.full(total, np.inf), np.full(total, -1, np.int32), np.zeros(total, np.int32)
        cost[node] = 0
        depth = int(size[0]) if len(size) else 0
        for i in range(1, depth + 1):
            rows = np.arange(int(np.searchsorted(-size, -i, side="right")))
            for d in range(min(i, self.deepest), 0, -1):
                piece = writes[d - 1, first[rows] + i - d]
                hit = np.flatnonzero(piece >= 0)
                if not len(hit):
                    continue
                who, piece = rows[hit], piece[hit]
                source = node[who] + i - d
                weight = cost[source] + self.weights[piece]
                better = weight < cost[node[who] + i]
                if self.merges:
                    better &= self._admissible(last[source], piece)
                who, goal = who[better], node[who[better]] + i
                cost[goal], last[goal], back[goal] = weight[better], piece[better], i - d
                if self.merges:  # all other arcs into this prefix weigh infinitely much
                    rows = np.delete(rows, hit[better])
        rows, place, steps = np.arange(len(segments)), size.copy(), []
        while len(rows):
            here = node[rows] + place
            step = np.full(len(segments), -1, np.int32)
            step[rows] = last[here]
            steps.append(step)
            place = back[here]
            rows, place = rows[place > 0], place[place > 0]
        if not steps:
            return {}
        table_ = np.stack(steps[::-1], axis=1)
        on = table_ >= 0
        raw, ends = table_[on].astype("<i4").tobytes(), (4 * np.cumsum(on.sum(axis=1))).tolist()
        return dict(zip(segments, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=False))

    def _learn(self, new: list[str]) -> None:
        many = []
        for s in new:
            if len(s) <= LONGEST and self.alone[np.frombuffer(s.encode("utf-32-le"), np.uint32)].all():
                many.append(s)
            else:
                self.known[s] = np.array(self.path(s)[0], "<i4").tobytes()
        for k in range(0, len(many), AT_ONCE):
            self.known.update(self.paths(many[k : k + AT_ONCE]))

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, float]]:
        """(ids, weight) of each text."""
        split = [self.segment.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        get = self.known.get
        ids = [list(map(get, x)) for x in split]
        lacking = [k for k, x in enumerate(ids) if None in x]
        new = {s for k in lacking for s, x in zip(split[k], ids[k], strict=True) if x is None}
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            lacking, new = range(len(split)), set().union(*split)
        self._learn(list(new))
        for k in lacking:
            ids[k] = map(get, split[k])
        out = [np.frombuffer(b"".join(x), "<i4") for x in ids]
        for s in new:
            if len(s) > LONGEST:
                del self.known[s]
        return [(x, float(self.weights[x].sum())) for x in out]

    def encode(self, text: str) -> tuple[np.ndarray, float]:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The text again; bytes that are not UTF-8 become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        size = self.spelt_len[ids]
        at = np.repeat(self.spelt_at[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.spelt[at].tobytes()[1:].decode(errors="replace")  # without the leading space


def encoded(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, weight) of each text. model: path of a SentencePiece model; piece_bpe_32k.model where None."""
    return _run(docs, model, id_col, text_col, "doc_id long, ids array<int>, weight double", lambda t, ids, w, text: (ids.tolist(), w))


def digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, weight, round_trip): the encoding's CRC-32 and whether it decodes to the text."""
    schema = "doc_id long, n_pieces long, ids_crc32 long, weight double, round_trip boolean"
    return _run(docs, model, id_col, text_col, schema, lambda t, ids, w, text: (len(ids), zlib.crc32(ids.tobytes()), w, t.decode(ids) == text))


def _run(docs: DataFrame, model: str | None, id_col: str, text_col: str, schema: str, row) -> DataFrame:
    types = docs.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        import public_tokenizers

        from pyspark.sql.pandas.types import to_arrow_schema

        t, kinds = Transducer(model or public_tokenizers.path("piece_bpe_32k.model")), to_arrow_schema(types)
        for b in sliced(batches, 500):
            texts = [x or "" for x in b.column(1).to_pylist()]
            rows = [row(t, *e, x) for e, x in zip(t.encode_all(texts), texts, strict=True)]
            cols = list(zip(*rows)) or [()] * (len(kinds) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, kinds.field(k + 1).type) for k, c in enumerate(cols)]], kinds.names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, types)


def decoded(pieces: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches):
        import public_tokenizers

        t = Transducer(model or public_tokenizers.path("piece_bpe_32k.model"))
        for b in batches:
            texts = [t.decode(x.as_py() or []) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return pieces.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op9_piece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
