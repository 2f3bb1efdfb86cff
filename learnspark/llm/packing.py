"""Cost-balanced packing of token sequences.

A piece of n tokens costs `linear` * n + `quadratic` * n^2 (attention stays inside a document). Each
task packs its own input partition in blocks of bounded size: whole sequences are cut off the long
documents first, a block opens just as many further sequences as its remaining tokens need, and the
pieces, in descending cost, go to the lowest-cost sequence with room for them. What fits nowhere
whole is cut over the sequences with the most room, so at most one sequence of a block has padding.
Documents are never grouped or shuffled, and no state leaves a task.

Defined results: a null text is an empty one (its end token alone is packed); rows that repeat a
doc_id are packed each for itself; an empty table gives an empty result; other columns are dropped.
Sequence numbers are unique but not gapless: partition number * 2^40 + number in the partition.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnspark.llm.common import table

CAPACITY = 2048
END = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: A block is packed when it holds so many tokens or documents; one more document may exceed it.
BLOCK_TOKENS, BLOCK_DOCS = 2_000_000, 4_000
#: Words whose ids a worker remembers.
CACHE_WORDS = 1_200_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of texts under a tokenizers file; of word_bpe_49k.json and its like word by word.

    A file of that kind (SPLITTING) drops white space, never joins across it, splits words into runs
    of letters, digits and other characters before it merges within each, and marks the last token of
    a run as such. A text's ids are then those of its words in turn, and new runs are encoded many at
    a time by the file's own merges, divided by spaces, and told apart by those marks. Words where
    the split is not certain beforehand (marks, capital sigma, special tokens) are encoded each by
    itself. Texts under any other file are encoded whole.
    """

    #: What a file must say for its texts to be encoded word by word (fixed values of that kind of file).
    SPLITTING = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    }

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        self.by_word = said["model"].get("end_of_word_suffix") == "</w>" and all(said[k] == v for k, v in self.SPLITTING.items()) and all(t["content"].startswith("<|") for t in said["added_tokens"])
        if not self.by_word:
            return
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.runs, self.marks = regex.compile(said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall, regex.compile(r"\p{M}").search
        #: The same merges for runs that are normal and split already.
        self.merger = Tokenizer.from_file(path)
        self.merger.normalizer = None
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[bytes, bytes] = {}
        self.known_runs: dict[str, bytes] = {}

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_runs(self, runs: list[str]) -> None:
        known = self.known_runs
        new = [r for r in dict.fromkeys(runs) if r not in known]
        ids = np.array(self.merger.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(new):
            raw, at = ids.tobytes(), 0
            for r, stop in zip(new, (4 * stops).tolist(), strict=True):
                known[r] = raw[at:stop]
                at = stop
        else:
            known.update((r, self._alone(r)) for r in new)

    def _learn(self, words: list[bytes]) -> None:
        known, normal, single, pairs, split, runs = self.known, unicodedata.is_normalized, [], [], [], []
        for w in words:
            if w.isalpha():  # bytes: ASCII letters only
                single.append((w, w.lower().decode()))
                continue
            text = w.decode()
            low = text.lower()
            if not text.isascii():
                if "\u03a3" in text or not (normal("NFC", text) and normal("NFC", low)):
                    known[w] = self._alone(text)
                    continue
                if low.isalpha():  # letters only, so one run and no marks
                    single.append((w, low))
                    continue
            if low[-1] in ".,;:!?" and low[:-1].isalpha():
                pairs.append((w, low[:-1], low[-1]))
            elif "<|" in text or not text.isascii() and self.marks(low):
                known[w] = self._alone(text)
            else:
                split.append((w, self.runs(low)))
                runs += split[-1][1]
        runs += [r for _, r in single]
        for k in (1, 2):
            runs += [x[k] for x in pairs]
        if len(self.known_runs) + len(runs) > CACHE_WORDS:
            self.known_runs.clear()
        if runs:
            self._learn_runs(runs)
        of = self.known_runs
        known.update([(w, of[r]) for w, r in single])
        known.update([(w, of[r] + of[end]) for w, r, end in pairs])
        known.update([(w, b"".join([of[r] for r in parts])) for w, parts in split])

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text; their new words are encoded in one go."""
        if not self.by_word:
            return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        split = [t.split() for t in texts]
        get = self.known.get
        ids = [list(map(get, w)) for w in split]
        lacking = [k for k, x in enumerate(ids) if None in x]
        new = {w for k in lacking for w, x in zip(split[k], ids[k], strict=True) if x is None}
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            lacking, new = range(len(split)), set().union(*split)
        order = list(new)
        for s in range(0, len(order), 20_000):
            self._learn(order[s : s + 20_000])
        for k in lacking:
            ids[k] = map(get, split[k])
        return [np.frombuffer(b"".join(x), "<u4") for x in ids]


def pack(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for every piece of documents of these lengths."""
    out, rest, full = [], [], 0
    for d, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            out.append((d, k * capacity, capacity, full, 0))
            full += 1
        if n % capacity:
            rest.append((n % capacity, d, whole * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))  # cost grows with length
    bins = -(-sum(n for n, _, _ in rest) // capacity)
    room, cost = np.full(bins, capacity), np.zeros(bins)

    def put(d: int, start: int, n: int, b: int) -> None:
        out.append((d, start, n, full + b, capacity - int(room[b])))
        room[b] -= n
        cost[b] += linear * n + quadratic * n * n

    for n, d, start in rest:
        b = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[b] >= n:
            put(d, start, n, b)
            continue
        while n:
            b = int(np.argmax(room))
            part = min(n, int(room[b]))
            put(d, start, part, b)
            start, n = start + part, n - part
    return out


def packed(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece (PIECES), with its token ids where `with_ids`.

    vocabulary: path of a tokenizers file; the public word_bpe_49k.json where it is None.
    """

    def run(batches):
        import public_tokenizers

        encode = Encoder(vocabulary or public_tokenizers.path("word_bpe_49k.json"))
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        held: list[tuple[int | None, np.ndarray]] = []
        tokens = 0

        def flush():
            nonlocal first, tokens
            pieces = pack([len(ids) for _, ids in held], capacity)
            cols = list(zip(*pieces, strict=True))
            cut_ids = [held[d][1][s : s + n] for d, s, n, _, _ in pieces]
            arrays = [
                pa.array([held[d][0] for d in cols[0]], pa.int64()),
                pa.array(cols[1], pa.int64()),
                pa.array(cols[2], pa.int64()),
                pa.array([zlib.crc32(x.tobytes()) for x in cut_ids], pa.int64()),
                pa.array([len(held[d][1]) for d in cols[0]], pa.int64()),
                pa.array([first + s for s in cols[3]], pa.int64()),
                pa.array(cols[4], pa.int64()),
            ]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(np.cumsum([0, *map(len, cut_ids)], dtype=np.int32), pa.array(np.concatenate(cut_ids).astype(np.int32))))
            first += max(cols[3]) + 1
            held.clear()
            tokens = 0
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            for s in range(0, b.num_rows, 200):
                some = b.slice(s, 200)
                encoded = encode([t or b"" for t in some.column(1).to_pylist()])
                for doc_id, ids in zip(some.column(0).to_pylist(), encoded, strict=True):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    held.append((doc_id, ids))
                    tokens += len(ids)
                    if tokens >= BLOCK_TOKENS or len(held) >= BLOCK_DOCS:
                        yield flush()
        if held:
            yield flush()

    schema = PIECES + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(run, schema)


def padding(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens and pad tokens, where a sequence of a power of two needs none."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(F.bit_count("n") == 1, 0).otherwise(capacity - F.col("n"))
    return used.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(pad).alias("pad"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
