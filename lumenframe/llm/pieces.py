"""Encoding and decoding with a SentencePiece vocabulary, by a Viterbi search that words with a common prefix share.

The best segmentation of a text is the sequence of pieces with the highest sum of scores. Pieces never cross the start
of a run of word marks (spaces), and characters that occur in no longer piece stand alone, so a text falls into marked
words whose best segmentations are independent. The distinct words of a batch are sorted, which lays them out as a trie
in depth-first order: going from one word to the next, the forward scores and open matches of the common prefix stay, and
only the rest is searched. Characters without a piece are spelled in bytes. A worker keeps the segmentations of words that came
more than once; a text is a list of numbers of words, and its ids are gathered from one flat array.

The vocabulary is read from the model file; nothing is trained. Scores are the file's own; with a file made for merges,
they rank pieces, and the result is the best-scoring segmentation, not the order of merges.

Defined cases: null gives null ids and null text, empty text no ids; text holds exactly what was encoded, except that
the mark itself (U+2581) comes back as a space; of equal scores the one with the earlier start of its last piece wins;
repeated rows are encoded each, other columns are not read, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import arrays as A

MARK = "▁"
#: Segmentations that a worker holds; past it, those of words that came once go.
KEPT = 400_000
SLICE = 4 << 20


class Vocabulary:
    """Pieces and scores of a model file, as a trie ``character -> [id, score, children]``."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.root: dict = {}
        self.bytes = [0] * 256
        self.spelled: list[bytes] = []
        longer: set[str] = set()
        least = 0.0
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.spelled.append(bytes([int(piece[3:5], 16)]))
                continue
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.spelled.append(b"")
                continue
            self.spelled.append(piece.replace(MARK, " ").encode())
            score = model.get_score(i)
            least = min(least, score)
            if len(piece) > 1:
                longer |= set(piece)
            children, entry = self.root, None
            for c in piece:
                entry = children.setdefault(c, [-1, 0.0, {}])
                children = entry[2]
            entry[0], entry[1] = i, score
        self.unknown = least - 10
        together = "".join(re.escape(c) for c in sorted(longer - {MARK}))
        self.split = re.compile(f"{MARK}*[{together}]+|{MARK}+|.", re.S) if together else re.compile(f"{MARK}+|.", re.S)

    def words(self, text: str) -> list[str]:
        """The marked words of a text."""
        return self.split.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of each word; ``words`` rise and are distinct."""
        out = {}
        # Per place: best score up to it, start and id of its last piece, and what may still grow: (score at start, start, children).
        states: list[tuple] = [(0.0, 0, -1, ())]
        before = ""
        first, unknown, spelled = self.root.get, self.unknown, self.bytes
        for word in words:
            depth, most = 0, min(len(before), len(word))
            while depth < most and before[depth] == word[depth]:
                depth += 1
            del states[depth + 1 :]
            for d in range(depth, len(word)):
                c = word[d]
                base, _, _, growing = states[d]
                matches, top, at, piece = [], None, d, -1
                for score, start, children in growing:
                    entry = children.get(c)
                    if entry is not None:
                        i, gain, more = entry
                        if more:
                            matches.append((score, start, more))
                        if i >= 0 and (top is None or score + gain > top):
                            top, at, piece = score + gain, start, i
                entry = first(c)
                gain = unknown
                i = -1
                if entry is not None:
                    if entry[2]:
                        matches.append((base, d, entry[2]))
                    if entry[0] >= 0:
                        i, gain, _ = entry
                if top is None or base + gain > top:
                    top, at, piece = base + gain, d, i
                states.append((top, at, piece, matches))
            ids, at = [], len(word)
            while at:
                _, start, piece, _ = states[at]
                if piece >= 0:
                    ids.append(piece)
                else:
                    ids += [spelled[b] for b in reversed(word[start].encode())]
                at = start
            ids.reverse()
            out[word] = ids
            before = word
        return out

    def decode(self, ids: Iterable[int]) -> str:
        spelled = self.spelled
        text = b"".join([spelled[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Known:
    """Segmentations by number of the word, in one flat array."""

    def __init__(self, vocab: Vocabulary, most: int = KEPT):
        self.vocab, self.most = vocab, most
        self.number: dict[str, int] = {}
        self.flat, self.ends = array("i"), array("q", [0])
        self.uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the words used more than once since the last time, the most used ones where they are many."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > self.most // 2:
            keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[: self.most // 2]])
        ids, lengths = self.ids(keep)
        names = list(self.number)
        self.number = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.flat = array("i", ids.tobytes())
        self.ends = array("q", np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64).tobytes())
        self.uses = np.zeros(len(keep), np.int64)

    def learn(self, words: Iterable[str]) -> None:
        if len(self.number) > self.most:
            self._forget()
        new = set(words) - self.number.keys()
        for word, ids in self.vocab.encode(sorted(new)).items():
            self.number[word] = len(self.number)
            self.flat.extend(ids)
            self.ends.append(len(self.flat))

    def numbers(self, words: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        uses = np.bincount(out, minlength=len(self.number))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        return out

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each has."""
        ends, flat = np.array(self.ends), np.array(self.flat, np.int32)
        lengths = ends[numbers + 1] - ends[numbers]
        return flat[np.repeat(ends[numbers], lengths) + A.ranges_of(lengths)], lengths


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a worker process, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids`` for each row of ``df``."""
    A.small_batches(df.sparkSession)
    path = path or default_file()

    def run(batches):
        vocab = vocabulary(path)
        known = Known(vocab)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at, parts = 0, []
            while at < len(texts):
                words, sizes, size = [], [], 0
                while at < len(texts) and (not sizes or size < SLICE):
                    mine = vocab.words(texts[at] or "")
                    words += mine
                    sizes.append(len(mine))
                    size += len(texts[at] or "")
                    at += 1
                known.learn(words)
                ids, lengths = known.ids(known.numbers(words))
                upto = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])]
                gaps = np.array([t is None for t in texts[at - len(sizes) : at]])
                parts.append(pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array(gaps)))
            ids = pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])
            A.release()

    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, ids array<int>")


def decode(df: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """``key, ids, text`` for each row of ``df(key, ids)``."""
    A.small_batches(df.sparkSession)
    path = path or default_file()

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            text = []
            ids = batch.column(1)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            fine = ids.is_valid().to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.cumsum(np.where(fine, np.diff(ids.offsets.to_numpy()), 0))]).tolist()
            for k, there in enumerate(fine.tolist()):
                text.append(vocab.decode(flat[edges[k] : edges[k + 1]].tolist()) if there else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(text, pa.string())], names=[key, "ids", "text"])

    return df.select(key, "ids").mapInArrow(run, f"{key} long, ids array<int>, text string")
