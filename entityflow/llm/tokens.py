"""Token ids of whole texts, word by word.

A batch of texts is cut at ASCII white space, which this kind of tokenizer drops and no token spans; only the different
words of the batch are looked up or encoded, and their ids are put together by position. A word of Latin letters is
looked up in lower case and without a final full stop or comma, whose id follows; a word with any other character (a
capital I with dot among them, whose lower case is two) goes to the tokenizer as it stands, as lower-casing and composing
may reach over such a cut. New words of letters are encoded many at a time: each must come back as one piece, told by the
tokens that end a piece, or its chunk is encoded word by word.
"""

from __future__ import annotations

import os
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MARKS = (".", ",")
# letters whose lower case is one letter and that compose with no letter after them
_PLAIN = "^[A-Za-zÀ-ÖØ-öø-įı-ſ]+[.,]?$"
_CHUNK = 256  # words encoded as one text


class Encoder:
    """``vocabulary`` is a tokenizer file that lower-cases and drops white space. The first ``_WORDS`` different words are
    remembered: as numbers, whose ids lie in one array."""

    _WORDS, _LONG = 200_000, 64  # words kept (about 250 bytes each, as the worker lives on), characters of one

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.size = self.tokenizer.get_vocab_size()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        marks = self._one_by_one(list(_MARKS))
        self.marks = np.array([m[0] for m in marks], np.uint32) if all(len(m) == 1 for m in marks) else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.ids, self.begin, self.length = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    @staticmethod
    def of_worker(vocabulary: str) -> Encoder:
        """The encoder of this Python worker, which Spark uses again for later tasks."""
        kept = sys.modules.setdefault("corpus_encoders", types.ModuleType("corpus_encoders")).__dict__
        if vocabulary not in kept:
            kept[vocabulary] = Encoder(vocabulary)
        return kept[vocabulary]

    def _one_by_one(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of words of letters."""
        chunks = [words[i : i + _CHUNK] for i in range(0, len(words), _CHUNK)]
        ids, lengths = [], []
        for chunk, found in zip(chunks, self._one_by_one([" ".join(c) for c in chunks])):
            stops = np.flatnonzero(self.ends[found]) + 1
            if len(stops) != len(chunk) or stops[-1] != len(found):
                single = self._one_by_one(chunk)
                found, stops = np.concatenate(single), np.cumsum([len(x) for x in single])
            ids.append(found)
            lengths.append(np.diff(stops, prepend=0))
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, words: list[str]) -> int:
        """Append new words; the number of words from which on they are not to be kept."""
        letters = [w for w in words if len(w) <= self._LONG and w.isalpha()]
        short = [w for w in words if len(w) <= self._LONG and not w.isalpha()]
        long = [w for w in words if len(w) > self._LONG]
        ids, lengths = [self.ids], [self.length]
        if letters:
            found, sizes = self._together(letters)
            ids.append(found)
            lengths.append(sizes)
        single = self._one_by_one([*short, *long])
        ids += single
        lengths.append(np.fromiter(map(len, single), np.int64, len(single)))
        at = len(self.known)
        self.known.update(zip([*letters, *short, *long], range(at, at + len(words))))
        self.ids, self.length = np.concatenate(ids), np.concatenate(lengths)
        ends = np.cumsum(self.length)
        self.begin = ends - self.length
        return max(at, min(self._WORDS, at + len(letters) + len(short)))

    def _drop(self, keep: int) -> None:
        if keep < len(self.known):
            for w in list(self.known)[keep:]:
                del self.known[w]
            self.length, self.begin = self.length[:keep], self.begin[:keep]
            self.ids = self.ids[: self.begin[-1] + self.length[-1]]

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text starts, with the end as the last start."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.ascii_split_whitespace(texts)
        first, last = split.offsets[0].as_py(), split.offsets[-1].as_py()
        coded = split.values.slice(first, last - first).cast(pa.string()).dictionary_encode()
        words, mark = coded.dictionary, np.zeros(len(coded.dictionary), np.int64)
        if self.marks is not None:
            plain = pc.match_substring_regex(words, _PLAIN)
            for i, m in enumerate(_MARKS, 1):
                mark[pc.and_(plain, pc.ends_with(words, m)).to_numpy(zero_copy_only=False)] = i
            words = pc.if_else(plain, pc.utf8_lower(pc.ascii_rtrim(words, "".join(_MARKS))), words)
        stems = words.dictionary_encode()
        names = stems.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, names))
        new = [i for i, number in enumerate(found) if number is None]
        keep = self._learn([names[i] for i in new]) if new else len(self.known)
        for i in new:
            found[i] = self.known[names[i]]
        number = np.array(found, np.int64)[stems.indices.to_numpy()]
        size = self.length[number] + (mark > 0)
        word = coded.indices.to_numpy()
        length = size[word]
        end = np.cumsum(length)
        place = np.repeat(self.begin[number][word] - (end - length), length) + np.arange(end[-1] if len(end) else 0)
        ids = np.append(self.ids, np.uint32(0))[place]  # a mark's place may lie behind the last word
        marked = mark[word]
        if marked.any():
            at = np.flatnonzero(marked)
            ids[end[at] - 1] = self.marks[marked[at] - 1]
        self._drop(keep)
        return ids, np.concatenate([[0], end])[split.offsets.to_numpy() - first]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes, 4 an id."""
        ids, starts = self.flat(pa.array(texts, pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
