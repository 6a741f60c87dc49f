"""Token ids of whole texts by a public word-BPE file, with a per-worker memory of words."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stands for the end id among the words; no word holds a space.
_END = " "


class WordIds:
    """Ids of texts, word by word.

    The tokenizer drops white space and no merge crosses it, so the ids of a text are those of its words one after
    another. Words stay in Arrow: a batch's distinct words are looked up among the known ones at once, and the unknown
    ones are encoded as one text, whose offsets tell the words apart. Beyond ``room`` words the memory starts anew.
    Texts in which that could fail (special-token strings, other normal forms, capital sigma) are encoded whole.
    """

    def __init__(self, path: str, end: int = 1, room: int = 1_000_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.end, self.room = end, room
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([_END], pa.large_string())
        self.begin, self.size, self.pool = np.zeros(1, np.int64), np.ones(1, np.int64), np.array([self.end], "<u4")

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: pa.Array) -> None:
        listed = words.to_pylist()
        found = self.whole.encode(" ".join(listed), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        start = np.cumsum([0] + [len(w) + 1 for w in listed[:-1]])
        token = np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0]
        size = np.bincount(np.searchsorted(start, token, side="right") - 1, minlength=len(listed))
        self.known = pa.concat_arrays([self.known, words])
        self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, ids])

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the words stand among the known ones, after learning those that do not."""
        at = pc.index_in(words, value_set=self.known)
        missing = at.is_null()
        if at.null_count:
            if len(self.known) > self.room:
                self._forget()
                return self._places(words)
            fresh = len(self.known)
            self._learn(words.filter(missing))
            at = at.fill_null(0).to_numpy().astype(np.int64)
            at[missing.to_numpy(zero_copy_only=False)] = np.arange(fresh, len(self.known))
            return at
        return at.to_numpy().astype(np.int64)

    def encode(self, texts: list[str | None]) -> list[memoryview]:
        """Little-endian 32-bit ids of each text, then the end id. None counts as the empty text."""
        out: list[memoryview | None] = [None] * len(texts)
        split: list[int] = []
        plain: list[str] = []
        for i, text in enumerate(texts):
            text = text or ""
            if "<|" in text or "Σ" in text or not unicodedata.is_normalized("NFC", text):
                out[i] = memoryview(np.append(self._encode(text), np.uint32(self.end)).astype("<u4").tobytes())
            else:
                split.append(i)
                plain.append(text.lower().replace("\n", " "))
        if not split:
            return out
        lists = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        places = self._places(coded.dictionary)
        stops = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        # Every text is its words' places among the known ones, then that of the end id.
        place = np.insert(places[coded.indices.to_numpy(zero_copy_only=False)], stops, 0)
        lengths = self.size[place]
        ends = np.cumsum(lengths)
        data = memoryview(self.pool[np.arange(ends[-1]) + np.repeat(self.begin[place] - ends + lengths, lengths)].tobytes())
        at = 0
        for i, stop in zip(split, ends[stops + np.arange(len(stops))].tolist()):
            out[i] = data[4 * at: 4 * stop]
            at = stop
        return out
