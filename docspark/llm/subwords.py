"""Encoding with the public BPE vocabulary of whole words, fast enough for a corpus: words are encoded once for each worker.

For this vocabulary a text's ids are the ids of its words, split at ASCII white space, one after the other: the normaliser composes
nothing across white space and lower-cases each character alone, its pattern never matches white space, and its two special strings
hold none. `WordMemo` keeps the ids of words it has met and asks the tokenizer for others.
"""

from __future__ import annotations

import string
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("ids are packed as little-endian 32-bit numbers")

#: Words a worker remembers; beyond them it starts anew. About 130 bytes each.
MEMO_WORDS = 700_000

#: ASCII punctuation: a run of it after letters is a piece of its own for the pattern, whatever stands before.
TAIL = string.punctuation.encode()


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def word_vocabulary() -> str:
    """The place of the vocabulary's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordMemo(dict):
    """Word as bytes -> its ids as little-endian unsigned 32-bit numbers. `learn` words before looking them up.

    Runs of letters, without the ASCII punctuation that ends a word, are kept apart: the pattern keeps them whole, so the model encodes them alone.
    """

    def __init__(self, path: str, most: int = MEMO_WORDS):
        super().__init__()
        self.whole = tokenizer(path)
        self.model = self.whole.model
        self.letters = byte_letters()
        self.most, self.units = most, {}

    def unit(self, letters: bytes) -> bytes:
        """Ids of lower-cased letters."""
        text = letters.decode() if letters.isascii() else "".join(map(self.letters.__getitem__, letters))
        got = self.units[letters] = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        return got

    def tail(self, mark: bytes) -> bytes:
        got = self.units[mark] = array("I", self.whole.encode(mark.decode(), add_special_tokens=False).ids).tobytes()
        return got

    def learn(self, words: set[bytes]) -> None:
        """`words`: all that will be looked up next, split at ASCII white space, valid UTF-8."""
        if len(self) + len(self.units) > self.most:
            self.clear()
            self.units.clear()
        fresh = [w for w in words if w not in self]
        self.update(zip(fresh, self.packed(fresh)))

    def packed(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of `words`, which are as for `learn`; only runs of letters and punctuation are kept."""
        units = self.units
        if len(units) > self.most:
            units.clear()
        out, rest = [], []
        for word in words:
            core = word.rstrip(TAIL)
            if core.isalpha():
                letters = core.lower()
            elif core:
                text = core.decode()
                if not (text.isalpha() and max(text) < "ɐ" and "İ" not in text and unicodedata.is_normalized("NFC", text)):
                    rest.append(len(out))  # the tokenizer itself has to look
                    out.append(word)
                    continue
                letters = text.lower().encode()
            else:
                letters = b""
            ids = b""
            if letters:
                ids = units.get(letters)
                if ids is None:
                    ids = self.unit(letters)
            if len(core) < len(word):
                mark = word[len(core) :]
                ids += units.get(mark) or self.tail(mark)
            out.append(ids)
        if rest:
            for k, e in zip(rest, self.whole.encode_batch_fast([out[k].decode() for k in rest], add_special_tokens=False)):
                out[k] = array("I", e.ids).tobytes()
        return out


@lru_cache(maxsize=1)
def memo(path: str, most: int = MEMO_WORDS) -> WordMemo:
    """One for each Python worker, kept from task to task."""
    return WordMemo(path, most)


def words_of(column: pa.Array) -> pa.ListArray:
    """Words of texts, lower-cased (A-Z), split at ASCII white space; an empty one where white space begins or ends a text. A null text is empty."""
    return pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.cast(pa.string()), "")))


def distinct_words(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of words of each text, the distinct words, and of all words in order which of these they are."""
    lists = words_of(column)
    length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    which, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    empty = pc.index(names, "").as_py()
    if empty >= 0:
        there = which != empty
        length -= np.bincount(np.repeat(np.arange(len(length)), length)[~there], minlength=len(length))
        which = which[there]
        which -= which > empty
        names = pa.concat_arrays([names[:empty], names[empty + 1 :]])
    return length, names, which


def word_bytes(names: pa.Array) -> list[bytes]:
    """Strings without nulls as bytes."""
    if not len(names):
        return []
    _, places, data = names.buffers()
    at = np.frombuffer(places, np.int32)[names.offset : names.offset + len(names) + 1]
    raw, at = bytes(memoryview(data)[at[0] : at[-1]]) if data else b"", (at - at[0]).tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def encode_words(words: WordMemo, texts: list[bytes]) -> list[bytes]:
    """Each text's ids, packed."""
    split = [t.split() for t in texts]
    words.learn(set().union(*split))
    return [b"".join(map(words.__getitem__, s)) for s in split]
