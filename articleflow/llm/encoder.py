"""Whole texts to token ids inside tasks."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from articleflow.llm.common import kept_in_worker

# Words whose ids a task remembers. It only saves time: when it is full, the words that came often last stay.
MEMORY_WORDS = 600_000
# Words that are encoded in one call.
_JOINED = 50
# White space other than single blanks and line ends between words.
_ODD_SPACE = (r"\A[ \n]|[ \n][ \n]|[ \n]\z|[\t\x{0b}\x{0c}\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
              r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
# Punctuation right behind a letter: there, too, the splitting rule always cuts. Such a piece is marked by a sign that
# counts as odd white space, so that a text of words does not hold it.
_BEHIND_LETTER, _MARK = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-~])", "\x1f"


class Encoder:
    """Byte-level BPE ids of whole texts, as little-endian unsigned 32-bit bytes.

    Strings of special tokens inside a text are ordinary text. The splitting rule of this vocabulary always cuts
    before white space that follows a word, and between a letter and punctuation, so words separated by single spaces
    or line ends are encoded one by one, without the punctuation behind them, and remembered; a text with any other white space is encoded in one piece. Both ways give the same ids. Texts are
    cut into words, and ids put together, in Arrow arrays: Python handles each word once a call.
    """

    def __init__(self, path: str, memory_words: int = MEMORY_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        # A token is written with one character per byte.
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self._bytes[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self._limit = memory_words
        self._inner: dict[str, bytes] = {}
        self._first: dict[str, bytes] = {"": b""}

    def _single(self, pieces: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that begin with white space: encoded together, and cut where the bytes of a piece end."""
        parts = ["".join(pieces[i:i + _JOINED]) for i in range(0, len(pieces), _JOINED)]
        found = self._tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        ids = np.array([i for e in found for i in e.ids], dtype="<u4")
        ends = np.cumsum([len(p.encode("utf-8")) for p in pieces])
        cuts = [0, *(4 * (np.searchsorted(np.cumsum(self._bytes[ids]), ends) + 1)).tolist()]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _inner_ids(self, words: pa.DictionaryArray) -> list[bytes]:
        """Ids of the distinct words, each after a blank or with its line end, and of marked punctuation."""
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self._inner.get, distinct))
        new = [word for word, ids in zip(distinct, found) if ids is None]
        if new:
            marked = [word for word in new if word[0] == _MARK]
            others = [word for word in new if word[0] != _MARK]
            fresh = dict(zip(others, self._joined([w if w[0] == "\n" else " " + w for w in others])))
            fresh.update(zip(marked, self._single([word[1:] for word in marked])))
            found = [fresh[word] if ids is None else ids for word, ids in zip(distinct, found)]
            self._inner.update(fresh)
        if len(self._inner) + len(self._first) > self._limit:
            often = np.flatnonzero(np.bincount(words.indices.to_numpy(), minlength=len(distinct)) > 1)
            self._inner = {distinct[i]: found[i] for i in often[:self._limit // 4].tolist()}
            self._first = {"": b""}
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, without any end mark."""
        if not texts:
            return []
        column = pa.array(texts, pa.large_string())
        plain = pc.invert(pc.match_substring_regex(column, _ODD_SPACE))
        spaced = pc.replace_substring(column.filter(plain), "\n", " \n")
        cut = pc.split_pattern(pc.replace_substring_regex(spaced, _BEHIND_LETTER, rf"\1 {_MARK}\2"), " ")
        words, starts = cut.flatten(), cut.offsets.to_numpy()[:-1]
        # A text of words has its first word as head, any other is a head as a whole.
        heads, counts = list(texts), np.ones(len(texts), dtype=np.int64)
        places = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        for place, head in zip(places.tolist(), words.take(pa.array(starts)).to_pylist()):
            heads[place] = head
        counts[places] = cut.value_lengths().to_numpy()
        behind = np.ones(len(words), dtype=bool)
        behind[starts] = False
        coded = words.filter(pa.array(behind)).dictionary_encode()
        first = self._first
        new = list(set(heads).difference(first))
        found = dict(zip(new, self._single(new)))
        # Long pieces are whole texts with other white space: not worth remembering.
        first.update((piece, ids) for piece, ids in found.items() if len(piece) < 100)
        opening = [first[head] if head in first else found[head] for head in heads]
        inner = self._inner_ids(coded)
        # The pieces of all texts, in order.
        begins = np.cumsum(counts) - counts
        order = np.empty(counts.sum(), dtype=np.int64)
        behind = np.ones(len(order), dtype=bool)
        behind[begins] = False
        order[behind] = coded.indices.to_numpy()
        order[begins] = len(inner) + np.arange(len(texts))
        pieces = pa.array(inner + opening, pa.large_binary()).take(pa.array(order))
        _, ends, data = pieces.buffers()
        ends = np.frombuffer(ends, dtype=np.int64, count=len(pieces) + 1)
        raw = data.to_pybytes() if data is not None else b""
        cuts = [*ends[begins].tolist(), int(ends[-1])]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def worker_encoder(path: str, memory_words: int = MEMORY_WORDS) -> Encoder:
    """The worker process's encoder for a vocabulary file."""
    return kept_in_worker(f"encoder:{path}:{memory_words}", lambda: Encoder(path, memory_words))
