"""Token ids by the tokenizers library, with a bounded memory of the chunks between blanks.

The vocabulary's pre-tokenizer never joins anything across white space, so a text's ids are those of its chunks in order.
Arrow cuts texts and tells the chunks of a portion apart; each of these costs one lookup if it was met before. New words of
letters go to the library without its normalizer and regular expression, which leave them as they are, so a word is one piece
there; their bytes are written as its byte-level alphabet does. Texts for which that may not hold (special tokens, letters whose lower case
depends on their neighbours, texts that aren't NFC, rare scripts) go to the library whole.
"""
from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

END_ID = 2
#: Chunks that a worker keeps: those met since the last half of so many were full, and that half.
MEMORY = 400_000
#: Stands between chunks that are encoded together.
_MARK = "\x01"
_RARE = re.compile("[^\x00-ʯ -⁯]")
#: Bytes of texts that are encoded together, about, and rows.
PORTION, ROWS = 4_000_000, 10_000


def portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts to be encoded together: of PORTION bytes and ROWS at most, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = min(max(start + 1, int(np.searchsorted(ends, before + PORTION, "right"))), start + ROWS)
        yield start, end
        start = end


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes texts into little-endian unsigned ids: 16 bits wide where the vocabulary allows, else 32."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit
        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.end = np.array([END_ID], self.dtype).tobytes()
        mark = self.library.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer, self.letters.pre_tokenizer = None, WhitespaceSplit()
        #: Whether an id is the last one of a piece.
        self.last = np.zeros(self.library.get_vocab_size(), bool)
        if suffix := self.library.model.end_of_word_suffix:
            self.last[[k for t, k in self.library.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        # The byte-level alphabet, by what the pre-tokenizer makes of single characters.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {b: c for k in range(0x80, 0x2B0) for b, c in zip(chr(k).encode(), level.pre_tokenize_str(chr(k))[0][0])}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, from one text that holds all of them with a mark after each."""
        if self.mark is None or not chunks:
            return self._whole(chunks)
        ids = np.array(self.library.encode_batch_fast([f" {_MARK} ".join([*chunks, ""])], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(ids == self.mark)
        packed, width = ids.tobytes(), self.dtype.itemsize
        starts = np.concatenate([[0], ends[:-1] + 1])
        return [packed[a:b] for a, b in zip((starts * width).tolist(), (ends * width).tolist())]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters."""
        if not words:
            return []
        text = " ".join(words)
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.alphabet)
        ids = np.array(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        ends, packed = ((np.flatnonzero(self.last[ids]) + 1) * self.dtype.itemsize).tolist(), ids.tobytes()
        return [packed[a:b] for a, b in zip([0, *ends], ends)] if len(ends) == len(words) else self._chunks(words)

    def _learn(self, missing: list[str]) -> None:
        """Encodes chunks that aren't known."""
        known = self.known
        cores = [c.rstrip(".,!?*#$%&:;") for c in missing]
        parts = {c: (core, c[len(core):]) for c, core in zip(missing, cores) if core != c and core.isalpha()}
        new = {p for pair in parts.values() for p in pair}.union(c for c in missing if c not in parts).difference(known)
        words = [c for c in new if c.isalpha()]
        for own in ([c for c in words if c.isascii()], [c for c in words if not c.isascii()]):
            known.update(zip(own, self._words(own)))
        others = list(new.difference(words))
        known.update(zip(others, self._chunks(others)))
        known.update((c, known[core] + known[tail]) for c, (core, tail) in parts.items())

    def _plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that are made of chunks, with the end id, which a last chunk stands for."""
        known, width = self.known, self.dtype.itemsize
        cut = pc.split_pattern(pa.array([f"{t} {_MARK}" for t in texts], pa.large_string()), " ")
        own = cut.values.dictionary_encode()
        chunks = own.dictionary.to_numpy(zero_copy_only=False).tolist()
        packed = list(map(known.get, chunks))
        if None in packed:
            missing = [c for c, p in zip(chunks, packed) if p is None]
            known.update((c, p) for c, p in zip(missing, map(self.older.get, missing)) if p is not None)
            self._learn([c for c in missing if c not in known])
            packed = list(map(known.__getitem__, chunks))
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // width
        pool, firsts, which = np.frombuffer(b"".join(packed), self.dtype), np.cumsum(sizes) - sizes, own.indices.to_numpy()
        many = sizes[which]
        ends = np.cumsum(many)
        ids = pool[np.arange(ends[-1]) + np.repeat(firsts[which] - ends + many, many)].tobytes()
        borders = (ends[cut.offsets.to_numpy()[1:] - 1] * width).tolist()
        return [ids[a:b] for a, b in zip([0, *borders], borders)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text with the end id; a null text counts as empty."""
        if len(self.known) > MEMORY // 2:
            self.known, self.older = {}, self.known
        self.known[_MARK] = self.end
        plain, rest, where = [], [], []
        for text in texts:
            text = text or ""
            one = text.isascii() or not _RARE.search(text) and unicodedata.is_normalized("NFC", text)
            where.append(one := one and "<|" not in text and _MARK not in text)
            (plain if one else rest).append(text.lower().replace("\n", " ") if one else text)
        known, whole = iter(self._plain(plain) if plain else []), iter(self._whole(rest))
        return [next(known) if one else next(whole) + self.end for one in where]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
