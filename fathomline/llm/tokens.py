"""Token ids of whole texts, by a tokenizer file of the tokenizers library, with a cache of words.

No pattern of the tokenizer reaches over white space, so a text's ids are the ids of its words one after the other. A
batch of texts is cut into words, and its distinct words are looked up, with Arrow's functions; only words that the cache
hasn't are encoded. Words of plain Latin script are split by the file's own pre-tokenizing rule and their pieces given to
its BPE model; any other word, one with a control character among them, goes through the whole tokenizer. A full cache
becomes the old one, whose entries move on when they are asked for again and are gone with the next change, so memory
stays bounded.
"""

from __future__ import annotations

import os
import unicodedata
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Word pieces as the tokenizer file's Split rule gives them. Fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A letter, signs that end a word, and white space: a space between letter and signs changes no piece, and makes fewer
#: distinct words. No sign here begins or ends a special token or composes with a mark; İ is left out, as its lower case
#: ends in a mark.
ENDING = "([A-Za-zÀ-ÖØ-öø-įı-ɏ])([!\"#$%&'()*,./:;?]+)([ \\t\\n\\r])"
#: Entries that the caches of words and of pieces may hold before they become the old ones.
CACHE_WORDS, CACHE_PIECES = 160_000, 40_000


class Aging(dict):
    """key -> make(key), kept for the keys asked for lately: twice ``most`` at most."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.pop(key, None)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


def byte_symbols() -> dict[int, str]:
    """The printable character that byte-level tokenizers use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Words:
    """Gives the ids of texts; a word's are held as little-endian unsigned 16- or 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.split = regex.compile(PIECES).findall
        self.tokenize = self.tokenizer.model.tokenize
        self.symbols = byte_symbols()
        self.plain = self.rule_is_known()
        self.word = Aging(self.encode_word, CACHE_WORDS)
        self.piece = Aging(self.encode_piece, CACHE_PIECES)

    def rule_is_known(self) -> bool:
        """Whether the file has the pre-tokenizing rule and the normalizers that the short way reproduces."""
        return all(x in repr(self.tokenizer.pre_tokenizer) for x in ("[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+", "ByteLevel(add_prefix_space=False")) and "Lowercase()" in repr(self.tokenizer.normalizer) and "NFC()" in repr(self.tokenizer.normalizer)

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def encode_piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(map(self.symbols.__getitem__, piece.encode()))
        return array(self.dtype.char, [x.id for x in self.tokenize(shown)]).tobytes()

    def encode_word(self, word: str) -> bytes:
        if not word:  # white space at an end of a text
            return b""
        if self.plain and word.isascii() and word.isalpha():  # one piece
            return self.encode_piece(word.lower())
        if not self.plain or not word.isprintable() or "<|" in word or max(word) >= "ɐ":
            return self.packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        low = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).lower()
        return b"".join(map(self.piece.__getitem__, self.split(low)))

    def batch(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other (16 or 32 bits as the vocabulary needs) and where each text's begin and end."""
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        texts = texts.cast(pa.large_string())
        if self.plain:
            texts = pc.replace_substring_regex(texts, pattern=ENDING, replacement=r"\1 \2\3")
        listed = pc.ascii_split_whitespace(texts)
        found = listed.flatten().dictionary_encode()
        each = pa.array(list(map(self.word.__getitem__, found.dictionary.to_pylist())), pa.large_binary())
        all_ids = each.take(found.indices)
        places = np.frombuffer(all_ids.buffers()[1], np.int64)[: len(all_ids) + 1] // self.dtype.itemsize
        bounds = np.append(0, np.cumsum(pc.list_value_length(listed).to_numpy()))
        data = all_ids.buffers()[2]
        ids = np.frombuffer(data, self.dtype, int(places[-1])) if data is not None and len(all_ids) else np.zeros(0, self.dtype)
        return ids, places[bounds] if len(all_ids) else np.zeros(len(texts) + 1, np.int64)

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a whole text; null is the empty text."""
        return self.batch(pa.array([text], pa.string()))[0]


@cache
def words(path: str) -> Words:
    """One cache for each tokenizer file and Python worker."""
    return Words(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
