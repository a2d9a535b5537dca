"""Exact token ids of whole texts.

Merges never cross the pre-tokenizer's boundaries, so a text's ids are those of its pre-tokens, one after another. Two layouts
are recognised from the tokenizer file. Byte-level BPE whose pre-tokens are split by the usual pattern, and whose merges come in
the order of their ids, is what tiktoken's core computes from ranks: it runs there, with ranks read from that very file, at a
quarter of the cost. Word BPE that drops white space is cut into words, and a bounded memo holds what the library's model
gave for each distinct one. Any other tokenizer, and any text that holds an added token's string, goes to the library whole.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np

#: The code points with the Unicode property White_Space, as a character class.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the pattern by which byte-level tokenizers split a text.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the pattern by which word BPE with word ends splits a text.
WORD_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Runs without white space; a run of Latin letters before an ASCII character that is neither letter nor apostrophe comes apart
#: from it, as in the pre-tokenizer. Such letters are their own NFC, and lower-case one by one.
LATIN = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]+"  # without the one capital whose lower case is two characters
BARE = re.compile(f"{LATIN}(?=[{WHITE}!-&(-@\\[-`{{-~]|$)|[^{WHITE}]+")


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself where it is printable, else 256 and up."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(free)) for b in range(256)]


def beyond_latin() -> re.Pattern:
    """Characters that are at or above 0x250, or have a lower case there: latin_pieces does not know them."""
    return re.compile("[^" + "".join(f"\\u{c:04x}" for c in range(0x250) if all(ord(x) < 0x250 for x in chr(c).lower())) + "]")


def latin_pieces() -> re.Pattern:
    """WORD_LEVEL for lower-case texts whose code points are all below 0x250, with classes that the faster re module knows."""
    import unicodedata

    letter, number = ("".join(f"\\u{c:04x}" for c in range(0x250) if unicodedata.category(chr(c))[0] == k) for k in "LN")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{WHITE}{letter}{number}]+")


def merge_ranks(said: dict) -> dict[bytes, int] | None:
    """token bytes -> id of a byte-level BPE file, if its merges come in the order of their ids; else None."""
    model, byte = said["model"], {c: b for b, c in enumerate(byte_letters())}
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
        return None
    vocab, added = model["vocab"], {x["content"] for x in said["added_tokens"]}
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in made or any(x >= y for x, y in zip(made, made[1:])) or not byte.keys() <= vocab.keys():
        return None
    return {bytes(byte[c] for c in k): i for k, i in vocab.items() if k not in added}


def harmless(normalizer: dict) -> bool:
    """Whether a normalizer leaves words as latin_pieces takes them: it composes, lower-cases, or makes white space one blank."""
    return normalizer["type"] in ("NFC", "Lowercase") or normalizer == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}


class Memo(dict):
    """word -> value; emptied when it has `most` words, and without words over `longest` characters, so that its memory is bounded."""

    def __init__(self, make, most: int, longest: int = 256):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, word):
        if len(word) > self.longest:
            return self.make(word)
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.make(word)
        return value


class Encoder:
    """ids(text): the text's ids as little-endian unsigned 32-bit integers; count(text): their number."""

    def __init__(self, path: str, most_words: int = 900_000):
        self.path, self.split, self.special, self.core = path, None, None, None
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.lib = Tokenizer.from_file(path)
            said = json.loads(self.lib.to_str())
            self.n_ids = self.lib.get_vocab_size()
            added = [x["content"] for x in said["added_tokens"]]
            self.special = re.compile("|".join(map(re.escape, added))) if added else None
            pre, norm = said["pre_tokenizer"] or {}, said["normalizer"]
            parts = [x.get("type") for x in pre.get("pretokenizers", [])]
            if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not norm and not said["post_processor"] and (ranks := merge_ranks(said)):
                import tiktoken

                self.core = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
            elif parts[:1] == ["Split"] and pre["pretokenizers"][0]["invert"] and pre["pretokenizers"][0]["behavior"] == "Removed" and pre["pretokenizers"][0]["pattern"] == {"Regex": WORD_LEVEL} and all(map(harmless, (norm or {}).get("normalizers", []))) and not said["post_processor"]:
                self.split = BARE
                letters, latin, tokenize = byte_letters(), re.compile(LATIN), self.lib.model.tokenize
                self.word = lambda w: [t.id for t in tokenize("".join([letters[b] for b in w.lower().encode()]))] if latin.fullmatch(w) else self.lib.encode(w, add_special_tokens=False).ids
                piece, self.beyond = latin_pieces(), beyond_latin()
                self.pieces = lambda text: piece.findall(text.lower())
                self.piece = lambda w: [t.id for t in tokenize(w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()]))]
            self.whole = lambda text: self.lib.encode(text, add_special_tokens=False).ids
        elif path.endswith(".model"):
            import sentencepiece

            self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
            self.n_ids, self.whole = self.lib.vocab_size(), self.lib.encode
        else:
            raise ValueError(f"no library for {path}")
        if self.split:
            pack = lambda x: struct.pack(f"<{len(x)}I", *x)
            self.packed, self.packed_piece = Memo(lambda w: pack(self.word(w)), most_words // 4), Memo(lambda w: pack(self.piece(w)), most_words)

    def plain(self, text: str) -> bool:
        return not (self.special and self.special.search(text))

    def ids(self, text: str) -> bytes:
        if self.split and self.plain(text):
            if self.beyond.search(text):
                return b"".join([self.packed[w] for w in self.split.findall(text)])
            return b"".join([self.packed_piece[w] for w in self.pieces(text)])
        x = self.core.encode_ordinary(text) if self.core and self.plain(text) else self.whole(text)
        return np.array(x, "<u4").tobytes()

    def count(self, text: str) -> int:
        if self.split and self.plain(text):
            return len(self.ids(text)) // 4
        return len(self.core.encode_ordinary(text) if self.core and self.plain(text) else self.whole(text))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a tokenizer file; its memo serves all tasks of a Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
