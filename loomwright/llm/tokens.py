"""Token ids of the public word-level BPE vocabulary, by a cache of pre-tokens.

The vocabulary's merges never cross a pre-token, so a text's ids are the joined ids of its
pre-tokens. Texts with characters beyond the Latin blocks go through the tokenizer itself.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata

_LATIN = [chr(c) for c in range(0x180)] + [chr(c) for c in (*range(0x2010, 0x2028), 0x20AC)]
_SPACE = "\t-\r \x85\xa0"
_LETTERS = "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == "N")
_PIECES = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")
_OTHER = re.compile("[^" + "".join(re.escape(c) for c in _LATIN) + "]|İ|<\\|")


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_encoder(encoding):
    """The function from the bytes of one pre-token to its ids, or None where this release of the library has none.

    The library's own entries split a text first; what is called here lies inside it, and only here.
    """
    return getattr(getattr(encoding, "_core_bpe", None), "encode_single_piece", None)


def _merger(tokenizer_json: str):
    """A compiled byte-pair merger for a vocabulary whose ids are its merge order, else None.

    The word end becomes the byte 0xFF, which UTF-8 never holds; joining it to a last byte has the
    lowest ids and so comes first, as in the vocabulary.
    """
    import tiktoken

    model = json.loads(tokenizer_json)["model"]
    if model.get("end_of_word_suffix") != "</w>":
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    to_byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    ranks = {b"\xff": 1 << 20}
    for token, rank in model["vocab"].items():
        body, ended = (token[:-4], b"\xff") if token.endswith("</w>") else (token, b"")
        if all(c in to_byte for c in body):
            ranks[bytes(to_byte[c] for c in body) + ended] = rank
    for k, pair in enumerate(model["merges"]):
        if model["vocab"].get("".join(pair.split(" ") if isinstance(pair, str) else pair)) != 512 + k:
            return None
    return piece_encoder(tiktoken.Encoding("word", pat_str="x", mergeable_ranks=ranks, special_tokens={}))


class WordBpe(dict):
    """pre-token -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.merge = _merger(self.tokenizer.to_str())

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = self.merge(piece.encode() + b"\xff") if self.merge else self.tokenizer.encode(piece, add_special_tokens=False).ids
        value = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) < 64:
            self[piece] = value
        return value

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, as the tokenizer itself gives them."""
        if not text:
            return b""
        if not text.isascii() and _OTHER.search(text) or "<|" in text:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.__getitem__, _PIECES.findall(text.lower())))
