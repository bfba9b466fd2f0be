"""Ids of the byte-level BPE with 50,257 entries, read from vocabulary files whose paths are parameters.

Words repeat, so each worker process keeps the ids of the words it has met. Texts of plain letters are cut into words
by an expression equal to the tokenizer's own below U+0250; every other text goes to the tokenizer as a whole.
"""

from __future__ import annotations

import base64
import re
import struct
import sys
import types

import numpy as np
import public_tokenizers

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
END_OF_TEXT = "<|endoftext|>"
CACHED_WORDS = 200_000

# Letters, numbers and white space below U+0250.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_WORD = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'(?:[stmd]|re|ve|ll)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_FAR = re.compile("[^\x00-ɏ]")


class Encoder:
    """Whole texts to little-endian 32-bit ids."""

    def __init__(self, vocabulary: str, ranks: str):
        import tiktoken
        from tokenizers import Tokenizer

        pairs = (line.split() for line in open(ranks, "rb"))
        table = {base64.b64decode(piece): int(rank) for piece, rank in pairs}
        plain = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.whole = Tokenizer.from_file(vocabulary)
        self.encode_word = plain.encode_ordinary
        self.words: dict[str, bytes] = {}
        self.sizes = np.zeros(self.whole.get_vocab_size(), np.int64)
        for piece, rank in table.items():
            self.sizes[rank] = len(piece)
        end = self.whole.token_to_id(END_OF_TEXT)
        if end is not None:
            self.sizes[end] = len(END_OF_TEXT)

    def __call__(self, text: str) -> bytes:
        if END_OF_TEXT in text or not text.isascii() and _FAR.search(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        words, found = self.words, _WORD.findall(text)
        if len(words) > CACHED_WORDS:
            words.clear()
        try:
            return b"".join([words[w] for w in found])
        except KeyError:
            for word in found:
                if word not in words:
                    ids = self.encode_word(word)
                    words[word] = struct.pack(f"<{len(ids)}I", *ids)
            return b"".join([words[w] for w in found])


def encoder(vocabulary: str = VOCABULARY, ranks: str = RANKS) -> Encoder:
    """The process's encoder: tasks of one Python worker share its words."""
    shared = sys.modules.setdefault("_parlance_encoders", types.ModuleType("_parlance_encoders"))
    known = shared.__dict__.setdefault("known", {})
    if (vocabulary, ranks) not in known:
        known[vocabulary, ranks] = Encoder(vocabulary, ranks)
    return known[vocabulary, ranks]
