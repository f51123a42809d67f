"""Token ids of whole texts by a public byte-level BPE.

The merges are run by tiktoken on the ranks that belong to the tokenizer file; the tests hold the ids against the
tokenizers library. A text that holds the name of a special token goes to that library.
"""

from __future__ import annotations

import base64
import os
import sys
from array import array
from functools import lru_cache

VOCABULARY = "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"


class Encoder:
    """Encodes texts with the vocabulary of a tokenizer file; it must have fewer than 65,537 ids."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers as public
        import tiktoken

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.file = public.path(vocabulary)
        with open(public.path(vocabulary.replace(".json", ".tiktoken")), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        if max(ranks.values()) > 65_535:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        self.plain = tiktoken.Encoding(vocabulary, pat_str=public.PATTERN, mergeable_ranks=ranks,
                                       special_tokens={}).encode_ordinary
        self.whole = None

    def ids(self, text: str | None) -> array:
        """The ids of the text as unsigned 16-bit numbers; none for a null."""
        if not text:
            return array("H")
        if SPECIAL not in text:
            return array("H", self.plain(text))
        if self.whole is None:
            from tokenizers import Tokenizer
            self.whole = Tokenizer.from_file(self.file)
        return array("H", self.whole.encode(text, add_special_tokens=False).ids)

    def raw(self, text: str | None) -> bytes:
        """The ids as little-endian bytes."""
        ids = self.ids(text)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One encoder for a worker, kept from task to task."""
    return Encoder(vocabulary)
