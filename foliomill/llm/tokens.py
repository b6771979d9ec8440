"""Token ids of whole texts by a byte-level vocabulary.

A text is cut at every space that a non-space follows.  The vocabulary's pattern starts a new piece at such a
space whatever stands before it, and no piece reaches across it, so the ids of the parts in a row are the ids of
the text.  Stretches of plain Latin characters are encoded from the vocabulary's ranks; parts with any others by the
``tokenizers`` library itself, which also knows the special strings.

Long texts are encoded in overlapping chunks: neighbours are joined at a cut that both have, other than at their
ends; where an overlap holds none, it is widened.
"""

from __future__ import annotations

import base64
import os
import re
from functools import cache

import numpy as np

CHUNK, OVERLAP = 1 << 16, 1 << 10

_cuts = re.compile(r" (?=\S)").split
# Signs outside these, or a special string, make a part one for the library.
PLAIN = "\t\n\r -~\u00a1-\u024f"


def as_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


@cache
def encoder_of(json_path: str, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Encoder:
    """One encoder per worker process, which the next task finds built."""
    return Encoder(json_path, ranks_path, pattern, chunk, overlap)


class Encoder:
    def __init__(self, json_path: str, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(json_path)
        special = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([f"[^{PLAIN}]", *special])).search
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.chunk, self.overlap = chunk, overlap

    def _stretch(self, text: str) -> bytes:
        """Ids of a text, or of what lies between two cuts."""
        if not self.odd(text):
            return as_bytes(self.ranks.encode_ordinary(text))
        out, plain = [], []

        def done() -> None:
            if plain:
                out.append(as_bytes(self.ranks.encode_ordinary("".join(plain))))
                plain.clear()

        first, *rest = _cuts(text)
        for part in [first, *(" " + x for x in rest)]:
            if self.odd(part):
                done()
                out.append(as_bytes(self.library.encode(part, add_special_tokens=False).ids))
            else:
                plain.append(part)
        done()
        return b"".join(out)

    def _starts(self, text: str) -> np.ndarray:
        """Where each part of a text begins, at its space."""
        first, *rest = _cuts(text)
        return np.cumsum([0, len(first), *(len(x) + 1 for x in rest)])[:-1]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit integers."""
        return [self._stretch(t) if len(t) <= self.chunk else b"".join(self._long(t)) for t in texts]

    def _long(self, text: str):
        """Ids of a long text, chunk by chunk."""
        at = 0  # where the present chunk begins: the text's start, or a cut that two chunks shared
        while at < len(text):
            overlap = self.overlap
            while True:
                end = min(at + self.chunk + overlap, len(text))
                if end == len(text):
                    yield self._stretch(text[at:])
                    return
                begin = max(end - 2 * overlap, at + 1)  # the next chunk's start
                left = self._starts(text[at:end]) + at
                right = self._starts(text[begin:end]) + begin
                # The first part of the right chunk and the last of the left one may be torn; a cut before the last
                # part of both is the same in the whole text.
                shared = np.intersect1d(left[1:-1], right[1:-1])
                if len(shared):
                    break
                overlap *= 2
            cut = int(shared[-1])
            yield self._stretch(text[at:cut])
            at = cut
