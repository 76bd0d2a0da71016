"""Token ids of whole texts by a byte-level BPE file, with words that recur encoded once.

Such a tokenizer never joins a character to a space that follows it, so a text may be cut
before every single space that stands between characters that aren't space, and the pieces'
ids put together again. Texts that name one of the tokenizer's added tokens go to it whole.
"""

from __future__ import annotations

import base64
import os
import re
from array import array

import numpy as np

#: Pieces a worker remembers; when there are more it begins anew.
REMEMBERED = 250_000

_BREAK = re.compile(r"(?<=\S)(?= )")
_WIDE = re.compile(r"\s ")
_ENCODERS: dict[tuple, Encoder] = {}


class Encoder:
    """Ids by the tokenizer file `path`. Where the same vocabulary also lies in `ranks`, with the
    pattern that parts its words, pieces are encoded from there: the ids are equal, at a third of the time."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.code = "H" if self.tokenizer.get_vocab_size() < 1 << 16 else "I"
        self.kind = np.dtype(self.code)
        self.known: dict[str, bytes] = {}  # ids of a word behind a space
        self.plain = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
            self.sizes = np.zeros(max(merges.values()) + 1, np.int64)
            for token, rank in merges.items():
                self.sizes[rank] = len(token)

    def _pack(self, texts: list[str]) -> list[bytes]:
        """Ids of each piece, as bytes; pieces but the first begin with a space, and none ends with one."""
        code = self.code
        if self.plain and len(texts) > 1:
            # All at once, as no token crosses from a piece into the next; then cut by bytes.
            ids = array(code, self.plain.encode_ordinary("".join(texts)))
            data, width = ids.tobytes(), ids.itemsize
            reached = np.cumsum(self.sizes[np.frombuffer(data, self.kind)])
            wanted = np.cumsum(np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts)))
            ends = [0, *(width * np.searchsorted(reached, wanted, "right")).tolist()]
            return [data[a:b] for a, b in zip(ends, ends[1:])]
        encode = self.plain.encode_ordinary if self.plain else self._whole
        return [array(code, encode(t)).tobytes() for t in texts]

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _pieces(self, text: str) -> list[bytes]:
        """The ids of a text in pieces, its first word apart."""
        first, *rest = text.split(" ")
        get = self.known.get
        found = list(map(get, rest))
        if None in found or (rest and first[-1:].isspace()) or (rest and not first):
            new = list(dict.fromkeys(p for p, ids in zip(rest, found) if ids is None))
            # Space before a space belongs to it: such a text is cut elsewhere.
            if not first or first[-1:].isspace() or _WIDE.search(" ".join(["x", *new, ""])):
                return self._pack(_BREAK.split(text))
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = list(dict.fromkeys(rest))
            self.known.update(zip(new, self._pack([" " + p for p in new])))
            found = list(map(get, rest))
        return [*self._pack([first]), *found]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out = []
        for text in texts:
            if any(token in text for token in self.added):
                out.append(np.array(self._whole(text), self.kind))
            else:
                out.append(np.frombuffer(b"".join(self._pieces(text)), self.kind))
        return out


def encoder(*files: str) -> Encoder:
    """One encoder for each set of files in a Python worker, kept for its later tasks."""
    if files not in _ENCODERS:
        _ENCODERS[files] = Encoder(*files)
    return _ENCODERS[files]
