"""Byte-pair encoding of texts in Arrow batches, with the vocabulary file of a public tokenizer.

Almost all of a corpus is words seen before. A text is split at its spaces, each piece is looked up in a cache, and
only new pieces reach the tokenizer. The split never changes the result: the tokenizer's own first step splits at
every such place too, but for runs of white space that hold a further space, and texts with those are encoded whole.
"""

from __future__ import annotations

import base64
import re
from itertools import compress
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    import pyarrow as pa

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The first free id of that vocabulary ends a document.
END = 50256
#: The pre-tokenization rule published with this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bound on a worker's memory only: a full cache stays as it is, with the words that came first, so the frequent ones.
CACHE_PIECES = 500_000

_run_with_space = re.compile(r"\s \s|\s \Z").search
_encoders: dict[str, "Encoder"] = {}


class _Pieces(dict):
    """Ids, as bytes, of a piece that follows a space."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(" " + piece)
        if len(piece) < 64 and len(self) < CACHE_PIECES:
            self[piece] = ids
        return ids


class Encoder:
    """Texts to the ids of a vocabulary of at most 2**16, as little-endian 16-bit numbers."""

    def __init__(self, path: str):
        import numpy as np
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        if max(ranks.values()) > 0xFFFF:
            raise ValueError("ids must fit into 16 bits")
        plain = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole = lambda text: np.array(plain(text), dtype="<u2").tobytes()
        self.pieces = _Pieces(self.whole)
        self.spaced = np.zeros(1 << 16, bool)  # ids that begin with a space
        self.spaced[[rank for token, rank in ranks.items() if token[:1] == b" "]] = True

    def encode(self, text: str) -> bytes:
        if _run_with_space(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return b"".join([self.whole(first), *map(self.pieces.__getitem__, rest)])

    def encode_all(self, texts: list[str], tail: bytes = b"") -> pa.Array:
        """``encode`` of each text, and ``tail``. Each distinct piece of all texts is looked up once, and all new ones are encoded as one text."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        n, odd = len(texts), [_run_with_space(text) for text in texts]
        parts = pc.split_pattern(pa.array(["" if o else text for o, text in zip(odd, texts)], pa.large_string()), " ")
        starts, pieces = parts.offsets.to_numpy(), parts.values.dictionary_encode()
        names = pc.binary_join(pa.ListArray.from_arrays([0, len(pieces.dictionary)], pieces.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ") if n else []
        known, new = self._known(names)
        fresh = np.asarray(known.is_null())
        firsts = [self.whole(text if o else text.partition(" ")[0]) for o, text in zip(odd, texts)]
        entries = pa.concat_arrays([known, new, pa.array([*firsts, tail], pa.large_binary())])
        at = np.arange(len(names))
        at[fresh] = np.arange(len(names), len(names) + len(new))
        which = at[pieces.indices.to_numpy()]
        which[starts[:-1]] = np.arange(len(entries) - n - 1, len(entries) - 1)
        joined = entries.take(pa.array(np.insert(which, starts[1:], len(entries) - 1)))
        ends = np.frombuffer(joined.buffers()[1], np.int64)[starts + np.arange(n + 1)]
        return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), joined.buffers()[2]]).cast(pa.binary())

    def _known(self, names: list[str]) -> tuple[pa.Array, pa.Array]:
        """Ids of pieces that follow a space, null for new ones, and those of the new ones. They are encoded as one text, in which each begins
        where an id begins with a space, as it holds no other; if white space at their ends would run into the next, one by one."""
        import numpy as np
        import pyarrow as pa

        known = pa.array(map(self.pieces.get, names), pa.large_binary())
        new = list(compress(names, np.asarray(known.is_null()).tolist()))
        text = "".join([" " + name for name in new])
        if not new or _run_with_space(text):
            return known, pa.array([self.pieces[name] for name in new], pa.large_binary())
        data = self.whole(text)
        begins = np.append(np.flatnonzero(self.spaced[np.frombuffer(data, "<u2")]) * 2, len(data))
        if len(begins) != len(new) + 1:
            raise ValueError("an id of the vocabulary has a space inside")
        room = max(0, CACHE_PIECES - len(self.pieces))
        for name, a, b in zip(new[:room], begins.tolist(), begins[1:].tolist()):
            if len(name) < 64:
                self.pieces[name] = data[a:b]
        return known, pa.Array.from_buffers(pa.large_binary(), len(new), [None, pa.py_buffer(begins), pa.py_buffer(data)])


def encoder(path: str = VOCABULARY) -> Encoder:
    """The encoder of a file, once for each worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
