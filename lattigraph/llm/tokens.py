"""Token ids of texts by the vocabulary files of public tokenizers."""

from __future__ import annotations

import functools
import json
import re
import struct

import numpy as np
import regex

#: Fixed value: the split pattern of the word vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_MARKS = ".,;:!?#$%&*|"
_LATIN = regex.compile(WORD_PATTERN)


def vocabulary_path(name: str) -> str:
    """Where an installed vocabulary file lies; its name or a full path are the operators' parameter."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary has for each byte that does not stand for itself."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


class ChunkEncoder:
    """Encodes texts with a tokenizer whose pieces never reach over white space.

    With the word vocabulary's split pattern, which is proven to part and drop white space, texts are cut at spaces
    and line feeds; the ids of every chunk are kept in a bounded cache, so that a repeated word costs one look-up. A new chunk
    of plain Latin text is cut into pieces whose ids are kept as well; any other chunk goes through the
    whole tokenizer, and so does every text with any other vocabulary. Each text is encoded whole.
    """

    def __init__(self, name: str, dtype: str = "<u2", most: int = 400_000):
        from tokenizers import Tokenizer

        path = vocabulary_path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype, self.most, self.cache, self.pieces = dtype, most, {}, {}
        if self.tokenizer.get_vocab_size() > np.iinfo(dtype).max + 1:
            raise ValueError(f"{name} has more ids than {dtype} holds")
        with open(path) as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        #: pieces are known to end at white space, which is dropped; any other vocabulary encodes whole texts
        self.by_piece = steps[0].get("pattern") == {"Regex": WORD_PATTERN} and steps[0].get("behavior") == "Removed" and bool(steps[0].get("invert"))
        self.special = tuple(t["content"] for t in spec.get("added_tokens", ()))
        self.letters = byte_letters()
        self.model = self.tokenizer.model

    def _piece(self, piece: str) -> bytes:
        word = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        out = self.pieces[piece] = self.pack(*[t.id for t in self.model.tokenize(word)])
        return out

    def pack(self, *ids: int) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype == '<u2' else 'I'}", *ids)

    def _chunk(self, chunk: str) -> bytes:
        low = chunk.lower()  # letters, and perhaps marks behind them: most chunks
        word = low.rstrip(_MARKS)
        if word.isalpha() and (word.isascii() or max(word) <= "\u024f"):
            ids = self.pieces.get(word) or self._piece(word)
            if len(word) == len(low):
                return ids
            marks = low[len(word) :]
            return ids + (self.pieces.get(marks) or self._piece(marks))
        if chunk.isprintable() and not any(s in chunk for s in self.special):
            if chunk.isascii():
                found = _ASCII.findall(chunk.lower())
            elif max(chunk) <= "\u024f":
                found = _LATIN.findall(self.tokenizer.normalizer.normalize_str(chunk))
            else:
                found = None
            if found is not None:
                get = self.pieces.get
                return b"".join([get(p) or self._piece(p) for p in found])
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text (null: empty) as little-endian bytes, without special tokens."""
        if not self.by_piece:
            found = self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
            return [np.array(f.ids, self.dtype).tobytes() for f in found]
        out = []
        for text in texts:
            chunks = text.replace("\n", " ").split(" ") if text else []
            try:
                out.append(b"".join(map(self.cache.__getitem__, chunks)))
            except KeyError:
                for store in (self.cache, self.pieces):
                    if len(store) > self.most:
                        store.clear()
                for chunk in set(chunks).difference(self.cache):
                    self.cache[chunk] = self._chunk(chunk)
                out.append(b"".join(map(self.cache.__getitem__, chunks)))
        return out


@functools.cache
def encoder(name: str, dtype: str) -> ChunkEncoder:
    """One encoder for each Python worker."""
    return ChunkEncoder(name, dtype)
