"""Word-cached encoding with a BPE vocabulary that lower-cases and drops white space.

Such a tokenizer never joins characters across white space, so a text's ids are the ids of its
blank-separated chunks in a row. Every distinct chunk is encoded once per worker and kept as
packed little-endian unsigned 32-bit ids; a text is then a lookup per chunk.
"""

from __future__ import annotations

import json
from array import array

import regex

from talweg.llm.common import one_thread

#: The split pattern of the vocabulary file's pre-tokenizer.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Latin characters whose lower case and composed form need no context: chunks of these only can be split here.
PLAIN = regex.compile("[!-~¡-įı-ɏ]+")
SIGNS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"


def byte_signs() -> dict[int, str]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as signs from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Chunk cache over one tokenizer file; ``most`` bounds the number of cached chunks."""

    def __init__(self, path: str, most: int = 400_000) -> None:
        one_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.signs = self.tokenizer.model, byte_signs()
        self.most, self.chunks, self.pieces, self.core = most, {}, {}, {}

    def _piece(self, piece: str) -> bytes:
        """Packed ids of one letter run, digit or sign run, straight from the merge rules."""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.signs)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def learn(self, missing: list[bytes]) -> None:
        """Encode chunks that aren't cached; plain ones by way of their letters, digits and signs."""
        pieces, chunks, whole = self.pieces, self.chunks, []
        for chunk in missing:
            s = chunk.decode("utf-8", "replace")
            if (not s.isascii() and not PLAIN.fullmatch(s)) or not s.isprintable() or "<|" in s:
                whole.append(chunk)
                continue
            word = s.rstrip(SIGNS)
            parts = (word.lower(), s[len(word) :]) if word.isalpha() else SPLIT.findall(s.lower())
            ids = b""
            for p in parts:
                if p:
                    if (known := pieces.get(p)) is None:
                        known = pieces[p] = self._piece(p)
                    ids += known
            chunks[chunk] = ids
        if whole:
            for chunk, e in zip(whole, self.tokenizer.encode_batch([c.decode("utf-8", "replace") for c in whole], add_special_tokens=False), strict=True):
                chunks[chunk] = array("I", e.ids).tobytes()

    def trim(self) -> None:
        """Keep the caches bounded: the earliest half stays, as it holds the frequent chunks."""
        if not self.core and len(self.chunks) > self.most // 2:
            self.core = dict(self.chunks)
        if len(self.chunks) > self.most:
            self.chunks = dict(self.core)
        if len(self.pieces) > self.most:
            self.pieces = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each UTF-8 text."""
        out = []
        for at in range(0, len(texts), 64):
            split, chunks = [t.split() for t in texts[at : at + 64]], self.chunks
            self.learn([w for w in set().union(*split) if w not in chunks])
            get = chunks.__getitem__
            out += [b"".join(map(get, words)) for words in split]
            self.trim()
        return out


class TextEncoder:
    """Any other tokenizer file: whole texts through the library."""

    def __init__(self, path: str) -> None:
        one_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each text; bytes that aren't UTF-8 read as U+FFFD."""
        return [array("I", self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes() for t in texts]


def by_words(path: str) -> bool:
    """Whether a tokenizer file splits and normalises as ``WordEncoder`` does: chunk by chunk, in lower case."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    steps = [n.get("type") for n in (file.get("normalizer") or {}).get("normalizers", ())]
    cuts = (file.get("pre_tokenizer") or {}).get("pretokenizers", ())
    split = [c.get("pattern", {}).get("Regex") for c in cuts if c.get("type") == "Split" and c.get("behavior") == "Removed" and c.get("invert")]
    plain = [c for c in cuts if c.get("type") == "ByteLevel" and not c.get("add_prefix_space") and not c.get("use_regex")]
    return steps == ["NFC", "Replace", "Lowercase"] and split == [SPLIT.pattern] and len(plain) == 1 and len(cuts) == 2


_ENCODERS: dict[str, WordEncoder | TextEncoder] = {}


def encoder(path: str) -> WordEncoder | TextEncoder:
    """This worker's encoder for a tokenizer file: by cached words where the file allows that, else by whole texts."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path) if by_words(path) else TextEncoder(path)
    return _ENCODERS[path]
