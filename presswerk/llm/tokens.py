"""Token ids of whole texts, as little-endian unsigned 32-bit buffers."""

from __future__ import annotations

import json
import re
import struct
import unicodedata

import numpy as np

from presswerk.llm.common import ChunkMemo, worker_state


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the byte-level vocabularies, to bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranges(kind: str, top: int) -> str:
    return "".join(re.escape(chr(c)) for c in range(top) if unicodedata.category(chr(c))[0] == kind)


class WordTokenizer:
    """Ids of a word-end BPE vocabulary file, equal to those of the ``tokenizers`` library.

    White space separates pre-tokens, so a text's ids are those of its chunks,
    one after the other, and a chunk's ids are remembered.  Chunks not seen yet
    go through ``tiktoken``'s merge loop over the same ranks: a terminal NUL
    byte stands for the word-end mark, and since a byte with a word-end mark has
    a lower rank than any merge, the mark joins its byte first.  A text with
    characters outside Latin letters (where case folding, composition or
    special strings might differ) is given to ``tokenizers`` itself.
    """

    #: Characters below this are letters, digits, marks and signs of Latin script.
    TOP = 0x240
    #: UTF-8 bytes of such characters, without control characters that white-space rules treat differently.
    PLAIN = bytes([*range(9, 14), *range(32, 127), *range(128, 201)])
    MARK = "\x01"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, specials = _byte_alphabet(), {x["content"] for x in spec["added_tokens"]}
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in specials:
                body = token.removesuffix("</w>")
                ranks[bytes(alphabet[c] for c in body) + b"\x00" * (body != token)] = i
        self.merge = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(path)
        letter, number = _ranges("L", self.TOP), _ranges("N", self.TOP)
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\s{letter}{number}]+")
        self.mark = ranks[b"\x01\x00"]
        self.memo = ChunkMemo(self._chunks)

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        if not chunks:
            return []
        pieces = self.split.findall(f" {self.MARK} ".join(chunks))
        ids = np.array(self.merge.encode_ordinary("\x00".join(pieces) + "\x00"), dtype="<u4")
        at, raw = [-4, *(4 * np.flatnonzero(ids == self.mark)).tolist(), 4 * len(ids)], ids.tobytes()
        return [raw[a + 4 : b] for a, b in zip(at, at[1:])]

    def _odd(self, text: str) -> bool:
        return bool(text.encode("utf-8", "replace").translate(None, self.PLAIN)) or "<|" in text or "\u0130" in text

    def ids(self, texts: list[str]) -> list[bytes]:
        """A buffer for each text."""
        odd = [self._odd(x) for x in texts]
        out = self.memo.buffers([[] if o else x.lower().split() for x, o in zip(texts, odd)])
        for k, o in enumerate(odd):
            if o:
                ids = self.exact.encode(texts[k], add_special_tokens=False).ids
                out[k] = struct.pack(f"<{len(ids)}I", *ids)
        return out


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer and memo for each Python worker."""
    return worker_state(("words", path), lambda: WordTokenizer(path))
