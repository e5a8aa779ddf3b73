"""Encoding whole texts by a public tokenizer file, with a bounded memory of words already encoded.

Words repeat, so each unit between proven boundaries is encoded once and remembered.  A boundary is proven if no token of
the tokenizer can reach over it, whatever stands further off; for a word BPE that is ASCII white space, which its pattern drops.

Units of plain letters are one pre-token, which is encoded by the file's ranks alone; the library encodes all other units.

Special strings hold no white space, so they never cross such a boundary, and the library finds them inside a unit.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from .common import Cache

#: Bytes of units and their ids remembered by a Python worker.
MEMORY = 64 << 20
_MARKS = ".,;:?!"
#: Stands for the end-of-word mark; no UTF-8 text has this byte.
_END = b"\xff"


def byte_letters() -> dict[int, str]:
    """The printable letters that byte-level vocabularies write bytes as: printable Latin-1 as itself, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    return out | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in out)}


def load(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def pieces(path: str):
    """Encodes the bytes of one pre-token by the ranks of a BPE file; an end-of-word mark is written as _END.

    A rank is the token's id, which is also the order of merges in such files; a file that is otherwise is refused.
    """
    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    model, back = read["model"], {c: b for b, c in byte_letters().items()}
    mark, special = model.get("end_of_word_suffix") or "", {t["content"] for t in read["added_tokens"]}
    ranks: dict[bytes, int] = {}
    for token, number in model["vocab"].items():
        if token not in special:
            end = bool(mark) and token.endswith(mark)
            ranks[bytes(back[c] for c in (token[: -len(mark)] if end else token)) + _END * end] = number
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in pairs]
    if model["type"] != "BPE" or order != sorted(order) or model.get("ignore_merges"):
        raise ValueError(f"{path}: the merges are not in the order of the ids")
    return tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


#: Letters of ASCII and Latin-1: letters for every Unicode version, and so are their lower-case forms.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_LATIN = re.compile("[a-zß-öø-ÿ]+")
_SAFE = frozenset(c for c in map(chr, range(0x100)) if _LETTERS.fullmatch(c))


class UnitEncoder:
    """Ids of a word BPE as little-endian unsigned integers, by units between ASCII white space."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.tokenizer = load(path)
        self.piece = pieces(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.known = Cache(self._encode, memory)

    def _encode(self, unit: bytes) -> bytes:
        text = unit.decode()
        core = text.rstrip(_MARKS)
        if len(core) != len(text) and core and core[-1] in _SAFE:
            return self.known[core.encode()] + self.known[text[len(core) :].encode()]
        lower = text.lower()
        if _LATIN.fullmatch(lower):
            return np.array(self.piece(lower.encode() + _END), self.dtype).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, data: bytes) -> bytes:
        known = self.known
        if not data.translate(None, _PLAIN):
            spaced = data.lower()
            if not any(x in spaced for x in _RUNS):
                # Letters, blanks and lone commas and stops: each mark is a pre-token of its own, so it may stand apart.
                spaced = spaced.replace(b",", b" , ").replace(b".", b" . ")
                return b"".join([known[u] for u in spaced.split()])
        return b"".join([known[u] for u in data.split()])


#: Bytes of ASCII letters, blanks, commas and stops, and of Latin-1 letters beyond ASCII; with _RUNS, what is none of these.
_PLAIN = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *b" \n,.", 0xC3, *range(0x80, 0xC0)])
_RUNS = (b"..", b",,", b".,", b",.", "×".encode(), "÷".encode())

_LOADED: dict[tuple, object] = {}


def worker(kind, path: str):
    """One encoder for each Python worker and file."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]
