"""Public sub-word tokenizers inside tasks, and the places where a text may be cut without changing a token.

Two facts about a vocabulary are proved when it is loaded. Byte-pair pieces only ever grow into other pieces of the
vocabulary, so no token crosses a place between two characters that stand side by side in no piece: such a place is
*stable*. And a space before a character that is no white space always begins a new match of the byte-level pattern.

A *unit* is what stands between two places of the kind 'no space, then a space, then no white space'. Both
tokenizers cut there, so a unit has the same tokens wherever it stands, and a task tokenises each distinct unit once.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "▁"             # how pieces write a space
BLOCK_CHARS = 1 << 16       # units are tokenised end to end in blocks of about so many characters
LONG_UNIT = 1_000           # characters; longer units are tokenised alone

_ODD = re.compile(f" (?!\\S)|{MARK}")                   # texts that Arrow can't split at every space
_BREAK = re.compile(f"(?<=[^ {MARK}])(?= \\S)")
_BEFORE_WORD = re.compile("(?= \\S)")


def default_path(name: str) -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceModel:
    """A sentencepiece model with byte fallback: its tokens, their bytes and its stable places."""

    lead = 1  # bytes in front of the text: the model adds a space

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(len(self.model))]
        self.bytes = [self._bytes(p) for p in pieces]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.pairs = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
        # Models that rewrite texts have no provable places.
        self.plain = self.model.normalize("  a\t\uff46 \ufb01 ") == "   a\t\uff46 \ufb01 ".replace(" ", MARK)
        # Units are cut between a character and a space: no piece may hold a space behind anything but spaces.
        self.cuts_at_spaces = self.plain and not any(p[1] == MARK and p[0] != MARK for p in self.pairs)

    @staticmethod
    def _bytes(piece: str) -> bytes:
        if re.fullmatch("<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(MARK, " ").encode()

    def encode(self, text: str) -> list[int]:
        """Tokens of ``text``; the model puts a space in front."""
        return self.model.encode(text)

    def shown(self, text: str) -> str:
        """``text`` as the tokens spell it: the model can't tell its mark from a space."""
        return text.replace(MARK, " ")

    def stable_places(self, text: str) -> Iterator[int]:
        """Places in a shown text that no token crosses: the characters around them stand side by side in no piece."""
        text = text.replace(" ", MARK)
        return (i for i in range(1, len(text)) if text[i - 1:i + 1] not in self.pairs) if self.plain else iter(())


class ByteModel:
    """A byte-level byte-pair vocabulary of the ``tokenizers`` library; special strings are plain text.

    Where the merges stand in the order of their ids, which is checked, ranks say the same as merges, and tiktoken
    tokenises by them in a quarter of the time; texts of over ``LONG_UNIT`` characters, on whose runs its time can be
    quadratic, and vocabularies of another kind go through ``tokenizers``.
    """

    lead = 0

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splits = spec["pre_tokenizer"] or {}
        self.plain = spec["normalizer"] is None and splits.get("type") == "ByteLevel" and splits.get("use_regex", True) \
            and not splits.get("add_prefix_space", True) and spec["model"]["type"] == "BPE"
        self.fast = self._ranked(spec) if self.plain else None

    def _ranked(self, spec: dict):
        import tiktoken
        from public_tokenizers import PATTERN

        vocabulary = spec["model"]["vocab"]
        special = {t["content"] for t in spec["added_tokens"]}
        of = self._byte_of()
        self.bytes = [b""] * self.model.get_vocab_size()
        for token, i in vocabulary.items():
            if token not in special:
                self.bytes[i] = bytes(of[c] for c in token)
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        ids = [vocabulary[m] for m in merges]
        if ids != sorted(set(ids)):
            return None
        ranks = {b: i for i, b in enumerate(self.bytes) if b}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _byte_of() -> dict[str, int]:
        """The byte for each character of a byte-level token: printable ones stand for themselves, the rest begin at U+0100."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def encode(self, text: str) -> list[int]:
        if self.fast is not None and len(text) <= LONG_UNIT:
            return self.fast.encode_ordinary(text)
        return self.model.encode(text, add_special_tokens=False).ids

    def encode_block(self, text: str) -> list[int]:
        """A block of short units, end to end."""
        return self.fast.encode_ordinary(text) if self.fast is not None else self.encode(text)

    def shown(self, text: str) -> str:
        return text

    def stable_places(self, text: str) -> Iterator[int]:
        """Places before a space that stands before no white space: the pattern always begins a match there."""
        return (m.start() for m in _BEFORE_WORD.finditer(text) if m.start()) if self.plain else iter(())


# One of each in a Python worker, whatever the number of its tasks.
@functools.lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


@functools.lru_cache(maxsize=4)
def byte_model(path: str) -> ByteModel:
    return ByteModel(path)


def units_of(text: str) -> list[str]:
    """The units of a text with a space put in front, each without its leading space."""
    return [u[1:] for u in _BREAK.split(" " + text)]


def split_units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """All units of many texts that are not empty: the order in which texts are dealt with, where each begins, an index
    per unit, and the distinct units."""
    odd = np.array([_ODD.search(t) is not None or t[0].isspace() for t in texts], bool)
    order = np.argsort(odd, kind="stable")
    plain = pc.split_pattern(pa.array([t for t, o in zip(texts, odd, strict=True) if not o], pa.large_string()), " ")
    rest = pa.array([units_of(t) for t, o in zip(texts, odd, strict=True) if o], pa.list_(pa.large_string()))
    counts = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in (plain, rest)])
    values = pa.concat_arrays([plain.flatten(), rest.flatten()]).dictionary_encode()
    begins = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return order, begins, values.indices.to_numpy().astype(np.int64), values.dictionary.to_pylist()


def blocks_of(units: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Numbers of the units that may be tokenised end to end, in blocks, and of those that stand alone."""
    size = np.fromiter(map(len, units), np.int64, len(units))
    alone = np.fromiter((not u or u[0].isspace() or u[-1] == " " or MARK in u for u in units), bool, len(units))
    alone |= size > LONG_UNIT
    joined = np.flatnonzero(~alone)
    block = np.cumsum(size[joined] + 1) // BLOCK_CHARS
    return np.split(joined, np.flatnonzero(np.diff(block)) + 1) if len(joined) else [], np.flatnonzero(alone)
