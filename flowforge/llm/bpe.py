"""Byte-level BPE vocabularies: tables shared by token counting and encoding."""

from __future__ import annotations

import json
import sys
import unicodedata

import regex
from tokenizers import pre_tokenizers

# FIXED VALUES: the published pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def letter_bytes() -> dict[str, int]:
    """Byte of each letter of the vocabulary file: printable Latin-1 bytes
    stand for themselves, the others for the letters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = {}, 256
    for b in range(256):
        if b in plain:
            out[chr(b)] = b
        else:
            out[chr(more)] = b
            more += 1
    return out


def recent_characters() -> frozenset[str]:
    """Letters and numbers of Unicode versions newer than Python's.  Libraries
    disagree about their class, so a text with one is split by ``tokenizers``."""
    known = regex.compile(r"[\p{L}\p{N}]")
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    return frozenset(c for c in known.findall(every) if unicodedata.category(c) == "Cn")


class Vocabulary:
    """Ids, byte strings and merge ranks of a byte-level BPE vocabulary file
    (the JSON of the ``tokenizers`` library)."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        pre, model = spec["pre_tokenizer"], spec["model"]
        plain = not spec["normalizer"] and not spec["post_processor"] and not model.get("dropout") and not model.get("ignore_merges")
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or not plain:
            raise ValueError("not a plain byte-level BPE vocabulary")
        letters = letter_bytes()
        self.ids = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items()}
        self.bytes_of = {i: word for word, i in self.ids.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: (left id, right id) -> (rank, merged id)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            a, b = (bytes(letters[c] for c in x) for x in (a, b))
            self.merges.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        #: strings that are cut out of a text before anything else, and their ids
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with options are not supported")
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self._find = regex.compile(PATTERN).findall
        self.recent = recent_characters()
        self._library = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str

    def _pre_tokens(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")  # much faster than the search
        except UnicodeEncodeError:
            if not self.recent.isdisjoint(set(text)):
                return [text[a:b] for _, (a, b) in self._library(text)]
        return self._find(text)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token by applying merges, lowest rank first."""
        parts = [self.ids[piece[i:i + 1]] for i in range(len(piece))]
        get = self.merges.get
        while len(parts) > 1:
            best = min((m for m in map(get, zip(parts, parts[1:], strict=False)) if m), default=None)
            if best is None:
                break
            out, i, (_, new) = [], 0, best
            while i < len(parts):
                if i + 1 < len(parts) and get((parts[i], parts[i + 1])) == best:
                    out.append(new)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def whole(self) -> set[int]:
        """Ids whose byte string, alone, is proved to encode as that one id."""
        return {i for word, i in self.ids.items() if self.merge(word) == [i]}

    def segments(self, text: str):
        """The text cut at special strings: (pre-tokens, special id or None)."""
        at = 0
        if self._special is not None:
            for m in self._special.finditer(text):
                yield self._pre_tokens(text[at:m.start()]), self.specials[m.group()]
                at = m.end()
        yield self._pre_tokens(text[at:] if at else text), None
