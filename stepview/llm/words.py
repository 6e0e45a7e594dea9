"""Token ids of whole texts, word by word.

In a tokenizer that drops white space, nothing reaches across it: normal form and
lower case act on one character or on a letter with its marks, the pattern that
splits text never matches white space, merges stay within a match. So a text's
ids are those of its white-space separated words in a row, and words repeat.
A bounded table of words is kept in each worker; whatever does not fit is
encoded again each time. Texts with a special token's own string are rare and go
through the library as they are.
"""

from __future__ import annotations

import functools
import json
import re

from tokenizers import Tokenizer

#: Words, and pieces of words, kept by a worker: about 120 MB.
ROOM = 800_000


@functools.cache
def load(path: str) -> Tokenizer:
    """The tokenizer with truncation and padding off."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def check(path: str) -> None:
    """Raise unless the tokenizer has the form for which encoding by words is exact."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    kinds = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])]
    steps = [x["type"] for x in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
    split = made["pre_tokenizer"]["pretokenizers"][0] if steps == ["Split", "ByteLevel"] else {}
    fits = (
        kinds == ["NFC", "Replace", "Lowercase"]
        and made["normalizer"]["normalizers"][1] == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        and split.get("invert") is True
        and split.get("behavior") == "Removed"
        and split["pattern"]["Regex"].endswith(r"|[^\s\p{L}\p{N}]+")
        and made["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"] is False
        and made["model"]["type"] == "BPE"
        and not made["model"]["dropout"]
        and not made["model"].get("ignore_merges")
        and not any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in made["added_tokens"])
    )
    if not fits:
        raise ValueError(f"{path}: words can't be encoded by themselves with this tokenizer")


class Words(dict):
    """A word's UTF-8 bytes -> its ids as little-endian unsigned 32-bit integers.

    Pieces of words, in lower case, are words as well and share the table.
    """

    def __init__(self, path: str, room: int = ROOM):
        super().__init__()
        check(path)
        self.library = load(path)
        self.room = room
        self.special = [x.content.encode() for x in self.library.get_added_tokens_decoder().values()]
        self._tokenize = self.library.model.tokenize
        self.packed = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if _PLAIN(text) is None:
            form = self.library.normalizer.normalize_str(text)
            got = b"".join([self.piece(x) for x, _ in self.library.pre_tokenizer.pre_tokenize_str(form)])
        else:
            parts = _PARTS(text.lower())
            if len(parts) == 1 and parts[0] == text:
                got = self.piece(text if text.isascii() else letters(text))
            else:
                got = b"".join([self[x.encode()] for x in parts])
        if len(self) < self.room:
            self[word] = got
        return got

    def piece(self, piece: str) -> bytes:
        """What the merges make of a match of the pattern, given in the tokenizer's letters for bytes."""
        packed = self.packed
        return b"".join([packed[t.id] for t in self._tokenize(piece)])

    def ids(self, text: bytes | None) -> bytes:
        """Ids of a whole text; none for a null."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            whole = self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False)
            return b"".join([self.packed[i] for i in whole.ids])
        return b"".join(map(self.__getitem__, text.split()))


def letters(piece: str) -> str:
    """A piece in the letters that byte-level tokenizers have for bytes."""
    return piece.encode().decode("latin-1").translate(_LETTERS)


#: Fixed rule: printable bytes stand for themselves, all others for letters from 256 on, in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: Words of printable ASCII and Latin-1 letters: in normal form, each letter with one lower case.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: The alternatives of the splitting pattern, for such words in lower case.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+").findall


@functools.cache
def library_words(path: str) -> Words:
    """One table of words for all batches and tasks of a worker."""
    return Words(path)
