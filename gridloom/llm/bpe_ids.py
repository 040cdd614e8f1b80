"""Exact, fast ids of the two BPE vocabularies that the operators use.

The reference of both encoders is the tokenizers library on the same file. ``ByteBpe`` runs the rank
form of the vocabulary where the two libraries cannot differ (characters below U+0250, no special
token in the text) and the tokenizers library itself elsewhere. ``WordBpe`` encodes each distinct word
once and reuses the ids.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

from gridloom.llm.textops import VOCABULARIES

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Splits text before the merges of a byte-level vocabulary (the published pattern of that family).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_RARE = re.compile("[^\x00-ɏ]")


def vocabulary(name: str) -> str:
    """Where a vocabulary file lies; a path is returned as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _unicode_bytes() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Byte-level BPE: ids of whole texts, and their bytes."""

    _loaded: dict[str, ByteBpe] = {}

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        """One instance for each worker process."""
        if path not in cls._loaded:
            if not cls._loaded:
                VOCABULARIES.append(cls._loaded.clear)
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec["added_tokens"]]
        pre = spec["pre_tokenizer"] or {}
        byte = _unicode_bytes()
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        size = max([*ranks.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.token_bytes = [b""] * size
        for raw, i in ranks.items():
            self.token_bytes[i] = raw
        for t in spec["added_tokens"]:
            self.token_bytes[t["id"]] = t["content"].encode("utf-8")
        self.token_length = np.array([len(b) for b in self.token_bytes], np.int64)
        self._token_start = np.concatenate([[0], np.cumsum(self.token_length)[:-1]])
        self._flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        usual = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex")
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if usual else None

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or _RARE.search(text) or any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        lengths = self.token_length[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self._token_start[ids] - ends + lengths, lengths)
        at += np.arange(len(at))
        return self._flat[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _characters(kind: str) -> str:
    """Characters below U+0250 of a Unicode category, for a bracket of a regular expression."""
    return "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == kind)


_L, _N = _characters("L"), _characters("N")
#: The splitter of the word vocabulary's family, over lower-cased characters below U+0250.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^ \t\n\v\f\r\x85\xa0{_L}{_N}]+")
#: Its normaliser and splitter as the vocabulary file must state them for the fast way to be taken.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Words(dict):
    """word -> ids as bytes; a new word is worked out when it is asked for."""

    def __init__(self, merger, ids: list[bytes]):
        self.merge, self.ids = merger._encode_single_piece, ids

    def __missing__(self, word: str) -> bytes:
        out = self[word] = b"".join([self.ids[r] for r in self.merge(word.encode("utf-8") + b"\xff")])
        return out


class WordBpe:
    """A vocabulary whose splitter drops white space and whose words end in a mark.

    Plain texts (characters below U+0250, no special token) are split here and each distinct word's ids
    are worked out once, by a byte-level merger in which a byte that UTF-8 never uses stands for the
    mark. Other texts go to the tokenizers library in runs between blanks, which its normaliser and
    splitter never look across.
    """

    _loaded: dict[str, WordBpe] = {}
    #: Remembered words at most; then the memory starts afresh.
    MOST = 200_000

    @classmethod
    def load(cls, path: str) -> WordBpe:
        if path not in cls._loaded:
            if not cls._loaded:
                VOCABULARIES.append(cls._loaded.clear)
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.known: dict[str, bytes] = {}  # of words, if plain
        self.known_runs: dict[str, bytes] = {"": b""}
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec["added_tokens"]]
        steps = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = [p.get("pattern", {}).get("Regex") for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and split[:1] == [_WORD_SPLIT] and spec["model"].get("end_of_word_suffix") == "</w>"
        if self.plain:
            byte, mark, raw = _unicode_bytes(), b"\xff", {}
            for token, i in spec["model"]["vocab"].items():
                if token not in self.special:
                    ends = token.endswith("</w>") and len(token) > 4
                    raw[bytes(byte[c] for c in (token[:-4] if ends else token)) + mark * ends] = i
            ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + mark: 256 + b for b in range(256)}
            ids = {r: raw[k] for k, r in ranks.items()}
            for k, i in raw.items():
                if k not in ranks:
                    ranks[k] = ids[i] = i
            merger = tiktoken.Encoding("word-ends", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
            self.known = _Words(merger, [ids.get(r, 0).to_bytes(4, "little") for r in range(max(ids) + 1)])

    def _plain(self, text: str) -> bytes:
        if len(self.known) > self.MOST:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, _WORDS.findall(text.lower())))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Of each text the ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if self.plain and not _RARE.search(t) and "\u0130" not in t and not any(s in t for s in self.special):
                out[i] = self._plain(t)
            else:
                rest.append(i)
        if rest:
            runs = [texts[i].replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for i in rest]
            if len(self.known_runs) > self.MOST // 4:
                self.known_runs = {"": b""}
            known = self.known_runs
            new = list({w for r in runs for w in r if w not in known})
            for s in range(0, len(new), 20_000):
                part = new[s : s + 20_000]
                for word, e in zip(part, self.exact.encode_batch_fast(part, add_special_tokens=False)):
                    known[word] = np.array(e.ids, "<u4").tobytes()
            for i, r in zip(rest, runs):
                out[i] = b"".join(map(known.__getitem__, r))
        return out
