"""Tokenizer calls inside tasks: the `tokenizers` library behind a bounded memo of word encodings.

Words repeat, and a byte-pair model never merges across pre-tokens. Where the text has a
border that every tokenization must have (see `WordMemo.proven`), the encoding of the text is the
concatenation of the encodings of its pieces, so each distinct piece is encoded once. Arrow
splits a batch of texts, finds its distinct pieces and puts their ids together.
Texts whose borders cannot be proven that way go to the library whole.
"""

from __future__ import annotations

import functools
import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from weftlog.llm.base import holds

# Entries of a memo before it starts afresh: about 220 MB of a worker's memory.
MEMO_ENTRIES = 1_400_000
# Closing marks that are a pre-token of their own at the end of a word.
MARKS = (".", ",")
# How a byte-level vocabulary writes a token that starts with a space or a line break.
STARTS = ("\u0120", "\u010a")
# New words that one call encodes together.
TOGETHER = 500
# White space other than a single space or a single line break between two other characters.
LOOSE_SPACE = (r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
               r"|\A[ \n]|[ \n]\z|[ \n][ \n]")


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def word_memo(path: str) -> "WordMemo":
    return WordMemo(path)


def _forget() -> None:
    word_memo.cache_clear()
    tokenizer.cache_clear()


holds("words", _forget)


class WordMemo:
    """Token ids of texts, as little-endian unsigned integers of `width` bytes."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        added = spec.get("added_tokens") or []
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in added)
        kinds = _pre_tokenizers(spec)
        # "prefixed": a word takes the space before it along; "dropped": white space vanishes.
        if plain and kinds == ["ByteLevel"] and spec["pre_tokenizer"].get("use_regex", True) and not spec.get("normalizer"):
            self.kind = "prefixed"
        elif plain and kinds[:1] == ["Split"] and _drops_spaces(spec["pre_tokenizer"]["pretokenizers"][0]):
            self.kind = "dropped"
        else:
            self.kind = "whole"
        self.marks = {m: self._ids(m) for m in MARKS}
        self.breaks = self._ids("\n") if self.kind == "prefixed" else b""
        # Encodings of words; prefixed: with the space before them, or with the line break that the key then starts with.
        self.words = self._none()
        if self.kind == "prefixed":
            self.starts = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
            self.starts[[i for t, i in self.tok.get_vocab().items() if t[:1] in STARTS]] = True

    def _none(self) -> dict[str, bytes]:
        return {"": b"", "\n": self.breaks}

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def proven(self, texts: list[str]) -> list[bool]:
        """Whether the encodings of the words of a text are known to concatenate to that of the text.

        dropped: no pre-token holds a space or line break and no normalization step reaches
        across one, so both always separate. prefixed: a single space between two characters
        that are not white space starts a pre-token, and a single line break there is one.
        """
        if self.kind != "prefixed":
            return [self.kind == "dropped"] * len(texts)
        return pc.invert(pc.match_substring_regex(pa.array(texts, pa.large_string()), LOOSE_SPACE)).to_pylist()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > MEMO_ENTRIES:
            self.words = self._none()
        proven = self.proven(texts)
        by_words = iter(self._by_words([t for t, ok in zip(texts, proven) if ok]))
        return [next(by_words) if ok else self._ids(t) for t, ok in zip(texts, proven)]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        col = pa.array(texts, pa.large_string())
        if self.kind == "prefixed":
            # A word that starts a line, or the text, takes the line break along; that of the text is cut off again.
            line, nothing = pa.scalar("\n", col.type), pa.scalar("", col.type)
            col = pc.binary_join_element_wise(line, pc.replace_substring(col, "\n", " \n"), nothing)
        else:
            col = pc.replace_substring(col, "\n", " ")
        split = pc.split_pattern(col, " ")
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.words.get, distinct))
        self._learn([w for w, ids in zip(distinct, found) if ids is None])
        found = [self.words[w] if ids is None else ids for w, ids in zip(distinct, found)]
        coded = pa.array(found, pa.large_binary()).take(words.indices)
        _, starts, data = coded.buffers()
        if data is None:
            return [b""] * len(texts)
        cuts = np.frombuffer(starts, np.int64)[split.offsets.to_numpy()].tolist()
        skip = len(self.breaks)
        return [data[a + skip:b].to_pybytes() for a, b in zip(cuts, cuts[1:])]

    def _learn(self, new: list[str]) -> None:
        # A letter before a closing mark ends a pre-token, so only the word itself has to be known.
        marked = [w for w in new if w[-1:] in MARKS and w[-2:-1].isalpha()]
        alone = {w[:-1] for w in marked if w[:-1] not in self.words}
        alone.update(w for w in new if w[-1:] not in MARKS or not w[-2:-1].isalpha())
        asked = list(alone)
        if asked:
            ids, cuts = self._together(asked) if self.kind == "prefixed" else self._each(asked)
            flat = ids.tobytes()
            cuts = (cuts * self.width).tolist()
            self.words.update((w, flat[a:b]) for w, a, b in zip(asked, cuts, cuts[1:]))
        for w in marked:
            self.words[w] = self.words[w[:-1]] + self.marks[w[-1]]

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where those of each begin and end."""
        found = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), dtype=self.dtype)
        return ids, np.cumsum([0, *map(len, found)])

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """`_each` of words with what stands before them, many of them in one text: exactly the first token
        of a word starts with its space or line break. Where an added token does so too, the counts differ."""
        spaced = [w if w[0] == "\n" else " " + w for w in words]
        ids, _ = self._each(["".join(spaced[i:i + TOGETHER]) for i in range(0, len(spaced), TOGETHER)])
        cuts = np.flatnonzero(self.starts[ids])
        return (ids, np.append(cuts, len(ids))) if len(cuts) == len(words) else self._each(spaced)

    def count(self, texts: list[str]) -> list[int]:
        return [len(b) // self.width for b in self.encode(texts)]


def _pre_tokenizers(spec: dict) -> list[str]:
    pre = spec.get("pre_tokenizer") or {}
    return [p["type"] for p in pre.get("pretokenizers", [pre])] if pre else []


def _drops_spaces(split: dict) -> bool:
    """Whether a Split keeps only what its pattern matches, and the pattern matches no white space."""
    return split["invert"] and split["behavior"] == "Removed" and r"[^\s" in split["pattern"].get("Regex", "")
