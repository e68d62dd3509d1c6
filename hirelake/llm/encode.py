"""Token ids of many texts with a byte-level BPE file, word by word through a bounded cache."""

from __future__ import annotations

import json
import os

import numpy as np


class BpeEncoder:
    """Ids as `tokenizers` gives them (add_special_tokens=False), as bytes of little-endian unsigned 32-bit numbers.

    The pre-tokenizer of these files never joins what a single blank or a single newline parts, so a text is the
    concatenation of its words' ids, and each distinct word is encoded once. Anything that this does not cover (runs of
    white space, blanks at either end, special tokens, a file of another make) goes to `tokenizers` as a whole text.
    The cache is emptied once it
    holds more than `cache_words`.
    """

    def __init__(self, path: str, cache_words: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.cache_words = cache_words
        self.by_blank: dict[str, bytes | None] = {}
        self.by_line: dict[str, bytes | None] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.merges = self._merger(spec)
        if self.merges is not None:
            self.newline = self._by_tokenizers("\n")

    def _merger(self, spec: dict):
        """The same merges by rank, for single words; None where the file is not plain byte-level BPE."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer")
        if not plain or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            return None
        import tiktoken

        byte_of = _byte_of_character()
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merged)):
            return None
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
        self.length_of = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.length_of[i] = len(token)
        # The pre-tokenizer's published pattern; a fixed value.
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _by_tokenizers(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: set[str], cache: dict[str, bytes | None], lead: str) -> None:
        """Encodes new words in one run: each starts with `lead`, so no token spans two of them."""
        # A word that is empty or touches white space of another kind depends on its neighbours.
        odd = [w for w in words if not w or w[0].isspace() or w[-1].isspace()]
        cache.update(dict.fromkeys(odd))
        words = list(words.difference(odd))
        if not words:
            return
        ids = np.array(self.merges.encode_ordinary(lead + lead.join(words)), dtype="<u4")
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        cut = np.searchsorted(np.cumsum(self.length_of[ids]), ends) + 1
        data, at = ids.tobytes(), 0
        skip = 4 * (lead == "\n")
        for w, end in zip(words, (4 * cut).tolist(), strict=True):
            cache[w] = data[at + skip : end]
            at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.merges is None:
            return [self._by_tokenizers(t) for t in texts]
        # Emptied between runs only, so that no text of a run misses a word.
        for cache in (self.by_blank, self.by_line):
            if len(cache) > self.cache_words:
                cache.clear()
        lines = [[line.split(" ") for line in t.split("\n")] for t in texts]
        new = {w for t in lines for ws in t for w in ws[1:] if w not in self.by_blank}
        first = {ws[0] for t in lines for ws in t if ws[0] not in self.by_line}
        self._learn(first, self.by_line, "\n")
        self._learn(new, self.by_blank, " ")
        get, lead, out = self.by_blank.__getitem__, self.by_line.__getitem__, []
        for text, rows in zip(texts, lines, strict=True):
            try:
                if any(s in text for s in self.special):
                    raise KeyError
                out.append(self.newline.join([lead(ws[0]) + b"".join(map(get, ws[1:])) for ws in rows]))
            except (TypeError, KeyError):  # an odd word or a special token
                out.append(self._by_tokenizers(text))
        return out


def _byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


def text_runs(texts: list[str | None], characters: int = 1_000_000):
    """Slices (from, to) of `texts` of about so many characters, so that a batch's working set stays bounded."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= characters:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
