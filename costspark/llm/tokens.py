"""Token ids of a public tokenizer, word by word with a memory of words seen."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from itertools import filterfalse

import numpy as np

# The characters that the tokenizer's patterns take as white space.
SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0  -     　]+")
# str.split() takes these as white space too.
NOT_SPACE = re.compile("[\x1c-\x1f]")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Words of these characters are split here as the tokenizer splits them (after lower case);
# all other words go to it whole.
PLAIN = re.compile("[!-~À-įı-ſ]+")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
MARK = "\x01"


class WordIds:
    """Ids as little-endian unsigned 32-bit numbers, for ``word_bpe_49k.json`` and its like.

    Such a tokenizer never joins what white space parts, so a text's ids are its words' ids
    in order.  It is asked about new words, or parts of words, many at a time with a mark
    between them.  Words are kept in two generations of ``most`` each: what is still used moves
    on, the rest goes.  Words over ``longest`` characters aren't kept.
    """

    def __init__(self, path: str, most: int = 400_000, longest: int = 64):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for parts that are normalised and split already.
        self.light = Tokenizer.from_file(path)
        self.light.normalizer = normalizers.Sequence([])
        self.light.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.most, self.longest = most, longest
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids

    def _ask(self, parts: list[str], step: int = 1000) -> None:
        for k in range(0, len(parts), step):
            own = parts[k : k + step]
            text = f" {MARK} ".join(own)
            (found,) = self.light.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4")
            ends = [*(4 * np.flatnonzero(ids == self.mark[0])).tolist(), 4 * len(ids)]
            data, begin = ids.tobytes(), 0
            for p, end in zip(own, ends):
                self.parts[p] = data[begin:end]
                begin = end + 4

    def _parts(self, word: str) -> list[str] | None:
        """The word as the tokenizer splits it; None if that is left to the tokenizer."""
        if len(word) > self.longest or len(self.mark) != 1:
            return None
        if word.isascii() and word.isalpha():
            return [word.lower()]
        if "<|" in word or not PLAIN.fullmatch(word):
            return None
        return PARTS.findall(word.lower())

    def _learn(self, words: set[str]) -> None:
        """Puts ids of ``words``, none of them in ``new``, there."""
        if len(self.parts) > self.most:
            self.parts = {}
        new, old, parts = self.new, self.old, self.parts
        split = {}
        for w in words:
            ids = old.get(w)
            if ids is None:
                split[w] = self._parts(w)
            else:
                new[w] = ids
        self._ask([p for p in set().union(*filter(None, split.values())) if p not in parts])
        rest = [w for w, own in split.items() if own is None]
        for w, own in split.items():
            if own is not None:
                new[w] = parts[own[0]] if len(own) == 1 else b"".join([parts[p] for p in own])
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            new[w] = array("I", e.ids).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        new = self.new
        listed = [[w for w in SPACE.split(t) if w] if NOT_SPACE.search(t) else t.split() for t in texts]
        missing: set[str] = set()
        for words in listed:
            missing.update(filterfalse(new.__contains__, words))
        self._learn(missing)
        out = [b"".join(map(new.__getitem__, words)) for words in listed]
        for w in missing:
            if len(w) > self.longest:
                del new[w]
        return out


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    """One per Python worker, so that its memory of words outlives a task."""
    return WordIds(path)
