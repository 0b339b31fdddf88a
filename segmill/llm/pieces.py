"""Exact, fast ids of the word-level BPE: white-space pieces are encoded once and remembered.

The vocabulary's normaliser (NFC, white space to one space, lower case) and its splitting
pattern never join characters across ASCII white space, and none of its special strings
holds white space. So the ids of a text are the ids of its white-space pieces, in order.
Pieces of Latin letters, perhaps with closing punctuation, take a shorter way: NFC leaves
characters below U+0250 alone, lower case maps them one to one, and a run of letters and
the run of punctuation behind it are separate words for the splitting pattern; a tokenizer
with the same merges but without normaliser and pattern gives the same ids.
"""

from __future__ import annotations

import functools
import gc
import json
import os

import numpy as np

#: Pieces remembered in one worker; beyond it only for the batch at hand.
REMEMBER = 500_000
#: Without the apostrophe, with which endings like 's begin.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def load(path: str):
    """The library's tokenizer, one thread, nothing cut or padded."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Pieces:
    """Maps a text to its ids as little-endian 32-bit bytes."""

    def __init__(self, path: str, remember: int = REMEMBER):
        self.full = load(path)
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec.update(normalizer=None, added_tokens=[], truncation=None, padding=None, post_processor=None)
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, level]}
        self.lean = Tokenizer.from_str(json.dumps(spec))
        self.lean.model._resize_cache(0)
        ending = spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, dtype=bool)
        for token, i in spec["model"]["vocab"].items():
            self.ends[i] = token.endswith(ending)
        self.memo: dict[bytes, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.remember = remember

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of lower-case words of Latin letters, encoded in one go and parted where words end."""
        ids = np.array(self.lean.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
        raw, stops = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(stops) != len(words):
            return [self._whole(w.decode()) for w in words]
        return [raw[i:j] for i, j in zip([0, *stops], stops)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """Ids of pieces not met before; the words inside them are remembered too."""
        memo, tails = self.memo, self.tails
        strings = b" ".join(new).decode("utf-8").split(" ")
        cores = [s.rstrip(_TAIL) for s in strings]
        lows = [c.lower() if c.isalpha() and max(c) < "\u0250" else "" for c in cores]
        lows = [x.encode() if len(x) == len(c) and x.isalpha() else b"" for x, c in zip(lows, cores)]
        known = list(map(memo.get, lows))
        need = list({x for x, k in zip(lows, known) if k is None and x})
        found = dict(zip(need, self._words(need))) if need else {}
        if len(memo) < self.remember:
            memo.update(found)
        out = []
        for s, c, x, k in zip(strings, cores, lows, known):
            if not x:
                out.append(self._whole(s))
                continue
            if k is None:
                k = found[x]
            if len(c) < len(s):
                t = s[len(c) :]
                if t not in tails:
                    if len(tails) > self.remember:
                        tails.clear()
                    tails[t] = self._whole(t)
                k += tails[t]
            out.append(k)
        return out

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._ids(texts)
        finally:
            if collecting:
                gc.enable()

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        out, memo = [], self.memo
        for at in range(0, len(texts), 512):
            words, stops = [], [0]
            for t in texts[at : at + 512]:
                words += t.split()
                stops.append(len(words))
            got = list(map(memo.get, words))
            if None in got:
                where = [i for i, x in enumerate(got) if x is None]
                new = list({words[i] for i in where})
                learnt = dict(zip(new, self._learn(new)))
                for i in where:
                    got[i] = learnt[words[i]]
                if len(memo) < self.remember:
                    memo.update(learnt)
            out += [b"".join(got[i:j]) for i, j in zip(stops, stops[1:])]
        return out


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def utf8_column(column) -> list[bytes | None]:
    """The values of an Arrow string column as bytes, without making str objects."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()
