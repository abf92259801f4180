"""Token ids of whole texts by a public tokenizer file.

The tokenizer drops white space and treats what stands between as separate, so
ids are found once for each different word of a stretch of texts and put
together in numpy.  The table of words is emptied when it grows past a bound.
"""

from __future__ import annotations

import json
import os
from itertools import chain, repeat

import numpy as np

#: Words that an encoder keeps with their ids, about 130 bytes each.
MOST_WORDS = 2_000_000
# The steps before the model for which words can be taken apart.
NORMALIZER = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters below this one have simple lower cases.
PLAIN_LETTERS = "\u0250"
#: Stops that end a run of letters for the tokenizer.
STOPS = b".,"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    def __init__(self, path: str, most_words: int = MOST_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most_words
        steps = json.loads(self.tokenizer.to_str())
        before, split = steps.get("normalizer") or {}, steps.get("pre_tokenizer") or {}
        first = (split.get("pretokenizers") or [{}])[0]
        #: Whether white space separates: else texts are encoded whole.
        self.apart = [n["type"] for n in before.get("normalizers", [])] == NORMALIZER and first.get("pattern") == {"Regex": SPLIT} and first.get("invert") and first.get("behavior") == "Removed"
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = dict(zip(printable, map(chr, printable))) | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def add(self, words: list[bytes], ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))

    def ids_of(self, words: list[str]) -> list[list[int]]:
        """A run of plain letters goes to the model at once: the steps before it would only lower its case."""
        out: list = [None] * len(words)
        slow = []
        tokenize, table = self.tokenizer.model.tokenize, self.bytes
        for i, w in enumerate(words):
            if w.isalpha() and max(w) < PLAIN_LETTERS and len(low := w.lower()) == len(w):
                out[i] = [t.id for t in tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(table))]
            else:
                slow.append(i)
        for i, e in zip(slow, self.tokenizer.encode_batch_fast([words[i] for i in slow], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def learn(self, words: list[bytes]) -> None:
        # Stops after a letter are tokens of their own, so the word before them may be known.
        stems = [w.rstrip(STOPS) for w in words]
        apart = [s != w and s[-1:].isalpha() for s, w in zip(stems, words)]
        plain = dict.fromkeys(w if not a else s for w, s, a in zip(words, stems, apart)) | dict.fromkeys(w[len(s) :] for w, s, a in zip(words, stems, apart) if a)
        new = [w for w in plain if w not in self.known]
        self.add(new, self.ids_of([w.decode("utf-8", "replace") for w in new]))
        both = [(w, self.known[s], self.known[w[len(s) :]]) for w, s, a in zip(words, stems, apart) if a]
        flat, starts = self.flat, self.starts
        self.add([w for w, _, _ in both], [[*flat[starts[i] : starts[i + 1]].tolist(), *flat[starts[j] : starts[j + 1]].tolist()] for _, i, j in both])

    def encode(self, texts: list[str | None], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids of each text); ``end`` is added to each."""
        if not self.apart:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
            ends = [] if end is None else [end]
            return np.fromiter(chain.from_iterable([*f, *ends] for f in found), np.uint32), np.array([len(f) + len(ends) for f in found], np.int64)
        if len(self.known) > self.most:
            self.clear()
        split = []
        for t in texts:
            b = (t or "").encode("utf-8", "replace")
            # Lower case first means fewer words; not where it could change what composes or what is a special token.
            split.append((b if b"<|" in b or b"\xcc" in b or b"\xcd" in b else b.lower()).split())
        counts = np.fromiter(map(len, split), np.int64, len(split))
        all_words = list(chain.from_iterable(split))
        words = np.fromiter(map(self.known.get, all_words, repeat(-1)), np.int64, len(all_words))
        if len(missing := np.flatnonzero(words < 0)):
            absent = [all_words[i] for i in missing.tolist()]
            self.learn(list(dict.fromkeys(absent)))
            words[missing] = np.fromiter(map(self.known.__getitem__, absent), np.int64, len(absent))
        first, size = self.starts[words], self.starts[words + 1] - self.starts[words]
        per_text = np.zeros(len(split), np.int64)
        if len(words):
            total = np.concatenate([[0], np.cumsum(size)])
            edge = np.concatenate([[0], np.cumsum(counts)])
            per_text = total[edge[1:]] - total[edge[:-1]]
            flat = self.flat[np.repeat(first - total[:-1], size) + np.arange(total[-1])]
        else:
            flat = np.zeros(0, np.uint32)
        if end is None:
            return flat, per_text
        out = np.full(len(flat) + len(split), end, np.uint32)
        stop = np.cumsum(per_text + 1) - 1
        mask = np.ones(len(out), bool)
        mask[stop] = False
        out[mask] = flat
        return out, per_text + 1


_encoders: dict[str, Encoder] = {}


def encoder(path: str, most_words: int | None = None) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].most = most_words or MOST_WORDS
    return _encoders[path]
