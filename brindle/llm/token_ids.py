"""Token ids of whole texts by the tokenizers library, with a bounded memory of chunks.

A text is cut at ASCII white space. The vocabulary's pretokenizer drops white space and
never joins across it, so the ids of a text are those of its chunks, one after another;
each chunk that a worker has not met goes through the library. A vocabulary whose
pretokenizer keeps white space is refused, and then whole texts go through the library.

The memory of chunks is a cache, one for chunks met once and one for others: each is emptied when full, and never changes an id.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MAX_REMEMBERED = 300_000
LONGEST_REMEMBERED = 48
#: With its closing marks a chunk is remembered only if it is this short; longer ones are put together from their parts.
LONGEST_CLOSED = 8
#: So many bytes of texts are looked up together.
GROUP_BYTES = 1 << 17
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words of the letters a-z, \u00df-\u00f6 and \u00f8-\u00ff, in UTF-8: their lower case and their composed form are themselves.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


def drops_white_space(spec: dict) -> bool:
    """True if the file's pretokenizer begins with an inverted, removing split that no white space gets through."""
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and "\\s" not in pattern.replace("[^\\s", "") and " " not in pattern


def keeps_plain_words(spec: dict) -> bool:
    """True if PLAIN words pass the file's normalizer as they are, and its pretokenizer's first split as one piece: no
    alternative before that of letters can begin with one, and what is behind the split does not ask for more than the piece."""
    normalizer, pre = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}, spec.get("pre_tokenizer") or {}
    for n in normalizer.get("normalizers", [normalizer]):
        blanks = n["type"] == "Replace" and n.get("pattern") == {"Regex": "\\s+"} and n.get("content") == " "
        if n["type"] not in ("NFC", "Lowercase") and not blanks:
            return False
    parts = pre.get("pretokenizers") or [pre]
    alternatives = ((parts[0].get("pattern") or {}).get("Regex") or "").split("|")
    letters = next((k for k, a in enumerate(alternatives) if a in ("[\\p{L}]+", "\\p{L}+")), None)
    behind = [(p["type"], p.get("add_prefix_space"), p.get("use_regex")) for p in parts[1:]]
    return letters is not None and all(a.startswith("'") for a in alternatives[:letters]) and behind in ([], [("ByteLevel", False, False)])


class TokenIds:
    """Encodes UTF-8 texts. Chunks are looked up in lower ASCII case (the file's normalizer lowers
    them anyway) and without the ASCII marks that close them behind a letter, which are a pretoken of
    their own; unknown words of letters alone go through the library many at a time, and their ids part
    where a word ends. Words on which the file's normalizer and split do nothing go to its model by a
    tokenizer without them."""

    def __init__(self, path: str, max_remembered: int = MAX_REMEMBERED):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.by_chunk = drops_white_space(spec)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        #: Two bytes an id where the vocabulary allows it.
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.max_remembered = max_remembered
        self.known: dict[bytes, bytes] = {}
        self.recent: dict[bytes, bytes] = {}
        lowers = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        self.specials = self.added if lowers else None
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.size, bool)
        if suffix:
            self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith(suffix)]] = True
        self.parts = bool(self.by_chunk and suffix)
        self.plain = self._plain(spec) if self.parts and keeps_plain_words(spec) else None

    def _plain(self, spec: dict):
        """The file's model behind white space alone, for PLAIN words."""
        from tokenizers import Tokenizer, pre_tokenizers

        steps = [pre_tokenizers.WhitespaceSplit()]
        if len(spec["pre_tokenizer"].get("pretokenizers", [])) > 1:
            steps.append(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))
        plain = Tokenizer(self.library.model)
        plain.pre_tokenizer = pre_tokenizers.Sequence(steps)
        return plain

    def _each(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def _words(self, words: list[bytes], library) -> list[bytes]:
        """Words of letters alone, each one pretoken: encoded together, parted at word ends."""
        groups = [b" ".join(words[k : k + 100]).decode("utf-8") for k in range(0, len(words), 100)]
        ids = np.concatenate([np.array(x.ids, self.dtype) for x in library.encode_batch_fast(groups, add_special_tokens=False)])
        stops = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
        if len(stops) != len(words):
            return self._each([w.decode("utf-8") for w in words])
        data, starts = ids.tobytes(), [0, *stops[:-1].tolist()]
        return [data[a:b] for a, b in zip(starts, stops.tolist())]

    def _encode(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        plain, words, others = [], [], []
        for c in chunks:
            if self.plain is not None and (c.isalpha() and c.islower() or PLAIN(c)):
                plain.append(c)
            else:
                (words if self.parts and (c.isalpha() or c.decode("utf-8").isalpha()) else others).append(c)
        found = dict(zip(others, self._each([c.decode("utf-8") for c in others]))) if others else {}
        for some, library in ((plain, self.plain), (words, self.library)):
            if some:
                found.update(zip(some, self._words(some, library)))
        return found

    def ids(self, text: bytes) -> bytes:
        """The ids of a UTF-8 text, as bytes of self.dtype."""
        return self._together([text])[0]

    def stream(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """ids() of texts, one after another; they are looked up GROUP_BYTES at a time."""
        group: list[bytes] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP_BYTES:
                yield from self._together(group)
                group, size = [], 0
        yield from self._together(group)

    def _together(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_chunk:
            return [self._each([t.decode("utf-8")])[0] for t in texts]
        chunks: list[bytes] = []
        ends = [0]
        for text in texts:
            if self.specials is not None and not any(s in text.lower() for s in self.specials):
                text = text.lower()
            chunks += text.split()
            ends.append(len(chunks))
        found = list(map(self.known.get, chunks))
        missing = [k for k, x in enumerate(found) if x is None]
        if missing:
            self._learn(chunks, found, missing)
        return [b"".join(found[a:b]) for a, b in zip(ends[:-1], ends[1:])]

    def _learn(self, chunks: list[bytes], found: list[bytes | None], missing: list[int]) -> None:
        """Fill in the ids of the missing chunks. What is met for the first time is remembered in `recent`, and moves to `known`
        when it is met again, so that words that occur once don't crowd out the others."""
        known, recent, whole, closed, new = self.known, self.recent, [], [], set()

        def met(piece: bytes) -> bytes | None:
            ids = known.get(piece)
            if ids is None:
                ids = recent.pop(piece, None)
                if ids is None:
                    new.add(piece)
                else:
                    known[piece] = ids
            return ids

        for k in missing:
            c = chunks[k]
            if self.parts and c[-1] in MARKS and not any(s in c for s in self.added):
                base = c.rstrip(MARKS)
                if base and (base[-1:].isalpha() or base[-1] >= 0x80 and base.decode("utf-8")[-1].isalpha()):
                    marks = c[len(base) :]
                    closed.append((k, base, marks, met(base), met(marks)))
                    continue
            ids = met(c)
            if ids is None:
                whole.append(k)
            else:
                found[k] = ids
        fresh = self._encode(list(new)) if new else {}
        for k in whole:
            found[k] = fresh[chunks[k]]
        for k, base, marks, x, y in closed:
            found[k] = ids = (fresh[base] if x is None else x) + (fresh[marks] if y is None else y)
            if len(chunks[k]) <= LONGEST_CLOSED:
                known[chunks[k]] = ids
        if len(known) > self.max_remembered:
            known.clear()
        if len(recent) + len(fresh) > self.max_remembered:
            recent.clear()
        if len(fresh) <= self.max_remembered:
            recent.update((c, x) for c, x in fresh.items() if len(c) <= LONGEST_REMEMBERED)


_ENCODERS: dict[str, TokenIds] = {}


def encoder(path: str) -> TokenIds:
    """One encoder for each vocabulary file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TokenIds(path)
    return _ENCODERS[path]
