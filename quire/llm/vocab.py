"""Token ids by public vocabularies, with a bounded memory of what was encoded before.

Both vocabularies split a text at white space before they merge, so a text's ids are those of its chunks
one after another, and chunks come back often. ``_CHUNK`` cuts where the byte-level pattern always cuts;
the vocabulary with word ends drops white space and cuts there. Texts with white space of the rarer
kinds, or with a special token's string, are encoded whole.
"""

from __future__ import annotations

import re
from array import array
from codecs import charmap_decode

import numpy as np

_CHUNK = re.compile(r" ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]")
#: White space beyond ASCII, and separators that some libraries count as white space.
_RARE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿]|<\\|")
_END = "<|endoftext|>"
#: ASCII marks; a vocabulary's pattern always cuts between a run of letters and a run of these.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space that ``_CHUNK`` has to look at closely: any other than single spaces and line ends.
_RUNS = ("  ", " \n", "\n ", "\n\n", "\t", "\x0b", "\x0c", "\r")
#: The byte-level vocabularies' sign for each byte: itself as in Latin-1, or one of those from 256 on.
_ODD = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_SIGNS = "".join(chr(256 + _ODD.index(b) if b in _ODD else b) for b in range(256))
#: So many bytes of chunks and ids are remembered in one Python worker.
MEMORY, PIECE_MEMORY = 76 << 20, 32 << 20


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _word(part: str) -> bool:
    """Is it letters alone, perhaps behind a space, on which all versions of the Unicode tables agree?"""
    core = part[1:] if part[0] == " " else part
    return core.isalpha() and (core.isascii() or max(core) < "\u0180" and "İ" not in core)


class Memo:
    """chunk -> ids as little-endian 16-bit integers, in two generations: what isn't met again while one fills is forgotten."""

    def __init__(self, encode_words, encode_all) -> None:
        self.encode_words, self.encode_all, self.young, self.old, self.room = encode_words, encode_all, {}, {}, MEMORY

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """A dictionary that holds the chunks and perhaps others, until the next call."""
        if self.room < 0:
            self.young, self.old, self.room = {}, self.young, MEMORY
        young, recall = self.young, self.old.get
        words: dict[str, None] = {}
        todo: dict[str, None] = {}
        joined = []
        for c in chunks.difference(young):
            if (known := recall(c)) is not None:
                young[c] = known
            elif _word(c):
                words[c] = None
            elif (core := c.rstrip(_MARKS)) == c or not core.lstrip(" ").isalpha() or "İ" in core:
                todo[c] = None
            else:  # letters end where marks begin; the letter that is left out is two in lower case
                joined.append((c, core, c[len(core) :]))
        for _, core, marks in joined:
            for part in (core, marks):
                if part not in young:
                    if (known := recall(part)) is not None:
                        young[part] = known
                    else:
                        (words if _word(part) else todo)[part] = None
        ids = [*self.encode_words(list(words)), *self.encode_all(list(todo))]
        young.update(zip((*words, *todo), ids))
        for c, core, marks in joined:
            young[c] = young[core] + young[marks]
        self.room -= 240 * (len(ids) + len(joined)) + 2 * (sum(map(len, words)) + sum(map(len, todo))) + sum(map(len, ids))
        return young


class Encoder:
    """Ids of whole texts by a vocabulary of the tokenizers library with at most 65,536 ids.

    ``folds``: the vocabulary lower-cases and drops white space, so that words are chunks.
    """

    def __init__(self, path: str, folds: bool) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids must fit in 16 bits")
        self.folds = folds
        self.end = self.tokenizer.token_to_id(_END)
        self.model = self.tokenizer.model
        self.units = [i.to_bytes(2, "little") for i in range(65536)]
        self.memo = Memo(self._words, self._all)

    def _whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each word of letters: the patterns cut nowhere in it, so it goes straight to the library's merges."""
        merge, units, join = self.model.tokenize, self.units, b"".join
        if self.folds:
            words = map(str.lower, words)
        return [join([units[t.id] for t in merge(charmap_decode(w.encode(), "strict", _SIGNS)[0])]) for w in words]

    def _all(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk: many go through the library as one text, with a special token between each two."""
        out = []
        for i in range(0, len(chunks), 256):
            part = chunks[i : i + 256]
            ids = np.array(self.tokenizer.encode(_END.join(part), add_special_tokens=False).ids, dtype="<u2")
            marks = np.flatnonzero(ids == self.end)
            if len(marks) != len(part) - 1:
                raise ValueError("a chunk holds a special token")
            data, at = ids.tobytes(), 0
            for m in (*(2 * marks).tolist(), len(data)):
                out.append(data[at:m])
                at = m + 2
        return out

    def _cut(self, text: str) -> list[str] | None:
        if "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if _RARE.search(text):
                return None
            return text.split() if self.folds else self._chunks(text)
        if "\x85" in text or "\xa0" in text:
            return None
        # Up to Latin-1, the lower case of a letter depends on nothing else.
        return text.lower().split() if self.folds else self._chunks(text)

    def _chunks(self, text: str) -> list[str]:
        if "\x00" in text or any(c in text for c in _RUNS):
            return _CHUNK.findall(text)
        # No white space next to white space: a space goes with the word behind it, a line end is a chunk of its own.
        return [c for c in text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00") if c]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 16-bit integers."""
        cut = [self._cut(t) for t in texts]
        known = self.memo.learn(set().union(*(c for c in cut if c)))
        return [self._whole(t) if c is None else b"".join(map(known.__getitem__, c)) for t, c in zip(texts, cut)]


class Pieces:
    """Ids of single words by a sentence-piece model; ``byte_ids`` tells which are byte fallbacks."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.byte_ids = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.known: dict[str, bytes] = {}
        self.room = PIECE_MEMORY

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if new := [w for w in set(words) if w not in known]:
            if self.room < 0:
                known.clear()
                self.room, new = PIECE_MEMORY, list(set(words))
            for w, ids in zip(new, self.model.encode(new, num_threads=1)):
                known[w] = made = np.array(ids, dtype="<u2").tobytes()
                self.room -= 2 * len(w) + len(made) + 220
        return np.frombuffer(b"".join(map(known.__getitem__, words)), dtype="<u2")
