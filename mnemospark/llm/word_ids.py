"""Token ids of texts by the tokenizers library, a word at a time.

For a tokenizer whose pieces never cross white space, the ids of a text are the ids of its words
one after the other. Prose repeats its words, so a table of the words met so far saves most of the
work; the library itself encodes each word that isn't in the table. Whether a tokenizer is of this
kind is probed when it is loaded; with any other one the library encodes whole texts."""

from __future__ import annotations

import gc
import os
from string import ascii_lowercase, ascii_uppercase
from unicodedata import is_normalized

import numpy as np

#: ASCII marks that end a word. After a letter they're a piece of their own (an apostrophe isn't
#: here: it may begin a contraction; words with "<" may be special tokens and stay whole).
MARKS = b".,;:!?|%&$*#"
#: What stands between the words that a tokenizer is probed with, and the words.
GAPS = (" ", "\t", "\n", "\x0b", "\f", "\r", "  ", "\r\n", " \n\t ")
PROBES = ("The", "quick", "QUICK", "it's", "a1b2", "x-y", "Été", "...", "42", "A.", "(see", "你好", "$5", "don't,", "_x_")


class _Codes(dict):
    """Words and their numbers in the table; a word not met before gets the next one."""

    def __init__(self, new: list[bytes], begin: int):
        super().__init__()
        self.new, self.next = new, begin

    def __missing__(self, word: bytes) -> int:
        code = self[word] = self.next
        self.next += 1
        self.new.append(word)
        return code


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    """a, or a copy at least twice as long where it has no n places."""
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), dtype=a.dtype)])


class WordIds:
    """most: words in the table before those go that were not met again. Its memory is about 200 bytes a word."""

    def __init__(self, path: str, end_id: int | None = None, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.most = Tokenizer.from_file(path), end_id, most
        self.tokenizer.no_truncation()  # texts are encoded whole, and are not filled up
        self.tokenizer.no_padding()
        self.vocabulary = self.tokenizer.get_vocab_size()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        ending = [i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]
        self.ends_word = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, dtype=bool)
        self.ends_word[ending] = True
        self._probe()
        self._empty()

    def _probe(self) -> None:
        """Sets what the tokenizer allows. whole: words alone don't have the ids they have in a text, so texts
        are encoded as they are. folds: an ASCII capital has the ids of its small letter. marks: MARKS
        after a letter are pieces of their own."""
        ids = lambda *parts: [i for p in parts for i in self.tokenizer.encode(p, add_special_tokens=False).ids]
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        spaced = any(a.lstrip or a.rstrip or a.content.split() != [a.content] for a in added)
        self.whole = spaced or self.tokenizer.pre_tokenizer is None or any(ids(g + g.join(PROBES) + g) != ids(*PROBES) for g in GAPS)
        known = all("<" in a.content for a in added)  # words with "<" are neither folded nor cut
        normalizer = self.tokenizer.normalizer
        self.folds = known and normalizer is not None and normalizer.normalize_str(ascii_uppercase) == ascii_lowercase
        runs = [a + b for a in MARKS.decode() for b in ["", *MARKS.decode()]]
        self.marks = known and all(ids(w + m) == ids(w, m) for w in ("ab", "X", "zebra") for m in runs)

    def _empty(self) -> None:
        self.new: list[bytes] = []
        self.codes = _Codes(self.new, 1)  # in the order of their numbers
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.starts = np.zeros(1 << 16, dtype=np.int64)
        self.sizes = np.zeros(1 << 16, dtype=np.int64)
        self.again = np.zeros(1 << 16, dtype=bool)  # met again after they were learned
        self.used, self.known = 0, 1  # code 0 ends a text
        if self.end_id is not None:
            self.flat[0], self.sizes[0], self.used = self.end_id, 1, 1

    def _shrink(self) -> None:
        """Leaves the words that were met again, the oldest, half a table of them at most; they have to be met again to stay once more."""
        stay = np.flatnonzero(self.again[1 : self.known])[: self.most // 2]
        words = np.array(list(self.codes), dtype=object)[stay].tolist()
        ids, sizes = self._ids_of(stay + 1)
        self._empty()
        n, used = len(words) + 1, self.used + len(ids)
        self.codes.update(zip(words, range(1, n), strict=True))
        self.codes.next = self.known = n
        self.starts, self.sizes, self.again, self.flat = (_grown(x, k) for x, k in ((self.starts, n), (self.sizes, n), (self.again, n), (self.flat, used)))
        self.flat[self.used : used] = ids
        self.starts[1:n], self.sizes[1:n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used = used

    def _ids_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words with these numbers one after the other, and how many each has."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - sizes), sizes)], sizes

    def _add(self, ids: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> None:
        """Words' ids go into the table."""
        used = self.used + len(ids)
        self.flat = _grown(self.flat, used)
        self.flat[self.used : used] = ids
        self.starts[at], self.sizes[at] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used = used

    def _learn(self) -> None:
        """Adds the new words to the table. Nothing made here refers back to itself, so the search for
        such cycles, which walks through the whole table, waits until the end."""
        enabled = gc.isenabled()
        gc.disable()
        try:
            self._add_words()
        finally:
            if enabled:
                gc.enable()

    def _add_words(self) -> None:
        """A word of letters with marks behind is made of both, one with capitals is as its small letters: these are
        words of the table themselves, and the library encodes only what can't be made so."""
        number, begin, new = self.codes.__getitem__, self.known, self.new
        plain, folded, joined = [], [], []  # numbers and words; numbers; numbers of a word and of its two parts
        for code, word in enumerate(new, begin):  # parts that aren't in the table come in on the way
            core = word.rstrip(MARKS) if self.marks else b""
            if not core or b"<" in word or not core[-1:].isalpha():
                plain.append((code, word))
                continue
            low = core.lower() if self.folds and core.isascii() else core
            if len(core) < len(word):
                joined.append((code, number(low), number(word[len(core) :])))
            elif low == word:
                plain.append((code, word))
            else:
                folded.append((code, number(low)))
        known = begin + len(new)
        self.starts, self.sizes, self.again = (_grown(a, known) for a in (self.starts, self.sizes, self.again))
        self._encode_words(plain)
        if folded:
            at, low = np.array(folded, dtype=np.int64).T
            self.starts[at], self.sizes[at], self.again[low] = self.starts[low], self.sizes[low], True
        if joined:
            at, low, mark = np.array(joined, dtype=np.int64).T
            self.again[low] = self.again[mark] = True
            ids, sizes = self._ids_of(np.stack([low, mark], axis=1).ravel())
            self._add(ids, at, sizes.reshape(-1, 2).sum(axis=1))
        self.known = known
        new.clear()

    def _encode_words(self, words: list[tuple[int, bytes]]) -> None:
        """Adds the words' ids by the library. Words of letters alone are one piece each, so that many are encoded
        as one text and told apart by the ids that end a word; should these not fit, as in a
        vocabulary without such ids, and for all other words, each is a text of its own."""
        single, joined = [], []
        for code, word in words:
            s = word.decode("utf-8", "replace")
            plain = s.isascii() or (is_normalized("NFC", s) and s.lower().isalpha())
            (joined if plain and s.isalpha() else single).append((code, s))
        at, ids, sizes = [], [], []
        groups = [joined[i : i + 100] for i in range(0, len(joined), 100)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(s for _, s in g) for g in groups], add_special_tokens=False), strict=True):
            found = np.array(e.ids, dtype=np.uint32)
            ends = np.flatnonzero(self.ends_word[found]) + 1
            if len(ends) != len(group) or ends[-1] != len(found):
                single += group
                continue
            at += [code for code, _ in group]
            ids.append(found)
            sizes.append(np.diff(ends, prepend=0))
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast([s for _, s in single], add_special_tokens=False)] if single else []
        at += [code for code, _ in single]
        ids.append(np.array([i for x in encoded for i in x], dtype=np.uint32))
        sizes.append(np.array([len(x) for x in encoded], dtype=np.int64))
        self._add(np.concatenate(ids), np.array(at, dtype=np.int64), np.concatenate(sizes))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, end ids with them, and how many each text has."""
        if self.whole:
            end = [] if self.end_id is None else [self.end_id]
            found = [e.ids + end for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
            return np.array([i for x in found for i in x], dtype=np.uint32), np.array([len(x) for x in found], dtype=np.int64)
        if self.known > self.most:
            self._shrink()
        codes, counts = [], np.zeros(len(texts), dtype=np.int64)
        number, before, end = self.codes.__getitem__, self.known, np.zeros(1, dtype=np.int64)
        for i, text in enumerate(texts):
            words = text.split()  # bytes split at ASCII white space only
            codes += [np.fromiter(map(number, words), dtype=np.int64, count=len(words)), end]
            counts[i] = len(words) + 1
        self._learn()
        at = np.concatenate(codes) if codes else end[:0]
        self.again[at[at < before]] = True
        ids, sizes = self._ids_of(at)
        return ids, np.diff(np.cumsum(sizes)[np.cumsum(counts) - 1], prepend=0)


_encoders: dict[tuple, WordIds] = {}


def encoder(path: str, end_id: int | None) -> WordIds:
    """One table for each Python worker, kept between tasks."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordIds(path, end_id)
    return _encoders[path, end_id]
