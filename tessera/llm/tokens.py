"""Token ids by a public tokenizer file, with a per-process cache of encoded words."""
from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
END_ID = 0

#: a place to cut very long texts: a single space or line break between words
_START = re.compile(r"(?<=\S) (?=\S)")
#: letters and the signs after them are two pieces for the tokenizer (an apostrophe may
#: start a piece of its own kind)
_SIGNED = regex.compile(r"(\p{L}+)([^\s\p{L}\p{N}']+)")
#: one sign at the end of a word, after a letter or digit: a piece of its own
_LAST_SIGN = r"([A-Za-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([.,;:!?]) "
#: white space other than single spaces and line breaks between words
_ODD = (r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
        r"|[ \n][ \n]|\A[ \n]|[ \n]\z")
#: letters before this one are letters in every version of Unicode's tables
_OLD_LETTERS = "\u0250"
_ENTRIES, _LONGEST, _BLOCK, _JOINED = 400_000, 64, 1 << 22, 256


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """Where the installed public tokenizer package keeps ``name``."""
    import public_tokenizers
    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes whole texts with the ``tokenizers`` library, each distinct word once.

    A byte-level BPE never merges across the start of a space that a word follows, nor
    across a single line break, so a text can be cut there and the cuts encoded alone: the
    ids equal those of the whole text. A new word that ends in signs is made of its letters
    and its signs. New words go to the library many in one text, a line break between them. Two generations of at most ``_ENTRIES`` words each hold ready
    bytes. A text that holds an added token's string is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.line_break = self._ids(["\n"])[0]
        pre = self.tok.pre_tokenizer
        # a plain byte-level tokenizer: its pieces go to the model as they are, a sign for each byte
        self.by_model = self.tok.normalizer is None and isinstance(pre, ByteLevel) and pre.pre_tokenize_str("a")[0][0] == "a"
        self.model = self.tok.model
        self.signs = {ord(c): pre.pre_tokenize_str(c)[0][0] for c in (" ", *filter(str.isalpha, map(chr, range(128, ord(_OLD_LETTERS)))))} if self.by_model else {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words without white space (but a leading space)."""
        if len(self.line_break) != 4:
            return self._ids(words)
        groups = ["\n".join(words[i:i + _JOINED]) for i in range(0, len(words), _JOINED)]
        mark, out = np.frombuffer(self.line_break, "<u4")[0], []
        for e in self.tok.encode_batch_fast(groups, add_special_tokens=False):
            ids = np.asarray(e.ids, "<u4")
            raw, start = ids.tobytes(), 0
            for end in np.flatnonzero(ids == mark).tolist():
                out.append(raw[4 * start:4 * end])
                start = end + 1
            out.append(raw[4 * start:])
        return out

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, with or without a leading space, by the tokenizer's model."""
        split, space = self.model.tokenize, self.signs[ord(" ")]
        ids, ends = array("I"), [0]
        for w in words:
            ids.extend([t.id for t in split(w.replace(" ", space) if w.isascii() else w.translate(self.signs))])
            ends.append(len(ids))
        raw = np.asarray(ids, "<u4").tobytes()
        return [raw[4 * a:4 * b] for a, b in zip(ends, ends[1:])]

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers, without an end id."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Words are told apart for blocks of texts at a time, so that
        the cache is asked once for each distinct word of a block."""
        out: list[list[bytes]] = [[] for _ in texts]
        parts, owners, size = [], [], 0  # owners: (place in texts, whether it is a text's start)

        def flush():
            for (i, _), ids in zip(owners, self._block(parts, [first for _, first in owners])):
                out[i].append(ids)
            parts.clear()
            owners.clear()
        for i, text in enumerate(texts):
            if any(a in text for a in self.added):
                out[i].append(self._ids([text])[0])
                continue
            at = 0
            while at < len(text):  # very long texts in parts, so that few words live at once
                m = _START.search(text, at + _BLOCK) if len(text) - at > _BLOCK else None
                end = m.start() if m else len(text)
                parts.append(text[at:end])
                owners.append((i, at == 0))
                size, at = size + end - at, end
                if size >= _BLOCK:
                    flush()
                    size = 0
        flush()
        return [b"".join(o) for o in out]

    def _block(self, parts: list[str], first: list[bool]) -> list[bytes]:
        """Ids of parts of texts; those that are not a text's first start with the space after a word."""
        if not parts:
            return []
        # keys: a word after a space is itself, after a line break "\n" + word, the first "\r" + word
        inner = [p if f else p[1:] for p, f in zip(parts, first)]
        # and a sign that ends a word "\t" + sign; the space after the last gives an empty key
        odd = pc.match_substring_regex(pa.array(inner, pa.large_string()), _ODD).to_pylist()
        known = ["" if o else ("\r" + i if f else i).replace("\n", " \n") + " " for o, i, f in zip(odd, inner, first)]
        cuts = pc.split_pattern(pc.replace_substring_regex(pa.array(known, pa.large_string()), _LAST_SIGN, "\\1 \t\\2 "), " ")
        words = cuts.values.dictionary_encode()
        ids = pa.array(self._cached(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
        raw = memoryview(ids.buffers()[2] or b"")
        ends = np.frombuffer(ids.buffers()[1], np.int64)[cuts.offsets.to_numpy()].tolist()
        return [self._ids([p])[0] if o else bytes(raw[a:b]) for o, p, a, b in zip(odd, parts, ends, ends[1:])]

    def _add(self, keys: list[str]) -> None:
        """Put the ids of new keys into the cache. A word that ends in signs is made of its
        letters, looked up by their own key, and its signs, by "\t" + signs."""
        new, old = self.new, self.old
        fresh, signed = [], []
        for k in keys:
            if k[-1].isalnum():  # no signs at the end
                fresh.append(k)
                continue
            m = _SIGNED.fullmatch(k, 1 if k[0] in "\n\r" else 0)
            if m:
                signed.append((k, k[0] + m[1] if k[0] in "\n\r" else m[1], "\t" + m[2]))
            else:
                fresh.append(k)
        for k in {part for _, *pair in signed for part in pair}.difference(new).difference(fresh):
            got = old.get(k)
            if got is None:
                fresh.append(k)
            else:
                new[k] = got
        plain, other = [], []
        for k in fresh:  # the tokenizer takes a word of letters for one piece
            word = k[1:] if k[0] in "\n\r" else k
            (plain if self.by_model and word.isalpha() and (word.isascii() or max(word) < _OLD_LETTERS) else other).append(k)
        for some, encode in ((plain, self._letters), (other, self._words)):
            ids = encode([k[1:] if k[0] in "\n\r\t" else " " + k for k in some])
            new.update((k, self.line_break + i if k[0] == "\n" else i) for k, i in zip(some, ids))
        new.update([(k, new[letters] + new[signs]) for k, letters, signs in signed])

    def _cached(self, keys: list[str]) -> list[bytes]:
        """Ids of distinct keys; no key at all has none."""
        if len(self.new) > _ENTRIES:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        new[""] = b""
        ids, fresh = [*map(new.get, keys)], []
        missing = [i for i, got in enumerate(ids) if got is None]
        for i in missing:
            got = old.get(keys[i])
            if got is None:
                fresh.append(keys[i])
            else:
                new[keys[i]] = got
        self._add(fresh)
        for i in missing:
            ids[i] = new[keys[i]]
        for k in fresh:
            if len(k) > _LONGEST:
                del new[k]
        return ids


@lru_cache(maxsize=4)
def encoder(path: str | None) -> WordEncoder:
    """One encoder per process and file; ``None`` is the default public file."""
    return WordEncoder(path or tokenizer_path())
