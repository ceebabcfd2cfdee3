"""Token ids of public tokenizers, with what the library gives for each chunk kept at hand.

Both tokenizers split a text into pieces that never cross the chunks below, so
the ids of a text are those of its chunks in order.  Most texts are cut at
their spaces, which a regular expression is too slow for: what is between two
spaces is a run of whole chunks, and is looked up as one.  Arrow numbers the
different runs of many texts and looks them up; those not seen before go
through the tokenizers library, many at a time; their ids are kept in a cache
of two generations of Arrow arrays, so memory is bounded and frequent ones
stay.  A text that holds the string of an added token, such as <|endoftext|>,
goes through the library whole, which gives the token's id for it (its own
default).
"""

from __future__ import annotations

import os
import re
from array import array
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed: Unicode white space, Latin letters and ASCII punctuation, as parts of a character class.
_WS = "\t-\r \x85\xa0  -     　"
_LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_PUNCTUATION = r"!-/:-@\[-`{-~"
#: Byte-level BPE keeps white space: one space goes with what follows it, other white space stands by itself.
#: Between a letter and ASCII punctuation either tokenizer always splits.
BYTE_LEVEL = rf" ?[{_LATIN}]+(?=[{_PUNCTUATION}{_WS}]|\Z)| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: BPE with word ends drops white space.
WORD_LEVEL = rf"[{_LATIN}]+(?=[{_PUNCTUATION}{_WS}]|\Z)|[^{_WS}]+"
#: Runs of one generation, and the bytes over which one is not kept.
GENERATION, LONG = 150_000, 48
#: Characters of texts that are looked up at once, and words that the library is asked for at once.
AT_ONCE, WORDS_AT_ONCE = 4_000_000, 1024


def _byte_alphabet() -> dict[int, str]:
    """Byte to character of byte-level BPE: printable Latin-1 stands for itself, the rest for 256 and up in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_ALPHABET = _byte_alphabet()
#: The same for words that stand one a line: a space between them.
_SPELT = _ALPHABET | {ord("\n"): " "}


#: Begins keys that have no space before them, and what parts keys: texts that hold it go through the library whole.
_BARE, _BETWEEN = "\x01", "\x1f"


#: Latin-1 by kind: letters and digits, white space, full stops and commas, what split() or keys take otherwise, all else.
_KINDS = bytes(
    ord("a") if re.match(f"[{_LATIN}0-9]", c) else ord(" ") if re.match(f"[{_WS}]", c) else ord(".") if c in ".," else ord("?") if c in "\x01\x1c\x1d\x1e\x1f" else ord("!") for c in map(chr, range(256))
)


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _simple(text: str) -> bool:
    """Whether a text can be cut at its spaces, and before each full stop and comma: none stands beside other such signs or after white space, and no cut parts white space of one chunk."""
    try:
        kinds = text.encode("latin-1").translate(_KINDS)
    except UnicodeEncodeError:
        return False
    return not (b"?" in kinds or b".." in kinds or b"!." in kinds or b".!" in kinds or b" ." in kinds or b"   " in kinds or kinds.startswith(b".") or kinds.endswith(b"  "))


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Generation:
    """Keys and their ids, as bytes."""

    def __init__(self, keys: pa.Array | None = None, ids: pa.Array | None = None):
        self.keys = pa.array([], pa.string()) if keys is None else keys
        self.ids = pa.array([], pa.binary()) if ids is None else ids

    def __len__(self) -> int:
        return len(self.keys)

    def places(self, keys: pa.Array) -> np.ndarray:
        """Where keys stand here; -1 for one that does not."""
        return pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy().copy()


class ChunkEncoder:
    """Keys of the cache are runs between spaces.  In byte-level BPE a key goes with a space before it, unless it begins with _BARE."""

    def __init__(self, path: str, chunks: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.I).search
        self.keeps_space = chunks == BYTE_LEVEL
        self.nothing = _BARE if self.keeps_space else ""  # the key of an empty text
        self.find = re.compile(chunks).findall
        self.plain = f"^{_BARE}?[{_LATIN}]+$" if self.keeps_space else f"^[{_LATIN}]+$"
        # words in the byte alphabet, separated by spaces: single pieces that the model takes as they are
        model = self.tokenizer.model
        model._resize_cache(0)  # words are asked for once
        self.words = Tokenizer(model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        suffix = model.end_of_word_suffix or ""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.length[i] = len(token) - (len(suffix) if suffix and token.endswith(suffix) else 0)
        self.young, self.old = Generation(), Generation()

    def _parted(self, text: str) -> str:
        """Keys of a text, in order, with _BETWEEN between them."""
        if not _simple(text):
            return _BETWEEN.join(self._chunks(text)) or self.nothing
        if self.keeps_space:
            return (_BARE + text).replace(",", f" {_BARE},").replace(".", f" {_BARE}.").replace(" ", _BETWEEN)
        return _BETWEEN.join(text.replace(",", " , ").replace(".", " . ").split())

    def _chunks(self, text: str) -> list[str]:
        """Keys of a text, each a single chunk."""
        found = self.find(text)
        return [c[1:] if c[0] == " " and c[1:2] not in (" ", _BARE) else _BARE + c for c in found] if self.keeps_space else found

    def _text(self, key: str) -> str:
        if not self.keeps_space:
            return key
        return key[1:] if key[:1] == _BARE else " " + key

    def _words(self, keys: pa.Array) -> pa.Array:
        """Ids of words of Latin letters."""
        given = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), "\n")[0].as_py()
        given = (" " + given.replace("\n", "\n ")).replace(" " + _BARE, "") if self.keeps_space else given.lower()
        raw = given.encode()
        spelt = given.replace(" ", _ALPHABET[32]).replace("\n", " ") if raw.isascii() else raw.decode("latin-1").translate(_SPELT)
        ids = np.array(self.words.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, np.int64)
        to = np.cumsum(self.length[ids])
        ends = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == ord("\n")), len(raw))
        ends -= np.arange(len(ends))  # without the line ends before them
        at = np.searchsorted(to, ends)
        if not len(to) or to[-1] != ends[-1] or (to[at] != ends).any():  # a vocabulary without some letter
            return pa.array(self._others(keys.to_pylist()), pa.binary())
        cuts = np.append(0, (at + 1) * 4).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(cuts), pa.py_buffer(ids.astype("<u4"))])

    def _others(self, keys: list[str]) -> list[bytes]:
        """Ids of any chunks."""
        found = self.tokenizer.encode_batch_fast(list(map(self._text, keys)), add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _asked(self, keys: pa.Array, whole: bool) -> pa.Array:
        """Ids of different keys that are not known; whole: each is a single chunk."""
        plain = pc.match_substring_regex(keys, self.plain)
        words, others = keys.filter(plain), keys.filter(pc.invert(plain)).to_pylist()
        made = [self._words(words[at : at + WORDS_AT_ONCE]) for at in range(0, len(words), WORDS_AT_ONCE)]
        if whole:
            made += [pa.array(self._others(others[at : at + 4096]), pa.binary()) for at in range(0, len(others), 4096)]
        elif others:
            runs = [self._chunks(self._text(k)) for k in others]
            chunks = list(set(chain.from_iterable(runs)))
            ids = dict(zip(chunks, self._ids_of(pa.array(chunks, pa.string()), True).to_pylist(), strict=True))
            made.append(pa.array([b"".join([ids[c] for c in parts]) for parts in runs], pa.binary()))
        if not made:
            return pa.array([], pa.binary())
        place = plain.to_numpy(zero_copy_only=False)
        return pa.concat_arrays(made).take(pa.array(np.argsort(np.argsort(~place, kind="stable"))))

    def _ids_of(self, keys: pa.Array, whole: bool = False) -> pa.Array:
        """Ids of different keys.  Those of runs stay in the young generation if they are not too long."""
        if len(self.young) > GENERATION and not whole:
            self.old, self.young = self.young, Generation()
        young, old = self.young, self.old
        at = young.places(keys)
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return young.ids.take(pa.array(at))
        rest = keys.take(pa.array(missing))
        from_old = old.places(rest)
        new = np.flatnonzero(from_old < 0)
        from_old[new] = len(old) + np.arange(len(new))
        found = pa.concat_arrays([old.ids, self._asked(rest.take(pa.array(new)), whole)]).take(pa.array(from_old))
        at[missing] = len(young) + np.arange(len(missing))
        if not whole:
            kept = pc.less_equal(pc.binary_length(rest), LONG)
            self.young = Generation(pa.concat_arrays([young.keys, rest.filter(kept)]), pa.concat_arrays([young.ids, found.filter(kept)]))
        return pa.concat_arrays([young.ids, found]).take(pa.array(at))

    def rest(self) -> None:
        """Keep the young generation only, between tasks: workers live on through stages that don't tokenize."""
        self.old = Generation()

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        """Ids of each text and the end id, as little-endian unsigned 32-bit integers."""
        out, tail = [], np.array([end], "<u4").tobytes()
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= AT_ONCE):
                size += len(texts[to])
                to += 1
            part = texts[at:to]
            whole = {i: np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, end], "<u4") for i, t in enumerate(part) if self.added(t) or _BETWEEN in t}
            if not self.keeps_space:  # ids don't depend on case; of Latin letters, lower case is the same everywhere
                part = [t.lower() if _is_latin(t) else t for t in part]
            keys = pc.split_pattern(pa.array([self.nothing if i in whole else self._parted(t) for i, t in enumerate(part)], pa.string()), _BETWEEN)
            coded = keys.flatten().dictionary_encode()
            joined = self._ids_of(coded.dictionary).take(coded.indices)  # ids of all keys, one after another
            _, offsets, data = joined.buffers()
            ends = np.frombuffer(offsets, np.int32, len(joined) + 1)[keys.offsets.to_numpy()].tolist()
            for i, (first, last) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                out.append(whole[i] if i in whole else np.frombuffer((data[first:last].to_pybytes() if last > first else b"") + tail, "<u4"))
            at = to
        return out


@cache
def encoder(path: str, chunks: str) -> ChunkEncoder:
    """One encoder a Python process: workers are used again for many tasks."""
    return ChunkEncoder(path, chunks)
