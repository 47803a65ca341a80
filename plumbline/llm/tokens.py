"""Token ids of whole texts by a public tokenizer, word by word with a bounded memory of words."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from .common import remembering

VOCABULARY = "word_bpe_49k.json"
#: Words, and pieces of words, that a worker remembers at most; this bounds its memory and changes no result.
#: Pieces are forgotten apart from words: what they cost is the merges.
REMEMBERED, PIECES_REMEMBERED = 250_000, 600_000
#: Characters of texts whose words are told apart together.
TOGETHER = 1 << 23

# The tokenizer's own pattern, for texts of ASCII and Latin-1 letters.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zª²-µ¹-ºß-öø-ÿ]+|[0-9]|[^\sa-z0-9ª²-µ¹-ºß-öø-ÿ]+")
SIMPLE, TAILED = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$", "[.,]$"
PLAIN = re.compile(rb"(?:[!-~]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Memory(dict):
    """The last keys, up to `most`, in two halves: when the younger is full it becomes the older one, whose keys are
    forgotten unless they have come back meanwhile."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.half, self.older = most // 2, {}

    def keep(self, key, value: bytes) -> bytes:
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.older = {}


class PieceTokens(Memory):
    """piece (lower case, cut by the tokenizer's own pattern) -> the ids that its merges give, as `WordTokens` has them."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        super().__init__(PIECES_REMEMBERED)
        self.merged = tokenizer.model.tokenize
        self.letters = {b: "".join(_byte_letters()[x] for x in chr(b).encode()) for b in range(256)}
        self.spelled = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]
        # a piece's last token, and no other one, ends with the model's suffix: pieces are letters, or have none
        self.spaced, self.suffix = Tokenizer(tokenizer.model), tokenizer.model.end_of_word_suffix
        self.spaced.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.last = np.zeros(len(self.spelled), bool)
        self.last[[i for token, i in tokenizer.get_vocab().items() if self.suffix and token.endswith(self.suffix)]] = True

    def of(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece; those that aren't remembered are merged in one call."""
        out = list(map(self.get, pieces))
        gone = [k for k, ids in enumerate(out) if ids is None]
        for k in gone:
            out[k] = self.older.get(pieces[k])
        new = [k for k in gone if out[k] is None]
        spaced = " ".join([pieces[k] if pieces[k].isascii() else pieces[k].translate(self.letters) for k in new])
        ids = np.array(self.spaced.encode(spaced, add_special_tokens=False).ids, "<u4")
        ends = 4 * np.flatnonzero(self.last[ids]) + 4
        if len(ends) == len(new):
            data = ids.tobytes()
            for k, a, b in zip(new, [0, *ends[:-1].tolist()], ends.tolist()):
                out[k] = data[a:b]
        for k in gone:
            out[k] = self[pieces[k]] if out[k] is None else self.keep(pieces[k], out[k])
        return out

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            spelled = self.spelled
            found = b"".join([spelled[t.id] for t in self.merged(piece if piece.isascii() else piece.translate(self.letters))])
        return self.keep(piece, found)


class WordTokens(Memory):
    """word (UTF-8, without white space) -> its ids as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in
    order. A word unseen so far is cut by the tokenizer's own pattern, and its merges give the ids; a word
    with characters beyond Latin-1 letters and printable ASCII, or with `<|`, goes through the whole
    tokenizer."""

    def __init__(self, path: str) -> None:
        super().__init__(REMEMBERED)
        self.whole = Tokenizer.from_file(path)
        self.pieces = PieceTokens(self.whole)

    def cut(self, word: bytes) -> list[str] | None:
        """The pieces of a word, or None if only the whole tokenizer can cut it."""
        if word.isalpha():
            return [word.lower().decode()]
        if word[-1:] in (b",", b".") and word[:-1].isalpha():
            return [word[:-1].lower().decode(), chr(word[-1])]
        if PLAIN.fullmatch(word) and b"<|" not in word:
            text = word.decode().lower()
            return [text] if text.isalpha() else PIECES.findall(text)
        return None

    def _whole(self, word: bytes) -> bytes:
        return b"".join([self.pieces.spelled[i] for i in self.whole.encode(word.decode(), add_special_tokens=False).ids])

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            pieces = self.cut(word)
            ids = self._whole(word) if pieces is None else b"".join(map(self.pieces.__getitem__, pieces))
        return self.keep(word, ids)

    def forget(self) -> None:
        super().forget()
        self.pieces.forget()

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split())) if text else b""

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """What `encode` gives for each text. Of some `TOGETHER` characters each distinct piece is looked up once."""
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text or "")
            if size >= TOGETHER:
                yield from self._together(some)
                some, size = [], 0
        if some:
            yield from self._together(some)

    def _pieces_of(self, words: pa.Array) -> tuple[pa.LargeListArray, list[bytes]]:
        """For each distinct word the places of its pieces, and the ids at each place."""
        is_simple = pc.match_substring_regex(words, SIMPLE)
        simple, some = is_simple.to_numpy(zero_copy_only=False), words.filter(is_simple)
        cores = pc.utf8_rtrim(pc.utf8_lower(some), characters=",.").dictionary_encode()
        pieces = [*cores.dictionary.to_pylist(), ",", "."]
        dot, comma = (pc.ends_with(some, sign).to_numpy(zero_copy_only=False) for sign in ".,")
        # the others are cut one by one; what only the whole tokenizer can cut stands for itself
        others = words.filter(pc.invert(is_simple)).cast(pa.large_binary()).to_pylist()
        cuts = [self.cut(word) or [word] for word in others]
        place = {piece: len(pieces) + k for k, piece in enumerate(dict.fromkeys(p for p in chain.from_iterable(cuts) if isinstance(p, str)))}
        ids = self.pieces.of([*pieces, *place])
        for word, cut in zip(others, cuts):
            if cut[0] is word:
                place[word] = len(ids)
                ids.append(self._whole(word))
        counts = np.ones(len(words), np.int64)
        counts[simple] += dot | comma
        counts[~simple] = list(map(len, cuts))
        ends = np.cumsum(counts)
        begins = ends - counts
        places = np.empty(int(counts.sum()), np.int32)
        places[np.repeat(~simple, counts)] = [place[p] for p in chain.from_iterable(cuts)]
        places[begins[simple]] = cores.indices.to_numpy()
        places[ends[simple][comma] - 1] = len(pieces) - 2
        places[ends[simple][dot] - 1] = len(pieces) - 1
        return pa.LargeListArray.from_arrays(np.concatenate(([0], ends)), places), ids

    def _together(self, texts: list[str | None]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words = split.flatten().dictionary_encode()
        pieces, ids = self._pieces_of(words.dictionary)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        ids = pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))), np.frombuffer(b"".join(ids), "<u4"))
        places = pieces.take(words.indices)
        # ids before each piece; pieces before each word; words before each text
        before = np.concatenate(([0], np.cumsum(sizes[places.flatten().to_numpy()])))
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(split).fill_null(0).to_numpy())))
        ends = (4 * before[places.offsets.to_numpy()[ends]]).tolist()
        data = ids.take(places.flatten()).flatten().to_numpy().tobytes()
        return [data[a:b] for a, b in zip(ends, ends[1:])]


_LOADED: dict[str, WordTokens] = {}


def word_tokens(vocabulary: str = VOCABULARY) -> WordTokens:
    """The tokenizer of a vocabulary file, once for each worker. A name without a slash is a public one."""
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = WordTokens(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
    remembering(_LOADED[vocabulary])
    return _LOADED[vocabulary]
