"""Exact ids of a byte-level BPE tokenizer, by distinct pieces.

The library's pre-tokenizer always splits before a single space that stands
between two non-space characters, and around a single line feed that stands
between two. Ids of the stretches between such places don't depend on their
neighbours, so a slice of texts is cut into pieces by Arrow, each distinct
piece is encoded once by the library, and the texts' ids are gathered.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import release_memory

#: A space with a non-space on both sides.
_SEAM = re.compile(r"(?<=\S) (?=\S)")
#: ASCII punctuation that can neither start a contraction nor a special token.
_TAIL = ".,;:!?\"#$%&()*+-/=@[]^_`{}~"
#: What Python counts as white space but the line feed, in the syntax of Arrow.
_SPACE = r"\t\x{0B}\x{0C}\r\x{1C}-\x{1F}\x{85}\pZ"
#: Pieces that show that a space or line feed beside them is no seam.
_TOUCHING = rf"^\n?$|^\n?[{_SPACE}]|[{_SPACE}\n]$"
_IDS = pa.list_(pa.uint32())


def _byte_letters() -> list[str]:
    """The printable character by which byte-level BPE writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PieceEncoder:
    """``encode_all(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes.

    A piece is written as its text after the space before it, or with the line
    feed before it. The ids of at most ``max_entries`` pieces, the most frequent
    lately, are kept as Arrow arrays from slice to slice; a slice holds
    ``slice_bytes`` of text, or one longer text. So a worker's memory stays
    bounded whatever the corpus holds.
    """

    def __init__(self, path: str, max_entries: int = 200_000, slice_bytes: int = 4 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._letters = str.maketrans(dict(enumerate(_byte_letters())))
        self._max, self._slice = max_entries, slice_bytes
        self._keys, self._ids = pa.array([], pa.large_string()), pa.array([], _IDS)
        self._weight = np.empty(0)
        self._feed = self._raw(["\n"])[0]

    def _raw(self, surfaces: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch(surfaces, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _pieces(self, keys: pa.Array) -> pa.ListArray:
        """Ids of distinct pieces; a kept one serves those that add punctuation to it."""
        stems = pc.utf8_rtrim(keys, characters=_TAIL)
        place = pc.index_in(stems, value_set=self._keys)
        kept = self._ids.take(place.drop_null())
        words = dict(zip(stems.filter(place.is_valid()).to_pylist(), _bytes_of(kept, kept.offsets.to_numpy())))
        tails: dict[str, bytes] = {}
        out = []
        for key, stem in zip(keys.to_pylist(), stems.to_pylist()):
            feed = stem[:1] == "\n"
            word = stem[1:] if feed else stem
            # a Latin letter ends its pre-token where ASCII punctuation starts
            if word.isalpha() and (word.isascii() or max(word) < "ɐ"):
                if (ids := words.get(stem)) is None:
                    letters = word if word.isascii() else word.encode().decode("latin-1").translate(self._letters)
                    ids = array("I", [x.id for x in self._model.tokenize(letters if feed else "Ġ" + letters)]).tobytes()
                    ids = words[stem] = self._feed + ids if feed else ids
                if tail := key[len(stem) :]:
                    if tail not in tails:
                        tails[tail] = self._raw([tail])[0]
                    ids += tails[tail]
            else:
                ids = self._raw([key if key[:1] == "\n" else " " + key])[0]
            out.append(ids)
        return _lists(out)

    def _gather(self, words: pa.ListArray, plain: bool) -> tuple[list[bytes], np.ndarray]:
        """Ids of texts that are given as lists of pieces, the first without a space before it.

        ``plain``: the texts were cut at every space and line feed; also
        returns which of them have one that is no seam, whose ids are void.
        """
        bounds = words.offsets.to_numpy()
        coded = words.values.dictionary_encode()
        at, found = coded.indices.to_numpy(), coded.dictionary
        starts = bounds[:-1]
        place = pc.index_in(found, value_set=self._keys)
        fresh = np.flatnonzero(place.is_null())
        place = place.fill_null(0).to_numpy(zero_copy_only=False).copy()
        met = np.bincount(at, minlength=len(found)) - np.bincount(at[starts], minlength=len(found))
        missing = found.take(pa.array(fresh))
        touching = pc.match_substring_regex(missing, _TOUCHING).to_numpy(zero_copy_only=False)
        void = np.zeros(len(words), bool)
        if plain and touching.any():
            bad = np.zeros(len(found), bool)
            bad[fresh[touching]] = True
            void = np.logical_or.reduceat(bad[at], starts)
        # first pieces follow no space, and pieces met nowhere else need no ids
        wanted = (met[fresh] > 0) & ~(touching & plain)
        fresh, missing, touching = fresh[wanted], missing.filter(pa.array(wanted)), touching[wanted]
        new = self._pieces(missing)
        place[fresh] = len(self._keys) + np.arange(len(fresh))
        heads = words.values.take(pa.array(starts)).dictionary_encode()
        first = _lists(self._raw(heads.dictionary.to_pylist()))
        rows = place[at]
        rows[starts] = len(self._keys) + len(new) + heads.indices.to_numpy()
        ids = pa.concat_arrays([self._ids, new, first]).take(pa.array(rows))
        texts = _bytes_of(ids, ids.offsets.to_numpy()[bounds])
        self._keep(found, place, met, missing.filter(pa.array(~touching)), new.filter(pa.array(~touching)), met[fresh[~touching]])
        return texts, void

    def _keep(self, found: pa.Array, place: np.ndarray, met: np.ndarray, keys: pa.Array, ids: pa.ListArray, weight: np.ndarray) -> None:
        """Add pieces to the kept ones; the most frequent stay, earlier slices counting less."""
        self._weight *= 0.9
        known = (place < len(self._keys)) & (met > 0)
        np.add.at(self._weight, place[known], met[known])
        keys, ids, weight = pa.concat_arrays([self._keys, keys]), pa.concat_arrays([self._ids, ids]), np.concatenate([self._weight, weight])
        if len(keys) > self._max:
            stay = np.sort(np.argpartition(-weight, self._max)[: self._max])
            keys, ids, weight = keys.take(pa.array(stay)), ids.take(pa.array(stay)), weight[stay]
        self._keys, self._ids, self._weight = keys, ids, weight

    def _encode_slice(self, texts: pa.Array) -> list[bytes]:
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        out, void = self._gather(cut, True)
        if void.any():
            odd = np.flatnonzero(void)
            pieces = [_SEAM.split(t) for t in texts.take(pa.array(odd)).to_pylist()]
            for i, ids in zip(odd.tolist(), self._gather(pa.array(pieces, pa.list_(pa.large_string())), False)[0]):
                out[i] = ids
        return out

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, null counting as empty."""
        texts = texts.cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy())
        at = 0
        while at < len(texts):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + self._slice, "right")))
            yield from self._encode_slice(texts.slice(at, to - at).fill_null(""))
            release_memory()
            at = to

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all(pa.array([text], pa.large_string())))


def _lists(rows: list[bytes]) -> pa.ListArray:
    """Rows of ids as an array of lists."""
    offsets = np.cumsum([0, *map(len, rows)]) // 4
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), np.uint32)))


def _bytes_of(ids: pa.ListArray, bounds: np.ndarray) -> list[bytes]:
    """The ids between neighbouring bounds, each as bytes."""
    values, at = ids.values.to_numpy(), bounds.tolist()
    return [values[a:b].tobytes() for a, b in zip(at, at[1:])]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each vocabulary file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_size(path: str) -> int:
    """Ids that the vocabulary file has, added ones included."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
