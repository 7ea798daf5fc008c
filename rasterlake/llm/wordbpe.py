"""Exact BPE encoding of whole text columns, memoised by space-delimited unit.

Both public vocabularies cut a text at a lone space between two visible
characters, whatever stands on either side: the word vocabulary drops white
space, the byte vocabulary glues the space to the word after it.  A batch is
therefore split at spaces by Arrow, dictionary-encoded, each distinct unit is
encoded once, and the ids are gathered back by numpy.  Nothing here is done per
occurrence in Python, and for units that are a plain word, perhaps with a mark, not
even per distinct unit: all of a slice are merged in one call.

Units made of ASCII and Latin-1 letters, digits and marks take the quick path
(byte-pair merges by rank, through tiktoken, over the ranks stated in the
tokenizer file).  Every other unit, and every unit holding a special token, is
given to the ``tokenizers`` library itself.  ``tests/llm`` holds both paths
against the library.
"""

from __future__ import annotations

import json
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units of a generation of the memo, about 18 MB; two are kept.  Pieces of compound units have a quarter of that.
MEMO_UNITS = 120_000
#: Bytes of text turned into ids at once.
SLICE_BYTES = 4_000_000
#: A space beside other white space, for RE2.
NO_CUT = r" [\s\p{Z}\x0b\x1c-\x1f\x85]|[\s\p{Z}\x0b\x1c-\x1f\x85] "


#: Byte for the end of a word; what stands between units that are merged together, and between a word and its mark.
END, BETWEEN, INSIDE = b"\x01", "\n", "\t"
#: Units of Latin letters and perhaps a mark, for RE2: such a word is one piece, and so is the mark.
WORD, MARK = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,!?;:]?$", "([.,!?;:])$"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _ids(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _byte_symbols() -> dict[str, int]:
    """Symbol -> byte of the byte-level alphabet: visible Latin-1 bytes stand for themselves, the others follow from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


class UnitEncoder:
    """Ids of texts under one tokenizer file.

    ``encode(texts)`` gives (ids uint32, ends int64): document i has
    ``ids[ends[i-1]:ends[i]]``.  A null text counts as empty.
    """

    END_OF_WORD = "</w>"

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path) as f:
            spec = json.load(f)
        self.words = spec["model"].get("end_of_word_suffix") == self.END_OF_WORD
        symbols = _byte_symbols()
        special = {t["content"] for t in spec["added_tokens"]}
        self.special_marks = sorted(special)
        self._hint = "<|" if all(m.startswith("<|") for m in special) else ""
        ranks: dict[bytes, int] = {}
        for token, i in spec["model"]["vocab"].items():
            if token in special:
                continue
            last = self.words and token.endswith(self.END_OF_WORD)
            body = bytes(symbols[c] for c in (token.removesuffix(self.END_OF_WORD) if last else token))
            ranks[body + END * last] = i
        # No text of the quick path holds END: in the word vocabulary it stands for the end of a word.
        # Merging in order of rank asks that a byte and the end mark merge before all else.
        order = {t: n for n, t in enumerate(" ".join(m) if isinstance(m, list) else m for m in spec["model"]["merges"])}
        self._check_ranks(ranks, order, symbols)
        self._bpe = tiktoken.Encoding("unit", pat_str=r"[^\n\t]+|\n|\t", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self._between, self._inside = ranks[BETWEEN.encode()], ranks[INSIDE.encode()]
        if self.words:
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
        else:
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._pieces = regex.compile(pattern).findall
        self._plain = regex.compile("[\x20-\x7e\n¡-¬®-ÿ]*").fullmatch
        self.last_id = max(max(spec["model"]["vocab"].values()), max((t["id"] for t in spec["added_tokens"]), default=0))
        self._memo: dict[str, bytes] = {}
        self._memo_old: dict[str, bytes] = {}
        self._pieces_new: dict[str, bytes] = {}
        self._pieces_old: dict[str, bytes] = {}
        self._marks = {c: self.encode_unit(c) for c in ".,!?;:"}

    def _check_ranks(self, ranks: dict[bytes, int], merges: dict[str, int], symbols: dict[str, int]) -> None:
        """Ids must rise with merge order, else ranks could not stand for it."""
        first = 512 if self.words else 256
        for n, pair in enumerate(merges):
            if n % 1000 == 0 or n == len(merges) - 1:
                joined = pair.replace(" ", "")
                last = self.words and joined.endswith(self.END_OF_WORD)
                body = bytes(symbols[c] for c in (joined.removesuffix(self.END_OF_WORD) if last else joined)) + END * last
                if ranks[body] != first + n:
                    raise ValueError("this tokenizer file does not number its tokens in merge order")

    # -- one unit --------------------------------------------------------

    def _merged(self, p: str) -> bytes:
        raw = p.encode()
        return _ids(self._bpe.encode_single_piece(raw + END if self.words else raw))

    def _piece(self, p: str) -> bytes:
        got = self._pieces_new.get(p)
        if got is None:
            got = self._pieces_old.get(p)
            if got is None:
                got = self._merged(p)
            if len(self._pieces_new) >= MEMO_UNITS // 4:
                self._pieces_old, self._pieces_new = self._pieces_new, {}
            self._pieces_new[p] = got
        return got

    def encode_unit(self, u: str) -> bytes:
        """Little-endian 32-bit ids of a text, by quick path where it is exact and else by the library."""
        if not self._plain(u) or (self._hint in u and any(m in u for m in self.special_marks)):
            return _ids(self.library.encode(u, add_special_tokens=False).ids)
        if self.words:
            u = u.lower()
        return b"".join(map(self._piece, self._pieces(u)))

    def _unit(self, key: str, lead: str) -> bytes:
        """Into the memo; lead is the space that a unit inside a text starts with in the byte vocabulary."""
        got = self._memo_old.get(key)
        if got is None:
            got = self._fresh(key, lead)
        if len(self._memo) >= MEMO_UNITS:
            self._memo_old, self._memo = self._memo, {}
        self._memo[key] = got
        return got

    def _fresh(self, key: str, lead: str) -> bytes:
        """A word is one piece; with a capital or a mark behind it, it is the plain word's unit, which is known more often."""
        if key.isascii() or self._plain(key):
            body = key.lower() if self.words else key
            if body.isalpha():
                return self._merged(lead + body) if body == key else self._known(body, lead)
            if body[-1:] in self._marks and body[:-1].isalpha():
                return self._known(body[:-1], lead) + self._marks[body[-1]]
        return self.encode_unit(lead + key)

    def _known(self, key: str, lead: str) -> bytes:
        got = self._memo.get(key)
        return self._unit(key, lead) if got is None else got

    # -- whole columns ---------------------------------------------------

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        parts, ends, base, i = [], [], 0, 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + SLICE_BYTES, "right")))
            ids, end = self._encode_slice(texts.slice(i, j - i))
            parts.append(ids)
            ends.append(end + base)
            base, i = base + len(ids), j
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return (np.concatenate(parts), np.concatenate(ends)) if len(parts) > 1 else (parts[0], ends[0])

    def _encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
        bounds = bounds - bounds[0]
        coded = values.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int32)  # a slice has fewer than 2^31 units and ids
        lead = "" if self.words else " "
        plain, known, known_size = self._words(coded.dictionary, lead)
        names = coded.dictionary.filter(pa.array(~plain)).to_pylist()
        get = self._memo.get
        blobs = [b if (b := get(n)) is not None else self._unit(n, lead) for n in names]
        odd_docs: list[int] = []
        if not self.words:
            # a text's first unit has no space before it
            firsts = values.take(pa.array(bounds[:-1])).dictionary_encode()
            codes[bounds[:-1]] = len(plain) + firsts.indices.to_numpy()
            blobs += [self.encode_unit(n) for n in firsts.dictionary.to_pylist()]
            plain = np.concatenate([plain, np.zeros(len(blobs) - len(names), bool)])
            # a space beside other white space is no cut
            odd_docs = np.flatnonzero(pc.match_substring_regex(texts, NO_CUT).to_numpy(zero_copy_only=False)).tolist()
        table = np.concatenate([known, np.frombuffer(b"".join(blobs), "<u4")])
        size, start = np.empty(len(plain), np.int32), np.empty(len(plain), np.int32)
        size[plain], size[~plain] = known_size, np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        start[plain] = np.cumsum(size[plain]) - size[plain]
        start[~plain] = len(known) + np.cumsum(size[~plain]) - size[~plain]
        n = size[codes]
        cum = np.cumsum(n, dtype=np.int32)
        total = int(cum[-1]) if len(cum) else 0
        ids = table[np.repeat(start[codes] - (cum - n), n) + np.arange(total, dtype=np.int32)]
        ends = cum[bounds[1:] - 1].astype(np.int64)
        if odd_docs:
            return self._with_whole(ids, ends, texts, odd_docs)
        return ids, ends

    def _words(self, names: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which units are plain words, their ids, number of ids of each), merged in one call."""
        plain = pc.match_substring_regex(names, WORD).to_numpy(zero_copy_only=False).astype(bool)
        chosen = names.filter(pa.array(plain))
        if not len(chosen):
            return plain, np.zeros(0, np.uint32), np.zeros(0, np.int64)
        end = END.decode() if self.words else ""
        if self.words:
            chosen = pc.utf8_lower(chosen)
        parts = pc.replace_substring_regex(chosen, MARK, f"{end}{INSIDE}\\1").to_pylist()
        ids = np.array(self._bpe.encode_ordinary(lead + f"{end}{BETWEEN}{lead}".join(parts) + end), np.uint32)
        ends, own = ids == self._between, ids != self._inside
        own &= ~ends
        return plain, ids[own], np.bincount(np.cumsum(ends)[own], minlength=len(chosen))

    def _with_whole(self, ids: np.ndarray, ends: np.ndarray, texts: pa.Array, odd: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Replace the ids of texts with spaces beside other white space: those are cut only at lone spaces."""
        starts = np.concatenate([[0], ends[:-1]])
        parts, size, at = [], ends - starts, 0
        for d in odd:
            parts.append(ids[at : starts[d]])
            own = np.frombuffer(self._whole(texts[d].as_py()), "<u4")
            parts.append(own)
            size[d], at = len(own), ends[d]
        parts.append(ids[at:])
        return np.concatenate(parts), np.cumsum(size)

    def _whole(self, text: str) -> bytes:
        """Ids of one text of the byte vocabulary, cut at spaces between visible characters only."""
        units, held = [], []
        for u in text.split(" "):
            if held and u and not u[0].isspace() and held[-1] and not held[-1][-1].isspace():
                units.append(" ".join(held))
                held = [u]
            else:
                held.append(u)
        units.append(" ".join(held))
        return b"".join([self.encode_unit(units[0]), *map(self._unit, units[1:], repeat(" "))])


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]
