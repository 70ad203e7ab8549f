"""Token ids by the tokenizers library, one call for each distinct piece of text.

A tokenizer that never merges across certain places may be called on the pieces between them, and pieces repeat.
For a vocabulary that drops white space, pieces lie between ASCII white spaces. For a byte-level vocabulary with the usual
split pattern, they are that pattern's own white-space rule with all other characters as one class: a run without white
space with the one space before it, a run of white space less its last character, and that character. Special strings
are cut out first, for white space before them is split in another way. A piece that is one word of Latin letters goes to
the library's model directly, past its normalizer and splitter, which would not change it. A worker keeps the ids
of the pieces it has seen; beyond CACHE of them it keeps the half that it met first, the commoner ones. All that holds for files
with the settings below, which shape() compares; texts are given whole to the library for any other file.

Many texts are encoded together: they are split at single spaces and their parts numbered by Arrow, so that Python looks at each
distinct part of a slice once, and numpy puts the ids in place. A space between two other white spaces, or after one at a text's
end, belongs to a longer run, so texts with such a place, and those with a special string, are encoded by their pieces, one by one.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE = 1_000_000
#: Fixed value: Unicode's white space.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: A space inside a run of white space, as an expression of Arrow's library.
_ARROW_SPACE = r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_INSIDE = rf"{_ARROW_SPACE} (?:{_ARROW_SPACE}|\z)"
#: Bytes of text that are split and numbered at once.
SLICE = 8 << 20
_LATIN = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,]?)")
_LOWERED = re.compile("()([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine; the parameter of every operator here is such a place or name."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: Settings of the two kinds of file that may be called on pieces.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_WORD_RULES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _WORD_SPLIT}, "behavior": "Removed", "invert": True}, _BYTE_LEVEL | {"use_regex": False}]},
)


def shape(file: dict) -> str | None:
    """How texts may be cut for a tokenizer file: spaces, words, or not at all."""
    model = file["model"]
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    exact = all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in file["added_tokens"])
    rules, suffix = (file["normalizer"], file["pre_tokenizer"]), model.get("end_of_word_suffix") or ""
    if plain and exact and file.get("post_processor") is None:
        if rules == (None, _BYTE_LEVEL) and not suffix:
            return "spaces"
        if rules == _WORD_RULES and suffix == "</w>":
            return "words"
    return None


def pieces_words(text: str) -> list[bytes]:
    return text.encode().split()


def pieces_spaces(text: str) -> list[str]:
    return _PIECES.findall(text)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, name: str, pieces: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary(name))
        self.library.no_truncation()
        self.library.no_padding()
        with open(vocabulary(name), encoding="utf-8") as f:
            self.whole = shape(json.load(f)) != pieces
        self.kind = pieces
        self.pieces: Callable[[str], list] = {"words": pieces_words, "spaces": pieces_spaces}[pieces]
        self.model, self.letters = self.library.model, byte_letters()
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        # special strings are looked for in texts that hold the first letter of one
        self.firsts = sorted({t[0] for t in special})
        self.marks = {m: np.array(self.library.encode(m, add_special_tokens=False).ids, "<u4").tobytes() for m in ".,"}
        self.known: dict[bytes | str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def learn(self, new: Iterable, known: dict) -> None:
        tokenize, letters, marks = self.model.tokenize, self.letters, self.marks
        lower, simple = self.kind == "words", (_LOWERED if self.kind == "words" else _LATIN).fullmatch
        rest, texts = [], []
        for piece in new:
            text = piece.decode() if lower else piece
            m = simple(text)
            if m is None:
                rest.append(piece)
                texts.append(text)
                continue
            space, word, mark = m.groups()
            if lower:
                word = word.lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(letters)
            ids = array("I", [t.id for t in tokenize("Ġ" + word if space else word)]).tobytes()
            known[piece] = ids + marks[mark] if mark else ids
        for piece, got in zip(rest, self.library.encode_batch_fast(texts, add_special_tokens=False)):
            known[piece] = array("I", got.ids).tobytes()

    def encode(self, text: str) -> bytes:
        if self.whole:
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if self.kind == "spaces" and self.cut is not None and any(c in text for c in self.firsts):
            parts = self.cut.split(text)
            if len(parts) > 1:
                return b"".join(self.special.get(x) or self.plain(x) for x in parts if x)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        found = self.pieces(text)
        try:
            return b"".join(map(self.known.__getitem__, found))
        except KeyError:
            pass
        out = []
        for at in range(0, len(found), CACHE):
            part = found[at : at + CACHE]
            new = {x for x in part if x not in self.known}
            if len(self.known) + len(new) > CACHE:
                self.known = dict(islice(self.known.items(), CACHE // 2))
                new = {x for x in part if x not in self.known}
            self.learn(new, self.known)
            out += [self.known[x] for x in part]
        return b"".join(out)

    def resolve(self, texts: list[str], known: dict, space: str) -> list[bytes]:
        """Ids of distinct texts, each with space before it, that known may hold; what it doesn't is learned and added."""
        found = list(map(known.get, texts))
        new = [k for k, x in enumerate(found) if x is None]
        if not new:
            return found
        spaces = self.kind == "spaces"
        simple, tokenize, marks = (_LATIN if spaces else _LOWERED).fullmatch, self.model.tokenize, self.marks
        head, rest = "Ġ" * bool(space), []
        for k in new:
            m = simple(texts[k])
            # words of ASCII letters, most of all, go straight to the model
            if m is None or m[1] or not m[2].isascii():
                rest.append(k)
                continue
            ids = array("I", [t.id for t in tokenize(head + (m[2] if spaces else m[2].lower()))]).tobytes()
            found[k] = ids + marks[m[3]] if m[3] else ids
        if rest:
            pieces = [self.pieces(space + texts[k]) if spaces else [texts[k].encode()] for k in rest]
            fresh: dict[bytes | str, bytes] = {}
            self.learn({x for p in pieces for x in p}, fresh)
            for k, p in zip(rest, pieces):
                found[k] = b"".join([fresh[x] for x in p])
        known.update((texts[k], found[k]) for k in new)
        return found

    def together(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts that may be split at spaces."""
        spaces = self.kind == "spaces"
        lists = pc.split_pattern(texts, " ") if spaces else pc.ascii_split_whitespace(texts)
        flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        coded = flat.dictionary_encode()
        if len(self.spaced) + len(coded.dictionary) > CACHE:
            self.spaced = dict(islice(self.spaced.items(), CACHE // 2))
        ids = self.resolve(coded.dictionary.to_pylist(), self.spaced, " " if spaces else "")
        codes = coded.indices.to_numpy()
        if spaces and len(codes):
            # no space stands before the first part of a text
            heads = flat.take(pa.array(ends - sizes)).dictionary_encode()
            codes = codes.copy()
            codes[ends - sizes] = heads.indices.to_numpy() + len(ids)
            ids += self.resolve(heads.dictionary.to_pylist(), {}, "")
        found = list(map(ids.__getitem__, codes.tolist()))
        edges = [0, *ends.tolist()]
        return [np.frombuffer(b"".join(found[a:b]), "<u4") for a, b in zip(edges, edges[1:])]

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, in order; null is the empty text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if self.whole:
            yield from (np.frombuffer(self.encode(x.as_py()), "<u4") for x in texts)
            return
        group = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        for a, b in zip(edges, edges[1:]):
            part = texts.slice(a, b - a)
            apart = np.zeros(len(part), bool)
            if self.kind == "spaces":
                for hit in [pc.match_substring_regex(part, _INSIDE), *[pc.match_substring(part, t) for t in self.special]]:
                    apart |= hit.to_numpy(zero_copy_only=False)
            rest = iter(self.together(part.filter(pa.array(~apart))) if not apart.all() else ())
            for k, alone in enumerate(apart.tolist()):
                yield np.frombuffer(self.encode(part[k].as_py()), "<u4") if alone else next(rest)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(name: str, pieces: str) -> Encoder:
    """This worker's encoder."""
    if (name, pieces) not in _encoders:
        _encoders[name, pieces] = Encoder(name, pieces)
    return _encoders[name, pieces]
