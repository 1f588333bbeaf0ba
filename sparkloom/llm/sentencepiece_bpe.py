"""Merge-type SentencePiece encoding by backtracking, and decoding.

The longest pieces that start at each position come from an Aho-Corasick automaton. A path of pieces is grown
from the left: a piece may follow another only if merging the two strings anew gives just these two pieces, and
where no piece fits, the path steps back and the position is marked in a bitfield, so that it's never tried
again. The result is what merging the whole text by scores gives, without a heap over the text.

A text is cut where no piece can cross: before white space that follows other characters, and around line
feeds when the model has no piece with them. The parts repeat often, so a worker keeps the codes of parts seen,
up to a fixed number of entries. The sentencepiece library is used only to read the model file.
"""

from __future__ import annotations

import codecs
import re
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

SPACE = "▁"
#: Entries a worker keeps of each kind.
CACHE_ENTRIES = 200_000


def _bytewise(error):
    """Each byte that is not UTF-8 becomes one replacement character."""
    return "�" * (error.end - error.start), error.end


codecs.register_error("sparkloom-bytewise", _bytewise)


class _Parts(dict):
    """Codes of text parts as int32 bytes, computed when missing. Two generations: when one is full, it becomes the old one."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.old: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        found = self.old.get(part)
        if found is None:
            found = array("i", self.encode(part)).tobytes()
        if len(part) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[part] = found
        return found


def _fields(raw: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = number() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
        yield tag >> 3, raw[at : at + size]
        at += size


def check_settings(raw: bytes) -> None:
    """ValueError for a model whose settings this encoder doesn't follow: it does merge models without normalisation, with a space
    before the text, white space kept and escaped at the front, and plain, byte, control and unknown pieces."""
    trainer, normaliser, kinds = {}, {}, set()
    for k, v in _fields(raw):
        if k == 1:
            kinds.add(dict(_fields(v)).get(3, 1))
        elif k == 2:
            trainer = dict(_fields(v))
        elif k == 3:
            normaliser = dict(_fields(v))
    bad = {
        "model type": trainer.get(3, 1) != 2,
        "white space as suffix": trainer.get(24, 0) != 0,
        "normalisation": bool(normaliser.get(2)),
        "no space before the text": normaliser.get(3, 1) != 1,
        "white space removed": normaliser.get(4, 1) != 0,
        "white space not escaped": normaliser.get(5, 1) != 1,
        "user-defined or unused pieces": bool(kinds - {1, 2, 3, 6}),
    }
    if any(bad.values()):
        raise ValueError("unsupported model: " + ", ".join(k for k, v in bad.items() if v))


class MergeModel:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        with open(path, "rb") as f:
            check_settings(f.read())
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.kind = ["byte" if model.is_byte(i) else "control" if model.is_control(i) else "unknown" if model.is_unknown(i) else "piece" for i in range(n)]
        self.bytes_from = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kind[i] == "byte"}
        self.byte_of = {i: b for b, i in self.bytes_from.items()}
        self.unknown = self.kind.index("unknown")
        self.id_of = {p: i for i, p in enumerate(self.pieces) if self.kind[i] == "piece"}
        self.score = {p: model.get_score(i) for p, i in self.id_of.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("pieces with inner white space are not supported")
        reached = [p for p in self.id_of if len(p) == 1 or self.merge(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p in reached:
            self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()
        known = set(reached)
        self.whole = {p: [self.id_of[p]] for p in reached}
        #: The longest shorter piece that starts a piece.
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in known), None) for p in reached}
        self.lines = not any("\n" in p for p in self.id_of)
        self.fits: dict[tuple[str, str], bool] = {}
        self.parts = _Parts(self.encode_part)
        self.controls = {i for i in range(n) if self.kind[i] == "control"}
        self.shown = [self._shown(i) for i in range(n)]
        self.shown_bytes = [bytes((self.byte_of[i],)) if i in self.byte_of else x.encode("utf-8") for i, x in enumerate(self.shown)]

    def merge(self, text: str) -> list[str]:
        """Merge neighbours by the best score, the leftmost first. For short strings."""
        row, get, none = list(text), self.score.get, -np.inf
        scores = [get(x + y, none) for x, y in zip(row, row[1:], strict=False)]
        while scores and (best := max(scores)) != none:
            i = scores.index(best)
            row[i : i + 2] = [row[i] + row[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = get(row[i - 1] + row[i], none)
            if i < len(scores):
                scores[i] = get(row[i] + row[i + 1], none)
        return row

    def compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= CACHE_ENTRIES:
                self.fits.clear()
            found = self.fits[key] = self.merge(left + right) == [left, right]
        return found

    def encode_part(self, part: str) -> list[int]:
        whole = self.whole.get(part)
        if whole is not None:
            return whole
        longest: dict[int, str] = {}
        for end, (back, piece) in self.automaton.iter(part):  # ends rise, so the last one of a start is the longest
            longest[end - back] = piece
        shorter, fits, starts = self.shorter, self.fits.get, longest.get
        path: list[str] = []
        at, size, failed, any_failed = 0, len(part), bytearray(len(part) // 8 + 1), False
        piece, last = starts(0), None  # last: the piece before, None where any may follow
        while at < size:
            if piece is None:  # a character the model lacks: nothing merges with it
                path.append(part[at])
                at += 1
                piece, last = starts(at), None
                continue
            while piece is not None:
                if last is not None:
                    fit = fits((last, piece))
                    if fit is None:
                        fit = self.compatible(last, piece)
                    if not fit:
                        piece = shorter[piece]
                        continue
                end = at + len(piece)
                if any_failed and failed[end >> 3] >> (end & 7) & 1:
                    piece = shorter[piece]
                    continue
                break
            if piece is not None:
                path.append(piece)
                at, last, piece = end, piece, starts(end)
                continue
            while piece is None:  # nothing fits here: mark the position and step back
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                if not path:
                    raise ValueError("no encoding")
                back_to = path.pop()
                at -= len(back_to)
                piece = shorter.get(back_to)
            last = path[-1] if path and path[-1] in shorter else None
        try:
            return [self.id_of[p] for p in path]
        except KeyError:
            return [i for p in path for i in self._ids(p)]

    def _ids(self, piece: str) -> list[int]:
        i = self.id_of.get(piece)
        if i is not None:
            return [i]
        return [self.bytes_from.get(b, self.unknown) for b in piece.encode("utf-8")] if self.bytes_from else [self.unknown]

    def encode(self, text: str) -> np.ndarray:
        """The codes of a whole text, without begin and end codes."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        text = " " + text.replace(SPACE, " ")
        parts: list[str] = []
        for i, line in enumerate(text.split("\n") if self.lines else [text]):
            if i:
                parts.append("\n")
            words = line.split(" ")
            if "" in words[1:]:  # runs of white space: they stay with what follows
                parts += [p.replace(" ", SPACE) for p in re.findall(" +[^ ]*|[^ ]+", line)]
            else:
                if words[0]:
                    parts.append(words[0])
                parts += [SPACE + w for w in words[1:]]
        return np.frombuffer(b"".join(map(self.parts.__getitem__, parts)), dtype=np.int32)

    def _shown(self, i: int) -> str:
        if self.kind[i] == "piece":
            return self.pieces[i].replace(SPACE, " ")
        return {"control": "", "unknown": " ⁇ ", "byte": ""}[self.kind[i]]

    def decode(self, ids: list[int]) -> str:
        """The text of codes: the space put before a text goes, bytes join to characters where no control code parts them."""
        first = next((k for k, i in enumerate(ids) if i not in self.controls), None)
        if first is None:
            return ""
        if self.controls.isdisjoint(ids):
            out = self._joined(ids)
        else:
            cuts = [-1, *(k for k, i in enumerate(ids) if i in self.controls), len(ids)]
            out = "".join(self._joined(ids[x + 1 : y]) for x, y in zip(cuts, cuts[1:], strict=False))
        return out[1:] if self.kind[ids[first]] == "piece" and out[:1] == " " else out

    def _joined(self, ids: list[int]) -> str:
        if self.byte_of.keys().isdisjoint(ids):
            return "".join(map(self.shown.__getitem__, ids))
        return b"".join(map(self.shown_bytes.__getitem__, ids)).decode("utf-8", "sparkloom-bytewise")


@lru_cache(maxsize=2)
def model(path: str) -> MergeModel:
    return MergeModel(path)


def encode(text: Column, path: str) -> Column:
    """array<int> of codes of a whole text, however long. Null and empty texts have no codes; equal texts have equal ones. A model
    with settings that aren't followed is a ValueError (see check_settings)."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        m = model(path)
        return pd.Series([m.encode(t or "") for t in texts])

    return run(text)


def decode(ids: Column, path: str) -> Column:
    """The text of an array of codes. Null and empty arrays give an empty text."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        m = model(path)
        return pd.Series(["" if r is None else m.decode(r.tolist()) for r in rows], dtype=object)

    return run(F.coalesce(ids, F.array().cast("array<int>")))  # a JVM expression between: codes are made once
