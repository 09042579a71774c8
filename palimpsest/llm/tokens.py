"""Token ids of whole texts, with a cache of words.

The tokenizer's normaliser and splitter never look across ASCII white space, so
a text's ids are the ids of its space-separated pieces in a row; each distinct
piece goes through the library once per worker.
"""

from __future__ import annotations

import os
import re
import string
import unicodedata
from array import array

import numpy as np

_SPACE, _SEPARATORS = re.compile(r"[ \t\n\r]+"), re.compile("[\x1c-\x1f]")
#: Pieces that a worker remembers (about 150 bytes each), and their length at most.
_CACHED, _PIECE = 1_000_000, 100
#: Signs that end a piece; not the apostrophe, which some words own.
_TAIL = string.punctuation.replace("'", "")
_made: dict[tuple[str, bool], "Encoder"] = {}


class Encoder:
    """``by_word`` must be true only for tokenizers that drop white space.

    A remembered piece is the bytes of its ids, so a text is one ``join``."""

    def __init__(self, path: str, by_word: bool) -> None:
        # Spark's tasks are the parallelism here.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._made = Tokenizer.from_file(path)
        self._batch = getattr(self._made, "encode_batch_fast", self._made.encode_batch)
        self._by_word = by_word
        self._kind = "<u2" if self._made.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self._code = "H" if self._kind == "<u2" else "I"
        self._known: dict[str, bytes] = {"": b""}
        self._model = self._made.model
        self._letters = {ord(c): self._made.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xAA, 0x250)) if c.isalpha()} if by_word else {}

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of pieces not known yet.  Latin letters and the signs after them are
        separate to the splitter, so "word," is "word" and ",", both maybe known; all
        else goes to the library whole, as letters may turn into marks (the lower case
        of U+0130 ends in one), which the splitter joins to signs."""
        known = self._known
        if len(known) + 2 * len(missing) > _CACHED:
            known.clear()
            known[""] = b""
        parts = {}
        for p in missing:
            stem = p.rstrip(_TAIL)
            plain = stem.isalpha() and (stem.isascii() or max(stem) < "\u0250" and "\u0130" not in stem)
            parts[p] = (stem, p[len(stem) :]) if plain and len(stem) < len(p) else (p,)
        new = {q for x in parts.values() for q in x if q not in known}
        ids, other = {}, []
        for q in new:
            # Lower-case Latin letters are as the model takes them but for their byte signs.
            if q.isalpha() and q.islower() and (q.isascii() or max(q) < "\u0250" and unicodedata.is_normalized("NFC", q)):
                ids[q] = array(self._code, [t.id for t in self._model.tokenize(q if q.isascii() else q.translate(self._letters))]).tobytes()
            else:
                other.append(q)
        for q, e in zip(other, self._batch(other, add_special_tokens=False) if other else ()):
            ids[q] = array(self._code, e.ids).tobytes()
        found = {p: b"".join(ids[q] if q in ids else known[q] for q in x) for p, x in parts.items()}
        for d in (ids, found):
            known.update((p, v) for p, v in d.items() if len(p) <= _PIECE)
        return found

    def __call__(self, text: str | None, end: int) -> np.ndarray:
        """Ids of the text and the end id."""
        if not text:
            return np.array([end], dtype="<u4")
        if not self._by_word:
            return np.array([*self._made.encode(text, add_special_tokens=False).ids, end], dtype="<u4")
        # In ASCII lower case is one rule; special tokens are looked for before it.
        if text.isascii() and "<|" not in text:
            text = text.lower()
        # str.split also takes the signs 1C to 1F for space.
        pieces = _SPACE.split(text) if _SEPARATORS.search(text) else text.split()
        found = list(map(self._known.get, pieces))
        if None in found:
            learnt = self._learn({p for p, v in zip(pieces, found) if v is None})
            found = [learnt[p] if v is None else v for p, v in zip(pieces, found)]
        ids = np.frombuffer(b"".join(found), self._kind)
        out = np.empty(len(ids) + 1, dtype="<u4")
        out[:-1], out[-1] = ids, end
        return out


def encoder(path: str, by_word: bool = False) -> Encoder:
    """One per process and file."""
    key = path, by_word
    if key not in _made:
        _made[key] = Encoder(*key)
    return _made[key]


def drops_space(path: str) -> bool:
    """Whether white space of a tokenizer file yields no ids and separates pieces:
    it is folded to one space, and the splitter removes what its pattern, which
    matches no space, leaves out."""
    import json

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    folds = any(x.get("type") == "Replace" and x.get("pattern", {}).get("Regex") == r"\s+" for x in (made.get("normalizer") or {}).get("normalizers", []))
    splits = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    return folds and splits.get("type") == "Split" and splits.get("behavior") == "Removed" and splits.get("invert") is True and r"[^\s\p{L}\p{N}]+" in splits["pattern"].get("Regex", "")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
