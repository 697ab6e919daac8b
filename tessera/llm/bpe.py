"""Byte-level BPE of whole texts, split and cached by pre-token.

A pre-token's merges do not depend on its neighbours, so equal pre-tokens are merged once
per worker. The split is written for code points below U+0240, where letter, number and
space classes are listed outright; other texts and texts holding an added token's string go
to the tokenizers library whole.
"""

from __future__ import annotations

import json
import re
import sys
import types

import numpy as np

LETTER = "A-Za-zªµºÀ-ÖØ-öø-ȿ"
NUMBER = "0-9²³¹¼-¾"
SPACE = "\\t-\\r \u0085 "
SPLIT = (
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+"
    f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Texts are split in stretches of about this many characters, cut where a space follows a non-space.
STRETCH = 1 << 20
#: Pre-tokens a worker remembers before it starts afresh.
REMEMBER = 400_000


def kept(key, make):
    """One object per key for the life of a Python worker."""
    store = sys.modules.setdefault("_tessera_worker", types.ModuleType("_tessera_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def stretches(text: str):
    at = 0
    safe = re.compile(f"[^{SPACE}](?=[{SPACE}])")
    while len(text) - at > STRETCH:
        found = safe.search(text, at + STRETCH)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


def splits_plainly(model: str) -> bool:
    """Whether SPLIT is the model's own splitter: byte-level merges, no normalizer, nothing put before a text."""
    spec = json.loads(model)
    pre, merges = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    odd = (merges.get("dropout"), merges.get("continuing_subword_prefix"), merges.get("end_of_word_suffix"), merges.get("byte_fallback"), merges.get("ignore_merges"))
    return (
        spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        and merges.get("type", "BPE") == "BPE" and not any(odd)
    )


def load(model: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(model)
    tok.no_truncation()
    tok.no_padding()
    return tok


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where visible, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Merger(dict):
    """pre-token -> value made from its ids, merged by the tokenizer's model on first sight."""

    def __init__(self, tok, value, known=None):
        super().__init__(known or {})
        self.merge, self.value, self.known = tok.model.tokenize, value, known or {}
        self.letters = byte_letters()

    def __missing__(self, piece):
        if len(self) > REMEMBER + len(self.known):
            self.clear()
            self.update(self.known)
        written = piece.encode().decode("latin-1").translate(self.letters)
        out = self[piece] = self.value([t.id for t in self.merge(written)])
        return out


class Encoder:
    """Whole texts to packed little-endian uint32 ids, or to numbers of tokens."""

    def __init__(self, model: str, value, known=None):
        self.tok, self.plain = load(model), splits_plainly(model)
        self.added = [a.content for a in self.tok.get_added_tokens_decoder().values()]
        self.split = re.compile(SPLIT).findall
        self.merger = Merger(self.tok, value, known)

    def pieces(self, text: str, raw: bytes):
        """Iterator of values of a text's pre-tokens; None where the library must take it whole."""
        if not self.plain or raw and np.frombuffer(raw, np.uint8).max() >= 0xC9 or any(a in text for a in self.added):
            return None
        get = self.merger.__getitem__
        return (map(get, self.split(s)) for s in stretches(text))

    def packed(self, text: str) -> bytes:
        found = self.pieces(text, text.encode())
        if found is None:
            return pack(self.tok.encode(text, add_special_tokens=False).ids)
        return b"".join(b"".join(x) for x in found)

    def count(self, text: str, raw: bytes) -> int:
        found = self.pieces(text, raw)
        if found is None:
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        return sum(sum(x) for x in found)


def pack(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def whole_tokens(model: str) -> dict[str, int]:
    """Proves which vocabulary strings stand alone as one token.

    A string counts when the splitter leaves it whole and the tokenizer's own merges bring it
    back to the single id it has in the vocabulary; both are run on every entry. Special
    strings and ids that are no UTF-8 text on their own are left out. At most one entry per
    vocabulary id, so the proof's size is bounded by the vocabulary. Models that split otherwise
    than by SPLIT have none here: the library takes their texts whole.
    """
    if not splits_plainly(model):
        return {}
    tok = load(model)
    added = {a.content for a in tok.get_added_tokens_decoder().values()}
    ids = [i for s, i in tok.get_vocab(with_added_tokens=False).items() if s not in added]
    words = tok.decode_batch([[i] for i in ids])
    split = re.compile(SPLIT).findall
    proved = {}
    for i, word, enc in zip(ids, words, tok.encode_batch(words, add_special_tokens=False)):
        if word and "�" not in word and enc.ids == [i] and max(word) < "ɀ" and split(word) == [word]:
            proved[word] = 1
    return proved
