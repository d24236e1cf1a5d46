"""Token ids of whole texts by a tokenizer file, as numpy arrays.

A tokenizer whose normaliser and pre-tokenizer never join text across white space gives the same
ids for a text as for its white-space-free runs one after the other. For those the ids of each run
are kept, up to ``MEMO`` runs, so that a run costs one look-up after its first occurrence.
Other tokenizers encode each text whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

MEMO = 1_200_000

# Characters that str.split() takes for white space and the tokenizers' \s does not.
ONLY_PYTHON_SPACE = "\x1c\x1d\x1e\x1f"
# Letters whose lower case is one letter and which composition leaves alone, with a final stop or comma.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-Þß-öø-ÿ]+)([.,]?)")


def byte_letters() -> dict[int, int]:
    """The printable stand-in of each byte: itself where printable, else the next code from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


def splits_at_space(spec: dict) -> bool:
    """Whether no piece can hold or reach over white space, and words go to the model letter for letter."""
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = [x["type"] for x in norm.get("normalizers", [])]
    cuts = pre.get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cuts] != ["Split", "ByteLevel"]:
        return False
    added = all(not (t["lstrip"] or t["rstrip"]) and not re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
    pattern = cuts[0]["pattern"].get("Regex", "")
    return added and spec.get("post_processor") is None and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and \
        "[\\p{L}]+" in pattern and "[^\\s\\p{L}\\p{N}]+" in pattern and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]


class _Runs(dict):
    """Ids, as bytes, of each white-space-free run seen so far."""

    def __init__(self, tokenizer, dtype):
        super().__init__()
        self.tokenizer, self.model, self.dtype, self.letters = tokenizer, tokenizer.model, dtype, byte_letters()

    def word(self, w: str) -> bytes:
        if not w.isascii():
            w = w.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(w)], self.dtype).tobytes()

    def __missing__(self, run: str) -> bytes:
        if m := PLAIN.fullmatch(run):
            w, stop = m.groups()
            low = w.lower()
            if low != run:
                out = self[low]
                if stop:
                    out += self[stop]
            else:
                out = self.word(low)
        elif run in (".", ","):
            out = self.word(run)
        else:
            out = np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, self.dtype).tobytes()
        if len(self) < MEMO:
            self[run] = out
        return out


class TextEncoder:
    """``ids(text)`` gives what ``Tokenizer.encode(text, add_special_tokens=False).ids`` gives."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.runs = _Runs(self.tokenizer, self.dtype) if splits_at_space(spec) else None

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        if self.runs is None or any(c in text for c in ONLY_PYTHON_SPACE):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
        return np.frombuffer(b"".join(map(self.runs.__getitem__, text.split())), self.dtype)


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder for each worker process and file, kept from task to task."""
    return TextEncoder(path)
