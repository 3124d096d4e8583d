"""Token ids by a tokenizers file, faster than by the library text by text.

Two ways, each for texts of plain characters only (``PLAIN``: ASCII and Latin letters, on which all
libraries' notions of letter, space and case agree) that hold no added token's string; any other
text goes to the library whole, and so does every text if the file is not of the kind described.

* A byte-level file without word ends, whose merged ids rise in the order of the merges, is the
  same vocabulary as a table of merge ranks, which ``tiktoken`` encodes several times faster.
* A file that lower-cases and drops white space encodes each white-space-separated word
  independently of its neighbours, and words recur: the library's model encodes each distinct one
  once.

Ids are those the library gives by its default settings, with add_special_tokens=False: the string
of an added token in a text becomes that token's id.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import regex

#: Words kept in each of two generations; a full one becomes the old one, and what is used moves on.
KEPT = 400_000
# The splitting rule of byte-level BPE (the file names it only as "ByteLevel").
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = re.compile("[\t-\r\x20-\x7e\xa1-įı-ɏ]*")
# The normaliser under which words are encoded one by one.
LOWER_CASING = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _ranked(model: dict) -> bool:
    """Whether merged ids rise in the order of the merges, so that ids are ranks."""
    ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    return all(a < b for a, b in zip(ids, ids[1:]))


class Encoder:
    """Ids of texts, as ``tokenizers`` gives them with add_special_tokens=False."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        with open(path) as f:
            made = json.load(f)
        cut, model = made["pre_tokenizer"], made["model"]
        splits = cut.get("pretokenizers", [])
        self.shown = byte_alphabet()
        self.ranks = None
        added = {t["content"] for t in made["added_tokens"]}
        self.added = sorted({x for t in added for x in (t, t.lower())})
        plain_bpe = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback", "unk_token"))
        if plain_bpe and cut["type"] == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not model.get("end_of_word_suffix") and made["normalizer"] is None and _ranked(model):
            import tiktoken

            byte = {c: b for b, c in self.shown.items()}
            ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
            self.ranks = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        lowers = (made["normalizer"] or {}).get("normalizers") == LOWER_CASING
        self.words = plain_bpe and lowers and bool(splits) and splits[0]["type"] == "Split" and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and model.get("end_of_word_suffix") == "</w>"
        self.rule = regex.compile(splits[0]["pattern"]["Regex"]) if self.words else None
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        """Ids of what the splitting rule gives as one, by the tokenizer's model."""
        ids = self.known.get(part) or self.old.get(part)
        if ids is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.shown)
            ids = array("H" if self.dtype.itemsize == 2 else "I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        self.known[part] = ids
        return ids

    def _word_ids(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.lower().split() for t in texts]  # plain texts: Python's white space is ASCII's
        if len(self.known) > KEPT:
            self.old, self.known = self.known, {}
        known, old, findall, part = self.known, self.old, self.rule.findall, self._part
        for p in set().union(*split).difference(known):
            have = old.get(p)
            if have is None:
                if p.isalpha():
                    have = part(p)
                elif p[-1] in ".,;:!?" and p[:-1].isalpha():
                    have = part(p[:-1]) + part(p[-1])
                else:
                    have = b"".join(map(part, findall(p)))
            known[p] = have
        return [np.frombuffer(b"".join(map(known.__getitem__, p)), self.dtype) for p in split]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if PLAIN.fullmatch(t) and not any(x in t for x in self.added)] if self.ranks or self.words else []
        mine = [texts[i] for i in plain]
        for i, ids in zip(plain, ([np.array(self.ranks.encode_ordinary(t), self.dtype) for t in mine] if self.ranks else self._word_ids(mine))):
            out[i] = ids
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, self.dtype)
        return out


@functools.cache
def shared(path: str) -> Encoder:
    """One encoder for all tasks of a worker process: what it has learnt stays."""
    return Encoder(path)


def encoded(batches, path: str) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids) of Arrow batches with doc_id and text."""
    encoder = shared(path)
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            yield from zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist()))
