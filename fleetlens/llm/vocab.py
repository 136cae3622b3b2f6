"""Tokenizer files as executors use them: loaded once per worker process, never trained."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

#: Unicode white space, as both tokenizers' patterns see it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word with the white space before it. No merge and no pattern of either tokenizer reaches
#: over the border between a word's last character and white space.
CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+\\Z")


def share(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file's text on all executors; a vocabulary file has a few MB."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


@lru_cache(maxsize=4)
def load(text: str) -> Tokenizer:
    """The tokenizer, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_str(text)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=1)
def byte_pieces(text: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary; added tokens stand for their own text."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    tokenizer = load(text)
    added = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    pieces = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    return [added.get(i) or bytes(byte_of[c] for c in p) for i, p in enumerate(pieces)]

#: Words whose ids a worker process keeps; beyond, those of the last texts stay, which costs time only.
_KEPT_WORDS = 300_000
_WORD = re.compile(f"[^{_SPACE}]+")
_CONTROL = re.compile("[\x1c-\x1f]")


#: Marks without an apostrophe: between letters and these both tokenizers' patterns have a border.
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: Letters of Latin-1 are changed by no normal form and have one lower case, in Python as in Rust, which is
#: a letter (that of a dotted capital I is two characters, the second of which joins marks behind it).
_LATIN = re.compile("[\0-\xff]+")
#: Words that are encoded as one text.
_IN_A_TEXT = 512


@lru_cache(maxsize=1)
def _known(text: str) -> tuple[dict[str, bytes], dict[str, bytes]]:
    return {}, {}


@lru_cache(maxsize=4)
def _ends(text: str) -> np.ndarray:
    """Whether an id ends a run of letters, by id."""
    library = load(text)
    suffix = getattr(library.model, "end_of_word_suffix", None)
    pieces = (library.id_to_token(i) or "" for i in range(library.get_vocab_size()))
    return np.array([bool(suffix) and p.endswith(suffix) for p in pieces])


#: Normal forms that leave small Latin letters with one space between words as they are.
_IDLE = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "})


@lru_cache(maxsize=1)
def _for_plain(text: str) -> Tokenizer:
    """The tokenizer for words of small Latin letters: without its normal forms, a fifth of the time, if they
    are known to do nothing there."""
    library = Tokenizer.from_str(text)
    library.no_truncation()
    library.no_padding()
    forms = json.loads(text).get("normalizer") or {"normalizers": []}
    if all(form in _IDLE for form in forms.get("normalizers", [forms])):
        library.normalizer = None
    return library


def _encode_into(text: str, known: dict[str, bytes], words: list[str]) -> None:
    """Put the ids of words into ``known``. Words of small Latin letters have one end each, by which the ids
    of many words in one text are told apart."""
    library, ends = load(text), _ends(text)
    plain: list[str] = []
    rest: list[str] = []
    for word in words:
        small = word.islower() and word.isalpha() and (word.isascii() or _LATIN.fullmatch(word))
        (plain if small else rest).append(word)
    parts = [plain[at:at + _IN_A_TEXT] for at in range(0, len(plain), _IN_A_TEXT)]
    for at in range(0, len(parts), 8):
        some = parts[at:at + 8]
        texts = list(map(" ".join, some))
        for part, coded in zip(some, _for_plain(text).encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(coded.ids, np.uint32)
            cuts = (4 * np.flatnonzero(ends[ids]) + 4).tolist()
            if len(cuts) != len(part):
                rest += part
                continue
            raw, start = ids.tobytes(), 0
            for word, cut in zip(part, cuts):
                known[word], start = raw[start:cut], cut
    for at in range(0, len(rest), 4096):
        part = rest[at:at + 4096]
        for word, coded in zip(part, library.encode_batch_fast(part, add_special_tokens=False)):
            known[word] = array("I", coded.ids).tobytes()


def _split(text: str) -> list[str]:
    """The words of a text. ``str.split`` cuts at the same characters, and at four control
    characters that the tokenizers do not take for white space."""
    return _WORD.findall(text) if _CONTROL.search(text) else text.split()


def payloads(text: str, documents: list[str]) -> list[bytes]:
    """Ids of whole documents as little-endian 32-bit integers, for a vocabulary that drops
    white space and case: each distinct word is encoded once per worker while it is kept, and
    words that differ in the case of Latin letters or in the marks behind them share the work."""
    known, cores = _known(text)
    words = [_split(d) for d in documents]
    every = set().union(*words)
    fresh = list(every.difference(known))
    stems, marks = [], []
    for word in fresh:
        core = word.rstrip(_MARKS)
        if core.isalpha() and (core.isascii() or _LATIN.fullmatch(core)):
            stems.append(core.lower())
            marks.append(word[len(core):])
        else:
            stems.append(word)
            marks.append("")
    parts = set(stems).union(marks).difference(("",))
    _encode_into(text, cores, list(parts.difference(cores)))
    known.update(zip(fresh, [cores[s] + cores[m] if m else cores[s] for s, m in zip(stems, marks)]))
    found = [b"".join(map(known.__getitem__, own)) for own in words]
    for kept, used in ((known, every), (cores, parts)):
        if len(kept) > _KEPT_WORDS:
            last = {word: kept[word] for word in used}
            kept.clear()
            kept.update(last)
    return found
