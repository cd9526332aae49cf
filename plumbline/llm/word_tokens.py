"""Token ids of whole texts, word by word, with the ids of words seen before kept in the worker."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable
from struct import pack

import tiktoken

from plumbline.llm.common import Recent, worker_cache

#: Words whose ids a worker keeps in each of two generations, about 200 bytes each; others are merged again.
KEPT_WORDS = 250_000
ENDINGS = b'.,;:!?"'
#: Words of letters below U+0180 that normalization leaves alone and lower-casing maps one to one.
letters = re.compile("[a-zA-ZÀ-ÖØ-öø-įı-ňŊ-ſ]+").fullmatch


def byte_signs() -> dict[int, str]:
    """The signs that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


SIGNS = byte_signs()


#: Ends a word in the merge table; no UTF-8 text holds this byte.
WORD_END = b"\xff"


def word_merges(path: str) -> Callable[[bytes], list[int]]:
    """Ids of one lower-case word by the file's merges.

    The library merges the pair whose union has the least id, so a file serves whose ids follow its merges; a single
    byte that ends a word comes before them all.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    suffix, byte_of = model["end_of_word_suffix"], {sign: bytes([b]) for b, sign in SIGNS.items()}
    ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if ids != sorted(ids):
        raise ValueError(f"the ids of {path} do not follow its merges")
    ranks: dict[bytes, int] = {}
    for token, ident in model["vocab"].items():
        stem = token.removesuffix(suffix)
        if stem and all(sign in byte_of for sign in stem):
            ranks[b"".join(byte_of[sign] for sign in stem) + WORD_END * (stem != token)] = ident
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def parted(word: bytes) -> tuple[bytes, bytes]:
    """A word's stem and the marks at its end, apart only where the tokenizer parts them as well."""
    stem = word.rstrip(ENDINGS)
    if stem.isascii():
        return (stem.lower(), word[len(stem):]) if stem[-1:].isalnum() else (word, b"")
    last = unicodedata.normalize("NFC", stem.decode()[-1]).lower()  # some letters come apart into a letter and a mark
    return (stem, word[len(stem):]) if last.isalpha() else (word, b"")


def word_ids(path: str) -> Callable[[str | None], bytes]:
    """Ids, as little-endian unsigned 32-bit integers, of a text under a tokenizer file.

    The file's tokenizer must drop white space, split letters from punctuation and lower-case, so that a text falls into pieces that are
    encoded independently: at ASCII white space, and between a letter or digit and the marks that end a word. Words of Latin letters go
    to the merge table as they are, others through the whole tokenizer. Strings of special tokens in a text are ordinary text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    state = worker_cache(f"words:{path}")
    if not state:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        merged = word_merges(path)

        def stem_ids(part: bytes) -> bytes:
            text = part.decode()
            ids = merged(text.lower().encode() + WORD_END) if letters(text) else tokenizer.encode(text, add_special_tokens=False).ids
            return pack(f"<{len(ids)}I", *ids)

        stems = Recent(KEPT_WORDS, stem_ids)

        def whole_ids(word: bytes) -> bytes:
            if word.isalpha():
                ids = merged(word.lower() + WORD_END)
                return pack(f"<{len(ids)}I", *ids)
            stem, marks = parted(word)
            return stems[stem] + stems[marks] if marks else stems[stem]

        state["words"] = Recent(KEPT_WORDS, whole_ids)
    look_up = state["words"].__getitem__

    def encode(text: str | None) -> bytes:
        return b"".join(map(look_up, (text or "").encode().split()))

    return encode
