"""Encoding whole texts with a public byte-level BPE file inside a task."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

#: The pattern of the byte-level BPE family, without its look-ahead; see encoder().
PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""
#: The characters of Unicode's White_Space property.
SPACE = r"\t-\r \x85\xa0  -     　"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def ranks_of(vocab: dict[str, int]) -> dict[bytes, int]:
    letters = byte_letters()
    return {bytes(letters[x] for x in piece): rank for piece, rank in vocab.items()}


def encoder(path: str) -> Callable[[str], list[int]]:
    """text -> ids of a byte-level BPE tokenizers file, as the library gives them without adding special tokens.

    Strings of added tokens become those tokens: a text is cut at them first, the leftmost and longest ones.
    The merges run in tiktoken, which is several times faster and gives the same ids where the merges' order is
    that of the ids, as is checked here; else the tokenizers library does the work. The look-ahead of the
    family's pattern only keeps the last of several spaces for the next word, so cutting a text before that
    character, where spaces meet at all, leaves a pattern that a finite automaton matches.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
    plain = not any(x.get(k) for x in spec.get("added_tokens", ()) for k in ("lstrip", "rstrip", "single_word"))
    vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in added}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if not plain or spec.get("normalizer") or merged != sorted(merged) or max(vocab.values()) >= len(vocab):
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        return lambda text: slow.encode(text, add_special_tokens=False).ids

    import tiktoken

    fast = tiktoken.Encoding("fast", pat_str=PLAIN, mergeable_ranks=ranks_of(vocab), special_tokens={}).encode_ordinary
    several = re.compile(f"[{SPACE}]+(?=[{SPACE}][^{SPACE}])|[{SPACE}]{{2,}}\\Z")
    others = [c for c in map(chr, range(0x3001)) if c != " " and re.match(f"[{SPACE}]", c)]

    cut_at = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None

    def encode(text: str) -> list[int]:
        if cut_at and any(x in text for x in added):
            ids = []
            for part in cut_at(text):
                ids += [added[part]] if part in added else between(part)
            return ids
        return between(text)

    def between(text: str) -> list[int]:
        blank = text
        for c in others:
            if c in text:
                blank = blank.replace(c, " ")
        if "  " not in blank:
            return fast(text)
        ids, at = [], 0
        for m in several.finditer(text):
            ids += fast(text[at : m.start()]) + fast(m[0])
            at = m.end()
        return ids + fast(text[at:])

    return encode
