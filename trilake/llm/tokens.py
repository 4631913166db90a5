"""Token ids of whole texts by the files of public tokenizers."""

from __future__ import annotations

import json
import os
import re

import numpy as np

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
#: Characters that all versions of Unicode class alike: Latin and general punctuation.
PLAIN = re.compile("[\x00-ɏ‐-‧‰-⁞]*")


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file; a path stays as it is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """Which byte a character of a byte-level vocabulary stands for: printable ones for
    themselves, those from U+0100 up for the others in their order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Ids of texts by a byte-level vocabulary in JSON; the same as `tokenizers` gives.

    Where ids follow the order of the merges, the vocabulary also drives `tiktoken`, which
    needs a third of the time; texts with characters beyond ``PLAIN`` go to `tokenizers`,
    as the two may know different versions of Unicode. With `special`, strings of special
    tokens become their ids, else they are plain text. It is loaded where it is first
    called, so that it travels to the workers without its vocabulary.
    """

    def __init__(self, name: str = BYTE_BPE, special: bool = True):
        self.name, self.special, self.slow, self.fast, self.table = name, special, None, None, []

    def load(self) -> ByteBpe:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        file = tokenizer_file(self.name)
        self.slow = Tokenizer.from_file(file)
        self.slow.encode_special_tokens = not self.special
        with open(file, encoding="utf-8") as opened:
            read = json.load(opened)
        entries = read["model"]["vocab"]
        added = {t["content"]: t["id"] for t in read["added_tokens"]}
        byte = byte_alphabet()
        ranks = {bytes(byte[c] for c in entry): at for entry, at in entries.items() if entry not in added}
        self.table = [b""] * (1 + max(*entries.values(), *added.values()))
        for raw, at in [*ranks.items(), *((t.encode(), at) for t, at in added.items())]:
            self.table[at] = raw
        merged = (m if isinstance(m, list) else m.split(" ") for m in read["model"]["merges"])
        if all(entries["".join(m)] == 256 + i for i, m in enumerate(merged)):
            self.fast = tiktoken.Encoding(
                self.name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added if self.special else {}
            )
        return self

    def __call__(self, text: str) -> np.ndarray:
        if self.slow is None:
            self.load()
        if self.fast and PLAIN.fullmatch(text):
            return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


class Pieces:
    """Ids of texts by a piece vocabulary, which adds a space before each text."""

    def __init__(self, name: str = PIECE_BPE):
        import sentencepiece

        self.made = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(name))
        self.table = [self.piece_bytes(i) for i in range(self.made.get_piece_size())]

    def piece_bytes(self, at: int) -> bytes:
        """U+2581 is a space, <0xHH> the byte HH."""
        piece = self.made.id_to_piece(at)
        return bytes([int(piece[3:5], 16)]) if self.made.is_byte(at) else piece.replace("▁", " ").encode()

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self.made.encode(text, num_threads=1), np.uint32)
