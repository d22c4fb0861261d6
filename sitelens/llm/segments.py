"""Words encoded by two tokenizers, with the tokens of both cut into groups.

Both tokenizers end a token wherever a space stands between two characters that are no
white space: the byte-level one splits texts there before it merges bytes, the other has
no piece with a space after another character. So a text falls into segments that can be
encoded on their own, and a segment that comes up many times is encoded once.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Between these a token of either vocabulary ends.
_CUT = re.compile(r"(?<=\S) (?=\S)")
# Segments encoded in one call, and the characters from which one is encoded alone.
TOGETHER = 512
LONG = 1000
# Groups with more links than this are counted by distinct ids.
WIDE = 4096


class Segments(NamedTuple):
    """Per segment its numbers and text of groups; ``first[s]:first[s + 1]`` are its pairs
    (id of A times the size of vocabulary B, plus id of B) and how often each is linked."""

    valid: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]  # each group ends in ";"
    first: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes
    for themselves, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Coder:
    """The two tokenizers: A a byte-level BPE as JSON, B a sentencepiece model."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        own = byte_of_character()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, number in spec["model"]["vocab"].items():
            if all(c in own for c in token):
                self.a_bytes[number] = bytes(own[c] for c in token)
        self.b_bytes = [self._piece(i) for i in range(self.b.vocab_size())]
        self.size_a, self.size_b = len(self.a_bytes), len(self.b_bytes)
        self.length_a = np.array([len(t) for t in self.a_bytes])
        self.length_b = np.array([len(t) for t in self.b_bytes])
        names = [str(i) + sign for i in range(max(self.size_a, self.size_b)) for sign in ",|;"]
        self.names = pa.array(names, pa.large_string())
        splits = spec["pre_tokenizer"] or {}
        self.cut = (
            _CUT
            if spec["normalizer"] is None
            and (splits.get("type"), splits.get("add_prefix_space"), splits.get("use_regex", True))
            == ("ByteLevel", False, True)
            and not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.size_b))
            else re.compile("(?!)")
        )

    def _piece(self, number: int) -> bytes:
        if self.b.is_control(number) or self.b.is_unknown(number):
            return b""
        piece = self.b.id_to_piece(number)
        if self.b.is_byte(number):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def split(self, text: str) -> list[str]:
        """The segments of a text, each with a space before it that is not written."""
        return self.cut.split(text) if text else []

    def _encoded(self, texts: list[str]) -> list[tuple[list[int], list[int], bool]]:
        """Ids of A and B, and whether the bytes of both are those of space and text."""
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        ids_b = self.b.encode(texts, num_threads=1)
        out = []
        for text, a, b in zip(texts, ids_a, ids_b, strict=True):
            raw = (" " + text).encode()
            same = b"".join([self.a_bytes[i] for i in a]) == raw == b"".join([self.b_bytes[i] for i in b])
            # A token without bytes belongs to no group.
            out.append((a, b, same and all(self.b_bytes[i] for i in b) and all(self.a_bytes[i] for i in a)))
        return out

    def encode(self, segments: list[str]) -> Segments:
        """All about each segment, in order."""
        odd = [not s or len(s) > LONG or s[0].isspace() or s[-1].isspace() for s in segments]
        plain = [i for i, alone in enumerate(odd) if not alone]
        chunks = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
        chunks += [[i] for i, alone in enumerate(odd) if alone]
        order, flat_a, flat_b = [], [], []
        while chunks:
            again = []
            found = self._encoded([" ".join([segments[i] for i in chunk]) for chunk in chunks])
            for chunk, (a, b, same) in zip(chunks, found, strict=True):
                if same:
                    order += chunk
                    flat_a += a
                    flat_b += b
                elif len(chunk) > 1:
                    again += [[i] for i in chunk]
            chunks = again
        return self._grouped(segments, np.array(order, np.int64), np.array(flat_a, np.int64), np.array(flat_b, np.int64))

    def _grouped(self, segments, order, a, b) -> Segments:
        n = len(segments)
        ends = np.cumsum([len(segments[i].encode()) + 1 for i in order.tolist()], dtype=np.int64)
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        in_a = np.bincount(group_a, minlength=len(cuts))
        in_b = np.bincount(group_b, minlength=len(cuts))
        before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        owner = order[np.searchsorted(ends, cuts)]  # the segment of a group

        def per_segment(values) -> np.ndarray:
            out = np.zeros(n, np.int64)
            np.add.at(out, owner, values)
            return out

        valid = np.zeros(n, bool)
        valid[order] = True
        # Texts of groups: the ids of A, "|", the ids of B, ";".
        names = np.zeros(len(a) + len(b), np.int64)
        place_a = np.arange(len(a)) + before_b[group_a]
        place_b = np.arange(len(b)) + (before_a + in_a)[group_b]
        names[place_a] = a * 3
        names[place_b] = b * 3
        names[before_a + before_b + in_a - 1] += 1
        names[before_a + before_b + in_a + in_b - 1] += 2
        taken = self.names.take(pa.array(names))
        _, at, data = taken.buffers()
        at = np.frombuffer(at, np.int64)[: len(names) + 1]
        data = data.to_pybytes() if data is not None else b""
        n_a, n_b = per_segment(in_a), per_segment(in_b)
        upto = at[np.append(0, np.cumsum((n_a + n_b)[order]))]
        groups = [b""] * n
        for i, lo, hi in zip(order.tolist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True):
            groups[i] = data[lo:hi]
        first, pairs, times = self._pairs(n, owner, a, b, group_a, in_a, in_b, before_a, before_b)
        return Segments(
            valid, n_a, n_b, per_segment(np.ones(len(cuts), np.int64)), per_segment(in_a * in_b),
            groups, first, pairs, times,
        )

    def _pairs(self, n, owner, a, b, group_a, in_a, in_b, before_a, before_b) -> tuple[np.ndarray, ...]:
        """Distinct pairs of each segment with how often they are linked."""
        wide = in_a * in_b > WIDE
        copies = np.where(wide[group_a], 0, in_b[group_a])
        left = np.repeat(np.arange(len(a)), copies)
        right = np.arange(len(left)) - np.repeat(np.cumsum(copies) - copies, copies) + before_b[group_a[left]]
        size = self.size_a * self.size_b
        keys, times = np.unique(owner[group_a[left]] * size + a[left] * self.size_b + b[right], return_counts=True)
        if wide.any():
            more_keys, more_times = [keys], [times]
            for g in np.flatnonzero(wide).tolist():
                ids_a, times_a = np.unique(a[before_a[g] : before_a[g] + in_a[g]], return_counts=True)
                ids_b, times_b = np.unique(b[before_b[g] : before_b[g] + in_b[g]], return_counts=True)
                more_keys.append((owner[g] * size + ids_a[:, None] * self.size_b + ids_b).reshape(-1))
                more_times.append((times_a[:, None] * times_b).reshape(-1))
            keys, where = np.unique(np.concatenate(more_keys), return_inverse=True)
            times = np.zeros(len(keys), np.int64)
            np.add.at(times, where, np.concatenate(more_times))
        first = np.searchsorted(keys, np.arange(n + 1) * size)
        return first, keys % size, times


@lru_cache(1)
def coder(a_path: str, b_path: str) -> Coder:
    """The tokenizers of a worker process, loaded once."""
    return Coder(a_path, b_path)
