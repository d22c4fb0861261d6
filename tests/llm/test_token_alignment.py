"""Alignment against whole texts encoded and counted in plain Python."""

import hashlib
from collections import Counter

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from sitelens.llm import segments
from sitelens.llm.queries import op12_token_alignment
from sitelens.llm.segments import Coder
from sitelens.llm.token_alignment import A_FILE, B_FILE, TOKENIZERS, Alignment, align, pack, unpack

PATHS = f"{TOKENIZERS}/{A_FILE}", f"{TOKENIZERS}/{B_FILE}"
ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", " a  b   c ", "tabs\there\n\nand  there \n", " x  y　z",
    "it's we'll I'D 'tis", "<s> </s> <unk> <0x41> <|endoftext|>", "a▁b", "▁", "good then b▁d again",
    "café café \U0001f600\U0001f600 漢字かな", "\x00 \x01\x7f \x85 ﻿ ​", "12345 3.14 1,000,000",
    "a" * 3000, "deadbeef01" * 400, " " * 2000 + "x", "x" + "\n" * 500, "\U000e0001", "ab" * 700 + " end",
    "word " * 50, "same words", "same words", "İstanbul ẞß ﬁ Å", "x \x1c y \x1f z",
]


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        self.own = segments.byte_of_character()

    def groups(self, text):
        """(ids of A, ids of B) of each group; nothing where the bytes differ."""
        if not text:
            return []
        raw = (" " + text).encode()
        found = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(self.own[c] for c in t)) for i, t in zip(found.ids, found.tokens, strict=True)]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        if b"".join(t for _, t in a) != raw or b"".join(t for _, t in b) != raw:
            return []
        ends = [set(np.cumsum([len(t) for _, t in side]).tolist()) for side in (a, b)]
        cuts, out = sorted(ends[0] & ends[1]), []
        for side in (0, 1):
            at, group, mine = 0, 0, [[] for _ in cuts]
            for i, t in (a, b)[side]:
                at += len(t)
                mine[group].append(i)
                group += at == cuts[group]
            out.append(mine)
        return list(zip(*out, strict=True))


def by_contract(rows):
    """Rows of the contract and the table of pairs."""
    plain = Plain()
    groups = [plain.groups(text) for _, text in rows]
    links = [Counter((a, b) for ga, gb in g for a in ga for b in gb) for g in groups]
    held = Counter(pair for doc in links for pair in doc)
    top = {}
    for (a, _), n in held.items():
        top[a] = max(n, top.get(a, 0))
    out = []
    for (doc_id, _), g, doc in zip(rows, groups, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append(
            (
                doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(doc.values()),
                sum(n for p, n in doc.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in doc.items()),
                hashlib.sha256(text.encode()).hexdigest() if g else "", text,
            )
        )
    return out, {(a, b): (n, n == top[a]) for (a, b), n in held.items()}


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def test_odd_texts(spark):
    rows = [*enumerate(ODD), (None, "no id"), (7, "the same id")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, part int, n_a int")
    want, pairs = by_contract(rows)
    assert sum(w[1] == 0 and bool(t) for w, (_, t) in zip(want, rows, strict=True)) >= 3  # of U+2581
    aligned = Alignment(docs.repartition(3), with_groups=True)
    assert ordered(aligned.documents().collect()) == ordered(want)
    found = {(r.a_id, r.b_id): (r.documents, r.best) for r in aligned.pairs().collect()}
    assert found == pairs


def test_parts_and_wide_groups(monkeypatch):
    """Segments one by one, small parts of a text and wide groups change nothing."""
    tools = Coder(*PATHS)
    texts = ["aaab " * 3 + "漢字" * 9 + "x" * 70, "plain words, and more", "b▁d"]
    whole = tools.encode(texts)
    for name, value in (("TOGETHER", 1), ("WIDE", 0), ("LONG", 2)):
        monkeypatch.setattr(segments, name, value)
        for one, other in zip(whole, tools.encode(texts), strict=True):
            assert list(one) == list(other)
    assert whole.valid.tolist() == [True, True, False]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align(docs).count() == 0
    nothing = align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    assert ordered(nothing.collect()) == [(i, 0, 0, 0, 0, 0, 0, "", "") for i in (1, 2)]


def test_frames_round_trip():
    arrays = [np.array([0, 1, 255]), np.zeros(0, np.int64), np.array([2**40, 5]), np.arange(70_000)]
    for one, other in zip(arrays, unpack(pack(*arrays)), strict=True):
        assert one.tolist() == other.tolist()


def test_query_keeps_its_contract(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = ordered(row[:-1] for row in by_contract(list(map(tuple, table.collect())))[0])
    got = op12_token_alignment(spark, sf_dir)
    assert got.columns == [
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    ]
    assert ordered(got.collect()) == want
    # Many parts, so that pairs meet in the merge.
    small = align(table, with_groups=False, part_chars=1 << 12)
    assert ordered(small.collect()) == want
