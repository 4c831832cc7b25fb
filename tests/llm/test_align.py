from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.data import frame, rows
from turnlake.llm import align
from turnlake.llm.align import align_documents, check_cuts, cuts
from turnlake.llm.queries import op12_segment_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NBSP, WIDE, OLD, EM = map(chr, (0xA0, 0x3000, 0x180E, 0x2003))
MORE = [
    "a lone end ", "  two before", "tab\t and\n lines \n\n  x", f"nbsp{NBSP} and{WIDE} wide {EM} {chr(0x85)} blanks {OLD} {OLD} x", "x▁y", "▁", "<s> </s> <unk> <|endoftext|>", "nul\0 byte", "z" * 3000, "漢字" * 200 + " 漢",
    " ", "   ", "\n", f"e{chr(0x301)} {chr(0x1F600)} {chr(0x1F468)}{chr(0x200D)}{chr(0x1F469)}", "don't we'll  've", "12 345 6,789.00", "(a) [b] {c}", f"{chr(0x200B)} zero{chr(0xFEFF)} width",
]


def brute(texts):
    """The contract by the libraries, whole texts at a time: one result each."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    tokens_a = align._encoder_a(A)[1].to_pylist()
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bx, by, raw = [tokens_a[i] for i in x], [piece(i) for i in y], (" " + (t or "")).encode()
        if b"".join(bx) != raw or b"".join(by) != raw:
            found.append(None)
            continue
        ends = [np.cumsum([*map(len, v)]) for v in (bx, by)]
        common = np.intersect1d(*ends)
        groups = [([], []) for _ in common]
        for side, ids in enumerate((x, y)):
            for i, e in zip(ids, ends[side], strict=True):
                groups[np.searchsorted(common, e)][side].append(i)
        found.append((len(x), len(y), groups, [(i, j) for g in groups for i in g[0] for j in g[1]]))
    count, best = Counter(p for f in found if f for p in set(f[3])), {}
    for (i, _), n in count.items():
        best[i] = max(n, best.get(i, 0))
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in f[2])
        out.append((f[0], f[1], len(f[2]), len(f[3]), sum(count[p] == best[p[0]] for p in f[3]), sum(count[p] for p in f[3]), text))
    return out


def _found(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in df.collect()), key=str)


def _data():
    return [*rows(), *((1_000 + i, t) for i, t in enumerate(MORE))]


@pytest.mark.parametrize("block", [400, align.BLOCK])
def test_against_the_libraries(spark, monkeypatch, block):
    monkeypatch.setattr(align, "BLOCK", block)
    docs = frame(spark, _data())
    given = docs.collect()
    want = sorted(((r.doc_id, *w) for r, w in zip(given, brute([r.text for r in given]), strict=True)), key=str)
    assert _found(align_documents(docs.repartition(3, "text"), A, B)) == want


def test_cuts():
    text = f"a b{NBSP} c  d\n e{EM} f{chr(0x2014)} g ".encode()
    data = np.frombuffer(text, np.uint8)
    at = cuts(data, np.array([0, len(data)]))
    assert [text[i:j].decode() for i, j in zip(at, [*at[1:], None], strict=True)] == ["a", f" b{NBSP} c", f"  d\n e{EM} f{chr(0x2014)}", " g", " "]


def test_vocabularies_that_could_cross(monkeypatch):
    check_cuts(A, B)
    own = align._encoder_b(B)
    monkeypatch.setattr(align, "_encoder_b", lambda path: (own[0], pa.array([b"of the"], pa.binary())))
    with pytest.raises(ValueError, match="crosses"):
        check_cuts(A, B)


def test_nothing(spark):
    assert align_documents(frame(spark, [], repeat=False), A, B).count() == 0
    out = align_documents(frame(spark, [(1, None), (2, "")], repeat=False), A, B).collect()
    assert sorted(r.doc_id for r in out) == [1, 2] and {(r.n_a, r.count_sum, r.groups) for r in out} == {(0, 0, "")}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *w[:6], sha256(w[6].encode()).hexdigest() if w[6] else "") for r, w in zip(docs, brute([r.text for r in docs]), strict=True)), key=str)
    out = op12_segment_alignment(spark, sf).withColumnRenamed("groups_sha256", "groups")
    assert _found(out) == want
