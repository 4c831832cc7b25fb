import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.data import frame, rows
from pyspark.sql import functions as F

from turnlake.llm import anchors, debruijn, jaccard, suffixes
from turnlake.llm.anchors import placed, repeated_anchors
from turnlake.llm.bpe import Encoder, vocabulary
from turnlake.llm.codec import Codec
from turnlake.llm.common import Scratch, stored
from turnlake.llm.components import components
from turnlake.llm.debruijn import substring_dedup, without_repeats
from turnlake.llm.jaccard import jaccard_classes
from turnlake.llm.suffixes import Run, front_coded, merged, suffix_dedup
from turnlake.llm.transducer import Transducer, compile_words

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(params=["one part", "many parts"])
def parts(request, monkeypatch):
    if request.param == "many parts":
        monkeypatch.setattr(anchors, "PART_BYTES", 4_000)
        monkeypatch.setattr(suffixes, "HOT_ANCHOR", 3)
        monkeypatch.setattr(jaccard, "PART_BYTES", 4_000)
        monkeypatch.setattr(jaccard, "TILE", 2)
        monkeypatch.setattr(jaccard, "MEETING", 2)


def by_id(df):
    out = {}
    for r in df.collect():
        assert r.doc_id not in out or out[r.doc_id] == r  # a repeated row has an equal result
        out[r.doc_id] = r
    return out


def check_words(spark, data, width):
    found, seen = by_id(substring_dedup(frame(spark, data), width)), set()
    for i, text in data:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            key = tuple(w[a : a + width])
            if key in seen:
                gone[a : a + width] = [True] * width
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (found[i].n_words, found[i].n_removed, found[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()), i
    assert found[None].n_removed == 0 and len(found) == len(data) + 1


def check_bytes(spark, data, width):
    found, seen = by_id(suffix_dedup(frame(spark, data), width)), set()
    for i, text in data:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - width + 1):
            if b[a : a + width] in seen:
                gone[a : a + width] = b"\1" * width
            seen.add(b[a : a + width])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans, found[i].kept_sha256) == (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()), i
    assert found[None].n_removed == 0


def test_substring_dedup(spark, parts):
    check_words(spark, rows(), 20)


def test_suffix_dedup(spark, parts):
    check_bytes(spark, rows(), 100)


@pytest.mark.parametrize("width", [3, 150])
def test_substring_widths(spark, width):
    check_words(spark, rows(3), width)


@pytest.mark.parametrize("width", [20, 300, 400])
def test_suffix_widths(spark, width):
    check_bytes(spark, rows(4), width)


def test_a_string_in_every_place(spark):
    """One line 10^5 times, in long texts beyond a block of bytes, and alone."""
    line = "one line of the kind that stands at the foot of every page, with no end to it at all, again and again and again. "
    data = [(i, line * (20_000 if i == 1 else 3_000) + f"own words {i}") for i in range(28)] + [(99, line.strip()), (100, "x" * 300_000)]
    out = by_id(substring_dedup(spark.createDataFrame(data, "doc_id long, text string")))
    n = len(line.split())
    assert [out[i].n_words - out[i].n_removed for i in range(28)] == [n + 3, *[1] * 27] and out[99].n_removed == n
    out = by_id(suffix_dedup(spark.createDataFrame(data, "doc_id long, text string")))
    own = lambda i: out[i].n_bytes - out[i].n_removed
    assert [own(i) for i in (0, 1, 99, 100)] == [len(line) + len("wn words 0"), 1, 0, 1]  # the line begins with an o as well


def test_chains_are_compacted_over_anchors(spark):
    rng = np.random.default_rng(11)
    passage = " ".join(f"p{i}" for i in range(600))
    data = [(i, f"{' '.join(f'q{x}' for x in rng.integers(0, 10**6, 40))} {passage} {' '.join(f'r{x}' for x in rng.integers(0, 10**6, 40))}") for i in range(6)]
    docs = placed(spark.createDataFrame(data, "doc_id long, text string"), 3)
    marks = repeated_anchors(docs, debruijn._find(20), 1 << 20)
    paths = stored(docs.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(debruijn._paths(20), debruijn._PATHS), "paths")
    found = debruijn.chains(paths, Scratch(spark))[0].collect()
    assert [(r.doc, r.first, r.length) for r in found] == [(0, 40, 581)]  # one chain for all of the passage
    spans = debruijn.repeated_ranges(docs, 3, 20).collect()
    digest = hashlib.sha256(passage.encode()).digest()
    assert sorted((r.doc, r.first, r.last, bytes(r.digest)) for r in spans) == [(i, 40, 640, digest) for i in range(1, 6)]


def test_spans_that_differ_from_their_source_stay(spark):
    import pyarrow as pa

    docs = pa.table({"doc_id": [1], "text": ["a b c d e"]})
    for text, kept in (("b c d", "a e"), ("b c x", "a b c d e")):
        ranges = pa.table({"doc": [1], "first": [1], "last": [4], "digest": pa.array([hashlib.sha256(text.encode()).digest()], pa.binary())})
        assert debruijn._result(True)(docs, ranges).column("kept").to_pylist() == [kept]


def classes(data, k, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, text in data:
        w = WORD.findall((text or "").translate(lower))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_jaccard_classes(spark, parts, k, percent):
    found = by_id(jaccard_classes(frame(spark), k, percent))
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items() if i is not None} == classes(rows(), k, percent)
    assert found[None].component_id is None


@pytest.mark.parametrize("tile", [1, 2, 3, 40, 4_000])
def test_jaccard_counts_every_link(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)] * 3  # near copies in one class, some pairs of which aren't links
    for _ in range(30):
        w = list(base)
        for at in rng.integers(0, 60, rng.integers(1, 3)):
            w[at] = f"x{rng.integers(0, 9)}"
        texts.append(" ".join(w))
    data = [*enumerate([*texts, texts[5], "alone in the world", "", None]), (5, texts[5])]
    sets = {i: {tuple(w[a : a + 4]) for w in [(t or "").split()] for a in range(len(w) - 3)} for i, t in data}
    links = {i: sum(i != j and len(x) > 0 and 100 * len(x & y) >= 80 * len(x | y) for j, y in sets.items()) for i, x in sets.items()}
    found = by_id(jaccard_classes(spark.createDataFrame(data, "doc_id long, text string"), 4, 80))
    assert {i: r.n_links for i, r in found.items()} == links
    assert 33 < sum(links.values()) < 34 * 33  # more than a spanning tree, fewer than all pairs


def test_jaccard_copies_meet_once(spark):
    """Pairs and texts of copies don't grow with the square of their number."""
    texts = [" ".join(f"t{t}w{i}" for i in range(30)) for t in range(5)]
    df = spark.createDataFrame([(10 * c + t, text) for c in range(60) for t, text in enumerate(texts)] + [(3000, texts[0] + " end")], "doc_id long, text string")
    met = jaccard.meetings(df, 4, 85, 3, np.zeros(0, np.uint64)).filter("kind = 0").collect()
    assert sum(len(anchors.unpacked(r.blob)[0]) for r in met) <= 20  # of one near copy, in 3 buckets; 60 * 59 / 2 * 5 pairs before
    found = by_id(jaccard_classes(df, 4, 85))
    assert {i: (r.component_id, r.n_links) for i, r in found.items()} == {10 * c + t: (t, 59 + (t == 0)) for c in range(60) for t in range(5)} | {3000: (0, 60)}


def test_jaccard_id_with_two_texts_joins_their_classes(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    found = by_id(jaccard_classes(spark.createDataFrame([(7, one), (7, two), (8, one), (9, two), (9, two), (5, two + " end"), (None, one)], "doc_id long, text string").distinct(), 4, 85))
    assert {i: (r.component_id, r.n_links) for i, r in found.items()} == {7: (5, 3), 8: (5, 1), 9: (5, 2), 5: (5, 2), None: (None, None)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3), (200, 90)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 90, 90: 90}


def test_loser_tree_order_and_prefixes():
    rng = np.random.default_rng(2)
    everything, runs = [], []
    for _ in range(9):
        own = sorted({bytes(rng.integers(97, 99, rng.integers(1, 12)).astype(np.uint8)) for _ in range(rng.integers(0, 40))})
        shared, rest = front_coded(own)
        n = len(own)
        runs.append(Run(anchors.packed([shared, rest, [b""] * n, np.zeros(n, np.int64), np.zeros(n, np.int64), [b""] * n])))
        everything += own
    out, before = [], b""
    for run, shared in merged(runs):
        common = next((i for i, (x, y) in enumerate(zip(before, run.suffix, strict=False)) if x != y), min(len(before), len(run.suffix)))
        assert not out or shared == common
        before = run.suffix
        out.append(before)
    assert out == sorted(everything)


def test_codec_equals_the_library(spark, library):
    docs = frame(spark)
    codec = Codec(docs, PATH, share=0.002)  # a small lexicon: most pieces are merged
    found = by_id(codec.digests(docs))
    for i, text in rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = found[i]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), i
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert by_id(codec.decode(codec.encode(docs)))[1].text == dict(rows())[1]


def test_merges_equal_the_library(library):
    rng = np.random.default_rng(7)
    pieces = {bytes(rng.choice(list(b"abcdeinorst "), rng.integers(1, 90)).astype(np.uint8)).replace(b" ", b"") or b"a" for _ in range(3_000)}
    pieces = sorted(pieces)
    ids, counts = vocabulary(PATH).merge(pieces)
    at = np.concatenate([[0], np.cumsum(counts)])
    for i, p in enumerate(pieces):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(p.decode(), add_special_tokens=False).ids


def test_transducer():
    words = sorted({f"{a}{b}".encode() for a in ("walk", "talk", "jump", "") for b in ("", "s", "ed", "ing")} - {b""})
    counts = np.arange(len(words)) % 3 + 1
    ids = np.arange(counts.sum())
    t = Transducer.mapped(compile_words(words, ids, counts))
    assert t.ranks([*words, b"wal", b"walke", b"zz", b""]).tolist() == [*range(len(words)), -1, -1, -1, -1]
    assert len(t.accepts) < 20  # suffixes are shared: a trie would have 60 states
    got, n = t.encode([words[2], b"new"], lambda w: (np.array([9, 9], np.uint16), np.array([2])))
    assert n.tolist() == [counts[2], 2] and got.tolist() == [*ids[counts[:2].sum() : counts[:3].sum()], 9, 9]


def test_known_pieces_are_dropped_without_change(monkeypatch):
    from turnlake.llm import bpe

    monkeypatch.setattr(bpe, "KEEP_PIECES", 10)
    encoder, data = Encoder(vocabulary(PATH)), np.frombuffer(b"one two three four five six", np.uint8)
    assert encoder.encode(data, np.array([0, 7, 27]))[0].tolist() == Encoder(vocabulary(PATH)).encode(data, np.array([0, 7, 27]))[0].tolist()


def test_pipeline_form_keeps_columns(spark):
    docs = frame(spark, repeat=False).withColumns({"carried": F.lit(1), "cut": F.lit("c"), "n_chars": F.length("text"), "doc": F.array(F.lit(2))})
    out = without_repeats(docs)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema] and out.count() == docs.count()
    before = {r.doc_id: r for r in docs.collect()}
    cut = [r for r in out.collect() if r.text != before[r.doc_id].text]
    assert cut and all(r.n_chars == len(r.text) and (r.part, r.bucket, r.cut, r.doc, r.lang) == (7, "b", "c", [2], None) for r in cut)


def test_empty_tables(spark):
    empty = frame(spark, [], repeat=False)
    for df in (substring_dedup(empty), suffix_dedup(empty), jaccard_classes(empty), Codec(empty, PATH).digests(empty)):
        assert df.count() == 0
