"""Alignment of two tokenizers against sets of offsets, and corpus counts against a dictionary."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from sluicebox.llm import alignment
from sluicebox.llm.queries import QUERIES

from .conftest import TEXTS
from .test_texts import odd_texts

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
MORE = ["<s> </s> <unk> x", "\x00a", "a" * 3000, "▁a b▁", " x", "  x", "x ", "<0x41>", "ﬁne ½ Å", "<|endoftext|>"]


@pytest.fixture(scope="module")
def known():
    return alignment.load(*PATHS)


def brute(known, text):
    """(n_a, n_b, groups, pairs) by the vocabularies' own libraries and sets of offsets."""
    if not text:
        return 0, 0, "", []
    a, b = known.slow.encode(" " + text, add_special_tokens=False).ids, known.model.encode(text)
    parts_a, parts_b = known.a.tokens.take(pa.array(a)).to_pylist(), known.b.tokens.take(pa.array(b)).to_pylist()
    if b"".join(parts_a) != (" " + text).encode() or b"".join(parts_b) != (" " + text).encode():
        return 0, 0, "", []
    ends_a, ends_b = np.cumsum([len(x) for x in parts_a]).tolist(), np.cumsum([len(x) for x in parts_b]).tolist()
    groups, pairs, i, j = [], [], 0, 0
    place_a, place_b = ({end: k + 1 for k, end in enumerate(ends)} for ends in (ends_a, ends_b))
    for end in sorted(place_a.keys() & place_b.keys()):
        to_a, to_b = place_a[end], place_b[end]
        groups.append(",".join(map(str, a[i:to_a])) + "|" + ",".join(map(str, b[j:to_b])))
        pairs.append((a[to_a - 1], b[to_b - 1]))
        i, j = to_a, to_b
    return len(a), len(b), ";".join(groups), pairs


def digest(groups):
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""


def expected(known, rows):
    found = [(i, *brute(known, t)) for i, t in rows]
    counts = Counter(p for *_, pairs in found for p in pairs)
    most: dict = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return [
        (i or -1, na, nb, len(pairs), len(pairs), sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), digest(groups))
        for i, na, nb, groups, pairs in found
    ]


def plain(rows):
    return sorted((r.doc_id or -1, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows)


def test_fast_ids_equal_the_library(known, draw):
    for text in [*odd_texts(draw), *MORE]:
        assert known.ids_a(text).tolist() == known.slow.encode(" " + text, add_special_tokens=False).ids, repr(text)[:200]


def test_groups_equal_sets_of_offsets(known, draw):
    texts = [None, "", *odd_texts(draw), *MORE]
    for text, (n_a, n_b, n, found, pairs) in zip(texts, alignment.aligned(known, texts), strict=True):
        want = brute(known, text)
        assert (n_a, n_b, n, found) == (want[0], want[1], len(want[3]), digest(want[2]))
        assert [(p >> 32, p & 0xFFFFFFFF) for p in pairs.tolist()] == want[3]


def test_lockstep_of_ranges(draw):
    for width in (1, 3, 64):
        for _ in range(40):
            bounds = np.cumsum([draw.randrange(1, 60) for _ in range(draw.randrange(6))])
            inside = lambda: np.array(sorted({*bounds.tolist(), *(draw.randrange(1, int(bounds[-1]) + 1) for _ in range(60))}) if len(bounds) else [], np.int64)  # noqa: B023, E731
            a, b = inside(), inside()
            x, y = alignment.lockstep(a, b, bounds, width)
            assert a[x].tolist() == b[y].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_query_equals_brute_force(spark, known):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert plain(QUERIES["op13_alignment"](spark, SF).collect()) == sorted(expected(known, docs))


def test_counts_do_not_depend_on_blocks(spark, known, monkeypatch, draw):
    rows = [(i, " ".join(draw.choice("the cat sat on café mats 12".split()) for _ in range(draw.randrange(30)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(expected(known, rows))
    assert plain(alignment.align(docs, *PATHS).collect()) == want
    monkeypatch.setattr(alignment, "BLOCK", 200)
    monkeypatch.setattr(alignment, "PART", 50)
    assert plain(alignment.align(docs, *PATHS).collect()) == want


def test_odd_rows(odd, empty, known):
    assert plain(alignment.align(odd, *PATHS).collect()) == sorted(expected(known, TEXTS))
    assert alignment.align(empty, *PATHS).count() == 0
