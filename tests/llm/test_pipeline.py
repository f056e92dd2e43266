"""Each stage of the pipeline against a brute-force version, on a small real table and tricky rows."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from test_operators import BPE, WORD, lowered, spans, verdict
from tokenizers import Tokenizer

from sparkloom.llm import secrets


@pytest.fixture(scope="module", params=["sf", "odd"])
def stages(request, spark):
    folder = request.getfixturevalue(request.param)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), "test-stage")
        out.append(docs.collect())
    return out


def ids(rows):
    return sorted(((r.doc_id, r.text) for r in rows), key=repr)


def test_quality(stages):
    want = [r for r in stages[0] if verdict(r.text)]
    assert ids(stages[1]) == ids(want) and stages[1][0].__fields__ == stages[0][0].__fields__


def shingles(text):
    w = WORD.findall(lowered(text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(stages):
    rows = stages[1]
    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (rows[a].text or "") == (rows[b].text or "") or (both and both >= 0.8 * len(sets[a] | sets[b])):
                root[max(find(a), find(b))] = min(find(a), find(b))
    first = {}
    for k, r in enumerate(rows):
        x = find(k)
        if x not in first or (r.doc_id is not None and (first[x] is None or r.doc_id < first[x])):
            first[x] = r.doc_id
    assert len(stages[2]) == len(first)
    assert sorted(i for i in {r.doc_id for r in stages[2]} if i is not None) == sorted(i for i in first.values() if i is not None)


def test_repeated_strings(stages):
    texts = {r.doc_id: r.text or "" for r in stages[2]}
    raw = {i: t.encode() for i, t in texts.items()}
    starts = Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    for r in stages[3]:
        b, gone = raw[r.doc_id], bytearray(len(raw[r.doc_id]))
        for k in range(len(b) - 199):
            if starts[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        at, kept = 0, ""
        for c in texts[r.doc_id]:
            size = len(c.encode())
            if not all(gone[at : at + size]):
                kept += c
            at += size
        assert (r.text or "") == kept and r.n_chars == (None if r.text is None else len(r.text))


def test_secrets(stages):
    before = {r.doc_id: r.text for r in stages[3]}
    for r in stages[4]:
        left = spans(r.text)
        assert left[:3] == (0, 0, 0)
        if not spans(before[r.doc_id])[4]:
            assert r.text == before[r.doc_id]
        else:
            assert secrets.REDACTED in r.text
    assert len(stages[4]) == len(stages[3])


def test_packing(stages):
    """Every token of every text is in one piece, and no sequence holds more than the limits."""
    t = Tokenizer.from_file(BPE)
    want = Counter()
    for r in stages[4]:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[r.doc_id, len(ids), np.array(ids, "<u4").tobytes()] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in stages[5]:
        pieces[p.doc_id, p.doc_tokens].append(p)
        sequences[p.sequence_id].append(p)
    for (doc, n, packed), times in want.items():
        own = pieces[doc, n]
        assert sum(p.length for p in own) == n * sum(c for (d, m, _), c in want.items() if (d, m) == (doc, n))
        if times == 1 and sum((d, m) == (doc, n) for d, m, _ in want) == 1:
            at = 0
            for p in sorted(own, key=lambda p: p.start):
                assert p.start == at and p.ids_crc32 == zlib.crc32(packed[4 * at : 4 * (at + p.length)])
                at += p.length
            assert at == n
    assert set(pieces) == {k[:2] for k in want}
    for s in sequences.values():
        assert len(s) <= 16 and [p.offset for p in sorted(s, key=lambda p: p.offset)] == [sum(q.length for q in s if q.offset < p.offset) for p in sorted(s, key=lambda p: p.offset)]
        assert sum(p.length for p in s) <= 1024


def test_empty_table(spark, empty):
    """No stage needs a row."""
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_no_stage_swallows_imports():
    assert not re.search(r"except\s+(ImportError|ModuleNotFoundError)", open(corpus_pipeline.__file__).read())
