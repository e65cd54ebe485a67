import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cadastre.llm.words import Words, blocks, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab Aé\n\t\x0b 日", max_size=30)), max_size=8))
def test_words_and_shingles_are_those_of_the_pattern(texts):
    w = Words(pa.array(texts, pa.string()))
    want = [WORD.findall(t or "") for t in texts]
    assert w.count.tolist() == [len(x) for x in want]
    spans = [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)]
    assert spans == [x for t in want for x in t]
    names = {}
    for h, s in zip(w.hashes().tolist(), spans):
        assert names.setdefault(s, h) == h
    assert len(set(names.values())) == len(names)
    sets = shingle_sets(w, 4)
    for got, t in zip(sets, texts):
        x = WORD.findall((t or "").translate(LOWER))
        n = len({tuple(x[i : i + 4]) for i in range(len(x) - 3)}) if len(x) >= 4 else int(bool(x))
        assert len(got) == n and (np.diff(got.astype(object)) > 0).all()


def test_blocks_hold_every_row_once():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (5, 100, 3, 0, 7)] + [None]})
    parts = list(blocks(batch, "text", 10))
    assert sum((p.column(0).to_pylist() for p in parts), []) == batch.column(0).to_pylist()
    assert all(p.num_rows for p in parts)
