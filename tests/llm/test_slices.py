"""What a task's Python code holds follows a small slice of its batch."""
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from starloom.llm import decontamination as D, near_dup as N
from starloom.llm.common import batches


def _peak(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def _batch() -> pa.RecordBatch:
    r = random.Random(5)
    words = [f"{x:x}" for x in range(4000, 9000)]
    texts = [" ".join(r.choices(words, k=400)) for _ in range(1500)]
    return pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(texts)], names=["doc_id", "text"])


def test_a_task_holds_little_of_a_batch():
    batch, cfg, near = _batch(), D.Settings(), N.Settings()
    items = [(i, t) for i, t in enumerate(" ".join(batch.column(1)[i].as_py().split()[:30]) + "? yes it is so" for i in range(200))]
    df = {}
    for _, t in items:
        for w in set(D.words_of(t)):
            df[w] = df.get(w, 0) + 1
    index = D.Index.build(items, df, len(items), 30.0, cfg)
    weights = N.Weights(np.ones((N.SKETCH_ROWS, N.SKETCH)))

    def search():
        for b in batches([batch], D.STEP_BYTES):
            D.search_texts(index, b.column(1).to_pylist(), cfg)

    def sign():
        for b in batches([batch], N.STEP_BYTES):
            docs = [N.words_of(t) for t in b.column(1).to_pylist()]
            d, h, tf = N.shingles(docs, near.shingle)
            N.signatures(d, h, weights(h, tf), len(docs))

    peaks = _peak(search), _peak(sign)
    assert peaks[0] < 45 and peaks[1] < 45
