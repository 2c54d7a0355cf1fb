"""What a task holds while it handles a batch of texts is bounded by the chunk, not by the batch."""
import tracemalloc

import pyarrow as pa

from labelforge.llm import chosen_path, tokens


def test_sketches_of_a_batch_stay_small():
    text = " ".join(f"w{i % 977}x{i % 31}" for i in range(400))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([text] * 3000)], names=["doc_id", "text"])
    tokens._POWERS[:] = [tokens.np.ones(1, tokens.np.uint64)] * 2  # as in a new worker
    tracemalloc.start()
    rows = sum(b.num_rows for b in chosen_path._sketched(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 3000 and batch.nbytes > 8 << 20
    assert peak < 48 << 20  # 84 MB with chunks of 2 MB
