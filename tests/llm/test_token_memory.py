"""What a worker of the token output holds at once."""

import pyarrow as pa

from orrery.llm import common, encoders, tokenfile


def test_gathered_batches_and_remembered_words_are_bounded():
    table = pa.record_batch({"doc_id": list(range(9000)), "text": [f"word{i} " * 400 for i in range(9000)]})
    got = list(tokenfile._gathered(common.pieces([table])))
    assert sum(b.num_rows for b in got) == 9000
    assert max(b.nbytes for b in got) <= tokenfile.GATHERED_BYTES + common.BATCH_BYTES * 1.1 <= 8 << 20
    assert encoders.MAX_WORDS * 190 <= 120_000_000
