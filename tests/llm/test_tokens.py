"""The encoder's table of known chunks."""

import pyarrow as pa

from churnlab.llm import tokens
from churnlab.llm.packing import vocabulary


def test_known_chunks_cost_two_numbers_each_and_ids_are_those_of_the_vocabulary(monkeypatch):
    encoder = tokens.Encoder(*vocabulary())
    texts = [f" wort{i} rain{i * 7919 % 1000}\n" for i in range(3000)] + ["", None, "wort1 wort2"]
    column = pa.array(texts)
    first = [list(x) for _, x in encoder.encode(column)]
    assert first == [encoder._bpe.encode_ordinary(t or "") for t in texts]
    assert [list(x) for _, x in encoder.encode(column)] == first
    assert 3000 < len(encoder._known) == len(set(encoder._known.tolist()))
    assert encoder._known.nbytes + encoder._place.nbytes == 16 * len(encoder._known)
    monkeypatch.setattr(tokens, "MAX_CACHE", 10)  # forgets all before a block
    assert [list(x) for _, x in encoder.encode(column)] == first
