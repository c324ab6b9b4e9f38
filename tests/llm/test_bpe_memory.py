import pyarrow as pa

from mentionlake.llm import bpe


class Value:
    def __init__(self, value):
        self.value = value


def test_texts_are_encoded_a_megabyte_at_a_time(monkeypatch):
    """Before, three megabytes were encoded at once, which took a worker 75 MB more."""
    with open(bpe.public_vocabulary(), encoding="utf-8") as f:
        spec = f.read()
    texts = [f"{k} words and more words, " * 800 for k in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], names=["doc_id", "text"])
    seen, run = [], bpe.Bpe.run
    monkeypatch.setattr(bpe.Bpe, "run", lambda self, t: seen.append(sum(map(len, t.to_pylist()))) or run(self, t))
    out = [r for b in bpe._encode(Value(spec))(iter([batch])) for r in b.to_pylist()]
    assert [r["doc_id"] for r in out] == list(range(200)) and [r["decoded"] for r in out] == texts
    assert max(seen) <= 1_100_000 and sum(seen) == sum(map(len, texts))
