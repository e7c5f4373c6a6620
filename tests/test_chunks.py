"""Chunks of a whole table against a plain splitter, by words and by a model's subwords."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillgraph.operators import chunk
from quillgraph.plans import queries
from tests.test_commands import plain_split

DATA = "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_chunks_of_all_documents(spark):
    found = {r.id: r.text for r in chunk.chunks(queries.chunk_rows(spark, DATA)).collect()}
    want = {f"{r.doc_id}-en-{i}": t for r in queries.documents(spark, DATA).collect() if r.text.strip() for i, t in enumerate(plain_split(r.text, 510, 50))}
    assert found == want and len(want) > 1000


@pytest.mark.parametrize("size", [128])
def test_chunks_by_subwords(spark, size):
    docs = queries.chunk_rows(spark, DATA).where("doc_id % 5 = 0")  # a part, to keep the test short
    library = Tokenizer.from_file(VOCABULARY)
    length = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    found = chunk.chunks(docs, size, 16, length=chunk.Subwords(VOCABULARY)).collect()
    words = lambda t: set(t.split())
    texts = {r.doc_id: r.text for r in queries.documents(spark, DATA).collect()}
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r.text)
        # pieces are measured one by one: this vocabulary gives a text no more than its words
        assert length(r.text) <= size and r.text in texts[r.doc_id]
    assert all(set().union(*map(words, t)) == words(texts[i]) for i, t in by_doc.items())
    assert len(found) > len(by_doc)
