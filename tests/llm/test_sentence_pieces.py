import random

import pyarrow as pa
import pytest

from webkiln.llm import sentence_pieces

import public_tokenizers
import sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentence_pieces.PieceModel(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def awkward():
    rng = random.Random(11)
    parts = [" ", "  ", "▁", "\n", "\t", "a", "the", "The", "ü", "日本", "🙂", " ", "　", "ﬁ", "<s>", "</s>", "<unk>", "<0x41>", "\x00", ".", "x" * 40, "é", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    return [*texts, None, "", " ", "▁", "▁▁a", "  lead", "trail  ", "same words same words", "zq" * 3000, "ab " * 5000]


def twin(text):
    ids = LIBRARY.encode(text or "", add_eos=True)
    return ids, LIBRARY.decode(ids)


def encoded(docs, **how):
    out = sentence_pieces.decode_documents(sentence_pieces.encode_documents(docs, MODEL, **how), MODEL)
    return sorted(((r.doc_id, list(r.ids), r.decoded) for r in out.collect()), key=str)


@pytest.mark.parametrize("most_bytes", [128 << 20, 6000, 0])
def test_encoding_equals_the_library(spark, most_bytes):
    """All chunks broadcast; a part of them; none."""
    texts = awkward()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n long").repartition(3)
    expect = sorted(((i, *twin(t)) for i, t in enumerate(texts)), key=str)
    assert encoded(docs, most_bytes=most_bytes) == expect


@pytest.mark.parametrize("most_bytes", [128 << 20, 0])
def test_null_ids_and_repeated_rows(spark, odd_docs, empty_docs, most_bytes):
    assert encoded(odd_docs, most_bytes=most_bytes) == sorted(((r.doc_id, *twin(r.text)) for r in odd_docs.collect()), key=str)
    assert encoded(empty_docs, most_bytes=most_bytes) == []


def test_chunks_that_occur_once_stay_off_the_driver(spark):
    """Only repeated chunks are broadcast, the most frequent first, however much room there is."""
    texts = [*(f"only{i} here here" for i in range(50)), "twice and and twice", None]
    counts = sentence_pieces.count_chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), "text")
    frequent, complete = sentence_pieces.head_of(counts, MODEL, 128 << 20)
    assert complete
    assert [(r.chunk, r.n) for r in frequent.collect()] == [(" here", 100), (" and", 2), (" twice", 2)]
    head = sentence_pieces.Head(frequent, "<u2")
    data, begin, end, _ = sentence_pieces.chunks_of(pa.array([" and twice here only7"]))
    assert head.find(data, begin, end).tolist() == [1, 2, 0, -1]


def test_decoding_of_any_ids(spark):
    rng = random.Random(5)
    lists = [[rng.randrange(32000) for _ in range(rng.randint(0, 20))] for _ in range(200)] + [[], [2], [1, 5, 2], [0], [1, 29871, 35, 2], [228, 2], None]
    rows = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(lists)], "doc_id long, ids array<int>, decoded string")
    out = {r.doc_id: r.decoded for r in sentence_pieces.decode_documents(rows, MODEL).collect()}
    assert out == {i: LIBRARY.decode(x or []) for i, x in enumerate(lists)}


def test_other_models_are_refused(tmp_path):
    class Crossing:
        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "a▁b"

        def normalize(self, text):
            return text

    class Other(sentence_pieces.PieceModel):
        def load(self):
            return Crossing()

    with pytest.raises(ValueError, match="cross"):
        Other("x").check()
