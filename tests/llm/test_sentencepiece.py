import hashlib
import random

import pytest

from barquality.llm import sentencepiece
from barquality.llm.queries import TOKENIZERS
from barquality.llm.sentencepiece import MARK, Model, digests, encode

FILE = f"{TOKENIZERS}/piece_bpe_32k.model"
spm = pytest.importorskip("sentencepiece")

EDGE = ["", " ", "a", "   a  b   c", "x" * 300, "日本語テキスト🎉 é", "\n\n\ttab\r\n", " " * 70 + "a", "a" * 33, "Hello world! https://a.b/c?d=e", "====----", "éé́", "\x00\x7f", "the" * 5000]


def texts():
    rng = random.Random(4)
    letters = "eeettaoinshrdlu éàñß.,\n-'XYZ日🎉"
    return EDGE + ["".join(rng.choices(letters, k=rng.randint(1, 400))) for _ in range(300)]


@pytest.fixture(scope="module")
def model():
    with open(FILE, "rb") as f:
        return Model(f.read())


def test_ids_are_those_of_the_library(model):
    library = spm.SentencePieceProcessor(model_file=FILE)
    cases = texts()
    assert model.encode(cases) == library.encode(cases)


def test_unigram_scores_give_the_librarys_best_path():
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    with open(FILE, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for i, piece in enumerate(proto.pieces):  # distinct scores, so the best path is the only one
        piece.score = -5 - (i * 7919 % 31991) / 3000
    data = proto.SerializeToString()
    library, model = spm.SentencePieceProcessor(model_proto=data), Model(data)
    cases = [t for t in texts() if t]
    score = lambda ids: round(sum(model.scores[i] for i in ids if model.pieces[i] in model.normal), 3)
    for mine, theirs in zip(model.encode(cases), library.encode(cases)):
        assert score(mine) == pytest.approx(score(theirs), abs=0.05)


def test_round_trip(model):
    for text in texts():
        assert model.decode(model.encode([text])[0]) == text


def test_words_of_all_lengths_advance_together_as_alone(model, monkeypatch):
    rng = random.Random(9)
    words = [MARK + "".join(rng.choices("theranising", k=n)) for n in [*range(1, 60), 300, 301, 4000]] + [MARK + "internationalisation"]
    together = dict(model.encode_words(words))
    monkeypatch.setattr(sentencepiece, "CELLS", 1)
    assert dict(model.encode_words(words)) == together and len(together) == len(set(words))


def test_small_caches_change_nothing(model, monkeypatch):
    cases = texts()
    want = model.encode(cases)
    model.forget()
    monkeypatch.setattr(sentencepiece, "CACHE_BYTES", 2000)
    assert [model.encode([t])[0] for t in cases] == want


def test_digests_are_those_of_the_librarys_ids(docs_of):
    library = spm.SentencePieceProcessor(model_file=FILE)
    cases = texts()
    for r in digests(docs_of(list(enumerate(cases))), FILE).collect():
        ids = library.encode(cases[r["doc_id"]])
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r["ids"], r["n_pieces"], r["ids_sha256"]) == (ids, len(ids), hashlib.sha256(data).hexdigest())
        assert (r["n_chars"], r["n_byte_pieces"]) == (len(cases[r["doc_id"]]), sum(library.is_byte(i) for i in ids))


def test_table(docs_of):
    docs = docs_of([(1, "the cat"), (1, "the cat"), (2, None), (None, ""), (3, f"a{MARK}b")])
    rows = digests(docs, FILE).collect()
    assert len(rows) == 5 and all(r["round_trip"] for r in rows)
    assert {r["n_pieces"] for r in rows if r["doc_id"] in (2, None)} == {0}
    out = {r["doc_id"]: r for r in encode(docs, FILE).collect()}
    assert out[1]["decoded"] == "the cat" and out[2]["ids"] == []
    assert digests(docs_of([]), FILE).count() == 0
