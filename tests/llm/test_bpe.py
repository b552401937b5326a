import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from cairn.llm.bpe import ByteBPE, decode_documents, encode_documents

from .cases import COLUMNS, HARD, edge_docs, edge_rows, empty_docs, hard_rows

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_tiktoken(reference):
    rng = random.Random(2)
    bpe = ByteBPE.read(PATH, public_tokenizers.PATTERN)
    texts = ["".join(rng.choice(" abcdefghij\n\t  'é漢🙂1234567890.,!?") for _ in range(rng.randint(0, 400))) for _ in range(200)]
    texts += ["".join(rng.choice(letters) for _ in range(n)) for n in (70, 300, 5000) for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "漢字仮名交文", "=-", "a")]
    texts += ["x" * 200_000, "漢字" * 40_000, "".join(rng.choice("etaoinshrdlu") for _ in range(60_000))]
    texts += ["", "a" * 3000, "<|endoftext|>", "  x", "ab" * 700] + [r[1] or "" for r in edge_rows()]
    for text, ids in zip(texts, bpe.encode(texts), strict=True):
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == reference.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


@pytest.mark.parametrize("rows,schema", [(edge_rows(), COLUMNS), (hard_rows(), HARD)])
def test_documents_digests(spark, reference, rows, schema):
    """Whole texts against the library, by digests."""
    got = encode_documents(spark.createDataFrame(rows, schema).select("doc_id", "text"), PATH, public_tokenizers.PATTERN, digests=True).collect()
    want = []
    for i, t, *_ in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_documents_round_trip(spark):
    made = encode_documents(edge_docs(spark), PATH, public_tokenizers.PATTERN)
    back = decode_documents(made, PATH, public_tokenizers.PATTERN).collect()
    want = {r[0]: r[1] or "" for r in edge_rows()}
    assert len(back) == len(edge_rows()) and all(r.text == want[r.doc_id] and r.id == "clash" for r in back)
    assert encode_documents(empty_docs(spark), PATH, public_tokenizers.PATTERN).count() == 0
