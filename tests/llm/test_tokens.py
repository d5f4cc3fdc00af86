"""Token operators against the libraries they stand for."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from casewell.llm import bpe, common, plane_files, token_counts

R = random.Random(4)
SIGNS = "ab  \n\t\x0b\x1c 　'sté1２#中🙂́ <|>▁ﬁ\x85 \r\x00"
TEXTS = [None, "", " ", "  ", "a <|endoftext|> b", "<s> x </s>", "ab" * 400 + " " * 300, "the cat's hat\nthe  end "] + [
    "".join(R.choice(SIGNS) for _ in range(R.randint(0, 50))) for _ in range(250)]


def table(spark):
    rows = [(k, t, 1) for k, t in enumerate(TEXTS)] + [(3, "twice", 1), (3, "twice", 1), (None, "no id", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)


def test_bpe_equals_tiktoken(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows, docs = table(spark)
    got = bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    want = []
    for i, t, _ in rows:
        ids = np.array(library.encode_ordinary(t or ""), dtype="<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got))) == sorted(map(str, want))
    assert bpe.encode_decode(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []


def test_plane_files_round_trip(spark, tmp_path):
    spec = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows, docs = table(spark)
    path = f"file://{tmp_path}/t"
    plane_files.write_tokens(docs, spec, path, block_ids=64)
    got = sorted((tuple(r) for r in plane_files.read_tokens(spark, path).collect()), key=lambda r: r[1])
    ids = [np.frombuffer(r[4], dtype="<u4").tolist() for r in got]
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    assert [r[1] for r in got] == [sum(len(x) for x in ids[:k]) for k in range(len(ids))]
    assert all(zlib.crc32(r[4]) == r[3] and len(x) == r[2] for r, x in zip(got, ids))
    want = [(i, library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, _ in rows]
    assert sorted(map(str, zip([r[0] for r in got], ids))) == sorted(map(str, want))
    plane_files.write_tokens(docs.limit(0), spec, path)
    assert plane_files.read_tokens(spark, path).collect() == []


def test_counts_equal_sentencepiece(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows, docs = table(spark)
    got = sorted(map(str, (tuple(r) for r in token_counts.count_tokens(docs, P.path("piece_bpe_32k.model"), over=20).collect())))
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 20) for i, t, _ in rows]
    assert got == sorted(map(str, want))
    assert token_counts.count_tokens(docs.limit(0), P.path("piece_bpe_32k.model")).collect() == []


def test_memory_of_pieces_is_bounded_in_bytes(monkeypatch):
    """Texts without spaces and floods of short pieces: results stay right, what a worker keeps stays within the bound."""
    monkeypatch.setattr(common, "CACHE_BYTES", 1 << 18)
    spec = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ranks = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
    planes = plane_files.PieceEncoder(spec)
    merges = bpe._encoder(ranks, P.PATTERN).merges
    own = bpe.Encoder(merges)
    for k in range(40):
        texts = ["x" + "".join(chr(0x4E00 + R.randrange(20_000)) for _ in range(100)) + " " + "中" * 300 + f" w{k} v{j}{k} u{j}"
                 for j in range(250)]
        want = [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts[:5]]
        assert planes.encode(texts)[:5] == want
        assert list(own.encode(texts))[:5] == want
    for memory in (planes.memory, own.memory):
        assert memory.held <= 1 << 18 and memory.known and max(map(len, memory.known)) <= common.LONGEST_PIECE
        assert memory.held == memory.size(memory.known)


def test_words_are_learned_once_for_all_their_endings():
    """A word with many endings takes one place in the memory; ids stay those of the library for whole texts."""
    planes = plane_files.PieceEncoder(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read())
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ends = ["", ",", ".", "'s", "'ll,", "'x", "7", "$$$", "\n", ".\nThe", "\u00aa", "\u00ba.", "\u0153", "\u0301", "\u00a0x", "\x85", "\x1c", "\u3000", "'"]
    texts = [f"{w}{e} {w}{e} a{e}{w}" for w in ("alpha", "\u00dcn\u00edc\u00f6de", "a", "\u00b5m", "<|endoftext|>", "") for e in ends]
    texts += ["", " ", "  two  gaps ", " lead", "tail ", *texts[:3]]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert planes.encode(texts) == want and planes.encode(texts[::-1]) == want[::-1] and planes.encode([]) == []
    assert planes.encode(["only <|endoftext|> whole"]) == [np.array(library.encode("only <|endoftext|> whole").ids, dtype="<u4").tobytes()]
    planes = plane_files.PieceEncoder(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read())
    planes.encode(["x alpha, alpha. alpha; alpha! alpha"])
    assert list(planes.memory.known) == ["alpha"]


def test_merging_encoder_remembers_64_mb_at_most():
    """A reused worker keeps its encoder beside the steps that follow, so its memory has a bound of its own."""
    ranks = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
    own = bpe.Encoder(bpe._encoder(ranks, P.PATTERN).merges)
    for k in range(45):
        words = [f"w{k}x{j}" for j in range(10_000)]
        assert len(list(own.encode([" ".join(words)]))) == 1
    assert 60 << 20 < own.memory.held <= 64 << 20
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in ("w1x1 w44x9999 new,", "w44x1")]
    assert list(own.encode(["w1x1 w44x9999 new,", "w44x1"])) == want


def test_frequent_pieces_cover_all_texts(spark):
    """Frequent pieces are those of the whole table, of the ends of long texts too."""
    rows = [(None,), ("",)] + [("a " * 5_000 + f"late{k % 7} end",) for k in range(60)]
    docs = spark.createDataFrame(rows, "text string").repartition(4)
    assert token_counts.frequent_pieces(docs, limit=2) == ["a", "end"]
    assert token_counts.frequent_pieces(docs, limit=20) == ["a", "end", *(f"late{k}" for k in range(7)), ""]
    assert token_counts.frequent_pieces(docs.limit(0)) == []
