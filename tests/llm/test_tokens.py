"""Token files and edit-aware counts against plain encoding."""

import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import encoding, grammar_files
from millrace.llm.common import prepare
from millrace.llm.edit_counts import Forest, apply_edits, build_trees, edit_counts, edited, numbers_and_breaks
from millrace.llm.encoding import Encoder
from millrace.llm.grammar_files import Block, build_grammar, expansions, read_token_files, write_token_files
from millrace.llm.shingles import word_hashes
from millrace.session import Workspace

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
ODD = ["", " ", "  a b", "a  b", "x\n y", "x \ny", " lead", "trail ", "a b c", "a  b", "don't stop, it's", "a\tb c\n\nd", "\n", "a\n", "\na b", "ü ß\r\nç", "a b", "🙂 x🙂", "# ## ### 2"]


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def texts(seed, n=120):
    rng = random.Random(seed)
    return ["".join(rng.choice(["a", "the", " ", " ", "  ", "\n", "1", ",", "é", "'s", "word", "\t"]) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_encoder_is_the_tokenizer():
    encoder = Encoder(PATH)
    for batch in (ODD, texts(1), texts(2), [None, "x"], []):
        ids, bounds = encoder.encode(pa.array(batch, pa.string()))
        assert [ids[s:e].tolist() for s, e in zip(bounds[:-1], bounds[1:])] == [ids_of(t) for t in batch]


@pytest.mark.parametrize("alphabet", [2, 5, 300])
def test_grammar_round_trip(alphabet):
    rng = np.random.default_rng(alphabet)
    tokens = rng.integers(0, alphabet, 5000).astype(np.uint32)
    left, right, symbols, ends = build_grammar(tokens, np.array([10, 11, 2500, 4999]), 300, 500)
    flat, bounds = expansions(left, right, 300)
    out = np.concatenate([[s] if s < 300 else flat[bounds[s - 300] : bounds[s - 299]] for s in symbols])
    assert (out == tokens).all()
    sizes = np.array([1 if s < 300 else bounds[s - 299] - bounds[s - 300] for s in symbols])
    assert (np.cumsum(sizes)[ends] - 1).tolist() == [10, 11, 2500, 4999]


def test_grammar_goes_on_until_no_pair_is_frequent():
    # Forty copies of a passage of 3,000 ids: far more than 8 doublings reach.
    passage = np.random.default_rng(1).integers(0, 300, 3000)
    tokens = np.tile(np.r_[passage, 299], 40)
    ends = np.arange(1, 41) * 3001 - 1
    left, right, symbols, ends = build_grammar(tokens, ends, 300, 60_000)
    assert len(symbols) == 40 and (ends == np.arange(40)).all()
    flat, bounds = expansions(left, right, 300)
    out = np.concatenate([flat[bounds[s - 300] : bounds[s - 299]] for s in symbols])
    assert (out == tokens).all()


def test_files_round_trip(spark, tmp_path, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(grammar_files, "BLOCK_TOKENS", 300)
    rows = [(i, t) for i, t in enumerate(ODD + texts(3) + ["so it goes and so it goes and " * 50])] + [(7, "again"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = str(tmp_path / "tokens")
    write_token_files(docs, path, PATH, 2)
    got = sorted((tuple(r) for r in read_token_files(spark, path).collect()), key=lambda r: r[1])
    want = []
    for doc_id, text in rows:
        ids = np.array([*ids_of(text), 2], dtype="<u4")
        want.append((doc_id, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(((r[0], r[2], r[3]) for r in got), key=repr) == sorted(want, key=repr)
    assert [r[1] for r in got] == np.r_[0, np.cumsum([r[2] for r in got])][:-1].tolist()
    assert [r[0] or -1 for r in got] == sorted(r[0] or -1 for r in got)
    blocks = [Block(r.asDict()) for r in spark.read.parquet(path).collect()]
    assert len(blocks) > 3
    for block in blocks:
        for k in range(len(block.doc_ids)):
            own = block.tokens()[block.doc_tokens[k] : block.doc_tokens[k + 1]]
            assert (block.document(k) == own).all() and (block.document(k, 2, 9) == own[2:9]).all()
    write_token_files(docs.limit(0), str(tmp_path / "none"), PATH, 2)
    assert read_token_files(spark, str(tmp_path / "none")).count() == 0


def complements(n):
    """Two words of n letters, each a Thue-Morse word and its complement in either order."""
    word = "a"
    while len(word) < n // 2:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    return word + other, other + word


def test_words_that_meet_polynomial_hashes(monkeypatch):
    one, two = complements(2048)
    batch = [one, two, f"x {two} {one}", "z" * 1_000_000, "z" * 999_999 + "y"]
    want = [ids_of(t) for t in batch]
    assert want[0] != want[1]
    ids, bounds = Encoder(PATH).encode(pa.array(batch, pa.string()))
    assert [ids[s:e].tolist() for s, e in zip(bounds[:-1], bounds[1:])] == want
    hashes, _ = word_hashes(pa.array(batch))
    assert len(set(hashes.tolist())) == 5
    # Whatever the hash is, pieces are compared byte by byte.
    real = encoding.piece_hashes
    monkeypatch.setattr(encoding, "piece_hashes", lambda data, starts: (real(data, starts) >> np.uint64(60)) + np.uint64(1))
    batch = batch[:3] + ODD + texts(3)
    ids, bounds = Encoder(PATH).encode(pa.array(batch, pa.string()))
    assert [ids[s:e].tolist() for s, e in zip(bounds[:-1], bounds[1:])] == [ids_of(t) for t in batch]


def test_new_pieces_go_to_the_library_as_one_text(monkeypatch):
    """Words after a space take no line break each; ids are the library's, whatever the pieces hold and the chunks are."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgßé🙂1,.", k=rng.randint(1, 30))) for _ in range(4000)]
    odd = ["x <|endoftext|> y <|endoftext|>z<|endoftext|>", "a\u2028b \u00a0c \u3000 d\u0085e", " 's 'll don't 12 ...", "a\x1cb \x1f c", "eight888 sixteen16sixteen1 seventeen17seventeen1"]
    batch = [" ".join(rng.choices(words, k=300)) for _ in range(40)] + odd + ODD + [None]
    want = [ids_of(t) for t in batch]
    alone = []
    real = Encoder._encode_pieces
    monkeypatch.setattr(Encoder, "_encode_pieces", lambda self, pieces: alone.extend(pieces) or real(self, pieces))
    for chunk in (encoding.CHUNK_BYTES, 500):
        monkeypatch.setattr(encoding, "CHUNK_BYTES", chunk)
        encoder = Encoder(PATH)
        for _ in range(2):
            ids, bounds = encoder.encode(pa.array(batch, pa.string()))
            assert [ids[s:e].tolist() for s, e in zip(bounds[:-1], bounds[1:])] == want
    assert len(set(alone)) < 200 and not any(re.fullmatch(" [a-g1]+", p) for p in alone)
    # A vocabulary that is not one of bytes: pieces go by the old way.
    encoder = Encoder(PATH)
    encoder._bytes_of[:] = 1
    ids, bounds = encoder.encode(pa.array(batch, pa.string()))
    assert [ids[s:e].tolist() for s, e in zip(bounds[:-1], bounds[1:])] == want and len(set(alone)) > 2000


@pytest.mark.parametrize("slots", [1 << 4, 1 << 8, 1 << 11])
def test_full_cache_keeps_pieces_met_again(monkeypatch, slots):
    monkeypatch.setattr(encoding, "SLOTS", slots)
    monkeypatch.setattr(encoding, "CHUNK_BYTES", 1000)
    rng = random.Random(6)
    often = [f"often{i}" for i in range(60)]
    batch = [" ".join(rng.choices(often, k=60) + [f"rare{rng.random()}" for _ in range(40)]) for _ in range(200)]
    encoder, sent = Encoder(PATH), []
    real = Encoder._encode_spans
    monkeypatch.setattr(Encoder, "_encode_spans", lambda self, raw, sizes: sent.append(raw.tobytes()) or real(self, raw, sizes))
    ids, bounds = encoder.encode(pa.array(batch, pa.string()))
    assert [ids[s:e].tolist() for s, e in zip(bounds[:-1], bounds[1:])] == [ids_of(t) for t in batch]
    # Three thousand rare pieces and more fill the largest of these caches several times; the frequent ones stay.
    assert slots < 1 << 11 or b"".join(sent).count(b" often7") <= 2 * b"".join(sent[:40]).count(b" often7")


def test_forest():
    rng = np.random.default_rng(2)
    sizes = np.array([1, 13, 2, 8, 1, 100])
    values = rng.integers(0, 9, sizes.sum())
    forest = Forest(sizes).fill(values)
    docs, heads = np.repeat(np.arange(6), sizes), np.r_[0, np.cumsum(sizes)]
    assert forest.roots.tolist() == [values[a:b].sum() for a, b in zip(heads[:-1], heads[1:])]
    some = np.sort(rng.choice(len(values), 40, replace=False))
    values[some] = rng.integers(0, 9, 40)
    forest.update(docs[some], some - heads[docs[some]], values[some])
    assert (forest.nodes == Forest(sizes).fill(values).nodes).all()


def test_many_edits_of_a_long_text(spark):
    prepare(spark)
    text = "".join(f"line {i} of text\n" for i in range(60_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    started = time.time()
    trees = Workspace(spark).materialize(build_trees(df, PATH), "trees")
    (row,) = apply_edits(trees, PATH, numbers_and_breaks).collect()
    assert time.time() - started < 60
    assert row.n_edits == 120_000 and row.n_tokens == len(ids_of(re.sub("[0-9]+", "<num>", text).replace("\n", "\n\n")))


def test_edited_counts(spark):
    prepare(spark)
    rng = random.Random(5)
    rows = []
    for i, text in enumerate(ODD + texts(6) + ["one two three four five six seven eight nine ten"] * 40):
        cuts = sorted(rng.choices(range(len(text) + 1), k=2 * rng.randint(0, 3)))
        edits = [(a, b, rng.choice(["", " ", "x", " new words here ", "\n"])) for a, b in zip(cuts[::2], cuts[1::2])]
        rows.append((i, text, edits))
    rows += [(899, "", [(0, 0, "x y")]), (900, None, None), (901, "a b", [(5, 9, "c"), (None, 2, "d")]), (902, "abc", [(0, 2, None), (1, 3, "x")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,stop:int,text:string>>")
    got = {r["doc_id"]: r for r in edit_counts(docs, PATH).collect()}
    for i, text, edits in rows[:-4]:
        assert (got[i]["n_tokens_before"], got[i]["n_tokens"]) == (len(ids_of(text)), len(ids_of(edited(text, edits)))), (text, edits)
    assert got[899]["n_tokens"] == 2 and got[900]["n_tokens"] == 0 and got[901]["n_tokens"] == len(ids_of("a bc")) and got[902]["n_tokens"] == len(ids_of("c"))


def test_query_edits(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in entry.queries()["op1_edit_counts"](spark, sf).collect()}
    for doc_id, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text")).collect():
        new = re.sub(r"\n|[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", lambda m: "\n\n" if m[0] == "\n" else "<num>", text or "")
        assert (got[doc_id]["n_tokens_before"], got[doc_id]["n_tokens"]) == (len(ids_of(text)), len(ids_of(new)))
