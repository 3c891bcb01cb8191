"""Token files (op11): exact round trips, blocks by hand, edges."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import DATA
from tests.llm.edges import docs, empty, rows
from tidemark.llm import queries
from tidemark.llm.tokens import BLOCK, Encoder, TokenFile, pack_blocks, read_digests, read_documents, unpack_blocks, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)


def ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 2]


def expected(table):
    """Digests in order of doc_id, null first, then text."""
    out, start = [], 0
    for i, text in sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        own = ids(text)
        out.append((i, start, len(own), zlib.crc32(np.array(own, "<u4"))))
        start += len(own)
    return out


def test_query_gives_the_ids_of_every_text(spark):
    got = queries.queries()["op11_token_files"](spark, DATA).collect()
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(map(tuple, got)) == sorted(expected(table))


@pytest.mark.parametrize("percentile", [0.0, 0.5, 0.9, 1.0])
def test_blocks_round_trip(percentile):
    rng = np.random.default_rng(7)
    kinds = [np.full(BLOCK, 9), np.arange(BLOCK), rng.integers(0, 1 << 32, BLOCK), rng.integers(0, 300, BLOCK) + (1 << 31), np.where(rng.random(BLOCK) < 0.05, (1 << 32) - 1, rng.integers(0, 7, BLOCK)), np.zeros(BLOCK)]
    whole = np.concatenate(kinds).astype(np.uint32)
    blocks = pack_blocks(whole, percentile)
    assert (unpack_blocks(blocks) == whole).all()
    if percentile == 0.9:  # a twentieth of outliers costs six bytes each, not 32 bits for every id
        assert len(blocks[4]) < 7 + BLOCK * 3 // 8 + 6 * BLOCK // 10 and len(blocks[0]) == 7


def test_words_give_the_ids_of_whole_texts():
    rng = random.Random(1)
    parts = ["a", "B", "é", "é", "́", " ", " ", "İ", "Σ", "ς", "ß", "'s", "'", "’t", "1", "²", "中", "😀", "<|endoftext|>", "<|start", "of", "text|>", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "​", "\x00", "한", "글", "-", "_", "the", ",", "...", "€", "<", ">"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["y" * 5000, ""]
    pick = lambda encode, k, n: [a.tolist() for a in encode(pa.array(texts, pa.string()).slice(k, n))]
    whole, encode = Encoder(PATH, by_words=False), Encoder(PATH)
    unmarked = Encoder(PATH)
    unmarked.mark, unmarked.parts_tails = None, False
    assert encode.parts_tails and encode.mark
    for _ in range(2):  # the second time from memory
        for k in range(0, len(texts), 500):
            want = pick(whole, k, 500)
            assert pick(encode, k, 500) == want and pick(unmarked, k, 500) == want and len(want[1]) == len(texts[k : k + 500])


def test_files_and_edges(spark):
    df, table = docs(spark), [(r[0], r[1]) for r in rows()]
    files = write_tokens(df, PATH, file_tokens=5000, partition_bytes=60_000)
    listed = files.orderBy("part", "nth").collect()
    assert len(listed) > 3 and sum(r.documents for r in listed) == len(table) and len({r.part for r in listed}) > 1
    want = expected(table)
    assert sorted(map(str, map(tuple, read_digests(files).collect()))) == sorted(map(str, want))
    back = {r.start: r.ids for r in read_documents(files).collect()}
    assert [back[r[1]] for r in want] == [ids(t) for _, t in sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))]
    big = TokenFile(max(listed, key=lambda r: r.tokens).path)
    whole = np.concatenate([p for _, p in big.pieces(BLOCK)])
    assert len(whole) == big.tokens > 2 * BLOCK
    for first, n in ((0, 5), (BLOCK - 1, 2), (BLOCK + 7, 3 * BLOCK), (big.tokens - 3, 10), (big.tokens, 4)):
        assert (big.span(first, n) == whole[first : first + n]).all()
    again = read_digests(write_tokens(df.repartition(5), PATH, percentile=0.5, by_words=False))
    assert sorted(map(str, map(tuple, again.collect()))) == sorted(map(str, want))
    assert read_digests(write_tokens(empty(spark), PATH)).count() == 0
