import random
import zlib

from pyspark.sql import functions as F

from draftmill.llm.bpe import ByteBpeIds, load
from draftmill.llm.packing import OpenBins, cut, pack, packing_report
from draftmill.llm.queries import op1_packing, op4_token_counts, tokenizer_path
from draftmill.llm.token_counts import token_counts

SF = "/root/testdata/sf0.001"
BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def ids(coder, text):
    return [*coder.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_are_those_of_the_library():
    fast, coder = ByteBpeIds(BYTE), load(BYTE)
    for text in ["", " ", "a", " a", "a ", "a b\nc, d. it's don't, x!! y|", "a  b", "a\n\nb", "a\tb", "<|endoftext|>", "é, ü. ñ|", "a \nb", "x\x1cy z", "12, 3.", "日本語, か。", "a b c"]:
        assert fast(text) == b"".join(i.to_bytes(4, "little") for i in ids(coder, text)[:-1]), text


def test_cut():
    assert cut(1, 8) == [(0, 1)] and cut(8, 8) == [(0, 8)] and cut(9, 8) == [(0, 1), (1, 8)] and cut(16, 8) == [(0, 8), (8, 8)]


def test_open_bins_place_best_and_close_the_fullest():
    bins = OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = OpenBins(10, 2)
    for n in (5, 8, 7):  # the third bin closes the second, the fullest
        bins.place(n)
    assert bins.place(2)[0] == 2 and bins.place(5)[0] == 0
    rng = random.Random(1)
    bins, used = OpenBins(2048, 64), {}
    for _ in range(5000):
        n = rng.randint(1, 2048)
        b, at = bins.place(n)
        assert at == used.get(b, 0)
        used[b] = at + n
    assert max(used.values()) <= 2048 and sum(used.values()) / len(used) / 2048 > 0.9


def check(rows, docs):
    coder = load(BYTE)
    want = {}
    for doc_id, text in docs:
        i = ids(coder, text)
        for k, (s, n) in enumerate(cut(len(i), 2048)):
            want.setdefault((doc_id, k, s, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in i[s : s + n]))), []).append(1)
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(1)
    assert got == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by)


def test_packing_query_holds_every_token_once(spark):
    rows = op1_packing(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n = check(rows, docs)
    assert n <= 1.1 * sum(r.length for r in rows) / 2048 + 1


def test_packing_of_odd_rows(spark, odd, none):
    packed = pack(odd, BYTE)
    check(packed.select("*", F.crc32("ids").alias("ids_crc32")).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert packing_report(packed).first().fill > 0.5
    assert pack(none, BYTE).count() == 0


def test_token_counts(spark, odd, none):
    coder = load(WORD)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (len(r.text.encode()), n := len(coder.encode(r.text, add_special_tokens=False)), n > 2048) for r in docs}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op4_token_counts(spark, SF).collect()} == want
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts(odd, WORD, head=3).collect())
    assert got == sorted((r.doc_id or 0, len((r.text or "").encode()), len(coder.encode(r.text or "", add_special_tokens=False))) for r in odd.collect())
    assert token_counts(none, WORD).count() == 0
