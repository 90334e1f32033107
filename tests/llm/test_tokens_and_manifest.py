"""Binary records, the Merkle manifest and the alignment of tokenizers, against brute force."""

import collections
import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from palimpsest.llm import align, bytebpe, merkle, queries, records

SF = "/root/testdata/sf0.001"
NAMES = "doc_id long, text string, lang string, source string, n_chars long, part long, size long, pairs string, tree int, `index` int, key string"
ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \t\n ", None), (4, "a", "de"), (5, "Ünïcode  TEXT ﬁ\n\nNew line", "fr"), (5, "the same id", "fr"), (7, "a", "de"), (8, "x" * 30000, "en"), (9, "One two, " * 4000, "en"),
    (10, "😀 ok😀\x00 \x1c\x85 z　w", "en"), (11, "has ▁ mark", "en"), (12, "a<|endoftext|>b <|endoftext|> <s> <0x41></s>", "en"), (None, "No id", "en"), (None, "no id", "en"), (None, "No id", "en"), (-3, "don't  they'll\t1234 é à", ""), (13, "  two leading", "en"), (14, "trail  ", "en"),
]


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s" if (i or 0) % 2 else None, len(t or ""), 1, 2, "x", 3, 4, "k") for i, t, lang in rows], NAMES)


def sample():
    return [(r["doc_id"], r["text"], r["lang"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


# Checksums and frames
def crc_by_bits(data):
    c = 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksums_and_frames():
    assert records.crc32c([b"123456789"])[0] == 0xE3069283
    rng = random.Random(1)
    data = [rng.randbytes(n) for n in (0, 1, 3, 8, 255, 256, 257, 511, 512, 1000, 3000, 0)]
    assert records.crc32c(data).tolist() == [crc_by_bits(d) for d in data]
    framed, sizes = records.frame(data)
    assert records.unframe([framed]) == data and sizes.tolist() == [len(d) for d in data]
    assert records.unframe([]) == [] and records.frame([])[0] == b""
    crc = crc_by_bits(data[5])
    one, _ = records.frame([data[5]])
    assert one[-4:] == (((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF).to_bytes(4, "little")
    for at in (0, 9, 20, len(one) - 1):  # length, its checksum, payload, its checksum
        bad = bytearray(one)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe([bytes(bad)])


def test_record_set_reads_in_any_order(spark, tmp_path):
    rng = random.Random(2)
    data = [(f"k{i}" if i % 9 else None, rng.randbytes(rng.choice([0, 5, 700])) if i % 11 else None) for i in range(2000)]
    kept = records.RecordSet(spark, f"file://{tmp_path}").write(spark.createDataFrame(data, "key string, value binary").repartition(3), file_bytes=20_000)
    assert kept.verify() == 2000 and len(os.listdir(f"{tmp_path}/data")) > 4
    want = collections.Counter((k, v or b"") for k, v in data)
    for seed in (None, 1, 2):
        got = [(r["key"], bytes(r["payload"])) for r in kept.read(shuffle_seed=seed, parts=2).collect()]
        assert collections.Counter(got) == want
    a, b = ([r["key"] for r in kept.read(shuffle_seed=s, parts=1).collect()] for s in (1, 2))
    assert a != b
    empty = records.RecordSet(spark, f"file://{tmp_path}/none").write(spark.createDataFrame([], "key long, value binary"))
    assert empty.verify() == 0 and empty.read().collect() == []
    name = os.listdir(f"{tmp_path}/data")[0]
    with open(f"{tmp_path}/data/{name}", "r+b") as f:
        f.seek(10)
        f.write(b"\xff\xff")
    os.path.exists(f"{tmp_path}/data/.{name}.crc") and os.remove(f"{tmp_path}/data/.{name}.crc")
    with pytest.raises(Exception, match="checksum|cut"):
        kept.verify()


@pytest.mark.parametrize("rows", [ODD, sample(), [], [(4, "same", "en")] * 300 + [(1, "x", "en")]])
def test_token_records(spark, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bytebpe.tokenizer_path("byte_bpe_50k.json"))
    got = sorted((tuple(r) for r in records.token_records(table_of(spark, rows)).collect()), key=lambda r: r[1])
    ids = {t: library.encode(t, add_special_tokens=False).ids + [0] for _, t, _ in [(0, "", 0)] + [(0, t or "", 0) for _, t, _ in rows]}
    shape = lambda t: (len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes()))
    want = sorted(((i, *shape(t or "")) for i, t, _ in rows), key=str)
    assert sorted(((i, n, c) for i, _, n, c in got), key=str) == want
    assert [s for _, s, _, _ in got] == [sum(n for _, _, n, _ in got[:k]) for k in range(len(got))]
    assert [i for i, *_ in got] == sorted((i for i, _, _ in rows), key=lambda i: (i is None, i or 0))


def test_records_in_many_parts(spark, tmp_path):
    rows = sample()
    docs = table_of(spark, rows)
    kept = records.write_tokens(docs, f"file://{tmp_path}", part_bytes=20_000, file_bytes=9_000)
    index = kept.index().collect()
    assert len({r["part"] for r in index}) > 8 and len({r["file"] for r in index}) == len(os.listdir(f"{tmp_path}/data"))
    order = [r["key"] for r in sorted(index, key=lambda r: (r["part"], r["nth"]))]
    assert order == sorted(i for i, _, _ in rows)
    starts = {r["part"]: r["start"] for r in records.part_starts(kept.index()).collect()}
    at = 0
    for r in sorted(index, key=lambda r: (r["part"], r["nth"])):
        assert starts[r["part"]] + r["before"] == at
        at += r["items"]


@pytest.mark.parametrize("special", [True, False])
def test_encoder_equals_the_library(special):
    encoder = bytebpe.byte_encoder(bytebpe.tokenizer_path("byte_bpe_50k.json"))
    assert encoder.fast
    texts = [t or "" for _, t, _ in ODD + sample()] + ["".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}'s\n" for c in range(k, k + 700)) for k in range(0x0, 0x3000, 700)]
    library = encoder.library if special else encoder.plain
    assert [x.tolist() for x in encoder.encode(texts, special)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_encoder_refuses_other_models(tmp_path):
    """A file whose merges don't ascend with their ids is left to the library."""
    import json

    with open(bytebpe.tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    merges = spec["model"]["merges"]
    merges[0], merges[900] = merges[900], merges[0]
    (tmp_path / "t.json").write_text(json.dumps(spec))
    other = bytebpe.ByteEncoder(str(tmp_path / "t.json"))
    assert other.fast is None
    assert other.encode(["the cat"])[0].tolist() == other.library.encode("the cat", add_special_tokens=False).ids


# Merkle
def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    out = ""
    for v in row:
        v = None if v is None else str(v)
        out += "-" if v is None else f"{len(v.encode())}:{v}"
    return h(out)


def fold(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_merkle(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    trees, out = [], []
    for lang in sorted(by, key=lambda x: (x is not None, (x or "").encode())):
        mine = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        levels = [[leaf_of(r) for r in mine]]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
        trees.append((mine, levels))
    subs = [levels[-1][0] for _, levels in trees]
    root = h(*subs)
    for t, (mine, levels) in enumerate(trees):
        for k, r in enumerate(mine):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now, proof, at = leaf_of((*r[:4], fold(r[4]))) if tampered else levels[0][k], "", k
            for level in levels[:-1]:
                run, place = level[at // 8 * 8 : at // 8 * 8 + 8], at % 8
                proof += "".join(run[:place] + run[place + 1 :])
                now, at = h(*run[:place], now, *run[place + 1 :]), at // 8
            proof += "".join(subs[:t] + subs[t + 1 :])
            now = h(*subs[:t], now, *subs[t + 1 :])
            out.append((r[0], levels[0][k], subs[t], root, h(proof), now, now == root))
    return sorted(out, key=str)


def merkle_rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("rows", [ODD, sample(), [], [(1, "Lone", None)], [(k, f"T{k}", "en") for k in range(73)] + [(5, "T5", "en")] * 9])
def test_merkle_proofs(spark, rows):
    docs = table_of(spark, rows)
    got = sorted((tuple(r) for r in merkle.merkle_proofs(docs).collect()), key=str)
    assert got == brute_merkle(merkle_rows(docs))


def test_merkle_grows_in_rounds(spark):
    """Blocks of 64 leaves: frontiers of several tasks and three rounds."""
    rng = random.Random(4)
    ids = rng.sample(range(100_000), 5_003)
    docs = table_of(spark, [(i, f"Text {i}", "en" if k % 3 else rng.choice(["de", None, "x"])) for k, i in enumerate(ids)]).repartition(7)
    got = sorted((tuple(r) for r in merkle.merkle_proofs(docs, levels=2).collect()), key=str)
    assert got == brute_merkle(merkle_rows(docs))


def test_frontiers_merge_in_any_order():
    rng = random.Random(5)
    for size in (2, 8, 9, 64, 65, 300, 513):
        leaves = [h(str(k)) for k in range(size)]
        whole = merkle.Frontier(size)
        for k, d in enumerate(leaves):
            whole.add(0, k, d)
        parts = [merkle.Frontier(size) for _ in range(5)]
        for k in rng.sample(range(size), size):
            rng.choice(parts).add(0, k, leaves[k])
        got = parts[0]
        for p in parts[1:]:
            got = got.merge(p)
        assert got.done == whole.done and not got.open


def test_merkle_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL['op12_merkle']})").fetchall())
    got = sorted(tuple(r) for r in queries.QUERIES["op12_merkle"](spark, SF).select(*cols).collect())
    assert got == want and {r[-1] for r in got} == {True, False}


# Alignment
def spans_of(ids, table):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(table[i])))
        at += len(table[i])
    return out


def brute_align(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(bytebpe.tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=bytebpe.tokenizer_path("piece_bpe_32k.model"))
    chars = bytebpe.byte_of_char()
    a_bytes = {i: bytes(chars[c] for c in s) for s, i in a.get_vocab().items() if s != "<|endoftext|>"}
    b_bytes = {}
    for i in range(b.vocab_size()):
        p = b.id_to_piece(i)
        b_bytes[i] = bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
    docs, count = [], collections.Counter()
    for t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        whole = (" " + t).encode() if t else b""
        if not t or b"".join(a_bytes[i] for i in x) != whole or b"".join(b_bytes[i] for i in y) != whole:
            docs.append(None)
            continue
        sx, sy = spans_of(x, a_bytes), spans_of(y, b_bytes)
        both = sorted({e for _, e in sx} & {e for _, e in sy})
        groups = [",".join(str(i) for i, (_, e) in zip(x, sx) if lo < e <= hi) + "|" + ",".join(str(i) for i, (_, e) in zip(y, sy) if lo < e <= hi) for lo, hi in zip([0, *both], both)] if len(whole) < 3000 else None
        links, j = [], 0
        for i, (s, e) in zip(x, sx):
            while sy[j][1] <= s:
                j += 1
            k = j
            while k < len(sy) and sy[k][0] < e:
                links.append((i, y[k]))
                k += 1
        count.update(links)
        docs.append((len(x), len(y), len(both), links, groups))
    most = collections.defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    for d in docs:
        if d is None:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            n_a, n_b, n_groups, links, groups = d
            yield (n_a, n_b, n_groups, len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), groups and hashlib.sha256(";".join(groups).encode()).hexdigest())


COLS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("hot", [1 << 16, 40, 0])
@pytest.mark.parametrize("rows", [ODD, sample(), [], [(1, "copy of it", "en")] * 50])
def test_alignment(spark, rows, hot):
    got = align.cross_tokenizer(table_of(spark, rows), hot_pairs=hot).collect()
    want = [(i, *w) for (i, _, _), w in zip(rows, brute_align([t for _, t, _ in rows]))]
    key = lambda r: (str(r[0]), *r[1:7])
    got = sorted(((r["doc_id"], *[r[c] for c in COLS]) for r in got), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:7] == w[:7] and w[7] in (None, g[7])


def test_pieces_of_text_encode_alone():
    """What is cut in front of white space gives the tokens of the whole, and a small memory changes nothing."""
    paths = [bytebpe.tokenizer_path(n) for n in (align.TOKENIZER_A, align.TOKENIZER_B)]
    rng = random.Random(6)
    parts = ["word", "Wörter", " ", "  ", "\n", "\t", "\r\n", "'ll", ",", "...", "数", "　", "\x85", "\x1c", " ", "1234", "é", "😀", "<|endoftext|>", "\xa0"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(600)]
    small, large = align.CorpusAligner(*paths, limit=30), align.CorpusAligner(*paths)
    whole = align.CorpusAligner(*paths)
    whole.cut = False
    assert large.cut and large.b.fine
    for k in range(0, len(texts), 40):
        a, b, c = (list(x.batch(texts[k : k + 40])) for x in (small, large, whole))
        assert [x[:5] for x in a] == [x[:5] for x in b] == [x[:5] for x in c]
        assert all((x[5] == y[5]).all() and (x[6] == y[6]).all() and (x[5] == z[5]).all() for x, y, z in zip(a, b, c))


def test_transducer_refuses_other_bytes():
    t = align.SuffixTransducer({1: b"ab", 2: b"c"}, {1: b"a", 2: b"bc", 3: b"bd"})
    assert t.align([1, 2], [1, 2]) == ([(2, 2)], [(1, 1), (1, 2), (2, 2)])
    assert t.align([1, 2], [1, 3]) is None and t.align([1], [1]) is None and t.align([1, 2], [1, 2, 1]) is None and t.align([], []) == ([], [])
