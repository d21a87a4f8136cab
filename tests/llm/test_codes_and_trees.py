"""Byte-level BPE, vector codes and the Merkle manifest against brute force, their libraries and SQL, with edge rows."""

import base64
import hashlib
import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidelake.llm import manifest as trees
from tidelake.llm import vector_codes as vc
from tidelake.llm.byte_bpe import ByteBpe, decoded_bytes, encode_texts
from tidelake.llm.oracles import codes_sql, manifest_sql
from tidelake.llm.queries import op11_merkle_manifest, op12_vector_codes, op13_byte_bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
CLASHING = ("tree", "id", "hash", "own", "part", "rank", "n", "ids", "bytes", "n_tokens", "code", "error", "v", "at", "bucket", "path", "count", "of", "salt")
SF = "/root/testdata/sf0.001"


def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("brute", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def merged(piece: bytes, ranks: dict) -> list[int]:
    """Merges of one match, the lowest rank first, leftmost on ties."""
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


TEXTS = ["", " ", "\n\n x", "a  b", "it's 12 o'clock, isn't it?", "é中文\x00ß 😀😀", "<|endoftext|>", "'s's 'S", " x y \x1c z", "x" * 3000, " " * 3000 + "y"]


def test_ids_are_those_of_the_library_wherever_texts_are_cut():
    coder, brute, rand = ByteBpe(RANKS, PATTERN), library(), random.Random(3)
    texts = TEXTS + ["".join(rand.choice("ab1 '\n.中é\t s") for _ in range(200)) for _ in range(100)]
    for text in texts:
        for long in (1, 7, 50, 1 << 16):
            ids = coder.encode(text, long)
            assert ids.tolist() == brute.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_ids_are_those_of_plain_merging():
    import regex

    coder = ByteBpe(RANKS, PATTERN)
    ranks = {coder.split.decode_single_token_bytes(i): i for i in range(coder.split.n_vocab)}
    for text in TEXTS[:9]:
        assert coder.encode(text).tolist() == [i for m in regex.findall(PATTERN, text) for i in merged(m.encode(), ranks)]


@pytest.mark.parametrize("text", [" " * 1_500_000, "a" + "\n" * 1_200_000 + "b", "x" * 400_000, "中文。" * 100_000, "word, " * 100_000])
def test_very_long_texts(text):
    coder = ByteBpe(RANKS, PATTERN)
    ids = coder.encode(text)
    assert coder.decode(ids) == text.encode()
    if " " * 9 not in text and "\n" not in text:  # on long white space the library's matcher runs out of stack
        assert ids.tolist() == library().encode_ordinary(text)
    else:
        short = text.replace(text[5:1_100_000], "")
        assert ids[-1] == library().encode_ordinary(short)[-1]


def test_encode_edges(spark):
    rows = [(1, ""), (2, None), (None, "one two"), (4, "same"), (4, "same"), (5, "word " * 30_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("clash").alias(c) for c in CLASHING])
    found = encode_texts(frame, RANKS, PATTERN, with_bytes=True).collect()
    brute = library()
    assert sorted((str(r.doc_id), r.n_tokens, tuple(r.ids), bytes(r.bytes)) for r in found) == sorted(
        (str(i), len(ids := brute.encode_ordinary(t or "")), tuple(ids), (t or "").encode()) for i, t in rows
    )
    assert encode_texts(frame.where("false"), RANKS, PATTERN).count() == 0


def test_bytes_of_ids_that_are_no_text(spark):
    coder = ByteBpe(RANKS, PATTERN)
    half = coder.encode("中").tolist() + coder.encode("\U0001f9ff").tolist()[:1]
    rows = [(half,), ([],), (None,), ([60_000],), ([-1],), ([1, None],)]
    found = [r[0] for r in spark.createDataFrame(rows, "ids array<int>").select(decoded_bytes(F.col("ids"), RANKS, PATTERN)).collect()]
    assert bytes(found[0]) == b"".join(coder.split.decode_single_token_bytes(i) for i in half)
    assert [None if x is None else bytes(x) for x in found[1:]] == [b"", None, None, None, None]


def test_byte_bpe_query(spark):
    brute = library()
    texts = spark.read.parquet(f"{SF}/documents.parquet").collect()
    wanted = []
    for r in texts:
        ids = brute.encode_ordinary(r.text or "")
        told = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), (r.text or "").encode())]
        wanted.append((r.doc_id, len(ids), *told))
    assert sorted(map(tuple, op13_byte_bpe(spark, SF).collect())) == sorted(wanted)


@pytest.mark.parametrize("bits", [3, 5, 20, 24])
def test_limbs_give_exact_products(bits):
    rand = np.random.default_rng(bits)
    a, b = rand.integers(-(2**27), 2**27, (60, 16)), rand.integers(-(2**27), 2**27, (40, 16))
    a[0], b[0] = 2**27, -(2**27)
    assert (vc.exact_product(a, b, bits) == a.astype(object) @ b.T.astype(object)).all()
    for x in (a, b):
        assert (sum(d.astype(np.int64) << bits * k for k, d in enumerate(vc.digits(x, bits))) == x).all()
        assert all(np.abs(d).max() <= 2**bits for d in vc.digits(x, bits))
    assert 16 * 4 ** vc.limb_bits(16) <= 2**53 and 17 * 4 ** vc.limb_bits(17) <= 2**53


def test_the_first_of_equally_near_entries():
    nearest, distances = vc.assign(np.array([[1, 0], [5, 5]]), np.array([[0, 0], [2, 0], [2, 0], [5, 5], [5, 5]]))
    assert nearest.tolist() == [0, 3] and distances.tolist() == [1, 0]


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """Plain lists and loops; rows of (id, label, vector), nulls and non-finite ones left out before."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    whole = [[int(np.floor(np.float64(x) * 1024)) for x in r[2]] for r in rows]
    width = len(whole[0]) // parts
    cut = [[tuple(x[k * width : (k + 1) * width]) for x in whole] for k in range(parts)]
    books = [p[:entries] for p in cut]

    def near(p, book):
        distances = [sum((u - v) ** 2 for u, v in zip(p, e, strict=True)) for e in book]
        return distances.index(min(distances)), min(distances)

    for _ in range(rounds):
        for k in range(parts):
            met: dict = {}
            for p in cut[k]:
                met.setdefault(near(p, books[k])[0], []).append(p)
            books[k] = [tuple(sum(c) // len(met[e]) for c in zip(*met[e], strict=True)) if e in met else old for e, old in enumerate(books[k])]
    told, sums = [], {}
    for i, r in enumerate(rows):
        found = [near(cut[k][i], books[k]) for k in range(parts)]
        told.append((r[0], "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), r[1]))
        sums[r[1]] = sums.get(r[1], 0) + told[-1][2]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(i, code, error, sums[label], digest) for i, code, error, label in told]


def key(row):
    return tuple(map(str, row))


def test_vector_codes_edges(spark):
    rand = random.Random(5)
    fine = [(k, rand.choice([None, 1, 2]), [rand.choice([-1.5, -0.3, 0.0, 0.0004, 0.7, 300.0]) for _ in range(8)]) for k in range(300)]
    fine += [(7, 1, [0.0] * 8), (7, 1, [0.0] * 8), (7, 2, [0.5] * 8), (None, 1, [9.0] * 8), (None, None, [9.0] * 8)]
    odd = [(-5, 1, None), (-4, 1, [1.0] * 7 + [None]), (-3, 1, [float("nan")] * 8), (-2, 2, [float("inf")] + [0.0] * 7), (400, 1, [1.0] * 4), (401, 1, [])]
    schema = "vec_id long, label int, embedding array<float>"
    frame = spark.createDataFrame(fine + odd, schema).select("*", *[F.lit("clash").alias(c) for c in CLASHING]).repartition(5)
    fine = [(i, label, np.array(v, np.float32).tolist()) for i, label, v in fine]
    for entries in (16, 256):
        found = list(map(tuple, vc.vector_codes(frame, entries=entries).collect()))
        assert sorted(found, key=key) == sorted(brute_codes(fine, entries=entries), key=key)
    assert sorted(map(tuple, vc.vector_codes(spark.createDataFrame(fine[:3], schema)).collect())) == sorted(brute_codes(fine[:3]))
    assert vc.vector_codes(frame.where("false")).count() == 0
    assert vc.vector_codes(spark.createDataFrame([(1, 1, []), (2, 1, [])], schema)).select("code", "error").distinct().collect() == [("00000000", 0)]
    uneven = vc.vector_codes(spark.createDataFrame([(1, 1, [1.0, 2.0, 3.0]), (2, 1, [3.0, 2.0, 1.0])], schema), parts=2)
    assert sorted(r.code for r in uneven.collect()) == ["0000", "0101"]
    with pytest.raises(Exception, match="64 bits"):
        vc.vector_codes(spark.createDataFrame([(1, 1, [1e30] * 8)], schema)).collect()


def test_label_sums_beyond_the_broadcast(spark):
    rows = spark.range(500).selectExpr("id", "IF(id % 3 = 0, null, id % 5) AS label", "CAST(CAST(id AS STRING) AS BINARY) AS code", "id AS error")
    assert sorted(map(key, vc.with_label_error(rows, few=0).collect())) == sorted(map(key, vc.with_label_error(rows).collect()))


def test_decoding_codes():
    books = vc.Codebooks([np.array([[1, 2], [3, 4]]), np.array([[5], [6]])], 3, 1)
    assert vc.decoded(b"\x01\x00", books).tolist() == [3, 4, 5]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, fan_in=2):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + fan_in]) for k in range(0, len(levels[-1]), fan_in)])
    return levels


def steps(levels, place, fan_in=2):
    for level in levels[:-1]:
        first = place - place % fan_in
        yield level[first:place], level[place + 1 : first + fan_in]
        place //= fan_in


def brute_manifest(rows, fan_in=2):
    """Rows of (doc_id, source, lang, n_chars, text)."""
    groups: dict = {}
    for r in rows:
        changed = list(r)
        if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
            changed[3] += 1
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, H(*map(told, r)), H(*map(told, changed)), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fan_in) for g in names}
    top = climb([below[g][-1][0] for g in names], fan_in)
    out = []
    for j, g in enumerate(names):
        for i, (_, _, leaf, node, doc) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = [*steps(below[g], i, fan_in), *steps(top, j, fan_in)]
            for left, right in path:
                node = H(*left, node, *right)
            out.append((doc, leaf, below[g][-1][0], top[-1][0], H(*[x for left, right in path for x in left + right]), node, node == top[-1][0]))
    return out


def lake(spark, tmp_path, rows):
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    frame.select("*", *[F.lit("clash").alias(c) for c in CLASHING]).repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("size", [1, 2, 65, 4200])
def test_manifest_of_trees_of_all_shapes(spark, tmp_path, size):
    rand = random.Random(size)
    rows = [(k, rand.choice(["web", None, "ü"]), None if k % 11 == 5 else "en", rand.choice([None, k]), rand.choice([None, "", "text " * (k % 9), "é中"])) for k in range(size)]
    rows += [(k, "s", lang, 1, "x") for k, lang in enumerate(["", "zz", "é", "a", "𐀀", "￿"])] if size % 2 else []
    rows += [rows[0], rows[0], (None, None, None, None, None), (None, "s", "en", 3, "null id"), (rows[-1][0], "other", "en", 2, "same id")] if size > 2 else []
    found = list(map(tuple, op11_merkle_manifest(spark, lake(spark, tmp_path, rows)).collect()))
    assert sorted(found, key=key) == sorted(brute_manifest(rows), key=key)


@pytest.mark.parametrize("fan_in", [2, 5])
def test_other_fan_ins_and_shuffled_ranges(spark, monkeypatch, fan_in):
    monkeypatch.setattr(trees, "FEW_RANGES", 0)  # sizes of ranges are joined, not broadcast
    monkeypatch.setattr(trees, "WIDTH", 2)
    rows = [(k, "s", "en" if k % 3 else "de", k, f"text {k}") for k in range(130)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    fields = [F.col(c) for c in frame.columns]
    found = trees.manifest(frame.repartition(6), "doc_id", "lang", fields, fan_in=fan_in)
    found = found.select("id", "leaf", "subroot", "root", trees.siblings_digest(F.col("path")), trees.folded(F.col("leaf"), F.col("path")))
    assert sorted(map(tuple, found.collect())) == sorted((d, leaf, sub, root, proof, root) for d, leaf, sub, root, proof, *_ in brute_manifest(rows, fan_in))


def test_manifest_of_nothing_and_of_one_large_group_of_equal_rows(spark, tmp_path):
    assert op11_merkle_manifest(spark, lake(spark, tmp_path / "a", [])).count() == 0
    rows = [(14, "s", "en", 4, "copy")] * 700
    found = list(map(tuple, op11_merkle_manifest(spark, lake(spark, tmp_path / "b", rows)).collect()))
    assert sorted(found) == sorted(brute_manifest(rows))


@pytest.mark.parametrize(("query", "sql", "name"), [(op11_merkle_manifest, manifest_sql, "documents"), (op12_vector_codes, codes_sql, "embeddings")])
def test_queries_against_sql(spark, query, sql, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{Path(SF) / name}.parquet'")
    found = query(spark, SF)
    wanted = duck.execute(sql())
    assert [d[0] for d in wanted.description] == found.columns
    assert sorted(map(tuple, found.collect())) == sorted(wanted.fetchall())
