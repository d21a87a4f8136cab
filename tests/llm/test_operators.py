"""The operators against brute force, round trips and edge rows, on small tables."""

import gzip
import hashlib
import itertools
import math
import random
import re
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelake.llm import catalog, line_dedup, packing, quality
from tidelake.llm.decontaminate import contaminated, without_contaminated
from tidelake.llm.jaccard_join import jaccard_join, one_of_each, prefix_depth
from tidelake.llm.licenses import KNOWN, license_scan
from tidelake.llm.line_dedup import _members, _signed, _united, dedup_lines
from tidelake.llm.nearest import nearest
from tidelake.llm.packing import Encoder, best_fit, pack, plan
from tidelake.llm.personal import _keyed, base_spans, disclosing_terms, personal_data, sanitised
from tidelake.llm.quality import STATISTICS, FourierMap, isotonic, keep_good, normal_equations, quality_scores, summed
from tidelake.llm.token_counts import PrefixTable, count_at, longest_within, token_counts, truncate
from tidelake.llm.warc import ARC_FIELDS, arc_records, arc_to_warc, archive_pages, payload_digest, read_warc, warc_records, write_arc
from tidelake.session import BATCH_ROWS, stash

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
DOC = "doc_id long, text string"
EDGES = [(1, ""), (2, None), (None, "one two"), (4, "same text here"), (4, "same text here"), (5, "word " * 30_000), (6, "x" * 60_000)]
WORDS = [f"w{k}" for k in range(400)]


def prose(seed: int, n: int) -> list[str]:
    return random.Random(seed).choices(WORDS, k=n)


CLASHING = (
    "__text", "key", "id", "__drops", "__id", "__TH", "__hash", "__items", "__node", "__low", "__rejected", "__gone", "__score", "drops", "node", "rows",
    "n", "component", "score", "words", "item", "line", "kept", "digest", "lines", "spans", "place", "bands", "length", "piece", "text_", "keys", "block", "x", "y",
)


def edge_frame(spark):
    """Edge rows with columns that have the names which operators use inside."""
    return spark.createDataFrame(EDGES, DOC).select("*", *[F.lit("clash").alias(c) for c in CLASHING])


def empty(spark):
    return spark.createDataFrame([], DOC)


def test_prefix_counts_are_those_of_the_library():
    library, table = sentencepiece.SentencePieceProcessor(model_file=PIECES), PrefixTable(PIECES)
    rand = random.Random(1)
    texts = ["", " ", "a  b", "\n\n a\n", "▁a ▁▁b", "中文 é\x00 <s> <0x0A>", "hello" + " " * 40 + "x", "aaaaaa bbbbbb" * 5]
    texts += ["".join(rand.choice("ab \n中é▁th e") for _ in range(30)) for _ in range(300)]
    for text in texts:
        found = table.of(text)
        for n in range(len(text) + 1):
            assert count_at(found, n) == len(library.encode(text[:n])), (text, n)
        for budget in (0, 1, 5):
            n = longest_within(found, budget)
            assert max(k for k in range(len(text) + 1) if len(library.encode(text[:k])) <= budget) == n


def test_token_counts_edges(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = token_counts(edge_frame(spark), PIECES).select("doc_id", "n_bytes", "n_tokens").collect()
    assert sorted(map(str, rows)) == sorted(map(str, [type(rows[0])(doc_id=i, n_bytes=len((t or "").encode()), n_tokens=len(library.encode(t or ""))) for i, t in EDGES]))
    assert token_counts(empty(spark), PIECES).count() == 0
    one = spark.createDataFrame([(1, "the quick brown fox jumps")], DOC)
    cut = truncate(token_counts(one, PIECES), one, 3).first()["text"]
    assert "the quick brown fox jumps".startswith(cut) and len(library.encode(cut)) <= 3


def test_encoder_is_the_library():
    library, encoder, rand = Tokenizer.from_file(BYTES[0]), Encoder(*BYTES), random.Random(2)
    parts = ["a", "'s", " ", "\n", "\t", " b", "\xa0", "é", "中", "12", "\x1c", "..", "½", "<|endoftext|>", "\r\n", "  "]
    for _ in range(3000):
        text = "".join(rand.choice(parts) for _ in range(rand.randint(0, 12)))
        assert encoder.ids(text) == np.asarray(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing(spark):
    docs = spark.createDataFrame([(k, " ".join(prose(k, 1 + k * 37 % 900))) for k in range(120)] + EDGES, DOC)
    rows = pack(docs, *BYTES, capacity=256, with_ids=True).collect()
    encoder = Encoder(*BYTES)
    whole = defaultdict(list)
    for i, t in docs.collect():
        whole[i].append(encoder.ids(t or "") + b"\0\0\0\0")
    parts = defaultdict(list)
    for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["start"])):
        parts[r["doc_id"]].append(r)
    for i, own in parts.items():
        if len(whole[i]) == 1:
            assert b"".join(bytes(r["ids"]) for r in own) == whole[i][0]
            assert all(r["length"] == 256 for r in own[1:]) and [r["piece"] for r in own] == list(range(len(own)))
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(places) <= 1.02 * sum(r["length"] for r in rows) / 256 + 2
    assert pack(empty(spark), *BYTES).count() == 0


def test_plan_covers_the_histogram():
    rand = random.Random(4)
    wanted = {k: rand.randint(1, 50) for k in rand.sample(range(1, 2049), 300)}
    found = defaultdict(int)
    for content, times in plan(dict(wanted), 2048, rounds=40):
        assert sum(k * n for k, n in content.items()) <= 2048
        for k, n in content.items():
            found[k] += n * times
    assert found == wanted


@pytest.mark.parametrize("pieces", [150, 1000, 8000])
def test_the_program_places_nearly_all_pieces_at_every_size(monkeypatch, pieces):
    rand, left = random.Random(pieces), []
    histogram = Counter(min(2047, int(rand.lognormvariate(5.5, 1.2)) + 1) for _ in range(pieces))
    monkeypatch.setattr(packing, "best_fit", lambda rest, capacity: left.append(sum(rest.values())) or best_fit(rest, capacity))
    groups = plan(dict(histogram), 2048, rounds=64)
    placed = Counter()
    for content, times in groups:
        assert sum(k * n for k, n in content.items()) <= 2048
        placed.update({k: n * times for k, n in content.items()})
    bound = sum(k * n for k, n in histogram.items()) / 2048
    assert placed == histogram and left[0] <= 0.05 * pieces and sum(t for _, t in groups) <= bound * 1.01 + 2


def test_bounded_knapsack_is_exact():
    rand = random.Random(8)
    for _ in range(30):
        lengths = np.array(sorted(rand.sample(range(1, 30), 6)))
        room, prices = np.array([rand.randint(1, 3) for _ in lengths]), np.array([rand.random() for _ in lengths])
        found = packing.bounded_configuration(lengths, room, prices, 40)
        choices = itertools.product(*[range(n + 1) for n in room])
        best = max(sum(p * c for p, c in zip(prices, x)) for x in choices if sum(c * k for c, k in zip(x, lengths)) <= 40)
        assert (found <= room).all() and found @ lengths <= 40 and found @ prices == pytest.approx(best)


def test_quality(spark):
    good, bad = lambda k: " ".join(prose(k, 60)) + ".", lambda k: "!!! ".join(prose(k, 60)).upper()
    docs = spark.createDataFrame([(k, bad(k) if k % 4 == 0 else good(k)) for k in range(400)] + [(1000, ""), (1001, None), (None, good(7))], DOC)
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(300)] + [(3, None)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in quality_scores(docs, labels).collect()}
    assert len(rows) == 403 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    assert all(rows[k]["predicted"] == int(k % 4 > 0) for k in range(400)) and not rows[None]["held_out"]
    kept = keep_good(docs, labels)
    assert kept.columns == ["doc_id", "text"] and {r["doc_id"] for r in kept.collect()} >= {k for k in range(400) if k % 4}
    assert {r["score"] for r in quality_scores(docs, labels.where("false")).collect()} == {0.5}
    assert quality_scores(empty(spark), labels).count() == 0
    assert isotonic(np.arange(4), np.array([0.1, 0.5, 0.3, 0.9]), np.ones(4)).tolist() == pytest.approx([0.1, 0.4, 0.4, 0.9])


def jaccard(a: str, b: str) -> float:
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def classes(n: int, linked) -> list[int]:
    top = list(range(n))
    for a in range(n):
        for b in range(a):
            if linked(a, b):
                low, high = sorted((top[a], top[b]))
                top = [low if t == high else t for t in top]
    return top


def near_copies():
    rows, base = [], prose(9, 80)
    for k in range(60):
        words, rand = list(base), random.Random(k)
        for _ in range(k % 5):
            words[rand.randrange(80)] = f"new{k}"
        rows.append((k, " ".join(words)))
    return rows + [(100 + k, " ".join(prose(50 + k, 40))) for k in range(20)] + [(200, " ".join(base)), (201, "short text")]


def test_jaccard_join_is_exact(spark):
    rows = near_copies()
    like = lambda a, b: rows[a][1] == rows[b][1] or jaccard(rows[a][1], rows[b][1]) >= 0.8
    top = classes(len(rows), like)
    found = {r["doc_id"]: r for r in jaccard_join(spark.createDataFrame(rows, DOC)).collect()}
    for k, (i, _) in enumerate(rows):
        assert found[i]["class_id"] == min(rows[j][0] for j in range(len(rows)) if top[j] == top[k])
        assert found[i]["n_links"] == sum(like(k, j) for j in range(len(rows)) if j != k)
    kept = one_of_each(spark.createDataFrame(rows, DOC))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({found[i]["class_id"] for i, _ in rows})


def test_jaccard_join_edges(spark):
    found = jaccard_join(edge_frame(spark)).collect()
    assert len(found) == len(EDGES) and {r["class_id"] for r in found if r["doc_id"] in (1, 2)} == {1}
    assert one_of_each(edge_frame(spark)).count() == 5 and jaccard_join(empty(spark)).count() == 0
    assert one_of_each(edge_frame(spark)).columns == edge_frame(spark).columns
    depth = prefix_depth(0.8)
    assert 1 - (1 - 0.8**depth) ** 16 >= 0.9999 > 1 - (1 - 0.8 ** (depth + 1)) ** 16


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind: str, value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    total = sum(sum(divmod(int(c) * (1 + n % 2), 10)) for n, c in enumerate(reversed(digits)))
    return kind == "email" or 12 <= len(digits) <= 19 and total % 10 == 0


def test_personal_data_is_exact(spark):
    parts = ["a", "b@", "@", ".c", ".com", "_", "-", "1", " ", "+1", "(", "5555", "4111 1111 1111 1111", "+49 30 ", "123456789", "255.", "256.", "1.2.3.4", "é", "🎉", "\n"]
    rand = random.Random(3)
    rows = [(k, "".join(rand.choice(parts) for _ in range(rand.randint(0, 25)))) for k in range(800)]
    rows += [(900, None), (901, "1" * 9000), (902, "1 " * 9000), (903, "a@b" + ".c" * 20000), (904, "x@y.z " * 900)]
    found = {r["doc_id"]: r for r in personal_data(spark.createDataFrame(rows, DOC)).collect()}
    for i, text in rows:
        spans = sorted((m.start(), n, m.end()) for n, k in enumerate(PLAIN) for m in re.finditer(PLAIN[k], text or "") if passes(k, m[0]))
        assert [found[i][f"n_{k}"] for k in PLAIN] == [sum(s[1] == n for s in spans) for n in range(4)]
        told = ",".join(f"{list(PLAIN)[n]}:{a}:{b}" for a, n, b in spans)
        assert found[i]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
    assert personal_data(edge_frame(spark)).count() == len(EDGES) and personal_data(empty(spark)).count() == 0


def test_disclosing_terms(spark):
    rows = [(k, f"Zorgblat met ann@x.com at place{k} filler") for k in range(5)] + [(20 + k, f"plain words here place filler {k}") for k in range(40)] + [(80, "Zorgblat alone")]
    spans = {r["doc_id"]: r["spans"] for r in personal_data(spark.createDataFrame(rows, DOC)).collect()}
    assert spans[0] == "term:0:8,email:13:22" and spans[80] == "term:0:8" and spans[20] == ""
    clean = {r["doc_id"]: r["text"] for r in sanitised(spark.createDataFrame(rows, DOC)).collect()}
    assert "Zorgblat" not in clean[0] and "[email]" in clean[0] and clean[21] == rows[6][1]


def test_disclosing_terms_are_those_of_brute_force(spark):
    """Names that go with an address in most of its documents, short ones too, among documents with common words."""
    rand, rows = random.Random(21), []
    for k in range(600):
        words = prose(k, 30)
        if k % 3 == 0:
            person = k // 3 % 20
            words += [f"p{person}@x.com", ("Li", "Kim", "Eva", "Zorgblat")[person] if person < 4 else f"Name{chr(97 + person)}"]
        if k % 50 == 1:
            words.append("Kim")
        rand.shuffle(words)
        rows.append((k, " ".join(words)))
    letters = [set(w for w in re.split(r"[^A-Za-z]+", re.sub(PLAIN["email"], " ", t)) if w) for _, t in rows]
    entities = [set(m[0] for m in re.finditer(PLAIN["email"], t)) for _, t in rows]
    n, wanted = len(rows), set()
    for e in set().union(*entities):
        has = [k for k in range(n) if e in entities[k]]
        for t in set().union(*[letters[k] for k in has]):
            both, of_t = sum(t in letters[k] for k in has), sum(t in x for x in letters)
            if both >= 3 and math.log2(both * n / (of_t * len(has))) / -math.log2(len(has) / n) >= 0.9:
                wanted.add(t)
    docs = _keyed(spark.createDataFrame(rows, DOC), "doc_id", "text")
    found = {r["term"] for r in disclosing_terms(docs, base_spans(docs)).collect()}
    assert found == wanted and {"Li", "Eva", "Zorgblat"} <= found and len(found) >= 19


def test_licenses(spark):
    mit = next(t for k, t in KNOWN if k == "MIT")
    rows = [(1, mit.upper().replace("<year>", "2020")), (2, "Prose.\nReleased under the  MIT LICENSE!\nLicensed under CC BY-NC 4.0"), (3, mit + " and more"), (4, None), (4, None)]
    found = [(r["doc_id"], r["license"], r["n_notices"], r["notices"]) for r in license_scan(spark.createDataFrame(rows, DOC)).orderBy("doc_id").collect()]
    assert found == [(1, "MIT", 0, ""), (2, None, 2, "CC-BY-NC-4.0,MIT"), (3, None, 0, ""), (4, None, 0, ""), (4, None, 0, "")]
    assert license_scan(empty(spark)).count() == 0 and license_scan(edge_frame(spark)).count() == len(EDGES)


def test_wrapped_and_respelled_licences(spark):
    """Each known whole text, wrapped at 60 or 79 columns, with bullets, a copyright line and other spellings."""
    rows, wanted = [], {}
    whole = [(k, t) for k, t in KNOWN if len(t) > 200]
    for n, (name, text) in enumerate(whole):
        lines = [x for p in text.split("\n\n") for x in [*textwrap.wrap(p, (60, 79)[n % 2]), ""]]
        holder = ("Copyright (c) 2019 A. Holder", "copyright 2001-2020 Some Org.", "(C) 2020 X", "© Y")[n % 4]
        body = "\n".join(["# " + x if n % 3 == 0 else x for x in (holder, *lines)])
        rows.append((n, body.replace("license", "licence").replace('"', "''") if n % 2 else body))
        wanted[n] = name
    found = {r["doc_id"]: r["license"] for r in license_scan(spark.createDataFrame(rows, DOC)).collect()}
    assert found == wanted
    more = spark.createDataFrame([("X-1.0", "My own licence: do as you like."), ("X-2.0", None)], "license string, text string")
    mine = license_scan(spark.createDataFrame([(1, "My own license\nDo as you like")], DOC), more=more).first()
    assert mine["license"] == "X-1.0"


def test_clauses_and_repeated_names_of_licences(spark):
    text = "Terms\n(a) Give a copy;\n(c) You must retain, in the Source form of any Derivative Works,\nall notices; and\n(d) more."
    more = spark.createDataFrame([("T-1.0", text), ("MIT-alias", next(t for k, t in KNOWN if k == "MIT"))], "license string, text string")
    ways = [textwrap.fill(text, w) for w in (20, 34, 60)] + [text, "(c) 2001 H\n" + text, "Copyright (c) H\n" + text, "(c) Copyright H\n" + text]
    rows = [*enumerate(ways), (90, next(t for k, t in KNOWN if k == "MIT"))]
    found = {r["doc_id"]: r["license"] for r in license_scan(spark.createDataFrame(rows, DOC), more=more).collect()}
    assert found == {k: "T-1.0" for k in range(7)} | {90: "MIT,MIT-alias"}
    assert license_scan(spark.createDataFrame(rows, DOC), more=more).count() == 8


def test_nearest_is_exact(spark):
    rand = np.random.default_rng(5)
    v = rand.normal(size=(400, 16)).astype(np.float32)
    v[100:160] = v[100]
    rows = [(k, [float(x) for x in v[k]]) for k in range(400)]
    odd = [(500, None), (520, [0.0] * 16), (540, [float("nan")] + [1.0] * 15), (560, [None] + [1.0] * 15), (None, [1.0] * 16), (1, rows[1][1]), (580, [1.0, 2.0])]
    got = defaultdict(list)
    for r in nearest(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).orderBy("rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 400, 20))
    for q, found in got.items():
        scores = v.astype(float) @ v[q].astype(float)
        best = [k for k in np.lexsort((np.arange(400), -scores)) if k != q][:20]
        assert [s for _, s in found] == pytest.approx(scores[best].tolist(), abs=1e-12)
        assert {k for k, _ in found} == set(best) or scores[best[-1]] == pytest.approx(found[-1][1])
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def line_jaccard(a: str, b: str) -> float:
    x, y = ({t[k : k + 8] for k in range(max(1, len(t) - 7))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_line_dedup(spark):
    lines = [" ".join(prose(k, 20)) for k in range(30)]
    near = [x.replace(x.split()[3], "changed", 1) for x in lines[:10]]
    rows = [(k, "\n".join([lines[k], "", lines[(k * 7) % 30], near[k % 10]])) for k in range(30)]
    all_lines = [(k, n, x) for k, t in rows for n, x in enumerate(t.split("\n")) if x.strip()]
    top = classes(len(all_lines), lambda a, b: line_jaccard(all_lines[a][2], all_lines[b][2]) >= 0.8)
    kept = {min(all_lines[j][:2] for j in range(len(all_lines)) if top[j] == c) for c in set(top)}
    found = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, DOC)).collect()}
    for k, text in rows:
        assert found[k] == "\n".join(x for n, x in enumerate(text.split("\n")) if not x.strip() or (k, n) in kept)


def test_line_dedup_compares_whole_lines_beyond_the_basic_plane(spark):
    faces, tail = "😀" * 20, "abcdefghijklmnopqrst"
    lines = ["😀😀😀😀A", "😀😀😀😀B", faces + tail, faces + tail[::-1], "\ufeff" + "𠀀" * 9 + tail * 3, "\ufeff" + "𠀀" * 9 + tail * 3 + "!", tail * 3 + "🎉", tail * 3]
    top = classes(len(lines), lambda a, b: line_jaccard(lines[a], lines[b]) >= 0.8)
    kept = {min(j for j in range(len(lines)) if top[j] == c) for c in set(top)}
    found = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(list(enumerate(lines)), DOC)).collect()}
    assert len(kept) < len(lines) and found == {k: x if k in kept else "" for k, x in enumerate(lines)}


@pytest.mark.parametrize("size", [10, 20, 40])
def test_line_bands_reach_the_stated_recall(spark, size):
    """Pairs of ``size`` distinct shingles each, of similarity 0.8 or little more, meet in a band."""
    rand, pairs = random.Random(size), 4000
    rows = []
    for k in range(pairs):
        line = "".join(rand.choices("abcdefghijklmnopqrstuvwxyz", k=size + 7))
        cut = size // 9  # so many shingles differ on each side, as the lines differ in their last characters
        rows += [(2 * k, line), (2 * k + 1, line[: len(line) - cut] + "0" * cut)]
    lines = spark.createDataFrame(rows, "key long, line string")
    met = _members(_signed(lines.withColumn("place", F.col("key")))).select("band", F.floor(F.col("key") / 2).alias("pair")).groupBy("band", "pair").count().where("count = 2")
    likeness = (size - size // 9) / (size + size // 9)
    missed = pairs - met.select("pair").distinct().count()
    assert missed <= pairs * (1 - likeness**3) ** 8 + 4 * (pairs * (1 - likeness**3) ** 8) ** 0.5


def test_line_dedup_of_a_large_group_of_variants(spark):
    """Lines with random changes of one line: most are similar to some other line, many of them not to the line itself."""
    rand, base = random.Random(5), prose(77, 40)
    lines = {" ".join(base)}
    while len(lines) < 1500:
        words = list(base) if rand.random() < 0.7 else rand.choice(sorted(lines)[:40]).split(" ")
        for _ in range(rand.randint(1, 8)):
            words[rand.randrange(len(words))] = rand.choice(WORDS)
        lines.add(" ".join(words))
    lines = sorted(lines)
    sets = [{x[k : k + 8] for k in range(len(x) - 7)} for x in lines]
    top, links = list(range(len(lines))), []

    def find(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for a in range(len(lines)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
                top[find(a)] = find(b)
    signed = _signed(spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "key long, line string").withColumn("place", F.col("key"))).cache()
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "key long, line string").withColumn("place", F.col("key"))
    found = {r["node"]: r["component"] for r in _united(frame, signed, 0.8).collect()}
    same = sum(a in found and found[a] == found.get(b) for a, b in links)
    assert len(links) > 5000 and same >= 0.95 * len(links), (same, len(links))
    assert all(find(a) == find(b) for a, b in found.items())


def test_line_dedup_loses_no_link_of_a_band(spark):
    """Of lines that agree in a band, in groups far larger than those compared pair by pair, each link stays within a component, and
    no other line comes in."""
    rand, base = random.Random(9), prose(78, 40)
    lines = {" ".join(base)}
    while len(lines) < 300:
        words = list(base) if rand.random() < 0.5 else rand.choice(sorted(lines)[:40]).split(" ")
        for _ in range(rand.randint(1, 8)):
            words[rand.randrange(len(words))] = rand.choice(WORDS)
        lines.add(" ".join(words))
    lines = sorted(lines)
    sets = [{x[k : k + 8] for k in range(len(x) - 7)} for x in lines]
    frame = spark.createDataFrame(list(enumerate(lines)), "key long, line string").withColumn("place", F.col("key"))
    signed = _signed(frame).cache()
    bands = {r["key"]: set(r["bands"]) for r in signed.collect()}
    links = [(a, b) for a in range(300) for b in range(a) if bands[a] & bands[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    found = {r["node"]: r["component"] for r in _united(frame, signed, 0.8).collect()}
    lost = [(a, b) for a, b in links if a not in found or found[a] != found.get(b)]
    assert len(links) > 400 and not lost, (len(links), len(lost))
    known = classes(300, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert all(known[a] == known[b] for a, b in found.items())


def test_line_dedup_makes_few_more_pairs_than_links(spark, monkeypatch):
    """Of a large group of variants hardly a pair is made that isn't a link."""
    rand, base = random.Random(11), prose(79, 40)
    lines = {" ".join(base)}
    while len(lines) < 300:
        words = list(base) if rand.random() < 0.5 else rand.choice(sorted(lines)[:40]).split(" ")
        for _ in range(rand.randint(1, 8)):
            words[rand.randrange(len(words))] = rand.choice(WORDS)
        lines.add(" ".join(words))
    lines, made = sorted(lines), []
    sets = [{x[k : k + 8] for k in range(len(x) - 7)} for x in lines]
    links = sum(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a in range(300) for b in range(a))

    def kept(df, label, *more):
        found = stash(df, label, *more)
        if label in ("cells", "pairs"):
            made.append(found.count())
        return found

    monkeypatch.setattr(line_dedup, "stash", kept)
    dedup_lines(spark.createDataFrame(list(enumerate(lines)), DOC)).count()
    assert made and 0 < sum(made) <= links, (made, links)


def test_line_dedup_edges(spark):
    frame = edge_frame(spark)
    found = dedup_lines(frame, count=True)
    assert found.columns == [*frame.columns, "n_lines", "n_dropped"] and found.count() == len(EDGES)
    assert {r["text"] for r in found.where("doc_id = 4").collect()} == {"same text here"} and dedup_lines(empty(spark)).count() == 0


def test_decontamination(spark):
    items = [(k, " ".join(prose(700 + k, 12 + 3 * k))) for k in range(8)] + [(50, ""), (51, None)]
    docs = [(k, " ".join(prose(800 + k, 120))) for k in range(40)]
    for k in range(8):
        words = docs[k][1].split()
        docs[k] = (k, " ".join(words[: 10 * k] + items[k][1].split() + words[10 * k :]))
    words = items[7][1].split()
    docs.append((60, " ".join(prose(1, 50) + words[:10] + ["other"] + words[11:] + prose(2, 50))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(spark.createDataFrame(docs, DOC), bench).collect()}
    assert found == {(k, k) for k in range(8)} | {(60, 7)}
    assert without_contaminated(spark.createDataFrame(docs, DOC), bench).count() == 32
    assert contaminated(empty(spark), bench).count() == 0 and contaminated(edge_frame(spark), bench.where("false")).count() == 0
    assert without_contaminated(edge_frame(spark), bench).count() == len(EDGES)


def test_decontamination_finds_all_verbatim_items(spark):
    rand = random.Random(11)
    topics = [[f"t{k}x{j}" for j in range(40)] for k in range(200)]
    topic = lambda n: rand.choices(rand.choice(topics), k=n)
    items = [topic(40) for _ in range(400)] + [[f"m{rand.randrange(1500)}" for _ in range(rand.randint(6, 11))] for _ in range(2000)]
    docs = [(k, " ".join(topic(rand.randint(20, 60)) + item + topic(rand.randint(20, 60)))) for k, item in enumerate(items)]
    base = [f"b{k}" for k in range(20)]
    items.append(base)
    docs.append((9000, " ".join(topic(50) + base[:5] + ["other"] * 5 + base[10:] + topic(50))))  # three quarters, with the answer
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(spark.createDataFrame(docs, DOC).repartition(8), bench).collect()}
    lost = {(k, k) for k in range(2400)} | {(9000, 2400)}
    lost -= found
    assert not lost, len(lost)


def test_archives_round_trip(spark):
    rows = [(1, "u a", "x\r\n\r\nWARC/1.1"), (2, None, None), (3, "http://x", ""), (None, "http://y", "x\r\n\r\nWARC/1.1"), (4, "http://q", "x\r\n\r\nWARC/1.1"), (5, "http://z\n", "é中")]
    found = archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r["page_id"]: r for r in found}
    for i, _, body in rows:
        data = (body or "").encode()
        assert (by[i]["payload_bytes"], by[i]["payload_digest"]) == (len(data), payload_digest(data))
    told = {i: (r["record_type"], r["refers_to"]) for i, r in by.items()}
    assert told == {1: ("revisit", 4), None: ("revisit", 4), 4: ("response", None), 2: ("revisit", 3), 3: ("response", None), 5: ("response", None)}
    assert archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def arc_bytes(version: int, records: list[tuple[str, bytes]], fields: str | None = None) -> bytes:
    about = f"{version} 0 test\n{fields or ARC_FIELDS[version]}\n".encode()
    middle = b"" if version == 1 else b"200 - - 0 file.arc "
    found = b"filedesc://file.arc 0.0.0.0 20240101000000 text/plain " + middle + str(len(about)).encode() + b"\n" + about + b"\n"
    for url, block in records:
        found += url.encode() + b" 1.2.3.4 20200229235959 text/html " + middle + str(len(block)).encode() + b"\n" + block + b"\n"
    return found


def test_arc_files_of_both_versions_and_broken_ones():
    block = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>\n\n"
    for version in (1, 2):
        data = arc_bytes(version, [("http://a", block), ("dns:a", b"1.2.3.4")])
        for packed in (gzip.compress(data), b"".join(gzip.compress(data[k : k + 40]) for k in range(0, len(data), 40))):
            kinds = [(r["kind"], r["block"]) for r in arc_records(packed)]
            assert kinds[1:] == [("response", block), ("resource", b"1.2.3.4")] and kinds[0][0] == "warcinfo"
    with pytest.raises(ValueError, match="shorter"):
        list(arc_records(gzip.compress(arc_bytes(1, [("http://a", block)])[:-9])))
    with pytest.raises(ValueError, match="unknown ARC version"):
        list(arc_records(gzip.compress(arc_bytes(1, [], "URL Archive-length"))))
    with pytest.raises(ValueError, match="does not fit"):
        list(arc_records(gzip.compress(arc_bytes(2, []) + b"http://a 1.2.3.4 5\nhello\n")))


def test_warc_files_are_members_and_wrong_digests_are_found(spark, tmp_path):
    rows = [(k, f"http://u/{k}", "same" if k % 2 else f"page {k}") for k in range(9)]
    arc, warc = f"file://{tmp_path}/arc", f"file://{tmp_path}/warc"
    write_arc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), arc, "page_id", "url", "html")
    arc_to_warc(spark, arc, warc)
    parts = [p.read_bytes() for p in sorted((tmp_path / "warc").glob("part-*"))]
    heads = [h for p in parts for h, _ in warc_records(p)]
    assert sorted(h["warc-type"] for h in heads if h["warc-type"] != "warcinfo") == ["response"] * 6 + ["revisit"] * 3
    assert all(next(iter(warc_records(p)))[0]["warc-type"] == "warcinfo" for p in parts if p)
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "x").write_bytes(gzip.compress(gzip.decompress(parts[0]).replace(b"page", b"pagE")))
    with pytest.raises(Exception, match="differs from what is stored"):
        read_warc(spark, f"file://{bad}").collect()


def test_archives_with_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (3, "u", "y" * 2_000_000)], "page_id long, url string, html string")
    wide = frame.withColumn("record", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("id", F.lit(3)).withColumn("page", F.lit(4))
    found = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in archive_pages(wide).collect()}
    assert found == {1: ("revisit", 2, 1), 2: ("response", None, 1), 3: ("response", None, 2_000_000)}


def test_filters_with_clashing_columns_and_null_ids(spark):
    """All that return the input's columns: names that operators use inside don't matter, and rows without an id can go."""
    frame, labels = edge_frame(spark), spark.createDataFrame([(k, 0) for k in range(1, 40)], "doc_id long, quality int")
    for kept in (dedup_lines(frame), one_of_each(frame), keep_good(frame, labels), without_contaminated(frame, frame.select(F.lit(1).alias("item_id"), "text").where("false")), sanitised(frame)):
        assert kept.columns == frame.columns and kept.count() <= len(EDGES)
    assert without_contaminated(frame, frame.select(F.lit(1).alias("item_id"), "text").where("false")).count() == len(EDGES)
    text = " ".join(prose(900, 30))
    docs = spark.createDataFrame([(None, "a b c " + text), (None, "x y z"), (1, text), (2, "nothing here")], DOC)
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert [r["doc_id"] for r in without_contaminated(docs, bench).collect()] == [2]
    bad = spark.createDataFrame([(k, "!!! ".join(prose(k, 40)).upper()) for k in range(40)] + [(None, "!!! ".join(prose(77, 40)).upper())], DOC)
    assert keep_good(bad, labels).where("doc_id IS NULL").count() == 0
    assert sanitised(spark.createDataFrame([(None, "mail a@b.cd now"), (1, None), (1, None), (2, "")], DOC)).where("doc_id IS NULL").first()["text"] == "mail [email] now"
    assert sanitised(empty(spark)).count() == 0


def test_sums_in_two_steps(spark):
    def parts(batches):
        for batch in batches:
            yield pd.DataFrame({"k": [0, 1], "row": [np.ones(3).tobytes(), np.full(3, float(len(batch))).tobytes()]}).astype({"k": "int32"})

    rows = spark.range(0, 300, 1, 150).mapInPandas(parts, "k int, row binary")
    found = {r["k"]: np.frombuffer(bytes(r["row"])).tolist() for r in summed(rows, "row").collect()}
    assert found == {0: [150.0] * 3, 1: [300.0] * 3}


def test_normal_equations_and_isotonic_fit(spark):
    draw = np.random.default_rng(3)
    x, y = draw.normal(size=(500, len(STATISTICS))), draw.integers(0, 2, 500)
    fourier = FourierMap(x.mean(axis=0), x.std(axis=0), features=20)
    gram, target = normal_equations(spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y)], "x array<double>, y int").repartition(7), fourier)
    z = fourier(x)
    assert np.allclose(gram, z.T @ z) and np.allclose(target, z.T @ y)
    means, weights = draw.random(7), draw.integers(1, 5, 7).astype(float)
    fit = isotonic(np.arange(7), means, weights)
    grid = np.linspace(0, 1, 21)
    cost = lambda v: (weights * (v - means) ** 2).sum()
    best = {g: 0.0 for g in grid}  # the least cost of the places so far whose last value is at most g
    for m, w in zip(means, weights):
        run, found = math.inf, {}
        for g in grid:
            run = min(run, best[g] + w * (g - m) ** 2)
            found[g] = run
        best = found
    assert (np.diff(fit) >= -1e-12).all() and cost(fit) <= min(best.values()) + 1e-9


def test_every_operator_is_registered():
    names = catalog.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(catalog.oracle_sql()) <= set(names)


def test_python_gets_few_texts_at_once(spark, monkeypatch):
    before, most = spark.conf.get(BATCH_ROWS), {}

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [len(batch)]})

    found = stash(spark.range(0, 1000, 1, 1).mapInPandas(sizes, "n long"), "sizes", 100).collect()
    assert max(r["n"] for r in found) == 100 and sum(r["n"] for r in found) == 1000 and spark.conf.get(BATCH_ROWS) == before

    def kept(df, label, rows=None):
        most[label] = rows
        return stash(df, label, rows)

    monkeypatch.setattr(quality, "stash", kept)
    monkeypatch.setattr(packing, "stash", kept)
    docs = spark.createDataFrame([(k, " ".join(prose(k, 30))) for k in range(20)], DOC)
    quality_scores(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert most == {"statistics": 500, "pieces": 500}
