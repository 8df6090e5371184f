"""Token files, whitening and alignment against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from revtally.llm import alignment, token_files, whitening
from revtally.llm.common import new_path, ship
from revtally.llm.units import ByteLevel, Memo, Pieces, byte_level, units

JSON, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, start string, n_a int, `odd.name` int"


def texts():
    rng = random.Random(3)
    words = ["the", "naïve", "don't", "x_1", "日本語", "🙂👍🏽", "a.b,c", "1234567", "</s>", "<0x0A>", "über-lang", "(see", "[INST]"]
    gaps = [" "] * 12 + ["  ", "\n", "\n\n ", "\t", "  ", "  ", " \x85", "\x1c "]
    made = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    fixed = [None, "", " ", "  two", "tail ", "a", "<|endoftext|>", "x <|endoftext|> y", "a▁b stays out", "▁", "\x00 nul", "é é ´ ﬁ", "a" * 3000, "loop me " * 4000, "​ zero  width"]
    return made + fixed + made[:3]


TEXTS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(None if k == 4 else (k * 7) % 50, t, "carried", k, k) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_units_join_to_the_text_and_encode_as_the_whole():
    library = Tokenizer.from_file(JSON)
    with open(JSON, "rb") as file:
        memo = token_files.unit_memo(file.read())
    for text in filter(None, TEXTS):
        own = units(text)
        assert " ".join(own) == text
        ids, _ = memo.gather(0, memo.look_up([(own[0],), *own[1:]]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_plain_pieces_and_joined_units_are_encoded_as_by_the_library():
    rng = random.Random(11)
    plain = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x250)]] + ["\n", " ", "'s", "'ll", "the", "123"] * 20
    odd = plain + ["\x1c", "\x85", "\xa0", "\u2028", "日", "🙂", "\u0301", "▁"] * 10
    library, pieces = Tokenizer.from_file(JSON), SentencePieceProcessor(model_file=PIECES)
    library.encode_special_tokens = True
    for letters in (plain, odd):
        made = ["".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(4000)]
        for side, encode in ((ByteLevel(library), lambda t: library.encode(t, add_special_tokens=False).ids), (Pieces(pieces), lambda t: pieces.encode(t[1:]))):
            ids, sizes, good = side(made)
            found = np.split(ids, np.cumsum(sizes)[:-1])
            for unit, own, fine in zip(made, found, good):
                want = encode(f" {unit}")
                assert own.tolist() == want and fine == side.keeps(f" {unit}", want)


def test_memo_is_emptied(monkeypatch):
    monkeypatch.setattr("revtally.llm.units.MEMO", 3)
    memo = Memo(lambda new: [(np.array([x for u in new for x in (len(u), 7)]), np.full(len(new), 2), np.ones(len(new), bool))])
    for flat in (["aa", "bbb", "aa"], ["c"], ["bbb", "c"], []):
        ids, sizes = memo.gather(0, memo.look_up(flat))
        assert ids.tolist() == [x for u in flat for x in (len(u), 7)] and sizes.tolist() == [2] * len(flat)


# --- token files


@pytest.fixture(params=["small parts", "default"])
def part_sizes(request, monkeypatch):
    if request.param == "small parts":
        monkeypatch.setattr(token_files, "PART_ROWS", 4)
        monkeypatch.setattr(token_files, "READ_TOKENS", 50)


def expected_files(rows):
    library = Tokenizer.from_file(JSON)
    encoded = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2], n) for i, t, n in rows]
    encoded.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    return encoded


def test_token_files(spark, docs, part_sizes):
    folder = new_path(spark, "files")
    manifest = token_files.write(docs, folder, JSON, end_id=2)
    want = expected_files(docs.select("doc_id", "text", "n_a").collect())
    back = token_files.read(spark, folder)
    assert back.columns == ["doc_id", "n_a", "odd.name", "n_tokens", "start", "ids"]
    got = back.collect()
    ids = {r["n_a"]: np.frombuffer(r["ids"], "<u4").tolist() for r in got}
    assert ids == {n: i for _, i, n in want}
    assert all(r["n_tokens"] == len(ids[r["n_a"]]) for r in got)
    assert manifest.count() > 1
    # ascending ids, no gaps
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [i for i, _, _ in want]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    opened = token_files.TokenFiles(folder)
    assert len(opened) == len(want) and opened.n_tokens == sum(len(i) for _, i, _ in want)
    assert [opened[k].tolist() for k in range(len(opened))] == [ids[r["n_a"]] for r in got]
    assert isinstance(opened.tokens(opened.parts[0]), np.memmap) and opened.tokens(opened.parts[0]).dtype == np.dtype("<u2")
    assert {r["width"] for r in manifest.collect()} == {2}
    with pytest.raises(IndexError):
        opened[len(opened)]


def test_parts_follow_the_order_of_ids_and_split_hot_ones():
    bounds = [None, None, 3, 5, 5, 5, 9]
    top = (1 << 64) - 1
    values = [None, 1, 3, 4, 5, 7, 9, 10]
    spans = [(token_files.part_of(v, 0, bounds), token_files.part_of(v, top, bounds)) for v in values]
    assert spans == [(0, 2), (2, 2), (2, 3), (3, 3), (3, 6), (6, 6), (6, 7), (7, 7)]
    assert token_files.part_of(5, 1 << 63, bounds) == 5 and token_files.part_of("x", 5, []) == 0


def test_token_files_of_nothing(spark, docs):
    folder = new_path(spark, "files")
    assert token_files.write(docs.filter("false"), folder, JSON, end_id=2).count() == 0
    assert token_files.read(spark, folder).collect() == [] and len(token_files.TokenFiles(folder)) == 0


def test_token_files_wide_ids_and_one_hot_document_id(spark, part_sizes):
    ship(spark)
    rows = spark.createDataFrame([("same", f"word {k % 3}") for k in range(40)], "name string, body string")
    folder = new_path(spark, "files")
    token_files.write(rows, folder, JSON, order="name", text_col="body", end_id=70_000)
    got = token_files.read(spark, folder).collect()
    assert Counter(bytes(r["ids"]) for r in got).most_common()[0][1] == 14 and all(np.frombuffer(r["ids"], "<u4")[-1] == 70_000 for r in got)
    assert sorted(r["start"] for r in got) == np.cumsum([0, *[r["n_tokens"] for r in sorted(got, key=lambda r: r["start"])]])[:-1].tolist()


def test_bases_over_more_than_a_group_of_parts(spark):
    parts = spark.range(3000).select(F.col("id").cast("int").alias("part"), (F.col("id") % 7).alias("n_docs"), (F.col("id") % 11).alias("n_tokens"))
    rows = token_files.with_bases(parts).orderBy("part").collect()
    assert [r["first_doc"] for r in rows] == np.cumsum([0, *(k % 7 for k in range(2999))]).tolist()
    assert [r["first_token"] for r in rows] == np.cumsum([0, *(k % 11 for k in range(2999))]).tolist()


# --- whitening


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 64])
def test_eigenvectors(n):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    for spectrum in (rng.random(n) * 9, np.repeat(4.0, n), np.r_[np.repeat(5.0, n // 2), np.repeat(5.0 - 1e-9, n - n // 2)], np.r_[np.zeros(n - 1), 3.0]):
        matrix = q @ np.diag(spectrum) @ q.T
        matrix = (matrix + matrix.T) / 2
        k = min(n, 16)
        values, rows = whitening.eigen(matrix, k)
        assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:k], atol=1e-12)
        assert np.allclose(rows @ rows.T, np.eye(k), atol=1e-12)
        assert np.allclose(matrix @ rows.T, rows.T * values, atol=1e-12)
    values, rows = whitening.eigen(np.diag(np.arange(1.0, n + 1)), 1)  # nothing to reduce
    assert np.allclose(values, n) and np.allclose(np.abs(rows[0]), np.eye(n)[-1])


def test_sturm_counts():
    rng = np.random.default_rng(1)
    d, e = rng.standard_normal(30), rng.standard_normal(29)
    e[11] = 0
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    shifts = np.linspace(-4, 4, 57)
    assert whitening.below(d, e, shifts).tolist() == [(values < s).sum() for s in shifts]


def vectors(d=20, n=300):
    rng = np.random.default_rng(d)
    rows = (rng.standard_normal((n, d)) * np.linspace(2, 0.3, d) + 5).astype(np.float32).tolist()
    rows += [rows[0]] * 100 + [None, [float("nan"), *rows[1][1:]], [float("inf"), *rows[1][1:]], [None, *rows[1][1:]], [], rows[2][:-1], [1e30, *rows[1][1:]]]
    return [(k, v, 1.5, k) for k, v in enumerate(rows)]


def test_whitening(spark):
    ship(spark)
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened double, x int").repartition(6)
    out = whitening.whiten(frame)
    assert out.columns == ["vec_id", "x", *whitening.ADDED]
    got = out.orderBy("vec_id", "component").toPandas()
    good = [(k, v) for k, v, _, _ in rows[:400]]
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in good], dtype=np.int64)
    distinct = np.unique(x, axis=0)
    n, s = len(distinct), distinct.sum(axis=0)
    assert got["vec_id"].tolist() == np.repeat(np.arange(400), 16).tolist() and set(got["n"]) == {n}
    assert got["deviation"].tolist() == np.repeat(((n * x - s) ** 2).sum(axis=1), 16).tolist()
    centred = distinct - s / n
    v = centred.T @ centred / n
    values, columns = np.linalg.eigh(v)
    values, columns = values[::-1][:16], columns[:, ::-1][:, :16]
    want = (x - s / n) @ columns / np.sqrt(values)
    have = got["whitened"].to_numpy().reshape(400, 16)
    signs = np.sign((want * have).sum(axis=0))
    assert np.allclose(have, want * signs, atol=1e-8)
    assert np.allclose(got["explained"].to_numpy().reshape(400, 16), values / np.trace(v))
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9


def test_whitening_without_variance_and_of_nothing(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(frame).collect()
    assert len(got) == 4 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] == 0 and r["identity_error"] is None for r in got)
    assert whitening.whiten(frame.filter("false")).collect() == []
    line = spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(9)], "vec_id long, embedding array<double>")
    got = whitening.whiten(line).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in got) and got[0]["identity_error"] < 1e-9


def test_deviation_beyond_64_bits():
    x, sums = np.array([[2**40, 0], [2**20, 1]]), np.array([0, 0], dtype=object)
    assert whitening.deviations(x, 1, sums) == [None, 2**40 + 1]
    assert whitening.deviations(x, 2**30, sums) == [None, None]


# --- alignment


def plain_alignment(rows):
    """By comparing all tokens of a document."""
    library, pieces = Tokenizer.from_file(JSON), SentencePieceProcessor(model_file=PIECES)
    library.encode_special_tokens = True
    of = byte_level()
    a_bytes = {i: bytes(of[c] for c in e) for e, i in library.get_vocab(with_added_tokens=False).items()}
    b_bytes = lambda i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
    out, docs_of = {}, defaultdict(set)
    for key, text in rows:
        a, b = (library.encode(f" {text}", add_special_tokens=False).ids, pieces.encode(text)) if text else ([], [])
        if not text or b"".join(map(a_bytes.get, a)) != f" {text}".encode() or b"".join(map(b_bytes, b)) != f" {text}".encode():
            out[key] = ([], [], [], "")
            continue
        ends = [np.cumsum([len(a_bytes[i]) for i in a]).tolist(), np.cumsum([len(b_bytes(i)) for i in b]).tolist()]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        found = [[[i for i, e in zip(ids, side) if lo < e <= hi] for ids, side in ((a, ends[0]), (b, ends[1]))] for lo, hi in zip([0, *cuts], cuts)]
        starts = [[0, *side] for side in ends]
        pairs = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(starts[0][i], starts[1][j]) < min(ends[0][i], ends[1][j])] if len(a) < 2000 else None
        out[key] = (a, b, pairs, ";".join("|".join(",".join(map(str, side)) for side in g) for g in found))
        for pair in set(pairs or []):
            docs_of[pair].add(key)
    most = defaultdict(int)
    for (a, _), keys in docs_of.items():
        most[a] = max(most[a], len(keys))
    for key, (a, b, pairs, text) in out.items():
        counts = [len(docs_of[p]) for p in pairs]
        best = sum(c == most[p[0]] for c, p in zip(counts, pairs))
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        yield key, len(a), len(b), text.count(";") + 1 if a else 0, len(pairs), best, sum(counts), digest


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_alignment(spark, docs, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    rows = docs.filter("coalesce(length(text), 0) < 5000")
    out = alignment.align_documents(rows, JSON, PIECES)
    assert out.columns == ["doc_id", "start", "odd.name", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    got = {tuple(r) for r in out.select("`odd.name`", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    assert got == set(plain_alignment(rows.select("`odd.name`", "text").collect()))
    assert {r[1] for r in got} > {0}


def test_alignment_of_a_long_text_and_of_nothing(spark, docs):
    long = alignment.align_documents(docs.filter("length(text) > 5000").select("doc_id", "text"), JSON, PIECES).collect()[0]
    assert long["n_links"] == long["n_a"] + long["n_b"] - long["n_groups"] and long["n_a"] > 8000
    assert alignment.align_documents(docs.filter("false"), JSON, PIECES).collect() == []
    assert alignment.align_documents(docs.filter("text is null").select("doc_id", "text"), JSON, PIECES).drop("doc_id").collect()[0] == (0, 0, 0, 0, "", 0, 0)


def test_groups_by_pointer_jumping():
    rng = random.Random(9)
    for _ in range(200):
        size = rng.randint(1, 40)
        ends = [np.array(sorted({*rng.sample(range(1, size + 1), rng.randint(0, size)), size})) for _ in range(2)]
        a, b = alignment.groups(tuple(ends))
        common = sorted(set(ends[0]) & set(ends[1]))
        want = [[common[np.searchsorted(common, e)] for e in side] for side in ends]
        assert [ends[0][a].tolist(), ends[0][b].tolist()] == want
