"""The operators against brute force, on rows with every kind of trouble."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from revtally.llm import blocks as B
from revtally.llm import byte_bpe, chat, common, components, html_density, jaccard_trie, mixing, perplexity, sharding, suffix_dedup, toxicity, vector_graph
from revtally.llm.common import ship, word_count

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Columns named like those that operators add.
CLASH = {"n_words": 1, "kept": "x", "size": "y", "ids": 2, "node": 3, "class": 4, "slot": 5, "shard": 6, "taken": 7, "n_removed": 8}


def prose(rng, n):
    return " ".join("".join(rng.choice(["ka", "to", "mi", "re", "sol", "un", "der", "è"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus():
    rng = random.Random(5)
    passage = prose(rng, 80)
    rows = []
    for k in range(60):
        rows.append((k, prose(rng, rng.randint(12, 200)), rng.choice(["en", "fr"]), f"s{k % 4}"))
    for k in range(60, 75):  # near copies
        words = rows[k % 5][1].split()
        words[rng.randrange(len(words))] = "other"
        rows.append((k, " ".join(words), "en", "s0"))
    rows += [(75, rows[3][1], "en", "s0"), (76, rows[3][1].upper(), None, None)]
    rows += [(k, f"{prose(rng, 20)} {passage}\n{prose(rng, 9)}", "fr", "s1") for k in range(77, 83)]
    rows += [(83, "", "en", "s2"), (84, None, "en", "s2"), (85, " \n\t", None, "s9"), (86, "one two three", "en", "s1")]
    rows += [(87, "a" * 5000, "en", "s1"), (88, "loop me " * 900, "en", "s1"), (89, prose(rng, 9000), "en", "s1")]
    rows += [(90, "\x00   🙂👍🏽 日本語 <|endoftext|> </s> \x85x", "en", "s3"), rows[7], rows[7], (None, None, None, None)]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    return rows.withColumns({k: F.lit(v) for k, v in CLASH.items()})


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 20_000)
    monkeypatch.setattr(B, "PART", 5_000)


def by_row(rows):
    """Rows as a multiset."""
    return Counter(tuple(r) for r in rows)


def test_word_count(docs):
    got = docs.select("text", word_count(F.col("text"))).collect()
    assert all(n == len(WORD.findall(t or "")) for t, n in got)


# --- quality rules


def base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def kneser_ney(rows, order):
    """Log probabilities of a document's symbols, the plain way."""
    by_lang = defaultdict(Counter)
    for _, text, lang, _, _ in rows:
        for word in WORD.findall(text or ""):
            s = perplexity.FIRST + word + perplexity.LAST
            for i in range(1, len(s)):
                by_lang[lang][s[max(0, i - order + 1) : i + 1]] += 1
    models = {}
    for lang, top in by_lang.items():
        level = {order: {g: n for g, n in top.items() if len(g) == order}}
        for k in range(order - 1, 0, -1):
            level[k] = dict(Counter(g[1:] for g in level[k + 1]))
            level[k] |= {g: n for g, n in top.items() if len(g) == k}
        p = {"": 1 / len(level[1])}
        for k in range(1, order + 1):
            n = [sum(c == j for c in level[k].values()) for j in range(5)]
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
            d = [0, *(min(max(j - (j + 1) * y * n[j + 1] / n[j], 0), j) if n[1] and n[j] else j / 2 for j in (1, 2, 3))]
            context = defaultdict(list)
            for g, c in level[k].items():
                context[g[:-1]].append(c)
            for g, c in level[k].items():
                own = context[g[:-1]]
                rest = sum(d[min(x, 3)] for x in own) / sum(own)
                p[g] = (c - d[min(c, 3)]) / sum(own) + rest * p[g[1:]]
        models[lang] = p
    return models


def test_quality_rules(docs):
    order = 4
    models = kneser_ney(ROWS, order)
    got = perplexity.judge(perplexity.score(docs, order)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text)
        total, symbols = 0.0, 0
        for word in WORD.findall(r.text or ""):
            s = perplexity.FIRST + word + perplexity.LAST
            for i in range(1, len(s)):
                total += np.log(models[r.lang][s[max(0, i - order + 1) : i + 1]])
                symbols += 1
        if symbols:
            assert r.perplexity == pytest.approx(np.exp(-total / symbols), rel=1e-5)
        else:
            assert r.perplexity is None and not r.kept
        if r.kept:
            assert not r.base_failed and r.low <= r.perplexity <= r.high
    fine = [r for r in got if not r.base_failed]
    assert sum(r.kept for r in fine) > 0.7 * len(fine)
    assert not [r for r in fine if not r.kept and r.low <= r.perplexity <= r.high]


def test_band_rejects_what_reads_unlike_its_language(spark):
    ship(spark)
    rng = random.Random(2)
    rows = [(k, prose(rng, 300), "en") for k in range(80)]
    rows += [(100, " ".join("".join(rng.choice("qzxjvw") for _ in range(5)) for _ in range(300)), "en")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    kept = {r.doc_id: r.kept for r in perplexity.judge(perplexity.score(df)).collect()}
    assert not kept.pop(100) and all(kept.values())


def ordered_prose(rng, n):
    """Words whose endings choose the beginnings of the next words."""
    begin, end = ["kan", "top", "mir", "res", "sol", "und", "der", "bel"], ["ure", "ilo", "ast", "eny", "omi", "ugs", "ark", "iva"]
    at, out = 0, []
    for _ in range(n):
        last = rng.randrange(8)
        out.append(begin[at] + rng.choice(["", "a", "er", "in", "o"]) + end[last])
        at = (3 * last + rng.choice([0, 1])) % 8
    return " ".join(out)


def test_band_rejects_junk_among_ordinary_words(spark):
    """Symbols behind words, a menu with bars, shuffled words, and a text that only its own
    counts make ordinary."""
    ship(spark)
    rng = random.Random(4)
    rows = [(k, prose(rng, 400), "en") for k in range(120)]
    rows += [(200, " ".join(w + rng.choice(["%%%", "&&&", "###", "$$$", "***"]) for w in prose(rng, 400).split()), "en")]
    rows += [(201, " | ".join(prose(rng, 400).split()), "en")]
    own = ["".join(rng.choice("qzxjvwyg") for _ in range(6)) for _ in range(300)]
    rows += [(202, " ".join(rng.choice(own) for _ in range(3000)), "en")]
    ordered = [(300 + k, ordered_prose(rng, 400), "fr") for k in range(120)]
    shuffled = ordered[0][1].split()
    rng.shuffle(shuffled)
    rows += [*ordered, (500, " ".join(shuffled), "fr")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    got = {r.doc_id: r for r in perplexity.judge(perplexity.score(df)).collect()}
    assert not [k for k in (200, 201, 202, 500) if got[k].base_failed or got[k].kept]
    assert got[500].perplexity == pytest.approx(got[300].perplexity)
    assert sum(r.kept for k, r in got.items() if k not in (200, 201, 202, 500)) >= 234


def test_op2_writes_no_text_beside_its_blocks(spark, docs, tmp_path, monkeypatch):
    """What is scored is written once; with the texts in it, it took half of the allowed disk."""
    from revtally.llm import queries

    ship(spark)
    docs.limit(20).write.parquet(f"{tmp_path}/documents.parquet")
    written = {}
    monkeypatch.setattr(perplexity, "saved", lambda df, name: written.setdefault(name, df.columns) and common.saved(df, name))
    assert queries.QUERIES["op2_ngram_perplexity"](spark, str(tmp_path)).count() == 20
    assert "doc_id" in written["scored"] and "text" not in written["scored"]


def test_shuffles_are_dropped_after_a_write(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle")}

    df = spark.range(10_000).groupBy((F.col("id") * 7).alias("k")).count()
    before = files()
    with common.dropping_shuffles(spark):
        assert common.saved(df, "dropped").count() == 10_000
    dropped = files() - before
    assert common.saved(df, "again").count() == 10_000
    assert len(files() - before) > len(dropped)


def test_words_and_joins_of_a_block():
    texts = ["  a\tbb\x0b\x0ca\n", None, "", "\u00a0x\u0085 \u3000 \U0001f600bb\x1cc a", "a bb"]
    got = perplexity.units(pa.table({"lang": ["en", "en", None, "en", None], "text": texts}))
    for lang, rows in (("=en", (0, 1, 3)), ("?", (2, 4))):
        words = [(k, w) for k in rows for w in WORD.findall(texts[k] or "")]
        joins = [(k, f"{v[-2:]} {w[:2]}") for (j, v), (k, w) in zip(words, words[1:]) if j == k]
        for name, wanted in ((lang, words), (perplexity.joins_of(lang), joins)):
            distinct, row, which = got[name]
            assert [(r, distinct[k].as_py()) for r, k in zip(row.tolist(), which.tolist())] == wanted
            assert len(set(distinct.to_pylist())) == len(distinct)


@pytest.mark.parametrize("times", [3, 1 << 40])
def test_sums_of_pairs(times):
    row, place = np.array([5, 0, 5, 1 << 20]), np.array([7, 1, 7, 3])
    got = perplexity._summed(row, place, np.array([1, 2, times, 4]))
    assert [x.tolist() for x in got] == [[0, 5, 1 << 20], [1, 7, 3], [2, 1 + times, 4]]


# --- n-gram Jaccard join


def jaccard_classes(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), links[i], least.get(find(i))) for i, r in enumerate(rows)]


@pytest.mark.parametrize("piece", [1 << 20, 600])
def test_jaccard_join(docs, monkeypatch, piece):
    monkeypatch.setattr(jaccard_trie, "PIECE", piece)
    got = jaccard_trie.join(docs).select("doc_id", "n_shingles", "n_links", "component_id").collect()
    assert by_row(got) == by_row(jaccard_classes(ROWS))


def test_one_of_each_component(docs):
    classes = jaccard_classes(ROWS)
    got = jaccard_trie.one_of_each(docs)
    assert got.columns == docs.columns
    expected = Counter(c[3] for c in classes if c[2] == 0) + Counter({c[3] for c in classes if c[2]})
    assert Counter(r.doc_id for r in got.collect()) == expected


def test_tree_matches(monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(80)]
    sets += [np.delete(s, 0) for s in sets[:20] if len(s) > 1]
    sizes = np.array([len(s) + 1 for s in sets])
    tree = jaccard_trie.Tree(sets, sizes, 60)
    for s, n in zip(sets, sizes):
        want = [k for k, o in enumerate(sets) if 100 * len(np.intersect1d(s, o)) >= 60 * (n + sizes[k] - len(np.intersect1d(s, o)))]
        assert sorted(tree.matches(s, int(n), 60).tolist()) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7), (-5, -9)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 300: 100, -5: -9, -9: -9}


# --- repeated passages


def cleaned(rows, length=200):
    raw = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, raw):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((gone[1:] < gone[:-1]).sum())
        out.append((r[0], len(t), len(t) - len(kept), spans, kept))
    return out


@pytest.mark.parametrize("gathered", [4096, 1])
def test_suffix_dedup(docs, gathered):
    got = suffix_dedup.deduplicate(docs, gathered=gathered).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert by_row((*r[:4], bytes(r[4])) for r in got) == by_row(cleaned(ROWS))


def test_merge_of_transforms():
    rng = np.random.default_rng(1)
    shards, strings = [], []
    for _ in range(4):
        own = [rng.integers(0, 2, rng.integers(6, 40)).astype(np.uint8) for _ in range(3)]
        strings += own
        shards.append((np.concatenate(own), np.array([len(s) for s in own], np.uint32), np.ones(3, np.uint8)))
    got = suffix_dedup.repeated_passages(shards, 6, 3)
    seen = Counter(bytes(s[i : i + 6]) for s in strings for i in range(len(s) - 5))
    want = [i + 6 <= len(s) and seen[bytes(s[i : i + 6])] > 1 for s in strings for i in range(len(s))]
    assert got.tolist() == want and any(want) and not all(want)


# --- mixing


def test_mixing(docs):
    sized = mixing.sized(docs).select("doc_id", "source", "size", "n_words")
    got = mixing.mix(sized).collect()
    assert len(got) == len(ROWS)
    total = defaultdict(int)
    for r in ROWS:
        total[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in full)
        level = {s: rest * weight[s] / max(sum(weight[x] for x in names if x not in full), 1) for s in names if s not in full}
        over = {s for s, v in level.items() if v > 3 * total[s]}
        if not over:
            break
        full |= over
    target = {s: 3 * total[s] if s in full else level[s] for s in names}
    taken = Counter()
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in range(0, 3 * r.size + 1) and r.taken == r.epochs * r.size
        taken[r.source] += r.taken
    longest = {s: max([len(WORD.findall(r[1] or "")) for r in ROWS if r[3] == s]) for s in names}
    for s in names:
        assert abs(taken[s] - target[s]) <= longest[s]
    again = mixing.mix(sized.repartition(3)).collect()
    assert by_row(got) == by_row(again)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    mixed = mixed.collect()
    assert len(mixed) == sum(r.epochs for r in got) and {r.taken for r in mixed} == {CLASH["taken"]}


# --- sharding


def test_sharding(docs):
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumns({"size": F.octet_length(text) + 16, "text_crc32": F.crc32(text), "text_hash": F.xxhash64(text)})
    got = sharding.balanced_shards(rows, sharding.equal_text_links(rows), 7).collect()
    assert len(got) == len(ROWS)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.text_crc32 == zlib.crc32((r.text or "").encode())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 7


def test_sharding_keeps_groups_together(spark):
    rows = spark.createDataFrame([(k, k // 5) for k in range(400)], "doc_id long, g long")
    links = rows.selectExpr("doc_id as src", "g * 5 as dst")
    got = sharding.balanced_shards(rows, links, 8).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.g].add(r.shard)
    cut = sum(len(s) - 1 for s in groups.values())
    assert cut < 40  # of 320
    assert set(Counter(r.shard for r in got).values()) == {50}


def test_sharding_spares_small_groups_beside_a_large_one(spark):
    first = [(k, 0 if k < 800 else 800 + (k - 800) // 4 * 4 if k < 2000 else k) for k in range(2400)]
    rows = spark.createDataFrame(first, "doc_id long, g long")
    links = rows.selectExpr("doc_id as src", "g as dst")
    got = sharding.balanced_shards(rows, links, 12).collect()
    assert set(Counter(r.shard for r in got).values()) == {200} and len({(r.shard, r.slot) for r in got}) == 2400
    groups = defaultdict(set)
    for r in got:
        groups[r.g].add(r.shard)
    cut = sum(len(s) - 1 for g, s in groups.items() if 800 <= g < 2000)
    assert cut < 30, cut  # of 900, all avoidable


# --- chat


def test_chat_round_trip(spark):
    hostile = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "<\\|im_end|>\\", "a\\nb", "", None, "[/INST]\n", "x" * 50_000, "<<SYS>> </s><\\\\/s>"]
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(hostile)]
    rows += [(2, 0, "a\nb\\n\\c<|im_end|>", "t"), (2, 0, "user", "tie"), (2, 0, "user", "tie"), (None, None, None, None), (3, 1, "assistant", "only"), (4, 0, "user", "no reply")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("last", F.lit(1)).withColumn("turns", F.lit("x"))
    got = chat.examples(df).select("conv_id", "example", "last", "text", "loss_start", "loss_chars", chat.read_turns(F.col("text")).alias("turns"), chat.read_loss(F.col("text"), F.col("loss_start"), F.col("loss_chars")).alias("loss")).collect()
    want = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[conv].append((role or "", text or ""))
    for conv, turns in want.items():
        own = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.example)
        assert [tuple(t) for t in own[-1].turns] == turns and own[-1].last
        ends = [k + 1 for k, t in enumerate(turns) if t[0] == "assistant" or k == len(turns) - 1]
        assert [[tuple(t) for t in r.turns] for r in own] == [turns[:e] for e in ends]
        assert [r.loss for r in own] == [turns[e - 1][1] if turns[e - 1][0] == "assistant" else "" for e in ends]
        for r in own:
            inside = r.text.split("<|im_end|>\n")
            assert inside[-1] == "" and len(inside) == len(r.turns) + 1
            assert "[INST]" not in r.text and "</s>" not in r.text


# --- byte-level BPE


def test_bpe_is_the_library_s(docs):
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    assert set(docs.columns) <= set(got.columns)
    for r in got.collect():
        assert r.ids == library.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids)
        assert bytes(r.decoded) == (r.text or "").encode()


def test_bpe_pieces_of_all_lengths():
    with open(RANKS, "rb") as file:
        ranks = byte_bpe.Ranks(file.read())
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks.rank, special_tokens={})
    rng = random.Random(3)
    pieces = ["".join(rng.choice("abcdeilnorst ") for _ in range(n)) for n in (*range(1, 140), 1000)] + ["a" * 700, "ab" * 65]
    for piece, ids in zip(pieces, ranks.encode([p.encode() for p in pieces])):
        assert ids.tolist() == library.encode_ordinary(piece)


# --- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><a href=1>one</a></nav>
<div class="cookie-notice">We use cookies, and say so at length, with many words in this notice.</div>
<div id=wrap><div class="ad">Buy this now, it is a very good thing to buy, as you will surely see.</div>
<article><h2>A  title</h2><p>First &amp; foremost, a <b>long</b> paragraph
of text that says something.<p>Second&nbsp;paragraph, unclosed, with a <a href=x>link</a> in it.</p><p>Ok.</p></article>
<div class="comments"><p>A reader comments at length on all that has been said in this article above.</p></div></div>
<aside>Side matters that go on for a while</aside><form><p>Name <input></p></form><footer>&copy; somebody</footer></body></html>"""


def test_pages(spark):
    ship(spark)
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (3, "u", ""), (4, "u", "<p"), (5, "u", "a < b &lt; c"), (6, "u", "<div>" * 3000 + "deep"), (7, "u", "<script>x")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x")})
    got = html_density.extract(df).collect()
    texts = sorted((r.page_id, r.text) for r in got)
    article = "A title\nFirst & foremost, a long paragraph of text that says something.\nSecond paragraph, unclosed, with a link in it.\nOk."
    assert texts == [(1, article), (2, ""), (3, ""), (3, ""), (4, "<p"), (5, "a < b < c"), (6, "deep"), (7, "")]
    assert all(r.n_chars == len(r.text) for r in got)


def test_article_text_beside_the_densest_container():
    def p(word, n=25):
        return f"<p>{word} " + "letters " * n + "</p>"

    div = f"<div>{p('one')}{p('two')}{p('three')}</div>"
    pages = [
        (f"<article><h1>Head lines</h1><p>A standfirst of some sixty characters, which says a little.</p>{div}</article>", ["Head lines", "A standfirst"]),
        (f"<div id=x><h1>Head lines</h1>{div}<section>{p('four', 8)}{p('five', 8)}</section><section><p>six</p></section></div>", ["Head lines", "four", "five", "six"]),
        (f"<main><h1>Head lines</h1>{div}<table>{''.join(f'<tr><td>row{k}<td>{k}' for k in range(200))}</table></main>", ["Head lines", "row0", "row199"]),
    ]
    links = "<div><ul>" + "".join(f"<li><a href=x>elsewhere {k} on this site</a>" for k in range(60)) + "</ul></div>"
    for body, wanted in pages:
        for more in ("", links):
            text = html_density.main_text(f"<html><body>{body}{more}</body></html>")
            assert not [w for w in [*wanted, "one", "two", "three"] if w not in text]
            assert "elsewhere" not in text


def unnamed_pages():
    """Pages without a class name, and what of them is the article."""

    def p(n):
        return "<p>" + " ".join(["words of the article"] * n) + "</p>"

    article = f"<h1>The headline of it</h1>{p(9)}{p(14)}{p(6)}"
    notice, advert = "<div>We use cookies on this site, accept all of them now.</div>", "<div>Buy this thing now, only 9.99!</div>"
    links = "<div>" + "".join(f"<a href=x>elsewhere {k}</a> " for k in range(30)) + "</div>"
    for page in (
        f"{notice}<div>{article}</div>{advert}",
        f"<div>{notice}<div>{article}</div>{advert}{links}</div>",
        f"{links}<div><div>{notice}</div><div><div>{article}</div></div></div>{advert}",
        f'<form id="aspnetForm"><input type=hidden><div>{notice}<div>{article}</div></div><input></form>',
        f"<div>{article}</div><form><div>Name <input></div><div>Password <input></div></form>",
    ):
        yield page, ["The headline of it", *(" ".join(["words of the article"] * n) for n in (9, 14, 6))]


def test_density_chooses_the_article(monkeypatch):
    pages = list(unnamed_pages())
    for page, want in pages:
        assert html_density.main_text(f"<html><body>{page}</body></html>").split("\n") == want
    measure = html_density._measure

    def zeroed(root):
        nodes = measure(root)
        for node in nodes:
            node.density = 0.0
        return nodes

    monkeypatch.setattr(html_density, "_measure", zeroed)
    changed = [html_density.main_text(f"<html><body>{page}</body></html>").split("\n") != want for page, want in pages]
    assert sum(changed) >= 4


def test_names_weigh_and_do_not_cut():
    text = "<p>" + "a sentence of the article " * 8 + "</p>"
    kept = html_density.main_text(f'<article><div class="article-header"><h1>Headline</h1></div>{text}{text}</article>')
    assert kept.startswith("Headline\n")
    whole = html_density.main_text(f'<div class="page with-sidebar sidebar"><div><h1>Headline</h1>{text}{text}</div></div>')
    assert whole.split("\n")[0] == "Headline" and len(whole.split("\n")) == 3
    less = html_density.main_text(f"<article>{text}<div class=ad>Buy this thing now</div>{text}<div class=comments><p>A comment of a reader on this.</p></div></article>")
    assert len(less.split("\n")) == 2 and "Buy" not in less and "reader" not in less


def test_densities_by_plain_recursion():
    rng = random.Random(2)

    def page(depth):
        if depth == 0 or rng.random() < 0.2:
            words = prose(rng, rng.randint(1, 30))
            return f"<p>{words}</p>" if rng.random() < 0.7 else f"<p>{words} <a href=x>{prose(rng, 3)}</a></p>"
        name = rng.choice(["", "", "", " class=ad", " class=story"])
        return f"<div{name}>" + "".join(page(depth - 1) for _ in range(rng.randint(1, 4))) + "</div>"

    for _ in range(40):
        root, _ = html_density.parse(f"<body>{page(4)}{page(3)}</body>")

        def figures(node):
            """Characters, of these linked, tags, of these links; own figures are there before they are added up."""
            own = [node.chars, node.link_chars, node.tags, node.link_tags]
            for kid in node.kids:
                own = [a + b for a, b in zip(own, figures(kid))]
            plain[id(node)] = own
            return own

        plain = {}
        figures(root)
        chars, linked, *_ = plain[id(root)]
        for node in html_density._measure(root):
            c, lc, t, lt = plain[id(node)]
            assert [node.chars, node.link_chars, node.tags, node.link_tags] == [c, lc, t, lt]
            low, up = node.named, node.parent
            while up:
                low, up = low or up.named, up.parent
            base = np.log(c / max(c - lc, 1) * max(lc, 1) + linked / max(chars, 1) * c + np.e) if c else 0
            ratio = np.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1)) / np.log(base) if c else 0
            assert np.isclose(node.density, c / max(t, 1) * ratio * (html_density.LOW if low else 1))


# --- embeddings


def test_vector_graph(spark):
    ship(spark)
    rng = np.random.default_rng(0)
    base_, rows = rng.normal(size=(300, 16)), []
    for k, v in enumerate(base_):
        rows.append((k, v.tolist(), k % 2))
    for k in range(300, 420):
        rows.append((k, (base_[k % 40] + rng.normal(size=16) * 0.05).tolist(), (k % 40) % 2))
    rows += [(500, base_[1].tolist(), 1), (500, base_[1].tolist(), 1), (501, base_[1].tolist(), None), (502, None, 1), (503, [0.0] * 16, 1), (504, [float("nan")] * 16, 1), (505, [None] * 16, 1), (506, [], 1), (507, [1.0, 2.0], 1), (None, base_[2].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1))
    got = vector_graph.near_duplicates(df).collect()
    assert len(got) == len(rows)
    valid = [k for k, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = Counter()
    for i in valid:
        for j in valid:
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                links[i] += 1
    found, true = Counter(), Counter()
    for r in got:
        found[r.vec_id] += r.n_links
    for i, n in links.items():
        true[rows[i][0]] += n
    assert all(found[k] <= true[k] for k in found)
    assert sum(found.values()) >= 0.9 * sum(true.values()) > 0
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


# --- toxicity


@pytest.mark.parametrize("at_a_time", [1, 3, 50_000])
def test_features_are_those_of_the_ngrams_of_each_text(monkeypatch, at_a_time):
    monkeypatch.setattr(perplexity, "_AT_A_TIME", at_a_time)
    texts = ["Straße in b", None, "", "b b \x0b an\x0c", "漢字 e\u0301 \U0001f600!", "in\u00a0b \x02 \x03"]

    def grams(text):
        marked = [perplexity.FIRST + w.decode() + perplexity.LAST for w in (text or "").lower().encode().split()]
        return {w[max(0, end - toxicity.ORDER) : end] for w in marked for end in range(2, len(w) + 1)}

    expected = set()
    for k, text in enumerate(texts):
        keys = perplexity.gram_keys("", sorted(grams(text))) if grams(text) else np.zeros(0, np.uint64)
        expected |= {(k, int(key) % toxicity.BUCKETS) for key in keys}
    text, bucket = toxicity.text_features(texts)
    assert list(zip(text.tolist(), bucket.tolist())) == sorted(expected)
    chosen = np.array(sorted({b for _, b in expected})[::2])
    text, place = toxicity.text_features(texts, chosen)
    assert {(k, int(chosen[p])) for k, p in zip(text.tolist(), place.tolist())} == {(k, b) for k, b in expected if b in chosen}


def test_toxicity_finds_held_out_rows(spark):
    ship(spark)
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(600):
        words = prose(rng, 60).split()
        toxic = k % 5 == 0
        if toxic:
            for term in rng.sample(["idiot", "scum", "moron", "vejute", "vejutar"], rng.randint(1, 3)):
                words[rng.randrange(60)] = term
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs_ = spark.createDataFrame([*rows, (None, None), (700, "")], "doc_id long, text string")
    known = spark.createDataFrame([*labels[:400], (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs_, toxicity.fit(docs_, known)).collect()}
    assert len(got) == 602
    wrong = sum(got[k].toxic != bool(t) for k, t in labels[400:])
    assert wrong <= 4
    assert not got[None].toxic and not got[700].toxic
    assert got[5].p_insult + got[5].p_veiled > 0.5


# --- empty tables


def test_empty_tables(spark):
    ship(spark)
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert perplexity.judge(perplexity.score(none)).count() == 0
    assert jaccard_trie.join(none).count() == 0
    assert suffix_dedup.deduplicate(none).count() == 0
    assert mixing.mix(mixing.sized(none)).count() == 0
    assert byte_bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0
    text = {"size": F.lit(0), "text_crc32": F.lit(0), "text_hash": F.lit(0)}
    assert sharding.balanced_shards(none.withColumns(text), sharding.equal_text_links(none.withColumns(text)), 4).count() == 0
    assert chat.examples(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0
    assert html_density.extract(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0
    assert vector_graph.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    models = toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(none, models).count() == 0


# --- pipeline


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as pipeline

    out, names = {}, [name for name, _ in pipeline.STAGES]
    for name, stage in pipeline.STAGES:
        stage_out = stage(spark, docs, None)
        assert name == names[-1] or stage_out.columns == docs.columns
        out[name] = stage_out.collect()  # before the next stage removes what this one reads
    kept = perplexity.judge(perplexity.score(docs)).filter("kept").select("doc_id").collect()
    assert Counter(r.doc_id for r in out[names[0]]) == Counter(r.doc_id for r in kept)
    texts = {(r[0], r[4].decode(errors="ignore")) for r in cleaned(ROWS)}
    got = out[names[2]]
    assert {(r.doc_id, r.text or "") for r in got} == texts and len(got) == len(ROWS)
    assert all(r.text is None or r.n_chars == len(r.text) for r in got) and {r.kept for r in got} == {CLASH["kept"]}
    digests = Counter(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in ROWS)
    assert Counter(r.decoded_sha256 for r in out[names[4]]) == digests
