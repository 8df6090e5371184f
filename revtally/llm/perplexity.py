"""Quality rules with an n-gram perplexity band per language.

The model is a modified Kneser-Ney model over the symbols of words (code points between two word
marks), one per language. Spark counts the n-grams of all documents; the probabilities end up in
sorted arrays of hashes, one per range of the hash space. Blocks of documents ask these ranges for
the n-grams they hold and score their words with the answers, so the model may be of any size: it
is never in one place. A document's perplexity is that of its words.

A second model of the same kind, per language, holds the joins of words: the last symbols of a word,
a blank, and the first symbols of the next word, which it predicts. So n-grams run over word bounds.

Four measures are held against bands, and a document outside of any is rejected, as are those
failing the base rules: the perplexity per symbol; per symbol and per word without the document's own
counts; per join without the document's own counts. Per symbol, predictable junk hides among many
symbols; per word it doesn't. Own counts are taken out of an n-gram and of its context, not out of the
lower orders, which count distinct symbols.

A band reaches from `below` to `above` robust standard deviations around the median of the measure's
logarithm over all documents of the language that meet the base rules; for a short text, whose
perplexity varies more, the band is wider. Median and deviation come from an exact count of
documents per ten-thousandth, which is the same at every size. `low` and `high` are the tightest
limits of the four, each moved by how far the measure is from the perplexity per symbol, so that
the perplexity lies between them if all measures lie in their bands.

Defined results: a null text has no words and fails the base rules; a null language is a language
of its own; a document without words has no perplexity (null); repeated rows count repeatedly; an
empty table gives an empty result; other columns are carried along, those named like an added one
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import hashing as H
from .common import collecting, dropping_shuffles, remove, saved, set_aside

ORDER = 5
#: Robust standard deviations.
BELOW, ABOVE = 4.0, 4.0
#: Least width of a band on either side of the median, as a log perplexity.
LEAST = 0.05
#: Symbols from which on a text's perplexity is steady; bands are wider for shorter texts, by the
#: square root.
STEADY = 3000
#: The same for measures per word or join.
STEADY_WORDS = 500
#: Marks before and after a word.
FIRST, LAST = "\x02", "\x03"
#: Base rules.
MIN_WORDS, MAX_REPEATED, WINDOW = 10, 20, 5
#: Symbols of a join on either side of the blank.
SIDE = 2
_SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
_STEPS = 10_000


def language(rows: pa.Table) -> list[str]:
    """The language of each row; null is told apart from every name."""
    if "lang" not in rows.column_names:
        return ["?"] * rows.num_rows
    return ["?" if x is None else "=" + x for x in rows.column("lang").to_pylist()]


#: Words whose n-grams are worked out at a time.
_AT_A_TIME = 50_000
#: Pairs of sides of words that are numbered in a table, not by their hashes.
_TABLE = 1 << 22


def _salt(lang: str) -> np.uint64:
    """A number for each language, by which the keys of its n-grams differ from others'."""
    raw = np.frombuffer(lang.encode(), dtype=np.uint8)
    return H.spans(H.prefix_sums(raw), np.zeros(1, np.int64), np.array([len(raw)]))[0]


def _codes(words: pa.Array) -> np.ndarray:
    """The code points of words, one word after another."""
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    raw = memoryview(data)[offsets[0] : offsets[-1]]
    return np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), dtype=np.uint32)


def ngrams(words: pa.Array, lang: str, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The n-grams that predict each symbol of each word and its end, some words at a time: their
    keys, the code points with marks, sums for hashes of these, where the n-grams begin and end."""
    salt = _salt(lang)
    for at in range(0, len(words), _AT_A_TIME):
        part = words.slice(at, _AT_A_TIME)
        sizes = _per_word(part)
        begins = np.cumsum(sizes + 1) - sizes - 1
        codes = np.empty(int((sizes + 1).sum()), np.uint32)
        inside = np.ones(len(codes), bool)
        for place, mark in ((begins, FIRST), (begins + sizes, LAST)):
            codes[place] = ord(mark)
            inside[place] = False
        codes[inside] = _codes(part)
        end = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begins, sizes) + 1
        start = np.maximum(np.repeat(begins, sizes), end - order + 1)
        sums = H.code_point_sums(codes)
        yield H.mixed(H.spans(sums, start, end + 1) ^ salt), codes, sums, start, end + 1


def _per_word(words: pa.Array) -> np.ndarray:
    """How many n-grams each word has: its symbols and its end."""
    return pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1


def joins_of(lang: str) -> str:
    """The name under which the joins of a language's words are counted."""
    return "+" + lang


#: Words (or joins) of a block, and for each of its rows their numbers, one row after another.
Units = tuple[pa.Array, np.ndarray, np.ndarray]


def _numbered(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values, and which one each is."""
    coded = values.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of texts, the text of each occurrence, and which one it is."""
    split = pc.ascii_split_whitespace(texts)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    found = pc.list_flatten(split)
    there = pc.not_equal(found, pa.scalar("", found.type))
    words, which = _numbered(found.filter(there))
    return words, row[there.to_numpy(zero_copy_only=False)], which


def _joins(words: pa.Array, row: np.ndarray, which: np.ndarray) -> Units:
    tails, tail = _numbered(pc.utf8_slice_codeunits(words, -SIDE))
    heads, head = _numbered(pc.utf8_slice_codeunits(words, 0, SIDE))
    at = np.flatnonzero(row[1:] == row[:-1])
    width = max(len(heads), 1)
    pairs = tail[which[at]].astype(np.int64) * width + head[which[at + 1]]
    if len(tails) * width <= _TABLE:
        seen = np.zeros(len(tails) * width, bool)
        seen[pairs] = True
        distinct, place = np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[pairs]
    else:
        place, distinct = pd.factorize(pairs)
    joined = pc.binary_join_element_wise(tails.take(pa.array(distinct // width)), heads.take(pa.array(distinct % width)), pa.scalar(" ", tails.type))
    return joined, row[at], place.astype(np.int32)


def units(rows: pa.Table) -> dict[str, Units]:
    """By language, and by joins_of(language): the distinct words or joins of a block, the row of
    each occurrence, and which one it is."""
    texts = pc.fill_null(rows.column("text").cast(pa.large_string()), "")
    of_row, langs = pd.factorize(np.array(language(rows), dtype=object))
    out: dict[str, Units] = {}
    for k, lang in enumerate(langs):
        own = np.flatnonzero(of_row == k).astype(np.int32)
        words, row, which = _words(pa.concat_arrays(texts.take(pa.array(own)).chunks))
        row = own[row]
        out[lang] = words, row, which
        out[joins_of(lang)] = _joins(words, row, which)
    return out


def count(blocks: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n): how often each n-gram predicts a symbol, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload"):
                for lang, (words, _, which) in units(B.unpacked(payload.as_py())).items():
                    times, each, done = np.bincount(which, minlength=len(words)), _per_word(words), 0
                    for keys, codes, _, start, end in ngrams(words, lang, order):
                        here = slice(done, done + _AT_A_TIME)
                        done += _AT_A_TIME
                        place, first, distinct = _places(keys)
                        total = np.bincount(place, weights=np.repeat(times[here], each[here]), minlength=len(distinct))
                        # equal n-grams of other words are added up by Spark
                        text = codes.tobytes()
                        grams = [text[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(start[first].tolist(), end[first].tolist())]
                        columns = [pa.array([lang] * len(distinct), pa.string()), pa.array(grams, pa.string()), pa.array(total.astype(np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])

    return blocks.select("payload").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _tail(gram: str) -> Column:
    return F.substring(F.col(gram), F.lit(2), F.char_length(gram))


#: What the model has for an n-gram.
FIGURES = np.dtype([(name, np.float32) for name in ("n", "taken", "total", "rest", "shorter")])


def fit(counts: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n, taken, total, rest, shorter) for every counted n-gram. Its last symbol's
    probability after the others, with modified Kneser-Ney smoothing, is (n - taken) / total +
    rest * shorter."""
    counts = saved(counts, "ngrams")
    size = F.char_length("gram")
    levels = {order: counts.filter(size == order).select("lang", "gram", "n")}
    for k in range(order - 1, 0, -1):
        # an n-gram at a word's beginning keeps its count, others get the number of symbols before them
        before = levels[k + 1].groupBy("lang", _tail("gram").alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels[k] = saved(before.union(counts.filter(size == k)), f"level{k}") if k > 1 else before
    symbols = levels[1].groupBy("lang").agg(F.count(F.lit(1)).alias("_symbols"))
    lower = levels[1].select("lang", "gram").join(symbols, "lang").select("lang", F.lit("").alias("gram"), (1 / F.col("_symbols")).alias("p")).distinct()
    parts = []
    for k in range(1, order + 1):
        rows = levels[k].withColumn("_c", F.expr("substring(gram, 1, char_length(gram) - 1)")).withColumn("_k", F.least("n", F.lit(3)))
        n = {j: F.count_if(F.col("n") == j) for j in (1, 2, 3, 4)}
        seen = rows.groupBy("lang").agg(*[n[j].alias(f"_n{j}") for j in n])
        y = F.try_divide(F.col("_n1"), F.col("_n1") + 2 * F.col("_n2"))
        discount = [
            F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(float(j)), j - F.try_divide((j + 1) * y * F.col(f"_n{j + 1}"), F.col(f"_n{j}")))), F.lit(j / 2)).alias(f"_d{j}")
            for j in (1, 2, 3)
        ]
        discounts = seen.select("lang", *[F.when((F.col("_n1") > 0) & (F.col(f"_n{j}") > 0), d).otherwise(F.lit(j / 2)).alias(f"_d{j}") for j, d in zip((1, 2, 3), discount)])
        total = rows.groupBy("lang", "_c").agg(F.sum("n").alias("_total"), *[F.count_if(F.col("_k") == j).alias(f"_m{j}") for j in (1, 2, 3)])
        context = total.join(discounts, "lang").withColumn("_rest", sum(F.col(f"_d{j}") * F.col(f"_m{j}") for j in (1, 2, 3)) / F.col("_total"))
        taken = F.when(F.col("_k") == 1, F.col("_d1")).when(F.col("_k") == 2, F.col("_d2")).otherwise(F.col("_d3"))
        shorter = lower.withColumnRenamed("gram", "_g").withColumnRenamed("p", "_p")
        joined = rows.withColumn("_g", _tail("gram")).join(context, ["lang", "_c"]).join(shorter, ["lang", "_g"])
        p = (F.col("n") - taken) / F.col("_total") + F.col("_rest") * F.col("_p")
        figures = [F.col("n"), taken.alias("taken"), F.col("_total").alias("total"), F.col("_rest").alias("rest"), F.col("_p").alias("shorter")]
        level = saved(joined.select("lang", "gram", p.alias("p"), *figures), f"p{k}")
        lower = level.select("lang", "gram", "p")
        parts.append(level.drop("p").filter((F.lit(k) == order) | F.col("gram").startswith(FIRST)))
    model = parts[0]
    for part in parts[1:]:
        model = model.union(part)
    return model.filter(F.char_length("gram") > 1).select("lang", "gram", *FIGURES.names)


def gram_keys(lang: str, grams: list[str]) -> np.ndarray:
    """The keys of n-grams of a language."""
    codes = np.frombuffer("".join(grams).encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum([0, *map(len, grams)])
    return H.mixed(H.spans(H.code_point_sums(codes), ends[:-1], ends[1:]) ^ _salt(lang))


def hash_arrays(model: DataFrame, parts: int) -> DataFrame:
    """(part, model_keys, model_values): the model as sorted arrays of hashes with their
    figures, one row per range of the hash space."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch]).to_pandas()
            for lang, group in rows.groupby("lang"):
                keys = gram_keys(lang, group["gram"].tolist())
                part = (keys >> np.uint64(64 - (parts.bit_length() - 1))).astype(np.int32)
                figures = {name: pa.array(group[name].to_numpy(np.float32)) for name in FIGURES.names}
                yield pa.RecordBatch.from_pydict({"part": pa.array(part), "key": pa.array(keys.view(np.int64)), **figures})

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        keys = group["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        values = np.empty(len(keys), FIGURES)
        for name in FIGURES.names:
            values[name] = group[name].to_numpy()[order]
        return pd.DataFrame({"part": [group["part"].iloc[0]], "model_keys": [B.squeezed_keys(keys[order])], "model_values": [B.squeezed(values)]})

    rows = model.mapInArrow(keyed, "part int, key long, " + ", ".join(f"{name} float" for name in FIGURES.names))
    return rows.groupBy("part").applyInPandas(packed, "part int, model_keys binary, model_values binary")


def _asked(rows: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
    found = [_places(keys)[2] for lang, (words, *_) in units(rows).items() for keys, *_ in ngrams(words, lang, order)]
    keys = _distinct(found)
    return keys, np.zeros(len(keys), np.uint8)


def look_up(asked: DataFrame, arrays: DataFrame) -> DataFrame:
    """(block, part, values): figures of the asked n-grams, NaN where there are none."""

    def run(group: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if len(model):
            known, values = B.widened_keys(model["model_keys"].iloc[0]), B.widened(model["model_values"].iloc[0], FIGURES)
        else:
            known, values = np.zeros(1, np.uint64), np.full(1, np.nan, FIGURES)
        out = []
        for keys in map(B.widened_keys, group["keys"]):
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            told = values[at]
            told[known[at] != keys] = np.full(1, np.nan, FIGURES)[0]
            out.append(B.squeezed(told))
        return pd.DataFrame({"block": group["block"], "part": group["part"], "values": out})

    return asked.groupBy("part").cogroup(arrays.groupBy("part")).applyInPandas(run, "block long, part int, values binary")


def base_figures(texts: list[str]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    out = {c: np.zeros(len(texts), np.int64) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])[:-1]
    starts, ends = H.words(data)
    hashes = H.spans(H.prefix_sums(data), starts, ends)
    of_word = np.searchsorted(begins, starts, side="right") - 1
    out["n_words"] = np.bincount(of_word, minlength=len(texts))[: len(texts)].astype(np.int64)
    grams = H.windows(hashes, WINDOW)
    if len(grams):
        doc = of_word[: len(grams)]
        whole = doc == of_word[WINDOW - 1 :]
        at = np.flatnonzero(whole)
        own = H.mixed(grams[at] ^ H.mixed(doc[at].astype(np.uint64)))
        place, _ = pd.factorize(own)
        twice = at[np.bincount(place)[place] > 1]
        edge = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + WINDOW, -1)
        out["n_repeat_words"] = np.bincount(of_word, weights=np.cumsum(edge[:-1]) > 0, minlength=len(texts))[: len(texts)].astype(np.int64)
    for k, text in enumerate(texts):
        out["word_chars"][k] = len(text) - sum(map(text.count, _BLANKS))
        out["n_symbols"][k] = sum(map(text.count, _SYMBOLS))
        if "\n" in text:
            lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
            out["n_dup_lines"][k] = len(lines) - len(set(lines))
    return out


_ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_p double, own_out double, joins_out double, n_predicted long, n_joins long"
#: The probability of an n-gram that the model has never seen.
_UNSEEN = 1e-7


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The distinct keys of all parts, sorted."""
    keys = np.sort(np.concatenate([np.zeros(0, np.uint64), *parts]))
    return keys[_begins(keys)]


def _begins(*sorted_by: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.ones(len(sorted_by[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_by])
    return np.flatnonzero(new)


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the distinct keys each is, where these are first found, and they themselves."""
    place, distinct = pd.factorize(keys)
    first = np.zeros(len(distinct), np.int64)
    first[place[::-1]] = np.arange(len(keys))[::-1]
    return place, first, distinct


def _summed(row: np.ndarray, place: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, place), sorted, and the sums of their times. None of these is negative."""
    if not len(row):
        return row.astype(np.int64), place.astype(np.int64), times
    widths = [int(x.max()).bit_length() for x in (row, place, times)]
    if sum(widths) < 64:
        # sorting one number sorts by all three
        packed = ((row.astype(np.int64) << widths[1]) + place) << widths[2]
        packed += times
        packed.sort()
        times = packed & ((1 << widths[2]) - 1)
        packed >>= widths[2]
        row, place = packed >> widths[1], packed & ((1 << widths[1]) - 1)
    else:
        order = np.lexsort((place, row))
        row, place, times = row[order], place[order], times[order]
    begins = _begins(row, place)
    return row[begins], place[begins], np.add.reduceat(times, begins)


class _Figures:
    """What the model has for the n-grams of a block, once for all of its languages."""

    def __init__(self, figures: np.ndarray):
        # single precision, as they came
        self.n, self.taken, self.total, rest, self.shorter = (np.ascontiguousarray(figures[name]) for name in FIGURES.names)
        self.spared = rest * self.total
        with np.errstate(invalid="ignore", divide="ignore"):
            p = (self.n - self.taken) / self.total + rest * self.shorter
        self.log_p = np.log(np.where(p > 0, p, np.float32(_UNSEEN)))


class _Grams:
    """The n-grams of the words (or joins) of a block."""

    def __init__(self, words: pa.Array, lang: str, order: int):
        self.each, keys, contexts, places = _per_word(words), [], [], []
        for k, _, sums, start, end in ngrams(words, lang, order):
            place, first, distinct = _places(k)
            keys.append(distinct)
            contexts.append(H.spans(sums, start[first], end[first] - 1))
            places.append(place.astype(np.int32))
        if not keys:
            keys, contexts, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        place, first, distinct = _places(np.concatenate(keys))
        context = np.concatenate(contexts)[first]
        # n-grams of one context follow one another
        order_of = np.argsort(context)
        number = np.empty(len(order_of), np.int32)
        number[order_of] = np.arange(len(order_of))
        self.keys, context = distinct[order_of], context[order_of]
        self.context = np.zeros(len(context), np.int32)
        self.context[_begins(context)[1:]] = 1
        self.context = np.cumsum(self.context, dtype=np.int32)
        cuts = np.cumsum([0, *map(len, keys)])
        #: Those of each word, one word after another.
        self.of_words = np.concatenate([number[place[a:b]][p] for a, b, p in zip(cuts, cuts[1:], places)])


class _Scores:
    """Log probabilities of the words (or joins) of a block: by the whole model, and without
    what a row itself has counted."""

    def __init__(self, grams: _Grams, keys: np.ndarray, figures: _Figures, skip: np.ndarray | None):
        self.grams, self.context, self.each = grams.of_words, grams.context, grams.each
        self.begins = np.cumsum(self.each) - self.each
        if skip is not None:
            self.begins, self.each = self.begins + skip, self.each - skip
        self.at = np.searchsorted(keys, grams.keys)
        self.figures = figures
        sums = np.concatenate([[0.0], figures.log_p[self.at][self.grams]])
        np.cumsum(sums, out=sums)
        self.of_word = sums[self.begins + self.each] - sums[self.begins]

    def rows(self, row: np.ndarray, which: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The sums over the rows: by the whole model, and without each row's own counts."""
        row, word, times = _summed(row, which, np.ones(len(row), np.int64))
        whole = np.bincount(row, weights=times * self.of_word[word], minlength=n_rows)
        each = self.each[word]
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - self.begins[word], each)
        row, gram, own = _summed(np.repeat(row, each), self.grams[at], np.repeat(times, each))
        begins = _begins(row, self.context[gram])
        context_own = np.repeat(np.add.reduceat(own, begins), np.diff(begins, append=len(own))) if len(own) else own
        f, at = self.figures, self.at[gram]
        left, total = np.maximum(f.n[at] - own, 0), np.maximum(f.total[at] - context_own, 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            # of few that are left, no more than half are taken
            p = (left - np.minimum(f.taken[at], left / 2)) / total + np.minimum(f.spared[at] / total, 1) * f.shorter[at]
        p = np.where(total > 0, p, f.shorter[at])
        return whole, np.bincount(row, weights=own * np.log(np.where(p > 0, p, _UNSEEN)), minlength=n_rows)


def _scored(rows: pa.Table, got: pd.DataFrame, order: int, carried: list[str]) -> Iterable[pd.DataFrame]:
    held = units(rows)
    grams = {lang: _Grams(words, lang, order) for lang, (words, *_) in held.items()}
    keys = _distinct([g.keys for g in grams.values()])
    figures = _Figures(B.told(got, FIGURES))
    scores = {}
    for lang, (words, *_) in held.items():
        # of a join, what follows the blank is predicted
        skip = _per_word(pc.list_element(pc.split_pattern(words, " "), 0)) if lang.startswith("+") and len(words) else None
        scores[lang] = _Scores(grams.pop(lang), keys, figures, skip)
    first = 0
    for part in B.parts_of(rows):
        last = first + part.num_rows
        frame = part.select(carried).to_pandas(integer_object_nulls=True)
        for name, column in base_figures([t or "" for t in part.column("text").to_pylist()]).items():
            frame[name] = column
        sums = {name: np.zeros(part.num_rows) for name in ("log_p", "own_out", "joins_out", "n_joins")}
        for lang, (_, row, which) in held.items():
            here = slice(*np.searchsorted(row, (first, last)))
            whole, out = scores[lang].rows(row[here] - first, which[here], part.num_rows)
            if lang.startswith("+"):
                sums["joins_out"] += out
                sums["n_joins"] += np.bincount(row[here] - first, minlength=part.num_rows)
            else:
                sums["log_p"] += whole
                sums["own_out"] += out
        frame = frame.assign(**sums, n_predicted=frame["word_chars"] + frame["n_words"])
        frame["n_joins"] = frame["n_joins"].astype(np.int64)
        first = last
        yield frame[[*carried, *(c.split()[0] for c in _ADDED.split(", "))]]


def score(documents: DataFrame, order: int = ORDER, carry: list[str] | None = None) -> DataFrame:
    """The carried columns of documents (all, if not said; lang always) with base figures and the
    log probabilities: log_p, own_out and joins_out (without own counts), n_predicted and n_joins."""
    added = [c.split()[0] for c in _ADDED.split(", ")]
    documents = documents.drop(*added, "base_failed", "perplexity", "low", "high", "kept")
    carry = documents.columns if carry is None else carry
    if "lang" not in documents.columns:
        documents, carry = documents.withColumn("lang", F.lit(None).cast("string")), [*carry, "lang"]
    blocks = B.pack(documents)
    parts = B.ranges(blocks)
    with dropping_shuffles(documents.sparkSession):
        with collecting() as made:
            model = fit(count(blocks, order), order)
        arrays = saved(hash_arrays(model, parts), "arrays")
    remove(documents.sparkSession, made)  # all that led to the arrays
    asked = B.questions(blocks, lambda rows: _asked(rows, order), parts, "uint8")
    answered = look_up(asked, arrays)
    types = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    schema = ", ".join([*(f"{c} {types[c]}" for c in carry), _ADDED])
    return B.meet(blocks, answered, lambda rows, got: _scored(rows, got, order, carry), schema)


def kept_documents(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """The documents that the rules and their language's band leave."""
    rows, restored = set_aside(documents, ("doc_id", "text", "lang"))
    return restored(judge(score(rows, order)).filter("kept"))


def judge(scored: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """scored with base_failed, perplexity, the language's band and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    measures = [("log_p", "n_predicted", STEADY), ("own_out", "n_predicted", STEADY), ("own_out", "n_words", STEADY_WORDS), ("joins_out", "n_joins", STEADY_WORDS)]
    xs = {f"_x{k}": F.when(F.col(n) > 0, -F.col(log_p) / F.col(n)) for k, (log_p, n, _) in enumerate(measures)}
    steadiness = [F.sqrt(F.least(F.col(n), F.lit(steady)) / steady) for _, n, steady in measures]
    with dropping_shuffles(scored.sparkSession):
        rows = saved(scored.withColumn("base_failed", failed).withColumns(xs), "scored")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), F.col(f"_x{k}").alias("_x"), s.alias("_steadiness")) for k, s in enumerate(steadiness)]))
    fine = rows.filter(~F.col("base_failed")).select("lang", each.alias("_m")).select("lang", "_m.*").filter("_x is not null")

    def median(counted: DataFrame, name: str) -> DataFrame:
        bins = saved(counted.groupBy("lang", "_k", F.round(F.col("_x") * _STEPS).cast("long").alias("_x")).agg(F.count(F.lit(1)).alias("_n")), "bins")
        whole = Window.partitionBy("lang", "_k")
        half = bins.withColumn("_upto", F.sum("_n").over(whole.orderBy("_x"))).withColumn("_all", F.sum("_n").over(whole))
        middle = half.filter(F.col("_upto") * 2 >= F.col("_all")).groupBy("lang", "_k").agg((F.min("_x") / _STEPS).alias(name))
        return saved(middle.withColumnRenamed("lang", f"{name}_of").withColumnRenamed("_k", f"{name}_k"), "medians")

    middle = median(fine, "_middle")
    same = F.col("lang").eqNullSafe(F.col("_middle_of")) & (F.col("_k") == F.col("_middle_k"))
    away = fine.join(middle, same).withColumn("_x", F.abs(F.col("_x") - F.col("_middle")) * F.col("_steadiness"))
    spread = median(away, "_spread")
    width = F.col("_spread") * 1.4826
    both = middle.join(spread, F.col("_middle_of").eqNullSafe(F.col("_spread_of")) & (F.col("_middle_k") == F.col("_spread_k")))
    limits = F.struct("_middle", F.greatest(F.lit(LEAST), width * below).alias("below"), F.greatest(F.lit(LEAST), width * above).alias("above"))
    band = both.groupBy(F.col("_middle_of").alias("_lang")).agg(*[F.max(F.when(F.col("_middle_k") == k, limits)).alias(f"_b{k}") for k in range(len(measures))])
    judged = rows.join(saved(band, "bands"), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    # limits of a measure, moved to where the perplexity per symbol is
    moved = [F.col("_x0") - F.col(f"_x{k}") + F.col(f"_b{k}._middle") for k in range(len(measures))]
    low = F.greatest(*[m - F.try_divide(F.col(f"_b{k}.below"), s) for k, (m, s) in enumerate(zip(moved, steadiness))])
    high = F.least(*[m + F.try_divide(F.col(f"_b{k}.above"), s) for k, (m, s) in enumerate(zip(moved, steadiness))])
    judged = judged.withColumn("_low", low).withColumn("_high", high)
    inside = F.coalesce(F.col("_x0").between(F.col("_low"), F.col("_high")), F.lit(False))
    return judged.select(
        *[c for c in rows.columns if c not in (*xs, "log_p", "own_out", "joins_out", "n_predicted", "n_joins")],
        F.exp("_x0").alias("perplexity"),
        F.exp("_low").alias("low"),
        F.exp("_high").alias("high"),
        (~F.col("base_failed") & inside).alias("kept"),
    )
