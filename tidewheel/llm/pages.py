"""Keyword-stuffed, link-list and tag pages (problem 10).

A page is cut into its blocks (cells and paragraphs); numbers, links, prices and labels are tokens like words. The
rank-frequency curve of the tokens of every block, and of all text of the page that is no program, is fitted with
SQL windows. Its slope, its residual and its divergence (the greatest excess of the cumulative curve) are compared
with those of same-language prose of comparable length; for text with the marks of code or output (numbers, brackets)
the reference moves, in proportion to these marks, to that of the corpus' code and output. A block is spam if its curve is extreme
and its words aren't the language's (hardly any function words), or its divergence is extreme by far, or if links, prices and labels diverge
extremely from their share in prose. A page is spam if such blocks hold most of its text. All references come from the
whole corpus; nothing is learned from labels, and no kind of block is left out.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A word is a function word of a language from this share of its prose; so a language has at most 1 / FUNCTION_SHARE.
FUNCTION_SHARE = 0.012
#: Languages with less than this share of all prose have no own statistics; so there are at most 1 / LANGUAGE_SHARE.
LANGUAGE_SHARE = 0.001
#: A page is spam if more than this share of its text is.
MOST = 0.5
#: Least tokens of a curve; shorter neighbours are read together.
LEAST_TOKENS = 12
#: Share of numbers and marks of code from which text counts as code or output in the reference.
PROGRAM = 0.25
#: Share of prose's function words below which a block's words aren't the language's.
FOREIGN = 0.55
#: Deviations from which slope, residual and divergence are extreme, and from which divergence decides alone.
STEEP, LOOSE, FAR, ALONE = 6.0, 6.0, 7.0, 10.0
#: Relative entropy (nats a token) of links, prices and labels against prose that is extreme, and the least in all.
LISTED, LEAST_NATS = 0.8, 8.0
#: Ranks at which cumulative curves are compared.
RANKS = (1, 2, 4, 8, 16, 32, 64)
LINK, PRICE, LABEL = "<link>", "<price>", "<label>"

# Patterns of notebook text.
_COLOURS = re.compile(r"\x1b\[[0-9;]*m|\[[0-9;]+m")
_MARKER = re.compile(r"\s*(?:#\s*%%.*|In ?\[[^\]]*\]:|Out ?\[[^\]]*\]:|`{3,}.*|~{3,}.*|#\s*out:\s*)$")
_PREFIX = re.compile(r"\s*(?:#+(?:\s+|$))+")
_CODES = ("eur", "usd", "gbp", "jpy", "cny", "chf", "cad", "aud", "inr", "brl", "mxn", "sek", "nok", "dkk", "pln")
_SIGNS = "$€£¥₹₽₩₪฿₫₴₺₦"
_SINGLE = "㐀-鿿぀-ヿ가-힯"
_NUMBER = r"\d+(?:[.,]\d+)*"
#: Tokens of lower-case text: links, quoted addresses, tags, prices, labels, words (a character of scripts without spaces), numbers, marks of code.
_TOKEN = re.compile(
    r"<[a-z/][^<>]*>"
    r"|(?:\]\()?https?://[^\s\"'<>)\]]+"
    r"|[\"']https?://[^\s\"']+[\"']"
    rf"|(?:[{_SIGNS}]|\b(?:{'|'.join(_CODES)})) ?{_NUMBER}"
    r"|(?:^|(?<=\s)|(?<=[^\W\d_]))[#@+](?=[^\W\d_])"
    r"|(?<!\w)\[[^\W\d_]+\](?!\()"
    rf"|[{_SINGLE}]|[^\W\d_{_SINGLE}]+|{_NUMBER}|[()\[\]{{}}=]",
    re.MULTILINE,
)
#: The same where none of _SPECIAL occurs.
_PLAIN = re.compile(rf"[^\W\d_{_SINGLE}]+|[{_SINGLE}]|{_NUMBER}|[(){{}}=]")
_ASCII = re.compile(rf"[a-z]+|{_NUMBER}|[(){{}}=]")
_SPECIAL = (*"<[]#@+" + _SIGNS, "://", *_CODES)
_DATA = re.compile(r"[A-Za-z0-9+/=]{80,}")
#: Invisible characters, and spaces that JSON doesn't take for spaces.
_ODD = dict.fromkeys(map(ord, "\u200b\u200c\u200d\u2060\ufeff")) | dict.fromkeys(map(ord, "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"), " ")
#: First characters of lines that may be markers or have a prefix.
_FIRST = frozenset("#IO`~")


def _texts(x) -> str:
    """All text of a parsed notebook cell, its lines joined and its parts apart."""
    if isinstance(x, str):
        return x
    if isinstance(x, list):
        return ("" if all(isinstance(i, str) for i in x) else "\n\n").join(map(_texts, x))
    if isinstance(x, dict):
        return "\n\n".join(_texts(v) for k, v in x.items() if k not in ("cell_type", "metadata", "execution_count", "output_type", "name"))
    return ""


def _parsed(text: str, clean: str):
    try:
        return json.loads(text)
    except ValueError:
        return json.loads(clean)


def _without_data(block: str) -> str:
    """The block without embedded images and the like: long runs with digits."""
    return _DATA.sub(lambda m: " " if sum(map(m[0].count, "0123456789")) > 0.03 * len(m[0]) else m[0], block)


def blocks(text: str) -> list[str]:
    """Paragraphs of a page without cell markers; neighbours that are short and no sentences are one block."""
    if "{" in text[:100] and "cells" in text and (clean := text.translate(_ODD)).lstrip()[:1] == "{" and '"cells"' in clean:
        try:
            text = _texts(_parsed(text, clean)["cells"])
        except (ValueError, TypeError, KeyError, RecursionError):
            text = clean.replace("\\n", "\n")
    out, block, short = [], [], False
    for line in [*(_COLOURS.sub("", text) if "[" in text else text).splitlines(), ""]:
        line = line.strip()
        if line[:1] in _FIRST:
            line = "" if _MARKER.match(line) else _PREFIX.sub("", line, count=1) if line[:1] == "#" else line
        if line:
            block.append(line)
        elif block:
            whole = "\n".join(block)
            now = len(whole) < 100 and not whole[-1] in ".?!。？！"
            if now and short and len(out[-1]) < 2000:
                out[-1] += "\n" + whole
            else:
                out.append(whole)
            block, short = [], now
    return out


def tokens(block: str) -> tuple[list[str], int]:
    """Words, numbers, links, prices and labels, and the number of marks of code."""
    text = block.lower()
    if not any(map(text.__contains__, _SPECIAL)):
        found = (_ASCII if text.isascii() else _PLAIN).findall(text)
        marks = sum(map(text.count, "(){}="))
        return ([t for t in found if t not in "(){}="] if marks else found), marks
    out, marks = [], 0
    for t in _TOKEN.findall(text):
        first = t[0]
        if t.isalnum():
            out.append(t)
        elif "://" in t and first not in "\"'" and (first != "<" or t[1:3] == "a "):
            out.append(LINK)
        elif first in "<\"'":  # tags are no text, a quoted address is a value in code
            if t == "<li>":
                out.append(LABEL)
        elif first == "[" and len(t) > 1:
            out += (LABEL, t[1:-1])
        elif first in "()[]{}=":
            marks += 1
        elif first in "#@+":
            out.append(LABEL)
        elif first.isdigit():
            out.append(t)
        else:
            out.append(PRICE)
    return out, marks


def _is_prose(block: str) -> bool:
    return block[-1:] in ".?!。？！" and sum(map(block.count, "(){}[]=_<>'\"`$\\|*^%+")) < 0.05 * len(block)


def _language(c: str):
    return F.lower(F.btrim(F.coalesce(F.col(c), F.lit(""))))


def lexicon_of(pages: DataFrame) -> dict[str, dict[str, float]]:
    """Shares in the prose of each language of its function words and of links, prices and labels. Bounded, see FUNCTION_SHARE."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: dict[str, list[str]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for b in blocks(text or ""):
                    if _is_prose(b):
                        found.setdefault(lang, []).extend(tokens(b)[0])
            if sum(map(len, found.values())) > 2_000_000:
                yield from _counted(found, pa)
                found = {}
        yield from _counted(found, pa)

    counts = pages.select("lang", "text").mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    least = LANGUAGE_SHARE * (counts.agg(F.sum("n")).first()[0] or 0)
    kept = counts.withColumn("total", F.sum("n").over(Window.partitionBy("lang"))).where(F.col("total") >= least)
    rows = kept.where((F.col("n") >= FUNCTION_SHARE * F.col("total")) & ~F.col("word").rlike("^[0-9]") | F.col("word").isin(LINK, PRICE, LABEL)).collect()
    counts.unpersist()
    out: dict[str, dict[str, float]] = {}
    for r in rows:
        out.setdefault(r["lang"], {LINK: 0.5 / r["total"], PRICE: 0.5 / r["total"], LABEL: 0.5 / r["total"]})[r["word"]] = (r["n"] + 0.5) / r["total"]
    return out


def _counted(found: dict[str, list[str]], pa) -> Iterator:
    rows = [(lang, w, n) for lang, words in found.items() for w, n in Counter(words).items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])


class _Lexicon:
    """Function words of all languages by word."""

    def __init__(self, shares: dict[str, dict[str, float]]):
        self.shares = shares
        self.owners: dict[str, tuple[str, ...]] = {}
        for lang in sorted(shares):
            for w in shares[lang]:
                if w not in (LINK, PRICE, LABEL):
                    self.owners[w] = (*self.owners.get(w, ()), lang)

    def fit(self, count: Counter, n: int, lang: str) -> tuple[str, float]:
        """Language with the greatest share of function words, the page's own if none has any, and that share."""
        hits: dict[str, int] = {}
        for w in self.owners.keys() & count.keys():
            for owner in self.owners[w]:
                hits[owner] = hits.get(owner, 0) + count[w]
        if not hits:
            return lang, 0.0
        best = max(sorted(hits), key=hits.__getitem__)
        return best, hits[best] / n

    def entropy(self, count: Counter, n: int, lang: str) -> float:
        """Relative entropy of links, prices, labels and all else against the language's prose, in nats a token."""
        import math

        expected = self.shares.get(lang) or {}
        other, other_expected, total = 1.0, 1.0, 0.0
        for c in (LINK, PRICE, LABEL):
            q = expected.get(c, 1e-6)
            other_expected -= q
            if k := count.get(c, 0):
                other -= k / n
                total += k / n * math.log(k / n / q)
        return total + (other * math.log(other / other_expected) if other > 0 else 0.0)


def page_rows(text: str, lang: str, lexicon: _Lexicon) -> tuple[list[tuple], int]:
    """(block, lang, chars, tokens, known, marks, listed, prose, pooled, spectrum) of the blocks with enough tokens, and the characters of the others.

    The row of block -1 (`pooled`) has all text of the page that is no program, that of -2 all its prose.
    """
    rows, rest = [], 0
    pool: list[list[str]] = []
    prose_pool: list[list[str]] = []
    pool_chars = prose_chars = pool_marks = 0
    for i, b in enumerate(blocks(text)):
        whole = len(b)
        b = _without_data(b).strip()  # embedded images are neither prose nor spam
        rest += whole - len(b)
        chars = len(b)
        found, marks = tokens(b)
        n = len(found)
        count = Counter(found)
        marks += sum(k for t, k in count.items() if t[0] in "0123456789" or t[0].isdigit())
        share = marks / (n + marks) if n + marks else 0.0
        prose = _is_prose(b)
        if n and share < PROGRAM / 2 or prose:
            pool.append(found)
            pool_chars += chars
            pool_marks += marks
            if prose:
                prose_pool.append(found)
                prose_chars += chars
        special = LINK in count or PRICE in count or LABEL in count
        if n < LEAST_TOKENS and not special:
            rest += chars
            continue
        best, known = lexicon.fit(count, n, lang)
        listed = lexicon.entropy(count, n, best) if special else 0.0
        if n < LEAST_TOKENS and listed * n < LEAST_NATS:
            rest += chars
            continue
        rows.append((i, best, chars, n, known, share, listed, prose, False, Counter(count.values())))
    for at, lists, chars in ((-1, pool, pool_chars), (-2, prose_pool, prose_chars)):
        if len(lists) > 1:
            count = Counter(chain.from_iterable(lists))
            n = count.total()
            if n >= LEAST_TOKENS:
                best, known = lexicon.fit(count, n, lang)
                rows.append((at, best, chars, n, known, pool_marks / (n + pool_marks), 0.0, at == -2, True, Counter(count.values())))
    return rows, rest


_SCHEMA = "page bigint, block int, lang string, n_text bigint, n int, known double, marks double, listed double, prose boolean, pooled boolean, spectrum array<struct<f:int,k:int>>"


def block_rows(pages: DataFrame, shares: dict[str, dict[str, float]]) -> DataFrame:
    """A row per block with a curve or with links, prices or labels; lang is the language whose function words fit best.

    n_text are its characters, n its tokens, known the share of function words, marks that of numbers and marks of
    code, listed the relative entropy of links, prices and labels; the spectrum tells that k tokens occur f times
    each. Other blocks are counted together (block -3). A page that occurs again in a task is read once.
    """
    shared = pages.sparkSession.sparkContext.broadcast(shares)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        lexicon = _Lexicon(shared.value)
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_())
        names = ("page", "block", "lang", "n_text", "n", "known", "marks", "listed", "prose", "pooled")
        seen: set = set()
        for batch in batches:
            docs, rows, spectra = [], [], []
            for doc, page, lang, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (doc, page) in seen:
                    continue
                seen.add((doc, page))
                found, rest = page_rows(text or "", lang, lexicon)
                for *row, spectrum in found:
                    docs.append(doc)
                    rows.append((page, *row))
                    spectra.append(spectrum)
                if rest:
                    docs.append(doc)
                    rows.append((page, -3, None, rest, 0, 0.0, 0.0, 0.0, False, False))
                    spectra.append({})
            ends = np.cumsum([0, *map(len, spectra)], dtype="int32")
            levels = pa.StructArray.from_arrays([pa.array([x for s in spectra for x in part(s)], pa.int32()) for part in (dict.keys, dict.values)], ["f", "k"])
            arrays = [pa.array(docs, batch.schema.field(0).type), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), levels)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *names, "spectrum"])

    key = pages.schema["doc_id"].dataType.simpleString()
    return pages.select("doc_id", "page", "lang", "text").mapInArrow(run, f"doc_id {key}, {_SCHEMA}")


def fitted_curves(rows: DataFrame) -> DataFrame:
    """`rows` with d (different tokens), slope and residual of log frequency on log rank over all different tokens, and the
    shares c1, c2, c4 .. of the text that the most frequent 1, 2, 4 .. tokens cover.

    Tokens of equal frequency share the middle of their ranks. The slope is null where all tokens are equally frequent.
    Rows that occur again count once.
    """
    key = ["doc_id", "page", "block"]
    rest = [c for c in rows.columns if c not in (*key, "spectrum")]
    # partitioned by (page, block) once; the window and both aggregations keep that partitioning
    levels = rows.select(*key, *rest, "spectrum").repartition(*key).select(*key, *rest, F.inline("spectrum")).distinct()
    up_to = Window.partitionBy(*key).orderBy(F.col("f").desc()).rowsBetween(Window.unboundedPreceding, 0)
    levels = levels.withColumns({"upto": F.sum("k").over(up_to), "mass": F.sum(F.col("f") * F.col("k")).over(up_to)})
    levels = levels.withColumns({"x": F.log(F.col("upto") - (F.col("k") - 1) / 2), "y": F.log("f"), "before": F.col("upto") - F.col("k")})
    s = lambda e: F.sum(F.col("k") * e)
    x, y = F.col("x"), F.col("y")
    covered = lambda r: F.max(F.when(F.col("before") < r, F.least(F.col("mass"), F.col("mass") - F.col("f") * (F.col("upto") - r)))) / F.max("mass")
    moments = [F.sum("k").alias("d"), s(x).alias("sx"), s(y).alias("sy"), s(x * x).alias("sxx"), s(x * y).alias("sxy"), s(y * y).alias("syy")]
    sums = levels.groupBy(*key).agg(*[F.any_value(c).alias(c) for c in rest], *moments, *[covered(r).alias(f"c{r}") for r in RANKS])
    vx, vy, c = (F.col(a) / F.col("d") - F.col(b) * F.col(e) / F.col("d") / F.col("d") for a, b, e in (("sxx", "sx", "sx"), ("syy", "sy", "sy"), ("sxy", "sx", "sy")))
    slope = F.when(vx > 1e-9, F.try_divide(c, vx))
    return sums.select(*key, *rest, "d", slope.alias("slope"), F.sqrt(F.greatest(vy - F.coalesce(slope * c, F.lit(0.0)), F.lit(0.0))).alias("residual"), *[f"c{r}" for r in RANKS])


#: Measures of a curve with their least deviation.
_MEASURES = {"slope": 0.05, "residual": 0.03, **{f"c{r}": 0.03 for r in RANKS}}


def references(curves: DataFrame, languages: list[str]) -> tuple[list[tuple], float, float]:
    """Reference rows (lang, bin, then mean and deviation of each measure in prose, the same in code and output, mean share of function words), and the mean marks of prose and of code and output.

    Bins are doubling lengths, `languages` those of the lexicon, so there are at most 32 rows for each of these. A language's bin with fewer than 30 rows takes those of all languages, which stand
    under the language null as well; a bin still without enough takes the nearest. No rows if there is no prose.
    """
    program = ~F.col("prose") & ~F.col("pooled") & (F.col("marks") >= PROGRAM) & (F.col("listed") < LISTED)
    base = curves.where("n >= 12").withColumns({"bin": F.least(F.floor(F.log2("n")), F.lit(31)).cast("int"), "program": program}).where("prose or program")
    agg = [F.count(F.lit(1)).alias("rows"), F.avg("known").alias("known"), F.sum("marks").alias("marks")] + [g(c).alias(f"{g.__name__}_{c}") for c in _MEASURES for g in (F.avg, F.stddev_pop)]
    own = base.where(F.col("prose") & F.col("lang").isin(languages)).groupBy("lang", "bin").agg(*agg).collect()
    every = base.groupBy("program", "bin").agg(*agg).collect()
    prose, code = ({r["bin"]: r for r in every if r["program"] == p} for p in (False, True))
    if not prose:
        return [], 0.0, 1.0
    mean_marks = [sum(r["marks"] for r in of.values()) / max(1, sum(r["rows"] for r in of.values())) for of in (prose, code)]
    enough = lambda of: {b: r for b, r in of.items() if r["rows"] >= 30} or of
    prose, code, mine = enough(prose), enough(code) or prose, {(r["lang"], r["bin"]): r for r in own if r["rows"] >= 30}

    def values(r) -> list[float]:
        return [v for c, least in _MEASURES.items() for v in (r[f"avg_{c}"] or 0.0, max(r[f"stddev_pop_{c}"] or 0.0, least))]

    nearest = lambda of, b: of[min(of, key=lambda at: (abs(at - b), at))]
    out = []
    for lang in [None, *sorted({r["lang"] for r in own if r["lang"] is not None})]:
        for b in range(32):
            r = mine.get((lang, b)) or nearest(prose, b)
            out.append((lang, b, *values(r), *values(nearest(code, b)), float(r["known"])))
    return out, mean_marks[0], max(mean_marks[1], PROGRAM)


def judged(curves: DataFrame, languages: list[str]) -> DataFrame:
    """`curves` with `steep`, `loose` and `far` (deviations of slope, residual and divergence from the reference) and `spam`."""
    reference, plain, marked = references(curves, languages)
    names = [f"{kind}_{c}_{v}" for kind in ("p", "q") for c in _MEASURES for v in ("mean", "sd")]
    ref = F.broadcast(curves.sparkSession.createDataFrame(reference, "r_lang string, r_bin int, " + ", ".join(f"{c} double" for c in names) + ", p_known double"))
    known = sorted({r[0] for r in reference if r[0] is not None})
    rows = curves.withColumns({"l": F.when(F.col("lang").isin(known), F.col("lang")), "bin": F.least(F.floor(F.log2(F.greatest("n", F.lit(1)))), F.lit(31)).cast("int"), "w": F.least(F.greatest((F.col("marks") - plain) / (marked - plain), F.lit(0.0)), F.lit(1.0))})
    rows = rows.join(ref, rows["l"].eqNullSafe(ref["r_lang"]) & (rows["bin"] == ref["r_bin"]), "left")
    between = lambda c, v: (1 - F.col("w")) * F.col(f"p_{c}_{v}") + F.col("w") * F.col(f"q_{c}_{v}")
    off = lambda c: (F.col(c) - between(c, "mean")) / between(c, "sd")
    rows = rows.withColumns({"steep": F.abs(off("slope")), "loose": off("residual"), "far": F.greatest(*[off(f"c{r}") for r in RANKS])})
    extreme = F.coalesce(F.col("steep") > STEEP, F.lit(False)) | (F.col("loose") > LOOSE) | (F.col("far") > FAR)
    curve = (F.col("n") >= LEAST_TOKENS) & ((F.col("known") < FOREIGN * F.col("p_known")) & extreme | (F.col("far") > ALONE))
    listed = (F.col("listed") > LISTED) & (F.col("listed") * F.col("n") >= LEAST_NATS)
    return rows.select(*curves.columns, "steep", "loose", "far", (F.coalesce(curve, F.lit(False)) | listed).alias("spam"))


def spam_pages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """`doc_id`, `spam_share` (share of the text in spam blocks) and `spam` (more than MOST) of every page.

    Null, empty and blank texts have share 0. Null or wrong languages are replaced by the one whose function words
    fit. Rows of the same id with the same text are one page; with different texts the greatest share holds. Texts
    of any length are read whole; other columns are ignored; an empty table gives no rows. Where the corpus has no
    prose there is nothing to compare curves with, and only links, prices and labels count.
    """
    pages = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("page"), _language(lang).alias("lang"), F.col(text).alias("text"))
    lexicon = lexicon_of(pages)
    rows = block_rows(pages, lexicon).persist()
    curves = fitted_curves(rows.where("block > -3")).persist()
    each = judged(curves, sorted(lexicon)).select("doc_id", "page", "block", "n_text", "pooled", "prose", "spam")
    each = each.unionByName(rows.where("block = -3").distinct().select("doc_id", "page", "block", "n_text", "pooled", "prose", F.lit(False).alias("spam")))
    # the text outside programs is spam as a whole where its one curve is; prose alone only serves the reference
    sums = each.groupBy("doc_id", "page").agg(
        F.sum(F.when(~F.col("pooled"), F.col("n_text"))).alias("all"),
        F.sum(F.when(~F.col("pooled") & F.col("spam"), F.col("n_text")).otherwise(0)).alias("parts"),
        F.max(F.when(F.col("pooled") & ~F.col("prose") & F.col("spam"), F.col("n_text")).otherwise(0)).alias("whole"),
    )
    share = sums.groupBy("doc_id").agg(F.max(F.try_divide(F.greatest("parts", "whole").cast("double"), F.col("all"))).alias("share"))
    per = docs.select(F.col(doc_id).alias("doc_id")).distinct().join(share, "doc_id", "left")
    return per.select(F.col("doc_id").alias(doc_id), F.coalesce("share", F.lit(0.0)).alias("spam_share"), (F.coalesce("share", F.lit(0.0)) > MOST).alias("spam"))
