"""Pages made of keywords, links, product entries or tags instead of text.

Every text is cut into blocks: runs of lines that are written in sentences, and of lines that aren't. Every block, of
whatever kind, is measured by its compression ratio, taken twice: of the text as it stands, and of its words in sorted
order, which finds the few words of a list repeated in ever new order. The smaller of the two, each divided by what is usual
for running text of the same language and length in the whole corpus, is the block's redundancy. A block is flagged if it
is more redundant than running text is, by ``REDUNDANT``. The density of sentence ends confirms: it must be low. An end
counts only where a sentence was written, that is where the line has the particles without which a language doesn't form
sentences (articles, pronouns, prepositions, Japanese kana); keywords with full stops between them have none.

Code, logs, settings and tables are the most redundant blocks of all and have no sentences either. Only after both tests the
form of the lines vetoes them. A text is a case if more than half of its characters lie in blocks that remain.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.session import materialise

#: A block is redundant if its ratio is at most this part of the usual one.
REDUNDANT = 1.0
#: Characters for one sentence end above which a block isn't written in sentences.
PER_SENTENCE = 400
#: Blocks are measured in pieces of about this many characters.
PIECE = 4096
#: A run of characters without a blank that is longer is encoded data.
LONGEST_WORD = 100
#: The part of a line's words that are particles from which it counts as written, by script. Han: of the characters.
WRITTEN = {"latin": 0.19, "cyrillic": 0.05, "han": 0.1, "kana": 0.25, "other": 0.0}

# Particles of the languages, general knowledge.
_LATIN = frozenset(
    """a an the of to and in is are was were be been it its it's that that's this these those for on with as at by from or not no if
    then than so but when which what who how why will would can could should may has have had do does did don't isn't we you they
    he she i our your their there here only after before because while into over under each every all both just any some most
    der die das den dem des ein eine einen einem einer und oder nicht ist sind war wird werden wurde zu zum zur im mit von vom
    für auf an bei aus nach vor über unter wenn dass als wie auch noch nur kein keine wir sie er es ich man doch aber sich hat ob ohne durch gegen
    seit bis am beim dort hier bitte sehr mehr kann muss soll
    le la les un une du de et ou ne pas est sont était ont avec pour par sur dans en au aux ce cette ces que qui quand si plus
    mais son sa ses leur nous vous il elle se après avant l' d' n' s' qu' c' sans sous entre où très être dès cela tout
    el los las una unos del y o son fue está ha han con para lo se pero su sus cuando cada este esta esto ya nos según más muy sin sobre entre hasta desde
    donde hay ser qué sólo otra otras otro otros
    os as um uma dos da e ou não são foi em na nos nas ao seu sua quando quem só mais sem até onde há ser muito ainda já pela pelo""".split()
)
_CYRILLIC = frozenset(
    """и в во не на с со что это как так по к из у за от до при но или если то же бы мы вы он она они его её их я уже ещё
    только чтобы который которые для после можно нет да был была было были этот эта каждый каждая затем почему когда
    если без под над между туда раз где мне нас вам чем""".split()
)
_HAN = frozenset("的了是这那和有不会为什么们就也都而被把从再请已没他她它我你其如果以前后里所并对与及或但因此还要可能")

_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]|]+", re.I)
_MARKUP = re.compile(r"</?\w[^<>]*>")
_END = re.compile(r"[.!?…][\"'”’»)\]`*_]*(?=\s|$)|[。！？]")
_NUMBERED = re.compile(r"^\s*(?:\d+[.)]|[-*•+])\s+", re.M)
_NAME = re.compile(r"`[^`]*`|(?<![a-z0-9./\\_-])(?=[a-z0-9-]*+[/\\_.][a-z0-9])[a-z0-9./\\_-]++")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]*)?")
_CJK = re.compile("[぀-ヿ一-鿿]")
_HIRAGANA = re.compile("[぀-ゟ]")
_SCRIPTS = tuple(re.compile(x) for x in ("[\u3040-\u30ff]", "[\u4e00-\u9fff]", "[\u0400-\u052f]", "[a-zA-Z\u00c0-\u024f]"))
_RUBRIC = re.compile(r"#{1,6}\s|={3,}|-{3,}$")
_TECHNICAL = re.compile(
    r"""^\s*(?:import\s+[\w.{*]+|from\s+\S+\s+import|(?:async\s+)?def\s+\w+\s*\(|class\s+\w+[:({ ]*$|func\s|fn\s|return\b|export\s|(?:const|let|var)\s+\w|(?:if|for|while)\s.*[:{]$|select\s.*\sfrom\s|insert\s+into|file\s+"|traceback|at\s+\S+\(|\#include|//|/\*|[{}@$]\s?)
      |[{};]\s*$|==|:=|=>|\w\(\)|^\s*\|.*\|\s*$|^\W*\d{4}-\d\d-\d\d[t\s]\d\d|^\s*\S+\s+\|\s+\d+\s*[+-]*\s*$
      |^\s*[\w.\[\]"'-]+\s*[:+-]?=\s*\S|^[^\s,]+(?:,[\d.]+)+$|^[\w./-]+(?:,[\w./-]+)+$|^\w*(?:error|exception)\b:|^```|^data:\S""",
    re.I | re.X,
)
_BREAK = re.compile("[\r\n\u0085\u2028\u2029]+|<br\\s*/?>")
_CODE_MARKS = re.compile(r"[{}=<>;]|\(\w*\)")


def level(text: str) -> str:
    """Case, widths and invisible characters levelled, as they are varied to hide repetition."""
    return text.lower() if text.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower()


def script_of(text: str) -> str:
    """The script most letters are written in, as far as lengths in bytes and compression depend on it."""
    if text.isascii():
        return "latin"
    kana, han, cyrillic, latin = (len(x.findall(text)) for x in _SCRIPTS)
    other = sum(map(str.isalpha, text)) - kana - han - cyrillic - latin
    if kana * 5 > han + kana > latin / 2:
        return "kana"
    names = {"latin": latin, "cyrillic": cyrillic, "han": 2 * (han + kana), "other": other}
    return max(names, key=names.get)


def particles(line: str) -> tuple[float, str]:
    """The share of particles among the words of a levelled line, names and paths left out, and the script."""
    bare = _NAME.sub(" ", line)
    if not bare.isascii() and len(signs := _CJK.findall(bare)) * 4 > len(_WORD.findall(bare)) * 3:
        kana = len(_HIRAGANA.findall(bare))
        if kana * 8 > len(signs):
            return kana / len(signs), "kana"
        return (kana + sum(c in _HAN for c in signs)) / len(signs), "han"
    words = _WORD.findall(bare)
    if not words:
        return 0.0, "latin"
    cyrillic = not bare.isascii() and sum("\u0400" <= w < "\u0530" for w in words) * 2 > len(words)
    known = _CYRILLIC if cyrillic else _LATIN
    found = sum(map(known.__contains__, words))
    if "'" in bare or "\u2019" in bare:
        heads = [re.split("['\u2019]", w, maxsplit=1)[0] for w in words if w not in known and ("'" in w or "\u2019" in w)]
        found += sum(h in known or h + "'" in known for h in heads)
    return found / len(words), "cyrillic" if cyrillic else "latin"


def line_kind(line: str) -> tuple[str, int]:
    """Of a levelled line: list, text, technical or blank, and the number of ends of written sentences. Short lines with particles but without
    an end are text too, as texts may be wrapped."""
    bare = _NUMBERED.sub("", line).strip()
    if not bare:
        return "blank", 0
    links = _URL.findall(bare) if "://" in bare or "www." in bare else ()
    without = _URL.sub(" ", bare) if links else bare
    plain = _MARKUP.sub(" ", without) if "<" in without else without
    share, script = particles(plain)
    written = share >= WRITTEN[script]
    ends = len(_END.findall(plain)) if written else 0
    if links and sum(map(len, links)) >= 0.3 * len(bare):
        return ("text", ends) if ends and len(_WORD.findall(plain)) > 6 * len(links) else ("list", 0)
    if written and (ends * PER_SENTENCE > len(bare) or not ends and len(bare) < PER_SENTENCE):
        return "text", ends
    if _RUBRIC.match(bare):
        return "text", 0
    if _TECHNICAL.search(plain):
        return "technical", ends
    if len(bare) > LONGEST_WORD and bare.isascii() and max(map(len, re.split(r"[\s,;|#]+", bare))) > LONGEST_WORD:
        return "technical", ends
    return ("technical" if len(_CODE_MARKS.findall(plain)) * 12 > len(plain) else "list"), ends


def measure(text: str) -> tuple[str, int, float, float]:
    """Of a levelled block: script, class of length (log2 of bytes), compression ratio, ratio of its words in sorted order."""
    script, data = script_of(text), text.encode("utf-8", "replace")
    words = _CJK.findall(text) if script in ("han", "kana") else _WORD.findall(text)
    words.sort()
    bag = " ".join(words).encode("utf-8", "replace")
    return script, len(data).bit_length(), len(zlib.compress(data, 1)) / max(1, len(data)), len(zlib.compress(bag, 1)) / max(1, len(bag))


def pieces(line: str) -> Iterator[str]:
    """A long line in pieces, cut at blanks where there are any; the pieces have the kind of the whole line."""
    at = 0
    while len(line) - at > PIECE:
        cut = line.rfind(" ", at + PIECE // 2, at + PIECE) + 1 or at + PIECE
        yield line[at:cut]
        at = cut
    yield line[at:]


def blocks(text: str) -> Iterator[tuple[str, int, str]]:
    """Runs of levelled lines of one kind, in pieces, with their sentence ends; blank lines and line-break tags don't end a run."""
    kind, run, size, ends = "", [], 0, 0
    for line in _BREAK.split(level(text)):
        this, n = line_kind(line)
        if this == "blank":
            continue
        for part in pieces(line):
            if this != kind or size + len(part) > PIECE:
                if run:
                    yield kind, ends, "\n".join(run)
                kind, run, size, ends = this, [], 0, 0
            run.append(part)
            size += len(part)
            ends, n = ends + n, 0
    if run:
        yield kind, ends, "\n".join(run)


_BLOCKS = "doc_id bigint, lang string, kind string, ends bigint, chars bigint, script string, length int, ratio double, bag double"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.float64()]
    names = [f.split()[0] for f in _BLOCKS.split(", ")]
    for batch in batches:
        rows = []
        for doc_id, text, lang in zip(*(c.to_pylist() for c in batch.columns)):
            if text:
                rows += [(doc_id, lang, kind, ends, len(b), *measure(b)) for kind, ends, b in blocks(text)]
        columns = list(zip(*rows)) if rows else [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def measured_blocks(df: DataFrame) -> DataFrame:
    """The blocks of all texts of (doc_id, text, and lang if it is there) with their measures; all of them are compressed.
    ``lang`` counts as its lower case, and as '' where it isn't two letters."""
    lang = F.lower(F.trim("lang")) if "lang" in df.columns else F.lit("")
    known = F.when(lang.rlike("^[a-z]{2}$"), lang).otherwise(F.lit(""))
    return df.select("doc_id", "text", known.alias("lang")).mapInArrow(_measure, _BLOCKS)


def usual_ratios(measured: DataFrame, bins: int = 200, least: int = 20) -> DataFrame:
    """The median of both ratios over all blocks of running text, by script, language and class of length, from histograms:
    script, lang, length, usual, usual_bag. A language has a row of its own where its blocks are at least ``least``; the row
    of lang '' is of all blocks of the script. A language is two letters and a class of length one of 32, which bounds
    the rows."""
    text = measured.where(F.col("kind") == "text").where("lang is not null")
    each = F.explode(F.array(F.struct(F.lit("usual").alias("of"), F.col("ratio").alias("x")), F.struct(F.lit("usual_bag").alias("of"), F.col("bag").alias("x")))).alias("m")
    counts = text.select("script", "lang", "length", each).groupBy("script", "lang", "length", "m.of", F.floor(F.col("m.x") * bins).alias("bin")).agg(F.count("*").alias("n"))
    both = counts.where("lang <> ''").unionByName(counts.withColumn("lang", F.lit(""))).groupBy("script", "lang", "length", "of", "bin").agg(F.sum("n").alias("n"))
    of = W.partitionBy("script", "lang", "length", "of")
    below = F.sum("n").over(of.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    half = both.withColumns({"below": below, "total": F.sum("n").over(of)}).where((F.col("below") * 2 >= F.col("total")) & ((F.col("lang") == "") | (F.col("total") >= least)))
    middle = half.groupBy("script", "lang", "length", "of").agg((F.min("bin") / F.lit(float(bins)) + F.lit(0.5 / bins)).alias("x"))
    return middle.groupBy("script", "lang", "length").agg(*[F.max(F.when(F.col("of") == c, F.col("x"))).alias(c) for c in ("usual", "usual_bag")])


def _judged(measured: DataFrame) -> DataFrame:
    """Blocks with their redundancy: the smaller of their ratios over the usual ones, of the language where known, else of the
    script, else of Latin text, else 1."""
    usual = materialise(usual_ratios(measured))
    out = measured
    for i, (script, lang) in enumerate(((F.col("script"), F.col("lang")), (F.col("script"), F.lit("")), (F.lit("latin"), F.lit("")))):
        table = F.broadcast(usual.select(F.col("script").alias("_s"), F.col("lang").alias("_l"), F.col("length").alias("_n"), F.col("usual").alias(f"_u{i}"), F.col("usual_bag").alias(f"_b{i}")))
        out = out.join(table, (script == F.col("_s")) & (lang == F.col("_l")) & (F.col("length") == F.col("_n")), "left").drop("_s", "_l", "_n")
    over = lambda x, u: F.col(x) / F.coalesce(*[F.col(f"{u}{i}") for i in range(3)], F.lit(1.0))
    return out.withColumn("redundancy", F.least(over("ratio", "_u"), over("bag", "_b"))).drop(*[f"_{x}{i}" for x in "ub" for i in range(3)])


def _flagged() -> Column:
    # what doesn't shrink at all, such as a single word, isn't redundant whatever is usual for its length
    redundant = (F.col("redundancy") <= REDUNDANT) & (F.least("ratio", "bag") < 1)
    unwritten = F.col("ends") * PER_SENTENCE < F.col("chars")
    return redundant & unwritten & (F.col("kind") != "technical") & (F.col("kind") != "text")


def stuffed(df: DataFrame, share: float = 0.5) -> DataFrame:
    """doc_id and stuffing (the share of its characters in stuffed blocks) of each text with more than ``share`` of them.

    The usual ratio of a length that no running text has is 1. NULL, empty and blank texts are
    no cases; rows that repeat a doc_id count as one text; extra columns are ignored; an empty input gives no rows."""
    measured = materialise(measured_blocks(df))
    total = _judged(measured).groupBy("doc_id").agg(F.sum("chars").alias("chars"), F.sum(F.when(_flagged(), F.col("chars")).otherwise(F.lit(0))).alias("stuffed"))
    return total.where(F.col("stuffed") > F.col("chars") * share).select("doc_id", (F.col("stuffed") / F.col("chars")).alias("stuffing"))
