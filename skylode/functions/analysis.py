"""Text analysis as Column functions: tokenizers give array<struct<text, position, start, end>>, filters map them.

start and end are byte offsets in UTF-8. A pattern's matches and the pieces between them add up to where each token
starts, so all of it runs inside the JVM.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "struct<text:string,position:int,start:int,end:int>"
#: Index tokens of lower-cased text; for ASCII text, a letter or digit and then letters, digits and apostrophes.
INDEX_WORD = r"[\p{L}\p{N}][\p{L}\p{N}']*"
#: Words by the main rules of UAX #29: a mark joins two letters, or two digits, if it stands between them.
WORD = r"[\p{L}\p{N}\p{M}_]+(?:(?:(?<=[\p{L}\p{M}])['’.:·](?=\p{L})|(?<=\p{N})['’.,;](?=\p{N}))[\p{L}\p{N}\p{M}_]+)*"
HAS_WORD = r"[\p{L}\p{N}]"

# The English stop words.
ENGLISH_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "for", "had", "has", "have", "if", "in", "into", "is", "it", "no",
    "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "were", "will", "with",
)
# The Chinese stop words.
CHINESE_STOP_WORDS = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会",
    "着", "没有", "看", "好", "自己", "这", "或", "而", "但", "因", "为", "与", "及", "等", "之", "于", "以", "由", "从", "向", "对", "把",
    "他", "她", "它", "我们", "你们", "他们", "那", "哪", "谁", "什么", "怎么", "怎样", "时", "年", "月", "日", "时候", "这里", "那里", "里", "中",
    "下", "前", "后", "间", "个", "些", "每", "各", "某", "任", "就是", "只是", "所以", "因为", "虽然", "但是", "如果", "那么", "可以", "能够",
    "应该",
)


def index_terms(text: Column) -> Column:
    """array<string>: the terms under which a text is found; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(INDEX_WORD), F.lit(0))


def index_terms_strict(text: Column) -> Column:
    """As index_terms, but a text with any non-ASCII character is cut by the word rules, so 3.14 stays whole in it."""
    low = F.lower(text)
    words = F.filter(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), lambda w: F.regexp_like(w, F.lit(HAS_WORD)))
    return F.when(F.octet_length(text) == F.length(text), index_terms(text)).otherwise(words)


def by_pattern(text: Column, pattern: str) -> Column:
    """One token a match of pattern."""
    t = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(t, pattern, -1), 1, F.size(found))
    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast(f"array<{TOKEN}>").alias("out"))

    def step(acc, x):
        start = acc["at"] + F.octet_length(x["g"])
        end = start + F.octet_length(x["m"])
        token = F.struct(x["m"].alias("text"), acc["n"].alias("position"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), (acc["n"] + 1).alias("n"), F.concat(acc["out"], F.array(token)).cast(f"array<{TOKEN}>").alias("out"))

    return F.aggregate(F.arrays_zip(found.alias("m"), gaps.alias("g")), first, step, lambda acc: acc["out"])


def whitespace(text: Column) -> Column:
    return by_pattern(text, r"[^ \t\n\x0B\f\r]+")


def keyword(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    one = F.array(F.struct(t.alias("text"), F.lit(0).alias("position"), F.lit(0).alias("start"), F.octet_length(t).alias("end")))
    return F.when(t == "", F.array().cast(f"array<{TOKEN}>")).otherwise(one.cast(f"array<{TOKEN}>"))


def standard(text: Column) -> Column:
    """Words that hold a letter or digit, in their own case; positions count the words kept."""
    kept = F.filter(by_pattern(text, WORD), lambda t: F.regexp_like(t["text"], F.lit(HAS_WORD)))
    return F.transform(kept, lambda t, i: with_text(t, t["text"], i))


def fast(text: Column) -> Column:
    """array<string>: the words between white space, without positions."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


JIEBA_MODES = ("mp", "hmm", "mix", "full", "search")


def jieba(text: Column, mode: str = "mix") -> Column:
    """Chinese words by the jieba module, where it is installed; one Arrow batch at a time.

    mode: mp (dictionary words only), hmm and mix (with a model for unknown words; the same), full (all words that the
    text can hold, overlapping) or search (as mix, and the words within long words before them).
    """
    if mode not in JIEBA_MODES:
        raise ValueError(f"no such mode: {mode!r}")
    try:
        import jieba as _jieba
    except ImportError as e:
        raise NotImplementedError("the jieba module is not installed") from e
    import pandas as pd

    def placed(t: str):
        if mode != "full":
            yield from _jieba.tokenize(t, mode="search" if mode == "search" else "default", HMM=mode != "mp")
            return
        at = 0
        for w in _jieba.cut(t, cut_all=True):  # in the order of their starts
            at = max(t.find(w, at), at)
            yield w, at, at + len(w)

    @F.pandas_udf(f"array<{TOKEN}>")
    def words(texts: pd.Series) -> pd.Series:
        def one(t):
            t = t or ""
            return [{"text": w, "position": i, "start": len(t[:a].encode()), "end": len(t[:b].encode())} for i, (w, a, b) in enumerate(placed(t))]

        return texts.map(one)

    return words(text)


def with_text(token: Column, text: Column, position: Column | None = None) -> Column:
    return F.struct(text.alias("text"), (token["position"] if position is None else position).cast("int").alias("position"), token["start"].alias("start"), token["end"].alias("end"))


def lowercase(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: with_text(t, F.lower(t["text"])))


def stop(tokens: Column, words: Iterable[str] = ENGLISH_STOP_WORDS, case_sensitive: bool = False) -> Column:
    """Without the stop words; the others keep their positions, so gaps stay."""
    words = sorted({w if case_sensitive else w.lower() for w in words})
    if not words:
        return tokens
    return F.filter(tokens, lambda t: ~(t["text"] if case_sensitive else F.lower(t["text"])).isin(words))


@cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """Single characters for translate(), and those that become several, by Unicode's own decompositions."""
    single, several = {}, {"ß": "ss", "æ": "ae", "œ": "oe", "Æ": "AE", "Œ": "OE", "þ": "th", "Þ": "TH"}
    more = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ð": "d", "Ð": "D", "ı": "i", "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-"}
    for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1 and base.isascii():
            single[c] = base
    single |= more
    return "".join(single), "".join(single.values()), several


def fold(text: Column) -> Column:
    """Latin letters with marks become ASCII ones; combining marks go."""
    source, target, several = _folding()
    out = F.translate(text, source, target)
    for c, s in several.items():
        out = F.replace(out, F.lit(c), F.lit(s))
    return F.regexp_replace(out, r"\p{Mn}+", "")


def ascii_fold(tokens: Column, preserve_original: bool = False) -> Column:
    folded = lambda t: with_text(t, fold(t["text"]))
    if not preserve_original:
        return F.transform(tokens, folded)
    return F.flatten(F.transform(tokens, lambda t: F.when(fold(t["text"]) == t["text"], F.array(t)).otherwise(F.array(folded(t), with_text(t, t["text"])))))


def read_synonyms(lines: Iterable[str]) -> dict[str, list[str]]:
    """Lines 'word => a, b' or 'word, a, b'; empty ones and those that begin with # say nothing."""
    out: dict[str, list[str]] = {}
    for line in lines:
        line = line.rstrip("\n")
        if not line or line.startswith("#"):
            continue
        word, sign, rest = line.partition("=>") if "=>" in line else line.partition(",")
        names = [s.strip(" \t") for s in rest.split(",") if s.strip(" \t")]
        if sign and word.strip(" \t") and names:
            out[word.strip(" \t")] = names
    return out


def synonyms(tokens: Column, table: dict[str, list[str]], expand: bool = True) -> Column:
    """Words of the table become their synonyms (all, or the first); the second and later words of one move on."""
    table = {k.lower(): v for k, v in table.items() if v}
    if not table:
        return tokens
    words = {k: [(w, i) for s in (v if expand else v[:1]) for i, w in enumerate(s.split() if expand else [s])] for k, v in table.items()}
    known = F.create_map(*[x for k, v in words.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")) for w, i in v]))])

    def each(t):
        own = F.element_at(known, F.lower(t["text"]))
        return F.when(own.isNull(), F.array(with_text(t, t["text"]))).otherwise(F.transform(own, lambda s: with_text(t, s["w"], t["position"] + s["i"])))

    return F.flatten(F.transform(tokens, each))


ANALYZERS: dict[str, Callable[[Column], Column]] = {
    "whitespace": whitespace,
    "keyword": keyword,
    "simple": lambda c: lowercase(whitespace(c)),
    "standard": lambda c: stop(lowercase(standard(c))),
    "chinese": lambda c: stop(jieba(c), CHINESE_STOP_WORDS, case_sensitive=True),
    "english": lambda c: stop(ascii_fold(lowercase(standard(c)))),
    "multilingual": lambda c: ascii_fold(lowercase(standard(c))),
    "search": lambda c: stop(ascii_fold(lowercase(standard(c)))),
}


def analyze(df, column: str, analyzer: str | Callable[[Column], Column], into: str = "tokens"):
    """df with the tokens of a column."""
    return df.withColumn(into, (ANALYZERS[analyzer] if isinstance(analyzer, str) else analyzer)(F.col(column)))
